"""A Merkle manifest of a table: a digest of every row, one root, and a proof for each row.

Leaves are ordered by group and id. Blocks of ``FAN ** LEVELS`` consecutive
nodes are reduced by tasks, again and again until at most ``TOP`` nodes are
left. The driver builds the tree above those and broadcasts, for each of them,
the siblings on its way to the root. Tasks then go down: the blocks below
complete the ways of their nodes, and those of the leaves fold every row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .ordering import numbered
from .shared import written

FAN = 8
#: Levels that a task reduces at once; a block has at most FAN ** LEVELS nodes.
LEVELS = 4
#: Nodes from which the driver builds the rest of the tree; the broadcast has a way of some 2 KB for each.
TOP = 4096
#: The sequence of subroots. Keys of groups are empty or start with a space.
ROOT = "root"

#: One step of a way to the root: the texts before and after the node in its run.
Steps = list[tuple[str, str]]


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, ``-`` if null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def climb(nodes: Sequence[str], levels: int | None = None) -> tuple[list[list[tuple[str, str]]], list[str]]:
    """Steps by level and place, and the nodes above ``levels`` levels, or the one that is left above all."""
    steps = []
    while len(nodes) > 1 if levels is None else len(steps) < levels:
        runs = [nodes[i : i + FAN] for i in range(0, len(nodes), FAN)]
        steps.append([("".join(run[:i]), "".join(run[i + 1 :])) for run in runs for i in range(len(run))])
        nodes = [digest(*run) for run in runs]
    return steps, list(nodes)


def way(steps: list[list[tuple[str, str]]], i: int) -> Steps:
    return [level[i // FAN**k] for k, level in enumerate(steps)]


def fold(node: str, steps: Steps) -> str:
    for before, after in steps:
        node = digest(before, node, after)
    return node


def _block_steps(block: pd.DataFrame, levels: int) -> tuple[list[list[tuple[str, str]]], list[str]]:
    """A block of a longer sequence goes up by all its levels, a whole sequence until one node is left."""
    return climb(block["digest"].tolist(), levels if block["total"].iloc[0] > FAN**levels else None)


NODES = "key string, pos long, digest string, up string, at long, total long"


def _reduced(nodes: DataFrame, levels: int) -> DataFrame:
    """One node for each block, as the next sequence."""
    size = FAN**levels

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at")
        _, (node,) = _block_steps(block, levels)
        at = int(block["at"].iloc[0]) // size
        return pd.DataFrame({"key": block["up"].iloc[:1], "pos": at, "digest": node, "up": block["up"].iloc[:1], "at": at, "total": -(-int(block["total"].iloc[0]) // size)})

    return nodes.groupBy("up", F.expr(f"at div {size}").alias("block")).applyInPandas(run, NODES)


def _top(nodes: Sequence) -> tuple[str, dict[tuple[str, int], tuple[str, Steps]]]:
    """The root, and for each node its subroot and its way."""
    ways, subroots = {}, {}
    for row in sorted(nodes, key=lambda r: (r.up.encode(), r.at)):
        subroots.setdefault(row.up, []).append(row)
    below = {}
    for up, rows in subroots.items():
        steps, (node,) = climb([r.digest for r in rows])
        below[up] = node
        for i, row in enumerate(rows):
            ways[row.key, row.pos] = (node, way(steps, i))
    if list(below) == [ROOT]:
        return below[ROOT], ways
    steps, (root,) = climb(list(below.values()))
    above = {up: way(steps, i) for i, up in enumerate(below)}
    return root, {(key, pos): (subroot, [*steps, *above[key]]) for (key, pos), (subroot, steps) in ways.items()}


WAYS = "key string, pos long, subroot string, before array<string>, after array<string>"


def _ways(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """The way of each node, from the ways of the blocks above."""
    size = FAN**levels

    def run(block: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at").reset_index(drop=True)
        steps, _ = _block_steps(block, levels)
        over = upper.iloc[0]
        rest = list(zip(over["before"], over["after"], strict=True))
        found = []
        for i, (key, pos, node, up) in enumerate(zip(block["key"], block["pos"], block["digest"], block["up"], strict=True)):
            whole = [*way(steps, i), *rest]
            found.append((key, pos, node if up == ROOT and key != ROOT else over["subroot"], [b for b, _ in whole], [a for _, a in whole]))
        return pd.DataFrame(found, columns=["key", "pos", "subroot", "before", "after"])

    return nodes.groupBy("up", F.expr(f"at div {size}")).cogroup(above.groupBy("key", "pos")).applyInPandas(run, WAYS)


RESULT = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _folded(block: pd.DataFrame, subroot: str, rest: Steps, root: str, levels: int) -> pd.DataFrame:
    block = block.sort_values("at").reset_index(drop=True)
    steps, _ = _block_steps(block, levels)
    end = "".join(before + after for before, after in rest)
    found = []
    for i, (id, node, other) in enumerate(zip(block["key"], block["digest"], block["other"], strict=True)):
        own = way(steps, i)
        folded = fold(node if other is None else other, [*own, *rest])
        found.append((id, node, subroot, root, digest(*(before + after for before, after in own), end), folded, folded == root))
    return pd.DataFrame(found, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(docs: DataFrame, *, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id: str = "doc_id", group: str = "lang", text: str = "text", tampered: Column | None = None, levels: int = LEVELS, top: int = TOP) -> DataFrame:
    """For each row its id, leaf, the subroot of its group, the root, the digest of its proof, and the root that its fold gives.

    ``tampered`` tells the rows that are folded with the A-Z of their text in
    lower case; by default none is. ``verified`` says whether the fold gives the
    root. Fields may be null and texts of any length or empty: each has its byte
    length in the leaf. Null ids come first, rows of one id in the order of their
    leaves; equal rows get neighbouring places, and a row each in the result. A
    null group is a group of its own, before the others. An empty table has no
    rows and no root. Other columns, whatever their names, have no part in it.
    """
    types = dict(docs.dtypes)
    key = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit(" "), F.col(group).cast("string")))
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = F.when(tampered, leaf(lowered if c == text else F.col(c) for c in fields)) if tampered is not None else F.lit(None).cast("string")
    rows = written(docs.select(F.col(id).alias("id"), key.alias("up"), leaf(F.col(c) for c in fields).alias("digest"), other.alias("other")), "leaves")
    leaves = written(numbered(rows, "up", ["id", "digest"], "at"), "placed")

    tables = [leaves]
    nodes = written(_reduced(leaves, levels), "nodes")
    while (n := nodes.count()) > top:
        if nodes.where("total > 1").isEmpty() and nodes.where(F.col("up") != ROOT).limit(1).count():  # one node of each of many groups: go on with these in order
            nodes = written(numbered(nodes.drop("at", "total").withColumn("up", F.lit(ROOT)), "up", ["key"], "at").select(*nodes.columns), "nodes")
        tables.append(nodes)
        nodes = written(_reduced(nodes, levels), "nodes")
    root, ways = _top(nodes.collect()) if n else ("", {})  # ``top`` rows at most
    told = docs.sparkSession.sparkContext.broadcast(ways)

    size = FAN**levels
    upper = None
    for nodes in reversed(tables[1:]):
        if upper is None:
            upper = docs.sparkSession.createDataFrame([(k, p, s, [b for b, _ in w], [a for _, a in w]) for (k, p), (s, w) in ways.items()], WAYS)
        upper = written(_ways(nodes, upper, levels), "ways")

    blocks = leaves.select(F.col("id").cast("string").alias("key"), "up", "digest", "other", "at", "total").groupBy("up", F.expr(f"at div {size}").alias("block"))
    if upper is None:

        def finish(block: pd.DataFrame) -> pd.DataFrame:
            return _folded(block, *told.value[block["up"].iloc[0], int(block["at"].iloc[0]) // size], root, levels)

        found = blocks.applyInPandas(finish, RESULT)
    else:

        def join(block: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
            over = over.iloc[0]
            return _folded(block, over["subroot"], list(zip(over["before"], over["after"], strict=True)), root, levels)

        found = blocks.cogroup(upper.groupBy("key", "pos")).applyInPandas(join, RESULT)
    return found.select(F.col("id").cast(types[id]).alias(id), *(c for c in found.columns if c != "id"))
