"""Random forests over sparse features.

A tree grows by levels. Each level is one pass over the rows, of which a node
reads only the words that it may ask for, and one aggregation by node, word and
value; MLlib holds each row as an array of all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window as W, functions as F

#: Values of a feature, from 0 to 1, are told apart in so many steps.
STEPS = 256
#: Rows that a task looks at together.
ROWS = 1 << 11
NODES = ("feature", "step", "low", "high", "zeros", "ones")
CELLS = "node int, feature int, step int, zeros long, ones long"


def _mix(x: np.ndarray) -> np.ndarray:
    """64 bits that look random, for each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _draws(keys: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often each row is in each tree's sample: Poisson of mean 1, by a hash of its key."""
    salt = _mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    part = _mix(keys.view(np.uint64)[:, None] ^ salt[None, :]) / 2.0**64
    return np.searchsorted(np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720)]), part, side="right")


class _Rows:
    """The features of some rows: sorted numbers row * width + feature, and the step of each."""

    def __init__(self, vectors: pa.StructArray, width: int):
        lists = vectors.field("indices")
        sizes = np.diff(lists.offsets.to_numpy())
        self.n, self.width = len(vectors), width
        self.row = np.repeat(np.arange(self.n, dtype=np.int64), sizes)
        self.feature = lists.flatten().to_numpy().astype(np.int64)
        self.at = self.row * width + self.feature
        self.step = np.clip(np.ceil(vectors.field("values").flatten().to_numpy() * STEPS), 0, STEPS).astype(np.int64)

    def reach(self, nodes: dict[str, np.ndarray], trees: int) -> np.ndarray:
        """The node of each row in each tree, by its place in ``nodes``; the first ``trees`` are the roots."""
        now = np.tile(np.arange(trees), (self.n, 1))
        go = np.argwhere(nodes["feature"][now] >= 0)
        while len(go):
            node = now[go[:, 0], go[:, 1]]
            want = go[:, 0] * self.width + nodes["feature"][node]
            i = np.minimum(np.searchsorted(self.at, want), max(len(self.at) - 1, 0))
            step = np.where(self.at[i] == want, self.step[i], 0) if len(self.at) else np.zeros(len(want), np.int64)
            node = np.where(step >= nodes["step"][node], nodes["high"][node], nodes["low"][node])
            now[go[:, 0], go[:, 1]] = node
            go = go[nodes["feature"][node] >= 0]
        return now


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


class RandomForest(Estimator):
    """Trees of Gini splits over samples with replacement. A node may ask for the square root of all features, by a hash of
    the node and the feature; ``_key`` tells rows apart. Features are from 0 to 1, labels 0 or 1."""

    def __init__(self, label: str, trees: int, min_leaf: int, depth: int, seed: int):
        super().__init__()
        self.label, self.trees, self.min_leaf, self.depth, self.seed = label, trees, min_leaf, depth, seed

    def _cells(self, rows: DataFrame, width: int, nodes: dict[str, np.ndarray], ids: np.ndarray, open_: np.ndarray) -> DataFrame:
        """Weights of label 0 and 1 by open node, feature that it may ask for, and step; feature -1 has all rows of a root."""
        trees, seed, first = self.trees, self.seed, len(nodes["feature"]) == self.trees and bool((nodes["zeros"] < 0).all())
        share = np.uint64(min(np.ceil(np.sqrt(width)) / width * 2.0**64, 2.0**64 - 2048))
        held = rows.sparkSession.sparkContext.broadcast((nodes, ids, open_))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nodes, ids, open_ = held.value
            for batch in _parts(batches):
                x = _Rows(batch.column("features"), width)
                y, draws = batch.column("label").to_numpy(), _draws(batch.column("_key").to_numpy(), trees, seed)
                now = x.reach(nodes, trees)
                asked = open_[now] & (draws > 0)
                out = []
                for tree in range(trees):
                    if first:
                        out.append(np.stack([np.full(x.n, tree), np.full(x.n, -1), np.zeros(x.n, np.int64), y, draws[:, tree]]))
                        continue
                    some = np.flatnonzero(asked[x.row, tree])
                    node = now[x.row[some], tree]
                    chosen = _mix(ids[node] ^ _mix(x.feature[some].astype(np.uint64) + np.uint64(seed << 32)))
                    some, node = some[chosen < share], node[chosen < share]
                    out.append(np.stack([node, x.feature[some], x.step[some], y[x.row[some]], draws[x.row[some], tree]]))
                node, feature, step, label, n = np.concatenate(out, axis=1)
                # one row for each node, feature and step of the part
                order = np.lexsort((step, feature, node))
                node, feature, step, label, n = (c[order] for c in (node, feature, step, label, n))
                new = np.flatnonzero(np.r_[True, (np.diff(node) != 0) | (np.diff(feature) != 0) | (np.diff(step) != 0)]) if len(node) else np.array([], np.int64)
                ones, all_ = (np.add.reduceat(c, new) if len(new) else np.array([], np.int64) for c in (n * label, n))
                told = [*(pa.array(c[new], pa.int32()) for c in (node, feature, step)), pa.array(all_ - ones, pa.int64()), pa.array(ones, pa.int64())]
                yield pa.RecordBatch.from_arrays(told, names=["node", "feature", "step", "zeros", "ones"])

        cells = rows.mapInArrow(look, CELLS)
        return cells.groupBy("node", "feature", "step").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))

    def _best(self, cells: DataFrame, nodes: dict[str, np.ndarray], open_: np.ndarray) -> list:
        """(node, feature, step, and the weights that have at least this step) of the best split of each node that has one."""
        at = np.flatnonzero(open_)
        whole = cells.sparkSession.createDataFrame(pa.table({"node": at.astype(np.int32), "z": nodes["zeros"][at], "o": nodes["ones"][at]}))
        up = W.partitionBy("node", "feature").orderBy(F.desc("step"))  # STEPS rows at most
        rows = cells.where("step > 0").select("node", "feature", "step", F.sum("zeros").over(up).alias("hz"), F.sum("ones").over(up).alias("ho"))
        rows = rows.join(F.broadcast(whole), "node").withColumns({"lz": F.col("z") - F.col("hz"), "lo": F.col("o") - F.col("ho")})
        rows = rows.where((F.col("hz") + F.col("ho") >= self.min_leaf) & (F.col("lz") + F.col("lo") >= self.min_leaf))
        pure = lambda z, o: (F.col(z).cast("double") * F.col(z) + F.col(o).cast("double") * F.col(o)) / (F.col(z) + F.col(o))
        gain = pure("lz", "lo") + pure("hz", "ho") - pure("z", "o")
        rows = rows.withColumn("gain", gain).where(F.col("gain") > 1e-9)
        best = rows.groupBy("node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), "step", "hz", "ho")).alias("b"))
        return sorted((r.node, -r.b.f, r.b.step, r.b.hz, r.b.ho) for r in best.collect())  # a row for each node of the level

    def _fit(self, dataset: DataFrame) -> ForestModel:
        one = dataset.select("features").first()
        width = one.features.size if one else 1
        rows = dataset.select("features", F.col(self.label).cast("long").alias("label"), "_key")
        n = self.trees
        nodes = {c: np.full(n, -1, np.int64) for c in NODES}
        ids, open_, depth = _mix(np.arange(1, n + 1, dtype=np.uint64)), np.ones(n, bool), 0
        found = {r.node: r for r in self._cells(rows, width, nodes, ids, open_).collect()}  # a row for each tree
        nodes["zeros"], nodes["ones"] = (np.array([found[t][c] if t in found else 0 for t in range(n)], np.int64) for c in ("zeros", "ones"))
        open_ = (nodes["zeros"] > 0) & (nodes["ones"] > 0)
        while depth < self.depth and open_.any():
            best = self._best(self._cells(rows, width, nodes, ids, open_), nodes, open_)
            depth, size = depth + 1, len(ids)
            if not best:
                break
            node, feature, step, hz, ho = np.array(best, np.int64).T
            nodes["feature"][node], nodes["step"][node] = feature, step
            nodes["low"][node], nodes["high"][node] = size + 2 * np.arange(len(node)), size + 2 * np.arange(len(node)) + 1
            new = {c: np.full(2 * len(node), -1, np.int64) for c in NODES}
            new["zeros"][::2], new["zeros"][1::2] = nodes["zeros"][node] - hz, hz
            new["ones"][::2], new["ones"][1::2] = nodes["ones"][node] - ho, ho
            nodes = {c: np.concatenate([nodes[c], new[c]]) for c in NODES}
            ids = np.concatenate([ids, _mix(np.repeat(ids[node], 2) * np.uint64(2) + np.tile(np.arange(2, dtype=np.uint64), len(node)) + np.uint64(1))])
            large = nodes["zeros"] + nodes["ones"] >= 2 * self.min_leaf
            open_ = (np.arange(len(ids)) >= size) & (nodes["zeros"] > 0) & (nodes["ones"] > 0) & large
        return ForestModel(n, width, nodes)


class ForestModel(Model, DefaultParamsWritable, DefaultParamsReadable):
    """The trees as lists of their nodes; the first ones are the roots, and a node without a split has the feature -1."""

    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "number of features", TypeConverters.toInt)
    nodes = Param(Params._dummy(), "nodes", "for each property of nodes, its values", TypeConverters.identity)

    def __init__(self, trees: int = 0, width: int = 1, nodes: dict[str, np.ndarray] | None = None):
        super().__init__()
        self._set(trees=trees, width=width, nodes={c: v.tolist() for c, v in (nodes or {}).items()})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, width = self.getOrDefault(self.trees), self.getOrDefault(self.width)
        nodes = {c: np.array(v, np.int64) for c, v in self.getOrDefault(self.nodes).items()}
        held = dataset.sparkSession.sparkContext.broadcast(nodes)

        def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            nodes = held.value
            chance = nodes["ones"] / np.maximum(nodes["zeros"] + nodes["ones"], 1)
            for vectors in batches:
                each = [_Rows(vectors.slice(i, ROWS), width).reach(nodes, trees) for i in range(0, len(vectors), ROWS)]
                yield pa.array(np.concatenate([(chance[x].sum(1) > trees / 2).astype(float) for x in each]) if each else [], pa.float64())

        return dataset.withColumn("prediction", F.arrow_udf(told, "double")("features"))
