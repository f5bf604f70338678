"""Source audit, manifest and mix against plain versions, and on awkward tables."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossaloom.llm import source_audit
from glossaloom.llm.manifest import manifest
from glossaloom.llm.mixing import mix, n_words, shard_texts, split, taken, write_shards
from glossaloom.llm.source_audit import audit

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_audit(rows, top=200):
    """{(lang, source, part, item): (value, rank)}"""
    docs = [(r[2] or "", r[3] or "", Counter(TERM.findall((r[1] or "").translate(LOWER)))) for r in rows]
    out = {}
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in d[2])
        kept = sorted(t for t in held if held[t] >= 3)
        count = defaultdict(Counter)
        for _, source, terms in own:
            count[source].update(terms)
            count[source].update({})
        whole = sum((count[s] for s in count), Counter())
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: share(count[s]) for s in count}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in count if o != s))
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] > 0 and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out |= {(lang, s, part, item.decode()): (-v, i + 1) for i, (v, item) in enumerate(found)}
    return out


def audited(df, **options):
    return {(r.lang, r.source, r.part, r.item): (r.value, r["rank"]) for r in audit(df, **options).collect()}


@pytest.fixture(scope="module")
def prose():
    draw = random.Random(4)
    words = [f"{a}{b}" for a in "abcdeäß字" for b in "klmnopqrstuvwxyz"]
    rows = []
    for i in range(150):
        lang, source = draw.choice(["en", "de", None]), draw.choice(["a", "b", "c", "ä", "", None, "z9"])
        body = " ".join(draw.choice(words[: draw.choice([5, 20, len(words)])]).title() + draw.choice(["", ".", "7x", "_"]) for _ in range(draw.randrange(60)))
        rows.append((i, body, lang, source, len(body)))
    return rows + rows[:9] + [(None, None, "fr", "x", None), (1, "", "fr", "y", 0), (2, "one two", "fr", "y", 7)]


def test_audit_against_plain(spark, prose, monkeypatch):
    df = spark.createDataFrame(prose, SCHEMA).withColumn("term", F.lit("x")).withColumn("P", F.lit(1)).repartition(5)
    expected = plain_audit(prose)
    assert audited(df) == expected
    monkeypatch.setattr(source_audit, "PAIRS", 50)
    monkeypatch.setattr(source_audit, "HELD", 1)
    assert audited(df, top=7, block=2) == plain_audit(prose, 7)


def test_audit_looks_at_few_terms(spark, monkeypatch):
    """Terms in buckets that can't reach the last rank are never evaluated."""
    rare = [(i, " ".join(f"w{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300)), "en", f"s{i % 2}", 0) for i in range(60)]
    often = [(100 + i, "strong signal words " * 50, "en", "s0", 0) for i in range(5)]
    df = spark.createDataFrame(rare + often, SCHEMA)
    written = {}
    monkeypatch.setattr(source_audit, "written", lambda d, name, f=source_audit.written: written.setdefault(name, f(d, name)))
    found = audited(df, top=3)
    assert found == plain_audit(rare + often, 3)
    buckets, kth = written["buckets"], {(r.lang, r.source): r.value for r in written["best"].where("rank = 3").collect()}
    left = [b.m for b in buckets.collect() if b.before >= 3 and b.bound < kth[b.lang, b.source]]
    assert sum(left) > 1000


def test_audit_of_long_texts_and_empty_tables(spark):
    rows = [(i, "Abc " * 300_000 + f"only{chr(97 + i)}", "en", s, 0) for i, s in enumerate("aab")]
    assert audited(spark.createDataFrame(rows, SCHEMA)) == plain_audit(rows)
    assert audited(spark.createDataFrame([], SCHEMA)) == {}


def plain_manifest(rows):
    """[(doc_id, leaf, subroot, root, proof digest, folded root)]"""
    h = lambda *parts: sha256("".join(parts).encode()).hexdigest()
    leaf = lambda r: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1])))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))

    def tree(nodes):
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, k in enumerate(at):
                run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
                paths[i].append((run[: k % 8], run[k % 8 + 1 :]))
            nodes, at = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)], [k // 8 for k in at]
        return nodes[0], paths

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    below = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, above = tree([below[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for (_, _, node, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), below[g][1], strict=True):
            path = path + above[k]
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            cur = leaf((r[0], r[1] and r[1].translate(LOWER), *r[2:])) if changed else node
            for before, after in path:
                cur = h(*before, cur, *after)
            out.append((r[0], node, below[g][0], root, h(*(x for before, after in path for x in before + after)), cur, cur == root))
    return sorted(map(repr, out))


def manifested(df, **options):
    found = manifest(df, tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, **options)
    return sorted(map(repr, map(tuple, found.collect())))


def test_manifest_against_plain(spark):
    draw = random.Random(6)
    rows = [(i, draw.choice(["Text ÄÖ", "", None, "a\nB", "x" * 500]), draw.choice(["en", "en", "de", None, ""]), draw.choice([None, "s"]), draw.choice([None, 3])) for i in draw.sample(range(-50, 10**6), 700)]
    rows += rows[:5] + [(None, "T", "en", "s", 1), (None, "Q", "en", "s", 1), (3, "lone", "zz", None, 4)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("leaf", F.lit("x")).withColumn("AT", F.lit(1)).repartition(7)
    expected = plain_manifest(rows)
    assert manifested(df) == expected
    assert manifested(df, levels=1, top=9) == expected  # several levels of blocks
    assert any("False" in x for x in expected) and any("True" in x for x in expected)


def test_manifest_of_more_groups_than_the_driver_takes(spark):
    rows = [(i, f"Text {i}", f"l{i % 90}" if i % 91 else None, "s", 6) for i in range(300)] + [(i, "T", "big", "s", 1) for i in range(1000, 1100)]
    assert manifested(spark.createDataFrame(rows, SCHEMA), levels=1, top=5) == plain_manifest(rows)


def test_manifest_of_small_tables(spark):
    one = [(1, "A", "en", "s", 1)]
    assert manifested(spark.createDataFrame(one, SCHEMA)) == plain_manifest(one)
    assert manifested(spark.createDataFrame([], SCHEMA)) == []
    long = [(i, "Ab" * 1_000_000, "en", "s", 1) for i in range(3)]
    assert manifested(spark.createDataFrame(long, SCHEMA)) == plain_manifest(long)


WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_targets(size):
    """Targets by source: shares by weight, filled up to twice the size one after the other."""
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, full = Fraction(3, 2) * sum(size.values()), set()
    while True:
        rest = total - sum(2 * size[s] for s in full)
        open_ = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * size[s]}
        if not above:
            return {s: 2 * size[s] if s in full else share[s] for s in order}
        full |= above


def mixed_rows(n=400, sources="aaaaaabcdeé"):
    draw = random.Random(8)
    rows = [(i, " ".join(["wörd"] * draw.choice([0, 1, 30, 400])) + draw.choice(["", "\n", " \t"]), "en", draw.choice([*sources, None]), 0) for i in range(n)]
    return rows + rows[:6] + [(None, None, "en", "a", 0), (None, " x ", "en", None, 0), (5, "y" * 10, "en", "tiny", 0), (6, "", "en", "nothing", 0)]


def test_mix_reaches_its_targets(spark):
    rows = mixed_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit("x")).withColumn("Place", F.lit(1))
    options = {"block_words": 64, "shard_words": 3000, "part": 16}
    found = taken(df, **options).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    expected = plain_targets(size)
    assert Counter((r.doc_id, r["size"], r.source_size) for r in found) == Counter((r[0], len(WORD.findall(r[1] or "")), size[r[3]]) for r in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in found)
    by_target = {(size[s], round(float(t), 6)): s for s, t in expected.items()}
    took = Counter()
    for r in found:
        took[by_target[r.source_size, round(r.target, 6)]] += r.taken
    for s, t in expected.items():
        assert abs(took[s] - t) <= 64 + size[s] / 100, (s, took[s], t)
    assert sum(took.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.02)
    again = taken(df.repartition(9), **options).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_mix_gives_each_shard_blocks_of_its_own(spark):
    rows = mixed_rows(200)
    df = spark.createDataFrame(rows, SCHEMA)
    options = {"block_words": 16, "shard_words": 500}
    made = mix(df, **options)
    pieces = made.pieces.toPandas()
    assert pieces["shard"].nunique() > 20
    assert not pieces.duplicated(["place", "j", "start", "from_word"]).any()
    draws = pieces.groupby(["place", "j"])["shard"].nunique()
    assert (draws == 1).all()
    block = pieces.groupby(["place", "nth"])["j"].nunique()
    assert block.max() == 2  # once in each pass at most
    by_shard = pieces[["shard", "place", "j"]].drop_duplicates().groupby("shard").size()
    assert by_shard.max() - by_shard.min() <= 1
    assert pieces.sort_values(["shard", "order"])["place"].diff().abs().gt(0).sum() > len(pieces) / 5  # sources lie mixed
    texts = shard_texts(df, **options).toPandas()
    told = {(r[0], r[1]): WORD.findall(r[1] or "") for r in rows}
    assert len(texts) == len(pieces)
    assert texts["text"].str.split(" ").str.len().sum() == (pieces["to_word"] - pieces["from_word"]).sum()
    assert {w for t in texts["text"] for w in t.split(" ")} <= {w for x in told.values() for w in x}


def test_shards_as_files(spark, tmp_path):
    df = spark.createDataFrame(mixed_rows(60), SCHEMA)
    options = {"block_words": 16, "shard_words": 800}
    write_shards(df, f"{tmp_path}/mix", **options)
    folders = sorted((tmp_path / "mix").glob("shard=*"))
    expected = shard_texts(df, **options).toPandas()
    assert len(folders) == expected["shard"].nunique() > 3
    for folder in folders:
        own = pd.concat([pd.read_parquet(f) for f in sorted(folder.glob("*.parquet"))])
        assert own["order"].is_monotonic_increasing and len(list(folder.glob("*.parquet"))) == 1
        assert sorted(own["text"]) == sorted(expected[expected["shard"] == int(folder.name[6:])]["text"])


def test_splitting_tree():
    quotas = np.array([1000, 0, 7, 300, 1])
    parts = split(quotas, 11, 0, 5, 99)
    assert [first for first, _, _ in parts] == list(range(11)) and all(n == 1 for _, n, _ in parts)
    assert (sum(q for _, _, q in parts) == quotas).all()
    assert max(q.sum() for _, _, q in parts) - min(q.sum() for _, _, q in parts) <= 1
    shares = np.array([split(quotas, 2, 0, seed, 1)[0][2][3] for seed in range(300)])
    assert abs(shares.mean() - 150) < 3 and 6 < shares.std() < 11  # hypergeometric: 7.6


def test_mix_of_empty_tables(spark):
    assert taken(spark.createDataFrame([], SCHEMA)).collect() == []
    found = taken(spark.createDataFrame([(1, None, "en", None, 0), (2, " ", "en", "a", 0)], SCHEMA)).collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    long = [(1, "w " * 500_000, "en", "a", 0), (2, "v " * 10, "en", "b", 0)]
    assert {r.doc_id: r.taken for r in taken(spark.createDataFrame(long, SCHEMA)).collect()}[2] == 20


def test_words(spark):
    texts = ["", " ", "a", " a", "a ", "\ta\x0b b\n", "a\xa0b", None, "  ", "x" * 10]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(n_words(F.col("t"))).collect()
    assert [r[0] for r in found] == [len(WORD.findall(t or "")) for t in texts]
