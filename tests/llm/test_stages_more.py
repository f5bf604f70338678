"""Signature trees and sieves by themselves."""

import random

import numpy as np
from pyspark.sql import functions as F

from glossaloom.llm import decontaminate, ngram_join
from glossaloom.llm.ngram_join import bitmap, connected, folded, promising, width_for
from glossaloom.llm.shared import sieved
from glossaloom.llm.substring_dedup import FmIndex, WaveletMatrix
from tests.llm import plain


def random_sets(seed):
    draw = np.random.default_rng(seed)
    base = [draw.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 7, 60, 300)]
    sets = []
    for b in base:
        for _ in range(12):
            own = b.copy()
            for k in draw.integers(0, len(b), draw.integers(0, 1 + len(b) // 12)):
                own[k] = draw.integers(0, 2**63, dtype=np.uint64)
            sets.append(np.unique(own))
    sets += [np.unique(draw.integers(0, 2**63, n, dtype=np.uint64)) for n in draw.integers(1, 200, 30)]
    return sorted(sets, key=len)


def test_signature_tree():
    for seed in range(4):
        sets = random_sets(seed)
        link = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
        plain = [set(s.tolist()) for s in sets]
        label = list(range(len(sets)))
        some = np.zeros(len(sets), bool)
        for i in range(len(sets)):
            for j in range(i):
                if link(plain[i], plain[j]):
                    some[i] = some[j] = True
                    old, new = label[i], label[j]
                    label = [new if x == old else x for x in label]
        found = connected(sets, 85)
        assert [[a == b for b in label] for a in label] == (found[:, None] == found[None, :]).tolist()
        told = promising(np.array([len(s) for s in sets]), [bitmap(s, width_for(len(s))).tobytes() for s in sets], 85)
        assert (told >= some).all() and told.sum() < len(sets)


def test_folding():
    own = np.random.default_rng(1).integers(0, 2**63, 300, dtype=np.uint64)
    assert (folded(bitmap(own, 1024), 4) == bitmap(own, 256)).all()


def test_wavelet_and_index():
    draw = np.random.default_rng(5)
    text = np.concatenate([np.append(draw.integers(1, 5, 50), 0) for _ in range(20)]).astype(np.int64)
    wavelet = WaveletMatrix(text, 4)
    for end in (0, 1, 63, 64, 65, 500, len(text)):
        for c in range(5):
            assert wavelet.rank(np.array([c]), np.array([end]))[0] == (text[:end] == c).sum()
    for size in (2, 5, 13):
        starts = np.array([i for i in range(len(text) - size) if 0 not in text[i : i + size]])
        windows = [tuple(text[i : i + size]) for i in starts]
        which, lo, hi = FmIndex(text, 4, size).intervals(text, starts, size)
        expected = {i: windows.count(w) for i, w in enumerate(windows) if windows.count(w) > 1}
        assert dict(zip(which.tolist(), (hi - lo).tolist(), strict=True)) == expected


def test_sieve(spark):
    ids = random.Random(1).sample(range(10_000), 500)
    rows = spark.range(10_000).withColumn("_x", F.lit(1)).union(spark.createDataFrame([(None, 1)], "id long, _x int"))
    wanted = spark.createDataFrame([(i,) for i in ids] + [(None,)], "w long")
    some, others = sieved(rows, "id", wanted, "w")
    held = {r.id for r in some.collect()}
    assert set(ids) <= held and len(held) < 600
    assert some.columns == rows.columns and some.count() + others.count() == 10_001


def test_orders_of_shingles_that_tell_little(spark, monkeypatch):
    """With tiny tables of counts, and hardly any shingle that is light, links and hits are the same."""
    draw = random.Random(12)
    base = [f"w{draw.randrange(60)}" for _ in range(400)]
    rows = []
    for i in range(120):
        at = draw.randrange(360)
        words = base[at : at + 40]
        for _ in range(draw.randrange(3)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = [(k, " ".join(base[a : a + 15])) for k, a in enumerate(range(0, 390, 30))] + [(99, "w1 w2")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for name, value in (("BITS", 2), ("MOST_BITS", 5), ("LOAD", 2), ("LIGHT", 3)):
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(decontaminate, "BITS", 1)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 2)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_classes(docs).collect()}
    assert found == plain.ngram_classes(rows)
    assert len(ngram_join._counts(docs, 4)) == 32
    hits = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert hits == plain.contamination(rows, items)
