"""Very long texts, awkward rows through the whole pipeline, and the fusion of language evidence by itself."""

import math
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from glossaloom.llm.decontaminate import decontaminate
from glossaloom.llm.language_id import _OWN, SMOOTHING, evidence, fit, fuse
from glossaloom.llm.ngram_join import join_classes
from glossaloom.llm.substring_dedup import dedupe_substrings
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(draw, n, least=6):
    return " ".join(f"w{draw.randrange(10**least)}" for _ in range(n))


def plain_fusion(rows, languages):
    """(language, confidence) of rows (host, domain, suffix, evidence, expected languages)."""
    n = len(languages)
    held = [defaultdict(lambda: [0.0] * n) for _ in range(4)]
    keys = lambda r: ((), (r[2],), (r[1], r[2]), (r[0],))
    for r in rows:
        for level, key in zip(held, keys(r), strict=True):
            level[key] = [a + b for a, b in zip(level[key], r[4], strict=True)]
    out = []
    for r in rows:
        prior = [1 / n] * n
        for level, key in zip(held, keys(r), strict=True):
            left = [max(a - b, 0.0) for a, b in zip(level[key], r[4], strict=True)]
            prior = [(a + SMOOTHING * p) / (sum(left) + SMOOTHING) for a, p in zip(left, prior, strict=True)]
        total = [e + math.log(p) for e, p in zip(r[3], prior, strict=True)]
        best = max(total)
        out.append((languages[total.index(best)], 1 / sum(math.exp(t - best) for t in total)))
    return out


def test_fusion_against_plain(spark):
    draw = random.Random(4)
    texts = {"en": "the and of that with this not have", "de": "der die und das nicht mit ist ein", "fr": "le la les des une pas est dans"}
    say = lambda k, n: " ".join(draw.choices(texts[k].split(), k=n))
    labelled = spark.createDataFrame([(say(k, 40), k) for k in texts for _ in range(20)], "text string, lang string")
    model = fit(labelled)
    rows = []
    for i in range(150):
        k = draw.choice(list(texts))
        host = draw.choice(["a.com", "b.a.com", "x.de", "y.de", "z.co.uk", "q.fr", "plain", None])
        body = f'<html lang="{draw.choice(list(texts))}"><p>{say(k, draw.randrange(4))}</p>' if draw.random() < 0.7 else say(k, 3)
        rows.append((i, draw.choice([body, None, ""]), host))
    given = evidence(spark.createDataFrame(rows, "id long, html string, host string").repartition(5), model, text="html", host="host", is_html=True)
    own = given.collect()
    expected = plain_fusion([tuple(r[_OWN]) for r in own], model.languages)
    found = {r.id: (r.language, r.confidence) for r in fuse(given, model).collect()}
    assert len(found) == 150 and len({x for x, _ in found.values()}) == 3
    for r, (language, confidence) in zip(own, expected, strict=True):
        assert found[r.id][0] == language and found[r.id][1] == pytest.approx(confidence, abs=2e-4)


def test_texts_of_a_megabyte(spark):
    draw = random.Random(5)
    long = words(draw, 150_000)
    assert len(long) > 1_000_000
    rows = [(1, long), (2, f"{words(draw, 20)} {long}"), (3, " ".join(long.split()[50_000:50_100])), (4, "x" * 1_000_000), (5, words(draw, 30)), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.kept) for r in dedupe_substrings(df).collect()} == plain.substring_dedup(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in join_classes(df).collect()} == plain.ngram_classes(rows)
    items = [(1, " ".join(long.split()[149_000:149_020])), (2, "x" * 1_000_000), (3, words(draw, 20))]
    found = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == plain.contamination(rows, items) and found[4][3]
    labelled = spark.createDataFrame([(long, "en"), (words(draw, 10) + " ä ö ü", "de")], "text string, lang string")
    model = fit(labelled)
    told = fuse(evidence(df.selectExpr("*", "'a.com' as host"), model, text="text", host="host"), model).collect()
    assert {r.doc_id: r.language for r in told}[2] == "en" and len(told) == 6


def test_pipeline_of_awkward_rows(spark, tmp_path):
    draw = random.Random(6)
    clean = [words(draw, 60) for _ in range(8)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    rows += [(0, clean[0], "en", "s", 1), (None, words(draw, 50), None, None, None), (20, None, "en", "s", 0), (21, "", None, "s", 0), (22, "too short", "en", None, 9), (23, f"{clean[1]} more", "en", "t", 1), (24, clean[2], "en", "t", 1)]
    item = words(draw, 30)
    rows.append((25, f"{words(draw, 10)} {item}", "en", "t", 1))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in found)[None] == 1 and all(r.n_tokens > 40 for r in found)
    assert {r.doc_id for r in found} >= {1, 2, 3, 4, 5, 6, 7, None} and {r.doc_id for r in found} <= {0, 1, 2, 3, 4, 5, 6, 7, None}


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
