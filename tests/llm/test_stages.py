"""Operators of the pipeline against plain versions, on small tables with every awkward case."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glossaloom.llm import ngram_join
from glossaloom.llm.components import components
from glossaloom.llm.decontaminate import decontaminate
from glossaloom.llm.line_dedup import dedupe_lines
from glossaloom.llm.ngram_join import join_classes, keep_one
from glossaloom.llm.quality import judge
from glossaloom.llm.substring_dedup import dedupe_substrings
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"


def make_docs():
    draw = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "né", "Su", "tó", "ra") for b in ("n", "st", "ve", "x", "", "zz")]
    passage = draw.choices(vocabulary, k=60)
    base = draw.choices(vocabulary, k=120)
    texts = [None, "", " \n\t ", "one", "two words", "x " * 40, "\n".join(["same line here"] * 12), "a\x0bb\x0cc\rd"]
    for i in range(60):
        words = draw.choices(vocabulary, k=draw.randint(1, 160))
        if i % 3 == 0:
            at = draw.randint(0, len(words))
            words[at:at] = passage[draw.randint(0, 20) : draw.randint(40, 60)]
        if i % 4 == 0:
            words = list(base)
            for _ in range(draw.randint(0, 6)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
        text = ""
        for w in words:
            text += w + draw.choice([" ", " ", "  ", "\n", " | ", ", "])
        texts.append(text)
    texts += [texts[20], texts[20], texts[21], " ".join(passage), "\n".join(draw.choices(vocabulary, k=400))]
    header = "shared first line\nshared second line\nshared third line\n\nand a fourth"
    texts += [f"{header}\nown text {i} " + " ".join(draw.choices(vocabulary, k=30)) for i in range(30)]
    return [(i, t, "en", None if i % 9 == 0 else f"h{i % 2}", len(t or "")) for i, t in enumerate(texts)]


DOCS = make_docs()
BENCHMARK = [(1, " ".join(DOCS[10][1].split()[:20])), (2, None), (3, ""), (4, "own text 7"), (5, DOCS[12][1]), (5, DOCS[12][1]), (10, "...")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(5)


def pairs():
    return [(d[0], d[1]) for d in DOCS]


def test_substring_dedup(docs):
    expected = plain.substring_dedup(pairs())
    found = {r.doc_id: r for r in dedupe_substrings(docs.select("doc_id", "text", F.lit(7).alias("kept"), F.lit("x").alias("id"))).collect()}
    assert {d: (r.n_words, r.kept) for d, r in found.items()} == expected
    assert {d: r.n_removed for d, r in found.items()} == {d: n - len(kept.split(" ")) * bool(kept) for d, (n, kept) in expected.items()}
    digests = {r.doc_id: r.kept_sha256 for r in dedupe_substrings(docs.select("doc_id", "text"), digest=True).collect()}
    assert digests == {d: hashlib.sha256(kept.encode()).hexdigest() for d, (_, kept) in expected.items()}


def test_substring_dedup_hot_passages(docs, monkeypatch):
    monkeypatch.setattr("glossaloom.llm.substring_dedup.HOT", 3)
    found = {r.doc_id: (r.n_words, r.kept) for r in dedupe_substrings(docs).collect()}
    assert found == plain.substring_dedup(pairs())


@pytest.mark.parametrize("big, shingles, heavy", [(2000, 4_000_000, 4096), (6, 4_000_000, 10**9), (2000, 400, 100)])
def test_ngram_join(docs, monkeypatch, big, shingles, heavy):
    monkeypatch.setattr(ngram_join, "BIG", big)
    monkeypatch.setattr(ngram_join, "BIG_SHINGLES", shingles)
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    monkeypatch.setattr(ngram_join, "HUBS", min(big // 2, 32))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in join_classes(docs).collect()}
    assert found == plain.ngram_classes(pairs())


def test_ngram_join_chains(spark, monkeypatch):
    """Chains of links whose ends do not link, cut into many chunks."""
    monkeypatch.setattr(ngram_join, "BIG", 4)
    monkeypatch.setattr(ngram_join, "HUBS", 1)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 100])) for i in range(40)] + [(100 + i, " ".join(words[300:360] + [f"z{i}"])) for i in range(12)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == plain.ngram_classes(rows)


def test_keep_one(docs):
    expected = {d for d, (_, c) in plain.ngram_classes(pairs()).items() if d == c}
    assert {r.doc_id for r in keep_one(docs).collect()} == expected


def test_components(spark):
    links = [(i, i + 1) for i in range(30) if i != 14] + [(100, 7), (50, 50), (61, 60)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = {i: 0 if i < 15 else 15 for i in range(31)} | {100: 0, 60: 60, 61: 60}
    assert found == expected
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_decontamination(spark, docs):
    items = spark.createDataFrame(BENCHMARK, ITEMS)
    found = decontaminate(docs.withColumn("n_hit", F.lit(1)), items).collect()
    expected = plain.contamination(pairs(), BENCHMARK)
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in found} == expected
    for r in found:
        assert sum(r.hit_words[1::2]) - sum(r.hit_words[::2]) == r.n_hit


def test_decontamination_without_items(spark, docs):
    found = decontaminate(docs, spark.createDataFrame([], ITEMS)).collect()
    assert len(found) == len(DOCS) and not any(r.contaminated for r in found)


def test_quality(docs):
    found = judge(docs, line_min_docs=5).collect()
    expected = plain.quality([(d[0], d[3], d[1]) for d in DOCS], line_min_docs=5)
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in found} == {d: x[:-1] for d, x in expected.items()}
    assert any(r.n_removed_words for r in found)


def test_quality_cleans_lines(docs):
    expected = plain.quality([(d[0], d[3], d[1]) for d in DOCS], line_min_docs=5)
    cleaned = {r.doc_id: r.text for r in judge(docs, line_min_docs=5, clean=True).collect()}
    for d in DOCS:
        gone = expected[d[0]][-1]
        assert cleaned[d[0]] == (d[1] if not gone else "\n".join(x for i, x in enumerate(d[1].split("\n")) if i not in gone))


def test_line_dedup(docs):
    found = dedupe_lines(docs.withColumn("gone", F.lit(1))).collect()
    assert {r.doc_id: r.text for r in found} == plain.line_dedup(pairs())
    assert any(r.n_removed for r in found)


@pytest.mark.parametrize("operator", [lambda d, s: dedupe_substrings(d), lambda d, s: join_classes(d), lambda d, s: decontaminate(d, s.createDataFrame(BENCHMARK, ITEMS)), lambda d, s: judge(d), lambda d, s: dedupe_lines(d)])
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], SCHEMA), spark).collect() == []


def test_pipeline(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCHMARK, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    import sentencepiece

    rows = {d[0]: (d[1], d[3]) for d in DOCS}
    judged = plain.quality([(d, h, t) for d, (t, h) in rows.items()])
    rows = {d: ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in judged[d][-1]) if t else t, h) for d, (t, h) in rows.items() if judged[d][6]}
    texts = {d: t for d, t in plain.line_dedup([(d, t) for d, (t, _) in rows.items()]).items() if plain.WORD.search(t)}
    texts = {d: texts[d] for d, (_, c) in plain.ngram_classes(texts.items()).items() if c == d}
    texts = {d: texts[d] for d, x in plain.contamination(texts.items(), BENCHMARK).items() if not x[3]}
    model = sentencepiece.SentencePieceProcessor(model_file=f"{corpus_pipeline.TOKENIZERS}/piece_bpe_32k.model")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: list(r.ids) for r in found} == {d: model.encode(t) for d, t in texts.items()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == list(corpus_pipeline.COLUMNS)
