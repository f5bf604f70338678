"""Awkward tables: repeated and null ids, clashing names, very long texts, empty tables."""

import base64
import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossaloom.functions.hashes import smallest
from glossaloom.llm import line_dedup, shared
from glossaloom.llm.decontaminate import decontaminate
from glossaloom.llm.language_id import declared_language, evidence, fit, fuse, visible_text
from glossaloom.llm.line_dedup import dedupe_lines
from glossaloom.llm.ngram_join import join_classes, keep_one
from glossaloom.llm.quality import judge
from glossaloom.llm.secret_scan import ACCESS, ASSIGN, CLASSES, N_CLASSES, base_spans, labelled_credentials, learned_spans, scan, train
from glossaloom.llm.sentencepiece import Vocabulary, encode, round_trip
from glossaloom.llm.substring_dedup import dedupe_substrings
from glossaloom.llm.token_counts import Unigram, count_tokens
from tests.llm import plain

CLASHES = "bit at word ones may own of lost h body gone lines id key n no text_ spans ka kb _bit _spans _gone _removed _h _text".split()


def clashing(df):
    """With extra columns of every name that an operator might use."""
    return df.select("*", *(F.lit(f"x{c}").alias(c) for c in CLASHES if c not in df.columns))


def kept_extras(df, found):
    return all(c in found.columns for c in CLASHES) and all(r[c] == f"x{c}" for r in found.collect() for c in CLASHES)


def some_words(draw, n):
    return " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))


def test_quality_of_repeated_rows(spark):
    draw = random.Random(1)
    rows = [(i, f"common line of five\n{some_words(draw, 40)}", "h") for i in range(30)]
    rows += [(7, f"common line of five\n{some_words(draw, 18)}", "h")] * 5 + [(None, f"common line of five\n{some_words(draw, 30)}", "h")] * 2 + [(50, None, "h")] * 200 + [(51, None, None)]
    found = judge(clashing(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert kept_extras(spark, found)
    one = {k: v for k, v in plain.quality([(i, h, t) for i, (_, t, h) in enumerate(rows)]).items()}
    expected = Counter((rows[i][0], x[0], x[6], 4 * len(x[7])) for i, x in one.items())
    assert Counter((r.doc_id, r.n_words, r.kept, r.n_removed_words) for r in found.collect()) == expected
    assert any(x[7] for x in one.values())


def test_line_dedup_extends_from_fingerprints(spark, monkeypatch):
    """Only selected lines are stored, and the matches of their first places make most of the result."""
    draw = random.Random(2)
    passage = [some_words(draw, 6) for _ in range(40)]
    rows = [(i, "\n".join([some_words(draw, 5) for _ in range(10)] + passage[i % 7 : 20 + i] + ["the same line"] + [some_words(draw, 5) for _ in range(3)])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stored = {}
    monkeypatch.setattr(line_dedup, "written", lambda d, name: stored.setdefault(name, shared.written(d, name)))
    found = {r.doc_id: r.text for r in dedupe_lines(df).collect()}
    assert found == plain.line_dedup(rows)
    n_lines = sum(len(t.split("\n")) for _, t in rows)
    assert stored["fingerprints"].count() < 0.6 * n_lines
    assert stored["matches"].where("no is not null").count() > 100
    # without the join of fingerprints nothing is found from first places
    monkeypatch.setattr(line_dedup, "written", lambda d, name: shared.written(d.where(F.lit(name != "first")), name))
    assert {r.doc_id: r.text for r in dedupe_lines(df).collect()} == dict(rows)


def test_line_dedup_random(spark):
    draw = random.Random(3)
    for seed in range(3):
        rows = [(i, "\n".join(draw.choice(["a b", "c", "d  e", "f\tg", " ", "h" + " x" * 24, "k" + " y" * 51]) for _ in range(draw.randint(1, 12)))) for i in range(60)]
        found = {r.doc_id: r.text for r in dedupe_lines(clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3)).collect()}
        assert found == plain.line_dedup(rows), seed


def test_line_dedup_of_repeated_ids(spark):
    lines = "one line\ntwo lines\nthree lines"
    rows = [(1, lines), (1, lines), (2, lines), (None, lines), (3, None), (4, "")]
    found = dedupe_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter([(1, ""), (1, ""), (2, ""), (None, lines), (3, None), (4, "")])


@pytest.mark.parametrize("operator", [dedupe_lines, judge, lambda d: decontaminate(d, d.sparkSession.createDataFrame([(1, "a b c")], "item_id long, text string"))])
def test_clashing_names(spark, operator):
    df = spark.createDataFrame([(1, "a b c\nd e\nf", "s"), (2, "a b c\nd e\nf", "s"), (None, None, None)], "doc_id long, text string, source string")
    found = operator(clashing(df))
    assert found.count() == 3 and kept_extras(df, found)


def test_very_long_texts(spark):
    draw = random.Random(4)
    long = "\n".join(some_words(draw, 9) for _ in range(15_000))
    df = spark.createDataFrame([(1, long, "s"), (2, long, "s"), (3, "x" * 1_000_000, "s")], "doc_id long, text string, source string")
    assert [len(r.text) for r in dedupe_lines(df).orderBy("doc_id").collect()] == [len(long), 0, 1_000_000]
    assert [r.n_words for r in judge(df).orderBy("doc_id").collect()] == [135_000, 135_000, 1]


def test_shared_tables_are_cleared(spark):
    kept = shared.written(spark.range(3), "x")
    assert kept.count() == 3 and shared.clear(spark) > 0
    with pytest.raises(Exception):  # noqa: B017
        kept.count()


def test_decontamination_of_repeated_rows(spark):
    draw = random.Random(5)
    item = some_words(draw, 40)
    items = [(5, item), (5, item), (5, item), (6, "two words"), (None, item[20:]), (7, some_words(draw, 12)), (8, item.split()[3])]
    rows = [(None, item), (3, "only two words here"), (3, "nothing of it"), (None, f"{item} {item}"), (4, None), (4, ""), (4, ".,"), (1, item.upper()), (1, some_words(draw, 30))]
    found = decontaminate(clashing(spark.createDataFrame(rows, "doc_id long, text string")), spark.createDataFrame(items, "item_id long, text string"))
    assert kept_extras(spark, found)
    expected = plain.contamination([(i, t) for i, (_, t) in enumerate(rows)], [(i, t) for i, t in items])
    told = lambda d, x: (d, x[0], x[1], tuple(i for i in x[2] if i != "None"), x[3])
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found.collect()) == Counter(told(rows[i][0], x) for i, x in expected.items())
    assert decontaminate(spark.createDataFrame(rows[:1], "doc_id long, text string"), spark.createDataFrame([(None, item)], "item_id long, text string")).first()["items"] == []


def test_decontamination_random(spark):
    draw = random.Random(6)
    say = lambda n: " ".join(draw.choice("abcde") for _ in range(n))
    rows, items = [(i, say(draw.randint(0, 90))) for i in range(150)], [(i, say(draw.randint(0, 16))) for i in range(40)]
    found = decontaminate(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in found.collect()} == plain.contamination(rows, items)


def test_ngram_join_of_repeated_and_null_ids(spark):
    draw = random.Random(7)
    one, other = some_words(draw, 60), some_words(draw, 60)
    rows = [(None, one), (5, one), (5, one), (7, f"{one} more"), (9, other), (None, None), (3, ""), (4, f"{other} z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = Counter((r.doc_id, r.n_shingles, r.component_id) for r in join_classes(df).collect())
    assert found == Counter([(None, 57, None), (5, 57, 5), (5, 57, 5), (7, 58, 5), (9, 57, 4), (None, 0, None), (3, 0, 3), (4, 58, 4)])
    kept = keep_one(clashing(df))
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, 5, 5, None, 3, 4]) and kept_extras(df, kept)


def test_substring_dedup_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr("glossaloom.llm.substring_dedup.PER_SHARD", 2)
    draw = random.Random(8)
    one, own = some_words(draw, 30), some_words(draw, 5)
    rows = [(None, one), (5, one), (5, one), (7, f"{own} {one}"), (8, None), (9, ""), (4, some_words(draw, 20))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = dedupe_substrings(clashing(df))
    assert kept_extras(df, found)
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()) == Counter([(None, 30, 0, one), (5, 30, 0, one), (5, 30, 0, one), (7, 35, 30, own), (8, 0, 0, ""), (9, 0, 0, ""), (4, 20, 0, rows[-1][1])])


def test_language_of_awkward_tables(spark):
    rows = [(1, "the and of that with this " * 5, "a.com"), (1, "the and of that with this " * 5, "a.com"), (None, None, None), (2, "der die und das nicht mit " * 5, "a.com")]
    labelled = spark.createDataFrame([(t, k) for _, t, _ in rows[:2] for k in ["en"]] + [(rows[3][1], "de")] + [(None, "de"), ("x", None)], "text string, lang string")
    model = fit(labelled)
    assert model.languages == ["de", "en"]
    given = clashing(spark.createDataFrame(rows, "doc_id long, text string, host string"))
    found = fuse(evidence(given, model, text="text", host="host"), model)
    assert kept_extras(given, found.withColumns({c: F.lit(f"x{c}") for c in CLASHES if c not in found.columns}))
    assert Counter((r.doc_id, r.language) for r in found.collect()) == Counter([(1, "en"), (1, "en"), (None, "en"), (2, "de")])
    assert [c for c in given.columns if c not in found.columns] == ["text", "host"]
    none = fit(labelled.limit(0))
    assert [r.language for r in fuse(evidence(given, none, text="text", host="host"), none).collect()] == ["und"] * 4


def test_language_sample_is_bounded(spark):
    rows = spark.range(500).select("id", F.concat(F.lit("some text "), F.col("id")).alias("text"), F.lit("en").alias("lang"))
    assert fit(rows, fit_rows=40).log.shape == (1, 1 << 16)
    chosen = rows.where(smallest(rows, F.xxhash64(*rows.columns), 40))
    assert chosen.count() == 40


def test_language_of_open_markup():
    for text in ("<script>" * 40_000, "<!--" * 80_000, "<a " * 350_000, "<html " * 150_000):
        started = time.process_time()
        assert "<" not in visible_text(text) and declared_language(text) is None
        assert time.process_time() - started < 5


def prose_pairs():
    """Class pairs of plain prose."""
    out = np.zeros((N_CLASSES, N_CLASSES))
    for word in "the quick brown fox jumps over a lazy dog and then nothing happened in 1984 or so, Mr. Smith said re-entering at 10/12".split():
        for a, b in zip(" " + word, word + " ", strict=True):
            out[CLASSES.get(a, 0 if a == " " else 1), CLASSES.get(b, 0 if b == " " else 1)] += 100
    return out.ravel()


def test_secrets_of_many_formats():
    draw = random.Random(10)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    say = lambda n, a=alphabet: "".join(draw.choices(a, k=n))
    model = train(labelled_credentials(), prose_pairs(), threshold=1.0)
    token = "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIiwibmFtZSI6IkpvaG4gRG9lIiwiaWF0IjoxNTE2MjM5MDIyfQ.SflKxwRJSMeKKF2QT4fwpMeJf36POk6yJV_adQssw5c"
    for before in ("", "GH=", "export PAT_1=", "https://x.y/", "(", "X"):
        for kind, value in [
            ("source_host_token", "ghp_" + say(36)), ("fine_grained_token", f"github_pat_{say(22)}_{say(59)}"), ("forge_token", "glpat-" + say(20)), ("model_key", "sk-" + say(48)),
            ("payment_key", "sk_test_" + say(24)), ("web_token", token), ("chat_token", f"xoxb-{say(12, '0123456789')}-{say(12, '0123456789')}-{say(24)}"), ("mail_key", f"SG.{say(22)}.{say(43)}"),
        ]:
            if before == "X" and value[0].isupper():
                continue  # one run of capitals
            text = f"ü {before}{value} then"
            assert learned_spans(text, base_spans(text), model) == [(2 + len(before), 3, 2 + len(before) + len(value), kind)], text
    for text in ["550e8400-e29b-41d4-a716-446655440000", "https://example.com/2021/05/13/some-very-long-slug-about-nothing-at-all", "node_modules/react-dom/cjs/react-dom.production.min.js", "AbstractSingletonProxyFactoryBeanGeneratorXYZ", "A" * 40, "2024-01-01T00:00:00.000Z/2024-12-31T23:59:59.999Z"]:
        assert learned_spans(text, base_spans(text), model) == [], text


def test_secrets_of_a_format_held_out():
    """What automata have learned of a format holds for a kind of it that they never saw."""
    known = {k: [v for v in values if not v.startswith("ghr_")] for k, values in labelled_credentials().items()}
    model = train(known, prose_pairs(), threshold=1.0)
    unseen = [v for v in labelled_credentials(50, 11)["source_host_token"] if v.startswith("ghr_")]
    assert len(unseen) == 50 and sum(model.best(v)[0] == "source_host_token" for v in unseen) >= 48


OTHER_WORDS = "morning river garden window bridge summer doctor yellow winter kitchen market station silver mountain letter friend evening journey captain island shadow mirror forest engine ticket account invoice customer payment shipping address checkout basket password session browser network storage monitor deploy release pipeline compile".split()


@pytest.fixture(scope="module")
def scanner():
    return train(labelled_credentials(), prose_pairs(), threshold=1.0)


def test_what_looks_like_a_secret_and_is_none(scanner):
    """Encoded prose and names, of words that the training has not got."""
    draw = random.Random(5)
    prose = lambda n: " ".join(draw.choices(OTHER_WORDS, k=n))
    encoded = [base64.b64encode(prose(9)[:30].encode()).decode() for _ in range(300)] + [base64.urlsafe_b64encode(prose(12).encode()).decode() for _ in range(300)]
    camel = ["".join(w.title() for w in draw.choices(OTHER_WORDS, k=9))[:40] for _ in range(500)]
    paths = [draw.choice("/_-.").join(draw.choices(OTHER_WORDS, k=draw.randint(3, 9))) for _ in range(500)]
    for texts in (encoded, camel, [x[0].lower() + x[1:] for x in camel], paths):
        assert sum(bool(learned_spans(f"x {t} y", [], scanner)) for t in texts) <= len(texts) / 100


def test_secrets_of_all_formats_held_out(scanner):
    values = labelled_credentials(40, 99)
    for name, some in values.items():
        assert sum(scanner.best(v)[0] == name for v in some) >= 0.97 * len(some), name
    long = "sk-proj-" + "".join(random.Random(1).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", k=120))
    assert learned_spans(f"x {long} y", [], scanner) == [(2, 3, 2 + len(long), "long_project_key")]


def test_whole_formats_held_out():
    """Formats that the training never saw are found by their bodies, three of four or more; not their whole length."""
    new = ("assistant_key", "access_token", "long_project_key")
    model = train({k: v for k, v in labelled_credentials().items() if k not in new}, prose_pairs(), threshold=1.0)
    for name in new:
        values = labelled_credentials(30, 12)[name]
        assert sum(bool(learned_spans(v, [], model)) for v in values) >= 0.75 * len(values), name


def test_automata_hold_lengths(scanner):
    body = "".join(random.Random(3).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=60))
    for name, head, n in (("source_host_token", "ghp_", 36), ("secret_key", "", 40), ("hub_token", "hf_", 34), ("package_token", "npm_", 36)):
        automaton = scanner.automata[name]
        assert len(automaton.steps) > n
        state, accepts = 0, []
        for i, c in enumerate(head + body):
            step = automaton.steps[state].get(c if c in automaton.marks else "")
            if step is None:
                break
            state = step[0]
            if automaton.end[state] > -3:
                accepts.append(i + 1)
        assert accepts == [len(head) + n], name


def test_ties_between_formats():
    """Of equal gains the first by name is taken, and of equal spans one."""
    twice = {"b_key": ["key-" + "0123456789abcdef"[i % 16] * 20 for i in range(64)]}
    model = train({**twice, "a_key": twice["b_key"]}, prose_pairs(), threshold=0.1, least_gain=5, others={})
    value = twice["b_key"][3]
    assert [k for _, _, _, k in learned_spans(f"{value} {value}", [], model)] == ["a_key", "a_key"]


def plain_base(text):
    text = text or ""
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [x for _, _, x in sorted(found)]


def test_secrets_of_whole_table(spark):
    """Base columns of the query against a plain version; none of the documents' prose is told a secret."""
    from glossaloom.llm.queries import op4_secret_scan

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = op4_secret_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(docs)
    for r in found:
        base = plain_base(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""} and (base or r.spans == "")


def test_secrets_of_awkward_tables(spark):
    rows = [(1, None), (1, ""), (2, "AKIA" + "A" * 16), (2, "AKIA" + "A" * 16), (None, "x" * 1_000_000), (3, "aA1" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = scan(clashing(df))
    assert kept_extras(df, found) and Counter((r.doc_id, len(r.secrets)) for r in found.collect()) == Counter([(1, 0), (1, 0), (2, 1), (2, 1), (None, 0), (3, 0)])
    assert scan(df.limit(0)).collect() == []


def test_tokens_of_awkward_tables(spark):
    vocabulary, unigram = Vocabulary.load("/opt/tokenizers/piece_bpe_32k.model"), Unigram.load("/opt/tokenizers/piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "two words"), (1, "two words"), (None, None), (2, ""), (3, "x" * 300_000)], "doc_id long, text string")
    for operator in (lambda d: encode(d, vocabulary), lambda d: round_trip(d, vocabulary), lambda d: count_tokens(d, unigram)):
        found = operator(clashing(df))
        assert kept_extras(df, found) and operator(df.limit(0)).collect() == []
        counts = Counter((r.doc_id, r.n_tokens) for r in found.collect())
        assert counts[1, 2] == 2 and counts[None, 0] == counts[2, 0] == 1 and max(n for i, n in counts if i == 3) > 10_000
