"""Operators on single texts: html, secrets, tokens, languages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glossaloom.llm.html_extract import extract, extract_text
from glossaloom.llm.language_id import evidence, fit, fuse, host_levels
from glossaloom.llm.secret_scan import N_CLASSES, base_spans, labelled_credentials, scan, train
from glossaloom.llm.sentencepiece import Encoder, Vocabulary, decode, encode, round_trip
from glossaloom.llm.token_counts import TrieCounter, Unigram, count_tokens
from glossaloom.llm.words import blocks, white_space_words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = [None, "", " ", "Hello  world", " a", "a\n b", "x ▁ y", "é́ ﬁ ①", "a\r\n\tb { }\r\n  x", "日本語のテキスト" * 40 + "한국어", "z" * 300, "    \n   \n\n", "😀😀 👍🏽", "Hello  world", "tab\there " * 50]


def test_words():
    import pyarrow as pa

    texts = ["ab  cd", None, "", "\x0bx\x1cy", "é è", "ab"]
    found = [b.word(i) for b in blocks(pa.array(texts), white_space_words()) for i in range(len(b.start))]
    assert found == [w.encode() for t in texts for w in re.findall("[^\x20\x09-\x0d]+", t or "")]
    hashes = [h for b in blocks(pa.array(texts), white_space_words()) for h in b.hashes().tolist()]
    assert hashes[0] == hashes[-1] and len(set(hashes)) == len(hashes) - 1


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var t='</p>';</script>{head}</head><body>{body}</body></html>"


LONG = "A paragraph, of some length, that says what the article is about, at last."


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain words", "plain words"),
        (page(f"<nav><ul><li><a href=x>Menu</a></li></ul></nav><article><h1>Head &amp; more</h1><p><b>{LONG}<br><p>Two &lt;b&gt;\n lines</p></article><footer>foot</footer>"), f"Head & more {LONG} Two <b> lines"),
        (page(f"<div class='site-header'><p>{LONG}</p></div><div id=content><p>{LONG}</p><p>b<i>o</i>ld</p></div><div class=sidebar><p>{LONG}</p></div>"), f"{LONG} bold"),
        (page(f"<main><header><h1>T</h1><p>by line</p></header><p>{LONG}</p><aside>{LONG}</aside><div class=ad>{LONG}</div><form><p>{LONG}</p></form></main>"), f"T {LONG}"),
        (page(f"<article><p>{LONG}</p></article><section class=comments><p>{LONG * 5}</p></section>"), LONG),
        (page(f"<div><div class='cookie-notice'><p>{LONG}</p></div><div><p>{LONG}</p><p>{LONG}</p></div></div>"), f"{LONG} {LONG}"),
        (page(f"<article><p>{LONG}<!-- no --></p><ul><li>one</li><li>two</li></ul><ul><li><a href=a>x</a></li><li><a href=b>y</a></li></ul></article>"), f"{LONG} one two"),
        (page(f"<article><section><p>{LONG}</p></section><section><p>Second.</p></section></article>"), f"{LONG} Second."),
    ],
)
def test_html(html, text):
    assert extract(html) == text


def test_html_deep_and_broken():
    assert extract("<div>" * 5000 + f"<p>{LONG}") == LONG
    assert extract(f"<p>{LONG}</div></p></span><script>x") == LONG
    assert extract("<" * 100) is not None


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", page(f"<article><p>{LONG}</p></article>"), "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    found = {r.page_id: (r.text, r.n_chars, r.url) for r in extract_text(rows).collect()}
    assert found == {1: (LONG, len(LONG), "u"), 2: ("", 0, None)}


def test_secrets(spark):
    token = labelled_credentials(1, 5)
    texts = [None, "", 'password = "hunter2hunter2" PassWD:short x', "AKIA" + "A" * 12 + " AKIAB", "0" * 31 + "g" + "a" * 40, f"é key {token['source_host_token'][0]} end", "an_ordinary_identifier_2 4111111111111111", "token: " + "f" * 40, "ſecret: abcdefghij"]
    found = {r.i: [(s.kind, s.start, s.end, s.learned) for s in r.secrets] for r in scan(spark.createDataFrame(list(enumerate(texts)), "i long, text string")).collect()}
    assert found[0] == found[1] == [] and found[6] == [] and found[8] == []
    assert found[2] == [("assign", 0, 26, False)]
    assert found[3] == [("access", 0, 16, False)]
    assert found[4] == [("hex", 32, 72, False)]
    assert found[5] == [("source_host_token", 6, 6 + len(token["source_host_token"][0]), True)]
    assert [x[0] for x in found[7]] == ["assign", "hex"]


def test_grammars_held_out():
    import numpy as np

    model = train(labelled_credentials(), np.ones(N_CLASSES**2))
    for name, values in labelled_credentials(60, seed=99).items():
        assert sum(model.best(v)[0] == name for v in values) >= 57
    assert base_spans("no secrets") == []


def test_sentencepiece(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    vocabulary = Vocabulary.load(MODEL)
    draw = random.Random(1)
    texts = TEXTS + ["".join(draw.choices("ab ▁\n\tcdeé{};\r日", k=draw.randint(1, 200))) for _ in range(200)]
    ids, ends = Encoder(vocabulary).encode(texts)
    for i, t in enumerate(texts):
        own = ids[ends[i] : ends[i + 1]].tolist()
        assert own == (library.encode(t) if t else [])
        if t and "▁" not in t:
            assert vocabulary.decode(own) == t
    rows = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "i long, text string, ids string")
    coded = encode(rows, vocabulary)
    assert {r.i: list(r.ids) for r in coded.collect()} == {i: ids[ends[i] : ends[i + 1]].tolist() for i in range(len(texts))}
    back = {r.i: r.text for r in decode(coded, vocabulary).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert all(r.round_trip for r in round_trip(rows.where("not contains(text, '▁')"), vocabulary).collect())


def brute_tokens(word, unigram):
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        options = [(best[b][0] + unigram.cost[word[b:end]], best[b][1] + 1) for b in range(end) if word[b:end] in unigram.cost]
        if word[end - 1] not in unigram.cost:
            n = len(word[end - 1].encode())
            options.append((best[end - 1][0] + n * unigram.unknown, best[end - 1][1] + n))
        best.append(min(options))
    return best[-1][1]


def test_token_counts(spark):
    unigram = Unigram.load(MODEL)
    found = {r.i: (r.n_pretokens, r.n_tokens) for r in count_tokens(spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "i long, text string, n_tokens int"), unigram).collect()}
    for i, t in enumerate(TEXTS):
        words = re.findall("[^\x20\x09-\x0d]+", t or "")
        assert found[i] == (len(words), sum(brute_tokens("▁" + w, unigram) for w in words))
    small = Unigram(["▁", "a", "b", "ab", "▁a", "bb"])
    counter = TrieCounter(small)
    words = ["".join(w) for w in __import__("itertools").product("abc", repeat=4)]
    counter.insert([w.encode() for w in words])
    assert {w: counter.known[w.encode()] for w in words} == {w: brute_tokens("▁" + w, small) for w in words}


WORDS = {"en": "the and of that with this from have", "fr": "le la les une dans avec pour est", "de": "der die und das nicht mit ein ist"}


def test_language(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choices(WORDS[lang].split(), k=30)), lang) for i, lang in enumerate(list(WORDS) * 60)]
    train_rows, held = rows[:120], rows[120:]
    model = fit(spark.createDataFrame(train_rows, "i long, text string, lang string"))
    given = [(i, t, f"s{i % 3}") for i, t, _ in held] + [(900, None, "s0"), (901, "", None)]
    found = {r.i: r for r in fuse(evidence(spark.createDataFrame(given, "i long, text string, host string"), model, text="text", host="host"), model).collect()}
    assert sum(found[i].language == lang for i, _, lang in held) >= 0.95 * len(held)
    assert len(found) == len(given) and all(0 < r.confidence <= 1 for r in found.values())
    assert fuse(evidence(spark.createDataFrame([], "i long, text string, host string"), model, text="text", host="host"), model).collect() == []


def test_language_evidence_beyond_text(spark):
    model = fit(spark.createDataFrame([(WORDS[k] * 3, k) for k in WORDS for _ in range(5)], "text string, lang string"))
    html = lambda lang, text: f"<html lang='{lang}'><script>the and of</script><p>{text}</p></html>"
    rows = [(i, html("fr", WORDS["fr"]), "a.example.com") for i in range(8)] + [(20 + i, html("de", WORDS["de"]), "c.example.net") for i in range(8)] + [(50, html("", ""), "a.example.com"), (51, html("de", ""), "b.example.org"), (52, html("", "qq"), "x.example.de"), (53, None, "b.example.com")]
    found = {r.i: r.language for r in fuse(evidence(spark.createDataFrame(rows, "i long, html string, host string"), model, text="html", host="host", is_html=True), model).collect()}
    assert found[50] == "fr" and found[51] == "de" and found[52] == "de" and found[53] == "fr"
    assert host_levels("www.Example.co.uk.") == ("www.example.co.uk", "example.co.uk", "uk")
    assert host_levels(None) == ("", "", "")
