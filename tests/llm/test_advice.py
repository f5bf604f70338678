"""Cases in which stages and operators once did less than the whole job."""

import random

import numpy as np

import corpus_pipeline
from glossaloom.llm.html_extract import extract
from glossaloom.llm.secret_scan import N_CLASSES, base_spans, labelled_credentials, learned_spans, train
from tests.llm import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """(id, text, source) as a table."""
    return spark.createDataFrame([(d, t, "en", h, len(t or "")) for d, t, h in rows], SCHEMA)


def line_dedup(docs, run=3, whole=50):
    """As plain.line_dedup, with shorter runs of at least ``whole`` words."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        lines = t.split("\n")
        some = [(i, " ".join(plain.WORD.findall(x))) for i, x in enumerate(lines) if plain.WORD.search(x)]
        gone = set()
        for n in range(1, run + 1):
            for k in range(len(some) - n + 1):
                key = tuple(x for _, x in some[k : k + n])
                if n == run or len(plain.WORD.findall(" ".join(key))) >= whole:
                    if key in seen:
                        gone |= {i for i, _ in some[k : k + n]}
                    seen.add(key)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return {d: t for d, t in out.items() if plain.WORD.search(t)}


def test_line_dedup_of_few_long_lines(spark):
    draw = random.Random(5)
    say = lambda n: " ".join(f"w{draw.randrange(10**6)}" for _ in range(n))
    one, half, rest, short, bound, below = say(55), say(30), say(26), say(20), say(50), say(49)
    texts = [
        one, f"{say(5)}\n{one}\n{say(9)}", f"{say(4)}\n {one.replace(' ', '  ')}", one,
        f"{half}\n{rest}\n{say(7)}", f"{say(8)}\n{half}\n\n{rest}", f"{half}\n{say(3)}\n{rest}",
        f"{short}\n{say(6)}", f"{short}\n{say(6)}", f"{bound}\n{say(2)}\n{bound}", f"{say(2)}\n{bound}", f"{below}\n{say(1)}", f"{say(1)}\nx\n{below}",
    ]
    found = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, documents(spark, [(i, t, "h") for i, t in enumerate(texts)]).repartition(3), "").collect()}
    assert found == line_dedup(list(enumerate(texts)))
    assert 3 not in found and one not in found[1] and rest not in found[5] and half in found[6] and below in found[12]


def test_quality_rules_in_a_hot_host(spark):
    draw = random.Random(6)
    own = lambda: " ".join(f"w{draw.randrange(10**6)}" for _ in range(30))
    rows = [(i, f"{own()}\nread on here" if i < 21 else f"{own()}\nfew have this" if i < 41 else own(), "hot") for i in range(400)]
    found = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, documents(spark, rows).repartition(3), "").collect()}
    expected = plain.quality([(d, h, t) for d, t, h in rows])
    assert found == {d: t.removesuffix("\nread on here") for d, t, _ in rows} and all(x[6] for x in expected.values())
    assert [d for d, x in expected.items() if x[-1]] == list(range(21))


def test_near_duplicates_of_five_words_at_80_percent(spark):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(100)]
    longer = words + [f"z{i}" for i in range(20)]
    changed = [*words[:50], "other", *words[51:]]
    far = words + [f"y{i}" for i in range(30)]
    rows = [(1, " ".join(words), "h"), (2, " ".join(longer), "h"), (3, " ".join(changed), "h"), (4, " ".join(far), "h")]
    rows += [(10 + i, " ".join(f"v{draw.randrange(10**6)}" for _ in range(40)), "h") for i in range(5)]
    pairs = [(d, t) for d, t, _ in rows]
    found = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()}
    assert found == {d for d, (_, c) in plain.ngram_classes(pairs, 5, 80).items() if d == c}
    assert 2 not in found and 4 in found and 2 in {c for _, c in plain.ngram_classes(pairs).values()}


def test_secrets_glued_to_what_is_before_them():
    draw = random.Random(9)
    model = train(labelled_credentials(), np.ones(N_CLASSES**2))
    digits, letters = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    say = lambda alphabet, n: "".join(draw.choices(alphabet, k=n))
    chat = "xoxb-" + say(digits, 12) + "-" + say(digits, 12) + "-" + say(letters + digits, 24)
    host, key, aws = "ghp_" + say(letters + digits, 36), "sk_live_" + say(letters, 24), say(letters + digits, 37) + "a1B"
    for before, value, after, kind in [
        ("SLACK=", chat, "", "chat_token"), ("GH=", host, "", "source_host_token"), ("https://host/", host, "/x", "source_host_token"), ("my-", host, "", "source_host_token"),
        ("X", host, "", "source_host_token"), ("", key, "", "payment_key"), ("K=", key, "", "payment_key"), ("", chat, "", "chat_token"), ("KEY=", aws, "", "secret_key"), ("", "xoxb-" + say(digits, 12), "", "chat_token"),
    ]:
        text = f"é {before}{value}{after} end"
        at = 2 + len(before)
        assert learned_spans(text, base_spans(text), model) == [(at, 3, at + len(value), kind)], text
    assert learned_spans("some-long_plain/path=of/words-and_marks", [], model) == []


def test_html_linked_blocks_of_the_article():
    long = "A paragraph, of some length, that says what the article is about, at last."
    linked = "<a href=y>One sentence, that is a link from its start to its end.</a>"
    cited = [f"A. Writer, <a href=r{i}>A work of some length about a matter, volume {i}</a>" for i in range(3)]
    plain_cited = " ".join(x.replace("</a>", "").split("<a")[0] + x.split(">")[1].split("<")[0] for x in cited)
    menu = "<ul><li><a href=a>Home</a></li><li><a href=b>News</a></li><li><a href=c>About us</a></li></ul>"
    body = f"<h1><a href=x>Title of it</a></h1><p>{long}</p><p>{linked}</p><ol>{''.join(f'<li>{x}</li>' for x in cited)}</ol>{menu}"
    expected = f"Title of it {long} One sentence, that is a link from its start to its end. {plain_cited}"
    assert extract(f"<html><body><article>{body}</article></body></html>") == expected
    beside = f"<div><h2><a href=x>Title of it</a></h2><div class=text><p>{long}</p><p>{long}</p></div>{menu}</div>"
    assert extract(f"<html><body>{beside}</body></html>") == f"Title of it {long} {long}"
