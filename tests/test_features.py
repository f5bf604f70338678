"""Rule indexes, readers by name, stored states, light classifiers, word vectors, cell changes."""

import csv
import html
import io
import json
import multiprocessing
import random
import re
import time
import zipfile

import numpy as np
import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from glossaloom.config import RuleSet, TagSet
from glossaloom.jobs import JobRegistry
from glossaloom.ml.light import Light, classify_light
from glossaloom.ml.train import STOP, classify, train
from glossaloom.operators import embed, explore, extract, metadata, rule_index, rules, sample, trainset, validate
from glossaloom.operators.rule_index import Index, paid_negatives, pruned, required_text
from glossaloom.operators.vectors import fit_vectors
from glossaloom.plans import catalogue
from glossaloom.sources import files, readers, sinks, stored

# Many rules -------------------------------------------------------------------------------------------------------


def random_rules(draw, n, regex=0.2):
    rows = []
    for _ in range(n):
        text = "".join(draw.choice("ab c") for _ in range(draw.randint(1, 5)))
        if draw.random() < regex:
            text = "REGEX:::" + draw.choice([f"^{text}", f"{text}+$", f"({text}|x)y?", "a.b", r"\ba", f"[ab]{text}", "(?i)AB", f"{text}{{2}}", r"c\d?"])
        rows.append((text, draw.randint(0, 3), draw.randint(0, 1), draw.randint(0, 1)))
    return RuleSet.of(rows, ["t", "u"])


def some_chunks(spark, draw, n=150):
    text = lambda: "".join(draw.choice("abc yx") for _ in range(draw.randint(0, 14)))
    rows = [(i, [text() for _ in range(draw.randint(0, 5))]) for i in range(n)] + [(n, None), (n + 1, [None, "ab"]), (n + 2, [])]
    return spark.createDataFrame(rows, "id long, chunks array<string>").repartition(3)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_automaton_tells_what_the_case_tells(spark, monkeypatch, seed):
    draw = random.Random(seed)
    ruleset, rows = random_rules(draw, 25), some_chunks(spark, draw)
    monkeypatch.setattr(rules, "pruned", lambda r: r)
    told = lambda df: {r.id: (r.t, r.u) for r in df.collect()}
    expected = told(rules.apply_rules(rows, ruleset))
    monkeypatch.setattr(rules, "CASE_RULES", 0)
    assert told(rules.apply_rules(rows, ruleset)) == expected
    monkeypatch.setattr(rules, "pruned", pruned)
    assert told(rules.apply_rules(rows, ruleset)) == expected
    assert len(pruned(ruleset).rules) < len(ruleset.rules)
    assert any(t for t, _ in expected.values()) and not all(t for t, _ in expected.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_training_rows_of_many_rules(spark, monkeypatch, seed):
    draw = random.Random(seed)
    ruleset, rows = random_rules(draw, 20), some_chunks(spark, draw)
    told = lambda: sorted(map(repr, trainset.training_set(rows, ruleset, negatives=True, keep=["id"]).collect()))
    expected = told()
    monkeypatch.setattr(trainset, "CASE_RULES", 0)
    assert told() == expected and len(expected) > 100


def test_required_text():
    known = {"abc": "abc", "ab?cd": "cd", "ab+c": "ab", "^foo$": "foo", "(a|b)cde": "cde", "a|b": None, r"tion (of|in)": "tion ", r"a\.b": "a.b", r"\d+ hours?": " hour", "[abc]x": "x", "(?i)abc": None, "a{2}bc": "bc", r"\x41b": None, "x*": None, r"\p{L}ab": "ab", "(?<n>ab)c": "c"}
    assert {p: required_text(p) for p in known} == known
    draw = random.Random(5)
    for _ in range(2000):
        pattern = "".join(draw.choice(["a", "b", "c", "?", "*", "+", "(a|b)", "[ab]", ".", r"\.", "|", "(c)", "^", "{1,2}"]) for _ in range(draw.randint(1, 6)))
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        need = required_text(pattern)
        for _ in range(20):
            text = "".join(draw.choice("abc.") for _ in range(draw.randint(0, 8)))
            if compiled.search(text) and need:
                assert need in text, (pattern, need, text)


def test_pruned_rules():
    ruleset = RuleSet.of([("slow", 5, 1), ("slow roast", 1, 0), ("roast", 0, 1), ("beef roast", 3, 0), ("zzz", -1, 0), ("REGEX:::slow .*", 0, 1)], ["t"])
    assert [r.text for r in pruned(ruleset).by_priority] == ["slow", "beef roast", "roast", "REGEX:::slow .*"]
    assert [r.text for r in pruned(RuleSet.of([("", 1, 1), ("a", 0, 1), ("b", 2, 0)], ["t"])).by_priority] == ["b", ""]
    assert pruned(RuleSet.of([("a", 1, 0)], ["t"])).rules == []


def test_rules_that_never_set_a_tag(spark):
    rows = spark.createDataFrame([(1, ["a"])], "id long, chunks array<string>")
    assert rules.apply_rules(rows, RuleSet.of([("a", 1, 0)], ["t"])).first().t == 0


def test_ten_thousand_rules(spark):
    """The time of many rules is that of few, and a CASE of them is not built."""
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(3, 7)))
    rows = spark.createDataFrame([(i, [" ".join(word() for _ in range(13)) for _ in range(20)]) for i in range(300)], "id long, chunks array<string>").cache()
    rows.count()
    of = lambda n: RuleSet.of([(word(), draw.randint(0, 9), draw.randint(0, 1)) for _ in range(n)], ["t"])
    few, many = of(120), of(10_000)
    took = []
    for ruleset in (few, few, many):
        began = time.perf_counter()
        found = {r.id: r.t for r in rules.apply_rules(rows, ruleset).collect()}
        took.append(time.perf_counter() - began)
    ranked = many.by_priority
    for r in rows.limit(20).collect():
        won = next((x for x in ranked if any(x.text in c for c in r.chunks)), None)
        assert found[r.id] == (won.encoding["t"] if won else 0)
    assert took[2] < 3 * took[1] + 3, took
    rows.unpersist()


def test_negatives_in_linear_time():
    draw = random.Random(9)

    def plain(hits, free, cost):
        out = []
        for place in sorted({k for _, k in hits}):
            own, taken = {p for p, k in hits if k == place}, 0
            for i in free:
                if i not in own and sum(p < i for p in own) > taken * cost:
                    taken += 1
                    out.append((i, place))
        return sorted(out)

    for _ in range(300):
        n = draw.randint(1, 30)
        hits = sorted({(draw.randrange(n), draw.randrange(3)) for _ in range(draw.randint(1, 12))})
        free = sorted(draw.sample(range(n), draw.randint(0, n)))
        cost = draw.randint(1, 3)
        assert sorted(paid_negatives(hits, free, cost)) == plain(hits, free, cost)
    began = time.perf_counter()
    found = paid_negatives([(i, 0) for i in range(0, 400_000, 4)], [i for i in range(400_000) if i % 4], 1)
    assert len(found) > 90_000 and time.perf_counter() - began < 5


# Plans ------------------------------------------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_extraction_is_computed_once(spark):
    rows = spark.createDataFrame([(1, "one hour that <b>is</b>")], "id long, text string")
    found = extract.extract(rows, ["hour"])
    assert plan_of(found).count("regexp_replace") == 5
    assert plan_of(extract.exploded(found)).count("regexp_replace") == 5
    assert extract.exploded(found).first().chunk == "one hour that is"


def test_validation_sample_reads_twice(spark):
    sf = "/root/testdata/sf0.001"
    plan = catalogue.queries()["validation_sample"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= 2


def test_sample_by_key_is_exact(spark):
    rows = spark.range(5000).withColumn("by", (F.col("id") % 3).cast("string")).withColumn("part", F.lit(1)).withColumn("parts", F.lit(2)).withColumn("size", F.lit(3)).repartition(5)
    found = sample.sample_rows_by(rows, "by", 7, key=["id"])
    assert found.columns == rows.columns
    assert {r.by: r["count"] for r in found.groupBy("by").count().collect()} == {"0": 117, "1": 117, "2": 117}


# Readers ----------------------------------------------------------------------------------------------------------


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text,lang\n1,one,en\n")
    (tmp_path / "b.csv").write_text('lang,"more, or",id,text\nde,x,2,"zwei\n""Zeilen"""\n')
    (tmp_path / "c[1]{x}.csv").write_text("id,text,lang\n3,drei,de\n")
    (tmp_path / "empty.csv").write_text("")
    found = readers.read_csv(spark, str(tmp_path), ["id", "text"], parent=True, pattern="*.csv")
    assert sorted(tuple(r) for r in found.collect()) == [("a", "1", "one"), ("b", "2", 'zwei\n"Zeilen"'), ("c[1]{x}", "3", "drei")]
    with pytest.raises(ValueError, match="no column 'lang'"):
        (tmp_path / "d.csv").write_text("id,text\n4,vier\n")
        readers.read_csv(spark, str(tmp_path), ["id", "lang"])
    assert readers.read_csv(spark, f"{tmp_path}/empty.csv", ["id"]).collect() == []
    assert readers.header(spark, f"{tmp_path}/b.csv") == ["lang", "more, or", "id", "text"]


def test_csv_below_folders(spark, tmp_path):
    (tmp_path / "x/y").mkdir(parents=True)
    (tmp_path / "x/y/a.csv").write_text("id\n1\n")
    (tmp_path / "x/b.csv").write_text("﻿id\n2\n")
    assert sorted(r.id for r in readers.read_csv(spark, str(tmp_path), ["id"], recursive=True).collect()) == ["1", "2"]


def test_metadata_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Key,Jahr,Größe,Ort\nx,5,1,A\n".encode("latin-1"))
    (tmp_path / "b.csv").write_bytes("Ort,Größe,Jahr,Key\nB,2.5,n/a,y\n".encode("latin-1"))
    found = readers.read_metadata(spark, str(tmp_path), ["Key", "Größe", "Jahr", "Ort"], "Key")
    assert dict(found.dtypes) == {"id": "string", "größe": "double", "jahr": "string", "ort": "string"}
    assert sorted(map(tuple, found.collect())) == [("x", 1.0, "5", "A"), ("y", 2.5, "n/a", "B")]


def test_long_csv_fields(spark, tmp_path):
    long = "wörd, \"x\"\n" * 120_000
    held = io.StringIO()
    csv.writer(held).writerows([["id", "text"], ["1", long], ["2", "short"]])
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("one.csv", held.getvalue())
    (tmp_path / "p.csv").write_text(held.getvalue())
    expected = {"1": long.replace("\r\n", "\n"), "2": "short"}
    for found in (readers.read_zip(spark, f"{tmp_path}/c.zip", ["id", "text"]), readers.read_zip(spark, f"{tmp_path}/c.zip", ["id", "text"], by_member=True), readers.read_csv(spark, f"{tmp_path}/p.csv", ["id", "text"])):
        assert {r.id: r.text for r in found.collect()} == expected


XML = '<?xml version="1.0"?><r:root xmlns:r="urn:r" xmlns="urn:d"><meta><rec2/></meta><rec><id>1</id><text>a &amp; b</text></rec><rec><text>c</text><id>2</id><extra>x</extra></rec></r:root>'


def test_xml_namespaces_and_first_record(spark, tmp_path):
    (tmp_path / "f.xml").write_text(XML)
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as archive:
        archive.writestr("one.xml", XML)
    expected = [("1", "a & b"), ("2", "c")]
    told = lambda df: sorted((r.id, r.text) for r in df.collect())
    assert told(readers.read_xml(spark, f"{tmp_path}/f.xml", ["id", "text"], "rec")) == expected
    for by_member in (False, True):
        assert told(readers.read_zip(spark, f"{tmp_path}/x.zip", ["id", "text"], kind="xml", row_tag="rec", by_member=by_member)) == expected
    assert readers.header(spark, f"{tmp_path}/f.xml", kind="xml", row_tag="rec") == ["id", "text"]
    assert readers.header(spark, f"{tmp_path}/x.zip", kind="zip", row_tag="rec") == ["id", "text"]


def test_a_task_for_each_member(spark, tmp_path):
    for a in range(2):
        with zipfile.ZipFile(tmp_path / f"z{a}.zip", "w") as archive:
            archive.mkdir("folder")
            for i in range(25):
                archive.writestr(f"folder/m{i}.csv", "text,id\n" + "".join(f"t{i},{a}-{i}-{k}\n" for k in range(5000 if i == 0 else 3)))
    rows = readers.read_zip(spark, str(tmp_path), ["id"], by_member=True, parent=True)
    assert rows.rdd.getNumPartitions() == 50
    assert rows.columns == ["parent", "id"] and rows.count() == 2 * (5000 + 24 * 3)
    assert rows.distinct().count() == rows.count() and {r.parent for r in rows.select("parent").distinct().collect()} == {"z0", "z1"}


def test_zip_writer(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text, {i}\n\"x\"", None) for i in range(100)], "id long, text string, other string").repartition(4)
    at = f"{tmp_path}/out"
    sinks.write_zip(rows, at)
    sinks.write_zip(rows, at)  # overwrites
    assert {p.suffix for p in (tmp_path / "out").iterdir()} == {".zip"}
    found = readers.read_zip(spark, at, ["text", "id"], by_member=True)
    assert sorted((int(r.id), r.text) for r in found.collect()) == [(i, f"text, {i}\n\"x\"") for i in range(100)]


def test_text_files(spark, tmp_path):
    told = sinks.write_text_files(spark.createDataFrame([("a b/c d", "Text ä\n"), ("e", None)], "name string, text string"), f"{tmp_path}/t")
    assert sorted(map(tuple, told.collect())) == [("a_b/c_d", 8), ("e", 0)]
    assert sorted(str(p.relative_to(tmp_path / "t")) for p in (tmp_path / "t").rglob("*") if p.is_file()) == ["a_b/c_d.txt", "e.txt"]
    assert (tmp_path / "t/a_b/c_d.txt").read_text() == "Text ä\n"


def test_only_files_that_are_asked_for(spark, tmp_path):
    for name in ("a/x.txt", "b/x.txt", "b/y[1].txt", "z.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    asked = spark.createDataFrame([("b/x.txt",), ("b/y[1].txt ",), ("none.txt",), ("b/x.txt",)], "name string")
    found = readers.file_texts(spark, str(tmp_path), asked=asked)
    assert sorted(map(tuple, found.collect())) == [("b/x.txt", "b/x.txt"), ("b/y[1].txt", "b/y[1].txt")]
    assert len(found.inputFiles()) == 2
    assert sorted(map(tuple, readers.file_texts(spark, str(tmp_path), asked=asked, most=1).collect())) == sorted(map(tuple, found.collect()))
    assert readers.file_texts(spark, str(tmp_path), asked=asked.where("false")).collect() == []


def test_lines_of_compressed_files(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "id long, text string").coalesce(1).write.option("header", True).option("compression", "gzip").csv(f"{tmp_path}/g")
    assert readers.header(spark, f"{tmp_path}/g") == ["id", "text"]
    assert [tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/g", ["text", "id"]).collect()] == [("x", "1")]
    assert files.escaped("a[1]*") == r"a\[1\]\*"


# Stored states ----------------------------------------------------------------------------------------------------


def test_stored_dataset(spark, tmp_path, monkeypatch):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    told = lambda d, n=None: sorted(r.id for r in d.read(n).collect())
    data = stored.StoredDataset(spark, f"{tmp_path}/d")
    with pytest.raises(ValueError):
        data.read()
    data.create(rows(1, 2))
    assert data.append(rows(3), "b") and not data.append(rows(3), "b")
    assert told(data) == [1, 2, 3]
    # a writer that dies before its new state is there leaves the old one
    for step in ("_write", "_become"):
        with monkeypatch.context() as m:
            m.setattr(stored.StoredDataset, step, lambda *a: (_ for _ in ()).throw(OSError("killed")))
            for change in (lambda: data.create(rows(9)), lambda: data.append(rows(9), "c")):
                with pytest.raises(OSError):
                    change()
        assert told(data) == [1, 2, 3]
    assert data.clean() == 2 and told(data) == [1, 2, 3]
    # of two writers that start from one state the later is told so
    with monkeypatch.context() as m:
        m.setattr(stored.StoredDataset, "_number", lambda self: 1)
        with pytest.raises(stored.Conflict):
            data.append(rows(7), "late")
    data.create(rows(5))
    assert told(data) == [5] and told(data, 2) == [1, 2, 3] and list(data.numbers()) == [1, 2, 3]
    data.append(rows(6).withColumn("more", F.lit("x")), "wide")
    assert {(r.id, r.more) for r in data.read().collect()} == {(5, None), (6, "x")}


def _log(folder, k):
    log = JobRegistry(folder, "ext")
    for i in range(30):
        job = log.add(f"{k}-{i}")
        if i % 2:
            log.finish(job, columns=["text"] if i % 3 else [])


def test_two_writers_of_the_job_log(tmp_path):
    writers = [multiprocessing.get_context("spawn").Process(target=_log, args=(str(tmp_path), k)) for k in range(2)]
    for w in writers:
        w.start()
    for w in writers:
        w.join(120)
    log = JobRegistry(str(tmp_path), "ext")
    assert len(log.all()) == 60 and len({j["pid"] for j in log.all()}) == 60
    assert len(log.finished()) == 30 and len(log.finished("text")) == 20
    log.reconcile()
    assert sum(j["status"] == "Failed" for j in log.all()) == 30


def test_classifiers_by_score(tmp_path):
    log = JobRegistry(str(tmp_path), "nb_train")
    for name, f1 in (("a", 0.5), ("b", 0.9), ("c", 0.9)):
        log.finish(log.add(name), scores={"t": {"f1": f1}})
    log.finish(log.add("other"), scores={"u": {"f1": 1.0}})
    log.add("running", scores={"t": {"f1": 1.0}})
    assert [j["name"] for j in log.best("t")] == ["b", "c", "a"]
    log.remove("2")
    log.finish("2")
    assert [j["name"] for j in log.best("t")] == ["c", "a"]


# Classifiers, vectors, changes ------------------------------------------------------------------------------------


def test_light_classifiers(spark):
    assert set(STOP) == {w for w in StopWordsRemover.loadDefaultStopWords("english") if "'" not in w}
    draw = random.Random(3)
    words = {1: "good fine great sunny".split(), 0: "bad poor awful rainy".split()}
    rows = [(f"{' '.join(draw.choice(words[y] + ['thing', 'item', 'the']) for _ in range(6))} n{i}", y, i % 2) for i, y in enumerate(draw.choices([0, 1], k=200))]
    models, _ = train(spark.createDataFrame(rows, "chunk string, t int, u int"), ["t", "u"], key=["chunk"])
    light = Light.of(models)
    texts = spark.createDataFrame([(r[0],) for r in rows] + [("",), (None,), ("unseen words",), ("Good GOOD bad",)], "chunk string")
    expected = [sorted((r.chunk or "", int(r.prediction)) for r in m.transform(texts.fillna("")).collect()) for m in models.values()]
    told = texts.select("chunk", light.predict(F.col("chunk")).alias("p")).collect()
    assert [sorted((r.chunk or "", r.p[t]) for r in told) for t in models] == expected
    again = Light.from_table(light.table(spark).repartition(3))
    assert [r.p for r in texts.select(again.predict(F.col("chunk")).alias("p")).collect()] == [r.p for r in told]
    extracts = spark.createDataFrame([(1, ["good great thing", "bad"]), (2, ["awful item", "fine fine"]), (3, None), (4, []), (5, [None, "good thing"])], "id long, chunks array<string>")
    keys = {"t": ["thing", "item"], "u": ["fine"]}
    plain = sorted(map(tuple, classify(extracts, models, keys).select("id", "t", "u").collect()))
    assert sorted(map(tuple, classify_light(extracts, light, keys).select("id", "t", "u").collect())) == plain
    with pytest.raises(ValueError):
        Light.of(train(spark.createDataFrame(rows, "chunk string, t int, u int"), ["t"], "rf", key=["chunk"], trees=10, depth=2)[0])


def test_word_vectors(spark):
    draw = random.Random(2)
    topics = [("slow roast oven beef gravy tender hours".split(), "kitchen warm meal"), ("engine wheel brake motor gear piston fuel".split(), "garage road drive")]
    lines = [" ".join(draw.choice(words + common.split() + ["the", "of"]) for _ in range(14)) for words, common in topics for _ in range(300)]
    texts = spark.createDataFrame([(t,) for t in lines] + [(None,), ("",)], "text string").repartition(4)
    vectors = fit_vectors(texts, dimensions=4)
    unit = vectors(["slow roast beef", "tender gravy", "motor fuel", "unknown words", "", None])
    cosine = unit @ unit.T
    assert cosine[0, 1] > 0.6 > cosine[0, 2] and cosine[1, 2] < 0.6
    assert not unit[3:].any()
    again = fit_vectors(texts.repartition(7), dimensions=4)
    assert np.allclose(np.abs(vectors(["slow roast"]) @ again(["oven beef"]).T), np.abs(again(["slow roast"]) @ vectors(["oven beef"]).T), atol=1e-3)
    assert not fit_vectors(texts.where("text = ''"))(["slow"]).any()
    ruleset = RuleSet.of([("slow roast", 1, 1, 0), ("motor fuel", 1, 0, 1)], ["food", "cars"])
    rows = spark.createDataFrame([(1, ["tender beef gravy"]), (2, ["brake gear piston"])], "id long, chunks array<string>")
    found = embed.apply_embeddings(rows, [ruleset], TagSet({"food": ["e"], "cars": ["e"]}), 0.6, encoder=vectors)
    assert {r.id: (r.food, r.cars) for r in found.collect()} == {1: (1, 0), 2: (0, 1)}


def test_cell_changes(spark):
    before = spark.createDataFrame([(1, "a", 1.5, "x"), (2, "b", 2.0, None), (2, "c", 3.0, "y"), (None, "n", 0.0, None), (4, "gone", 4.0, "z")], "id int, old string, b double, c string")
    after = spark.createDataFrame([(1, "a", 2.5), (2, "c", 3.0), (None, "m", 0.0), (5, "new", 5.0)], "id int, old string, b double")
    found = {tuple(r) for r in metadata.cell_changes(before, after, ["id"]).collect()}
    changed = {(1, 1, "b", "1.5", "2.5", "changed"), (1, 1, "c", "x", None, "changed"), (None, 1, "old", "n", "m", "changed")}
    changed |= {(2, 1, "old", "b", "c", "changed"), (2, 1, "b", "2.0", "3.0", "changed")}
    gone = {(2, 2, c, v, None, "removed") for c, v in (("old", "c"), ("b", "3.0"), ("c", "y"))} | {(4, 1, c, v, None, "removed") for c, v in (("old", "gone"), ("b", "4.0"), ("c", "z"))}
    assert found == changed | gone | {(5, 1, c, None, v, "added") for c, v in (("old", "new"), ("b", "5.0"), ("c", None))}
    assert metadata.cell_changes(before, before, ["id"]).collect() == []


def test_frequent_chunks(spark):
    draw = random.Random(1)
    rows = [f"often {i}" for i in range(30) for _ in range(400 - 10 * i)] + [f"rare {draw.random()}" for _ in range(20_000)]
    df = spark.createDataFrame([(c,) for c in rows], "chunk string").repartition(5)
    exact = explore.top_chunks(df.groupBy("chunk").count(), 20).collect()
    proven = explore.frequent_chunks(df, 20)
    assert "LogicalRDD" in plan_of(proven) and "Aggregate" not in plan_of(proven)  # found from the summary
    assert sorted(map(tuple, proven.collect())) == sorted(map(tuple, exact))
    for x, tracked in ((1000, 10_000), (20, 40), (0, 10_000)):  # not proven: all are counted
        found = explore.frequent_chunks(df, x, tracked=tracked)
        assert found.collect() == explore.top_chunks(df.groupBy("chunk").count(), x).collect()
    assert explore.frequent_chunks(df.where("false"), 5).collect() == []


def test_best_class(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (5, None)], "id int, embedding array<double>")
    classes = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [0.0, 2.0]), ("none", [0.0, 0.0])], "class string, vector array<double>")
    found = {r.id: (r["class"], r.cosine) for r in embed.best_class(rows, classes).collect()}
    assert found[1][0] == "b" and found[2] == ("a", 1.0) and found[4][0] == "a" and found[3][1] is None and found[5][1] is None
    with pytest.raises(ValueError):
        embed.best_class(rows, classes, most=3)


def test_preview_does_not_depend_on_partitions(spark):
    rows = spark.range(500).withColumn("x", F.lit("y"))
    first = explore.preview(rows, "RANDOM", 20).collect()
    assert explore.preview(rows.repartition(9), "RANDOM", 20).collect() == first
    assert explore.preview(rows, "RANDOM", 20, key=["id"]).collect() != first


def test_highlight_table(spark):
    rows = spark.createDataFrame([(1, ["a k", "b"]), (2, ["c", "k", "k"]), (3, [])], "id long, chunks array<string>")
    found = {r.id: r for r in explore.highlight_table(rows, ["k"], key=["id"], percent=100).collect()}
    assert found[2].marked == [2, 3] and found[2].chunk_3 == "k" and found[1].chunk_3 is None and found[3].marked == []


def test_quotas_keep_other_columns(spark):
    counts = spark.createDataFrame([("r1", 90, "x"), ("r2", 10, "y")], "rule string, count long, v string")
    assert {(r.rule, r.v, r.quota) for r in validate.quotas(counts, 100, 5).collect()} == {("r1", "x", 90), ("r2", "y", 10)}


def test_index_of_rules_with_odd_texts():
    index = Index.of(RuleSet.of([("", 0, 1), ("\x00", 0, 1), ("REGEX:::.*", 0, 1), ("a", 0, 1)], ["t"]).rules)
    assert index.always == [0, 2] and set(index.words) == {"a", "REGEX:::.*"}
    assert json.loads(json.dumps(rule_index.GAP)) == "\x00"


# Queries without SQL against plain versions -----------------------------------------------------------------------


def plain_markup(text):
    """Without hidden elements, comments, declarations and tags; character references are decoded before and after."""
    if "&" in text:
        text = html.unescape(text.strip())
    if "<" not in text:
        return text
    text = re.sub(r"(?is)<(script|style|template)\b[^>]*>.*?</\1\s*>", "", text)
    return html.unescape(re.sub(r"(?s)<!--.*?-->|<![^>]*>|</?[a-zA-Z][^>]*>", "", text))


def plain_spelling(text):
    """Numbers below a hundred spelled one by one, for texts that have no others."""
    ones = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
    tens = "twenty thirty forty fifty sixty seventy eighty ninety".split()
    say = lambda n: ones[n] if n < 20 else tens[n // 10 - 2] + (f"-{ones[n % 10]}" if n % 10 else "")
    return " ".join(re.sub(r"\d+", lambda m: say(int(m[0])), w) for w in text.split())


def test_markup_of_pages_against_plain(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    told = {r.page_id: r.text for r in catalogue.queries()["html_to_text"](spark, "/root/testdata/sf0.001").collect()}
    assert told == {r.page_id: plain_markup(r.html) for r in pages.collect()}


def test_digits_of_documents_against_plain(spark):
    from glossaloom.functions.clean import spell_digits

    draw = random.Random(4)
    texts = [" ".join(draw.choice(["word", str(draw.randrange(100)), f"a{draw.randrange(10)}"]) for _ in range(12)) for _ in range(200)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spell_digits(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in found if re.search(r"\d", r.t)} == {t: plain_spelling(t) for t in texts if re.search(r"\d", t)}


def test_embedding_evidence_against_plain(spark):
    """Every chunk with a keyword of the tag whose cosine with the mean of the tag's rules is above the threshold, and no other."""
    sf = "/root/testdata/sf0.001"
    chunks = {r.doc_id: r.chunks for r in catalogue._extracts(spark, sf).collect()}
    found = {r.doc_id: r for r in catalogue.queries()["embedding_evidence"](spark, sf).collect()}
    assert set(found) == set(chunks)
    seen = 0
    for tag, keys in catalogue.TAGS.keywords.items():
        positive = [r.text for r in catalogue.RULES_A.rules if r.encoding.get(tag) == 1]
        vector = embed.hashing_encoder(positive).astype(float).mean(0) if positive else None
        for doc, held in list(chunks.items())[:60]:
            asked = [c for c in held if any(k in c for k in keys)] if vector is not None else []
            cosine = embed.hashing_encoder(asked).astype(float) @ vector / np.linalg.norm(vector) if asked else []
            near = [c for c, x in zip(asked, cosine, strict=True) if x > 0.2]
            edge = any(abs(x - 0.2) < 1e-5 for x in cosine)
            if not edge:
                assert found[doc][f"{tag}_evidence"] == "|".join(near) and found[doc][tag] == bool(near)
                seen += len(near)
    assert seen > 20


def test_embedding_evidence_in_parts(spark):
    """A task holds the vectors of a few texts at a time, however many a batch has; the cosines are those of the Column."""

    def encoder(texts):
        assert len(texts) <= 1 << 10
        return embed.hashing_encoder(texts)

    rows = spark.createDataFrame([(i, [f"that the {i} {j}" for j in range(300)]) for i in range(10)] + [(10, None), (11, [None, "that"])], "id int, chunks array<string>").coalesce(1)
    asked = (rows, [catalogue.RULES_A], catalogue.TAGS, 0.5)
    found = {r.id: r for r in embed.apply_embeddings(*asked, encoder=encoder).collect()}
    vector = embed.class_vectors([catalogue.RULES_A])["linking"]
    texts = [c for i in range(10) for c in found[i].chunks]
    pairs = spark.createDataFrame([(t, v) for t, v in zip(texts, embed.hashing_encoder(texts).tolist(), strict=True)], "t string, v array<float>")
    near = {r.t for r in pairs.where(embed.cosine(F.array(*map(F.lit, vector)), F.col("v")) > 0.5).collect()}
    assert 0 < len(near) < len(texts)
    assert {c for i in range(10) for c in found[i].linking_evidence} == near
    assert found[10].linking_evidence is None and None not in found[11].linking_evidence and found[0].nominal_evidence == []


# How often the input is computed -------------------------------------------------------------------------------------


def counted(spark, rows):
    """``rows`` and a counter of how often one of them was computed."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(look, rows.schema), seen


@pytest.mark.parametrize("algorithm, options", [("nb", {}), ("rf", {"trees": 10, "depth": 3})])
def test_training_rows_are_computed_once(spark, algorithm, options):
    rows = spark.createDataFrame([(f"{'good' if i % 2 else 'bad'} word{i % 7} number{i}", i % 2, i % 3 % 2) for i in range(200)], "chunk string, t int, u int")
    rows, seen = counted(spark, rows)
    _, scores = train(rows, ["t", "u"], algorithm, **options)
    assert [r["class"] for r in scores.orderBy("class").collect()] == ["t", "u"] and seen.value == 200


def test_rows_of_a_sample_are_computed_twice(spark):
    rows, seen = counted(spark, spark.range(1000).withColumn("chunks", F.array(F.lit("a k"), F.lit("b"))))
    assert sample.sample_rows(rows, 10, key=["id"]).count() == 100 and seen.value == 2000
    found = explore.highlight_table(rows, ["k"], key=["id"])
    assert found.count() == 100 and len(found.collect()) == 100 and seen.value == 4000


def test_classified_rows_go_with_one_chunk(spark):
    """A row with many chunks is not copied to each of them; nulls and empty lists stay rows."""
    rows = spark.createDataFrame([(f"{'good' if i % 2 else 'bad'} word{i % 7}", i % 2) for i in range(100)], "chunk string, t int")
    models, _ = train(rows, ["t"])
    data = spark.createDataFrame([(1, ["bad word1", "good word2", "good word2"]), (2, None), (3, []), (4, [None, "good word3"]), (4, [None, "good word3"])], "id int, chunks array<string>")
    found = classify(data, models, {"t": ["good"]})
    assert sorted((r.id, r.t) for r in found.collect()) == [(1, 1), (2, 0), (3, 0), (4, 1), (4, 1)]
    assert {r.id: r.chunks for r in found.collect()} == {r.id: r.chunks for r in data.collect()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    carried = re.findall(r"Generate explode.*?, \[([^\]]*)\], (?:true|false)", plan)
    assert carried and not any("_row" in c or "chunks" in c for c in carried)


def test_uses_of_many_rules_meet_rows_without_a_shuffle(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = catalogue.queries()["trainset_many_rules"](spark, "/root/testdata/sf0.001")
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


# Forests ---------------------------------------------------------------------------------------------------------


def test_forest_splits_as_plain(spark):
    """The first split of a tree is the best one by Gini of the rows as drawn, and each row is told by its leaf."""
    from glossaloom.ml.forest import STEPS, RandomForest, _draws

    draw = random.Random(5)
    rows = [(x := draw.choice([0, draw.random()]), int(x + draw.gauss(0, 0.2) > 0.5), draw.getrandbits(60)) for _ in range(300)]
    data = spark.createDataFrame([(Vectors.sparse(1, {0: x} if x else {}), y, k) for x, y, k in rows], ["features", "t", "_key"])
    model = RandomForest("t", 1, 2, 1, 42).fit(data)
    n = _draws(np.array([k for _, _, k in rows]), 1, 42)[:, 0]
    step, y = np.array([int(np.ceil(x * STEPS)) for x, _, _ in rows]), np.array([y for _, y, _ in rows])

    def impure(part):
        w, p = n[part].sum(), (n * y)[part].sum()
        return 2 * p * (w - p) / w if w else 0

    cuts = [c for c in sorted(set(step[n > 0])) if c and min(n[step >= c].sum(), n[step < c].sum()) >= 2]
    best = min(impure(step >= c) + impure(step < c) for c in cuts)
    nodes = model.getOrDefault("nodes")
    cut = nodes["step"][0]
    assert nodes["feature"] == [0, -1, -1] and abs(impure(step >= cut) + impure(step < cut) - best) < 1e-6
    assert nodes["zeros"][2] + nodes["ones"][2] == n[step >= cut].sum() and nodes["zeros"][0] + nodes["ones"][0] == n.sum()
    told = {r._key: r.prediction for r in model.transform(data).collect()}
    most = [float(2 * (n * y)[part].sum() > n[part].sum()) for part in (step < cut, step >= cut)]
    assert told == {k: most[int(s >= cut)] for (_, _, k), s in zip(rows, step, strict=True)}


def test_forest_of_a_wide_vocabulary(spark, tmp_path):
    """Rows are read as their words, not as arrays of all words; a saved forest tells the same."""
    from glossaloom.ml.train import load, save

    rows = [(" ".join([*(f"w{i}x{j}" for j in range(12)), *(f"{'good' if i % 2 else 'bad'}{j}" for j in range(4))]), i % 2) for i in range(8000)]
    models, scores = train(spark.createDataFrame(rows, "chunk string, t int").repartition(8), ["t"], "rf", trees=10, depth=2)
    assert models["t"].stages[-1].getOrDefault("width") > 70_000 and 0 <= scores.first().f1 <= 1
    save(models, str(tmp_path))
    some = spark.createDataFrame(rows[:50], "chunk string, t int")
    tell = lambda m: [r.prediction for r in m["t"].transform(some).collect()]
    assert tell(load(str(tmp_path), ["t"])) == tell(models)
