"""Goldens and properties of the labelling operators."""

import pytest
from pyspark.sql import functions as F

from glossaloom.config import Project, RuleSet, SourceSpec, TagSet, tags_of
from glossaloom.jobs import JobRegistry, duration
from glossaloom.ml.train import classify, train
from glossaloom.operators import dataset, embed, explore, extract, metadata, rules, sample, trainset, validate

RECIPES = RuleSet.of(
    [("hour", 0, 0), ("slow", 0, 0), ("homemade", 0, 0), ("dough", 0, 0), ("1 hour", 1, 0), ("2 hours", 1, 1), ("3 hours", 1, 1), ("slow cooker", 1, 1), ("slowly pour", 1, 0), ("slow roast", 1, 1), ("unpackage the dough", 1, 0), ("roll the dough", 1, 1), ("homemade dough", 99, 1)],
    ["long"],
)


def tagged(spark, chunks, ruleset, **more):
    rows = spark.createDataFrame([(i, c if isinstance(c, list) else [c]) for i, c in enumerate(chunks)], "id long, chunks array<string>")
    return [r for r in rules.apply_rules(rows, ruleset, **more).orderBy("id").collect()]


def test_rules_golden(spark, monkeypatch):
    texts = ["slow roast the meat", "slowly pour the dough", "homemade dough slowly pour", "1 hour slow roast", "12 hours", "quick salad", []]
    expected = [1, 0, 1, 0, 1, 0, 0]
    assert [r.long for r in tagged(spark, texts, RECIPES)] == expected
    monkeypatch.setattr(rules, "CASE_RULES", 2)
    assert [r.long for r in tagged(spark, texts, RECIPES)] == expected


def test_regex_rules(spark, monkeypatch):
    r = RuleSet.of([("plain", 0, 0), (r"REGEX:::^(?P<n>\w+) x$", 5, 1)], ["t"])
    assert [x.t for x in tagged(spark, ["ab x", "ab x y", ["plain", "é x"]], r)] == [1, 0, 1]
    assert [x.t for x in tagged(spark, ["ab x", ["plain", "é x"]], r, strict_compat=True)] == [0, 1]
    monkeypatch.setattr(rules, "CASE_RULES", 1)
    assert [x.t for x in tagged(spark, ["ab x", "ab x y", ["plain", "é x"]], r)] == [1, 0, 1]


def test_rule_files_or(spark):
    a, b = RuleSet.of([("x", 0, 1)], ["t"]), RuleSet.of([("y", 0, 1, 1), ("y", 0, 0, 1)], ["t", "u"])
    found = tagged(spark, ["x", "y", "x y", "z"], [a, b])
    assert [(r.t, r.u) for r in found] == [(1, 0), (0, 1), (1, 1), (0, 0)]
    assert tags_of([a, b]) == ["t", "u"]


def test_extract(spark):
    rows = spark.createDataFrame([(1, "HOUR by HOUR", "a"), (2, "one hour, two hour", "b"), (3, None, "c"), (4, "an hour", None), (5, "an hour", "")], "id long, text string, meta string")
    found = extract.extract(rows, ["hour"], 1).collect()
    assert [(r.id, r.chunks) for r in found] == [(2, ["one hour two", "two hour"])]
    assert {r.id for r in extract.keyword_gate(rows, ["hour"], ignore_case=True).collect()} == {1, 2, 4, 5}
    text = extract.to_text(extract.extract(rows, ["hour"], 1))
    assert text.first().text == "one hour two|two hour"
    assert extract.from_text(text).first().chunks == ["one hour two", "two hour"]
    for r in extract.exploded(extract.extract(rows, ["hour"], 2)).collect():
        assert "hour" in r.chunk and len(r.chunk.split()) <= 5
    assert extract.extract(rows.where("false"), ["hour"]).collect() == []


def plain_negatives(chunks, ruleset):
    """Matches, and of the chunks without any rule's text those before which a rule has more matches than its negatives cost."""
    free = [i for i, c in enumerate(chunks) if all(r.text not in c for r in ruleset.rules)]
    none = dict.fromkeys(ruleset.tags, 0)
    found = []
    for rule in ruleset.rules:
        hits = [i for i, c in enumerate(chunks) if rule.text in c]
        taken: list[int] = []
        for i in free:
            if sum(h < i for h in hits) > len(taken) * len(ruleset.tags):
                taken.append(i)
        found += [(i, rule.text, rule.encoding) for i in hits] + [(i, rule.text, none) for i in taken]
    return found


@pytest.mark.parametrize("tags", [["k"], ["k", "l"], ["k", "l", "m"]])
def test_negative_sampling(spark, tags):
    ruleset = RuleSet.of([("A", 1, *[1] * len(tags)), ("B", 2, *[0] * len(tags))], tags)
    chunks = ["x", "A", "y", "z", "A", "AB", "y", "y", "y", "B", "q"]
    rows = spark.createDataFrame([(1, chunks), (2, []), (3, None)], "id long, chunks array<string>")
    found = trainset.training_set(rows, ruleset, negatives=True, keep=["id"]).collect()
    assert sorted((r.pos, r.rule, tuple(r[t] for t in tags)) for r in found) == sorted((i, rule, tuple(e[t] for t in tags)) for i, rule, e in plain_negatives(chunks, ruleset))


def test_training_dedupe(spark):
    rows = spark.createDataFrame([(1, "s", ["A B", "A"]), (2, "s", ["A B"])], "id long, src string, chunks array<string>")
    found = trainset.training_set(rows, RuleSet.of([("A", 1, 0), ("B", 2, 1)], ["t"]), keep=["id", "src"])
    best = trainset.dedupe(found, ["id", "pos"], ["src"]).orderBy("chunk").collect()
    assert [(r.id, r.chunk, r.rule, r.t) for r in best] == [(1, "A", "A", 0), (1, "A B", "B", 1)]


def test_quota_golden(spark):
    counts = spark.createDataFrame([("r1", 90), ("r2", 10)], "rule string, count long")
    assert {r.rule: r.quota for r in validate.quotas(counts, 100, 5).collect()} == {"r1": 90, "r2": 10}
    train_rows = spark.createDataFrame([(i, f"r{1 + (i >= 90)}", 1) for i in range(100)], "id long, rule string, t int")
    sampled = validate.validation_sample(train_rows, 50, 5, key=["id"])
    assert 0 < sampled.count() <= 60 and {r.truth for r in sampled.collect()} == {None}
    assert validate.quotas(counts.where("false")).collect() == []


def test_scores(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (1, 1)], "truth int, predicted int")
    r = validate.score(rows).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (0.6, 0.667, 0.667, 0.667)
    empty = validate.score(rows.where("truth = 0 and predicted = 0")).first()
    assert (empty.accuracy, empty.precision, empty.f1) == (1.0, 0.0, 0.0)
    assert [(x.label, x.n, x.pct) for x in validate.confusion_matrix(rows).collect()] == [("TN", 1, 20.0), ("FP", 1, 20.0), ("FN", 1, 20.0), ("TP", 2, 40.0)]
    both = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "id long, a int, b int")
    assert {x["class"]: x.accuracy for x in validate.score_all(both, both, ["a", "b"]).collect()} == {"a": 1.0, "b": 1.0}


def test_samples(spark):
    df = spark.range(200).withColumn("src", F.when(F.col("id") < 150, "a").otherwise("b"))
    assert sample.sample_rows(df, 10, key=["id"]).count() == 20
    by = {r.src: r["count"] for r in sample.sample_rows_by(df, "src", 10, key=["id"]).groupBy("src").count().collect()}
    assert by == {"a": 15, "b": 5}
    a, b = sample.split(df, 80, key=["id"])
    assert a.count() + b.count() == 200 and 130 < a.count() < 190
    assert sample.sample_rows(df.where("false"), 10, key=["id"]).count() == 0


def test_explore(spark):
    rows = spark.createDataFrame([(["a k b", "a k b", "z"],), (["c k"],)], "chunks array<string>")
    counts = explore.chunk_counts(rows, ["k"])
    assert [(r.chunk, r["count"]) for r in explore.top_chunks(counts, 5).collect()] == [("a k b", 2), ("c k", 1)]
    assert explore.random_chunks(counts, 50).count() == 2
    with pytest.raises(ValueError):
        explore.top_chunks(counts, 5000)
    assert explore.preview(counts, "RANDOM", 1).count() == 1
    assert [(r.pos, r.highlight) for r in explore.split_chunks(rows, ["z"]).collect()] == [(0, False), (1, False), (2, True), (0, False)]


def test_embeddings(spark):
    ruleset = RuleSet.of([("slow roast", 1, 1, 0), ("fast", 1, 0, 0)], ["long", "none"])
    rows = spark.createDataFrame([(1, ["slow roast", "slow boat", "quick"]), (2, ["quick"]), (3, None)], "id long, chunks array<string>")
    found = {r.id: r for r in embed.apply_embeddings(rows, [ruleset], TagSet({"long": ["slow"], "none": ["quick"]}), 0.6).collect()}
    assert found[1].long == 1 and found[1].long_evidence == ["slow roast"] and found[1].none == 0
    assert found[2].long == 0 and found[2].long_evidence == []
    vectors = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    first, second = vectors.select(embed.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert abs(first.c - 0.5**0.5) < 1e-12 and second.c is None


def test_dataset(spark):
    meta = spark.createDataFrame([(1, "x", "7"), (2, "y", "no"), (2, "z", "9"), (3, "w", "1")], "id long, name string, size string")
    tags = spark.createDataFrame([(1, 1), (1, 1), (9, 1)], "id long, T int")
    stored = spark.createDataFrame([(3,)], "id long")
    found = dataset.create_dataset(meta, tags, ["T"], {"id": "INTEGER", "name": "TEXT", "size": "INTEGER"}, stored=stored).orderBy("id").collect()
    assert [(r.id, r.name, r.size, r.t) for r in found] == [(1, "x", 7, 1), (2, "y", None, 0)]
    assert dataset.create_dataset(None, tags, ["T"], {"id": "INTEGER"}).count() == 2


def test_metadata(spark):
    files = spark.createDataFrame([("d", "b"), ("d", "a"), ("e", "c")], "dir string, filename string")
    assert sorted((r.id, r.filename) for r in metadata.metadata_ids(files).collect()) == [("d_0", "a"), ("d_1", "b"), ("e_0", "c")]
    assert metadata.common_columns([files, files.withColumn("x", F.lit(1)).drop("dir")]) == ["filename"]
    assert sorted((r.filename, r.change) for r in metadata.changes(files, files.where("dir = 'e'").union(files.where("dir = 'e'"))).collect()) == [("a", "removed"), ("b", "removed"), ("c", "added")]


def test_config(tmp_path):
    tags = TagSet({"a": ["x", "y"], "b": ["y", "z"]})
    tags.save(f"{tmp_path}/k.json")
    assert TagSet.load(f"{tmp_path}/k.json").all_keywords() == ["x", "y", "z"]
    made = RuleSet.new(tags, ["a", "b"]).added("x, y", 3, {"a": 1})
    made.save(f"{tmp_path}/r.csv", TagSet({"a": []}))
    again = RuleSet.load(f"{tmp_path}/r.csv")
    assert again.tags == ["a"] and [(r.text, r.priority, r.encoding["a"]) for r in again.rules] == [("x", 0, 0), ("y", 0, 0), ("z", 0, 0), ("x, y", 3, 1)]
    with pytest.raises(ValueError):
        SourceSpec("s", "id", ["text"], "text")
    Project(f"{tmp_path}/p/one").create()
    assert Project.all_in(f"{tmp_path}/p") == ["one"]


def test_jobs(tmp_path):
    log = JobRegistry(str(tmp_path), "ext")
    one, two = log.add("first", n=6), log.add("second")
    log.finish(one)
    assert [j["name"] for j in log.finished()] == ["first"] and log.exists("second") and two == "2"
    jobs = log.all()
    jobs[1]["owner"] = -1
    log._save(jobs)
    log.reconcile()
    assert log.all()[1]["status"] == "Failed"
    log.remove(one)
    assert not log.exists("first") and duration(3725) == "01:02:05"


@pytest.mark.parametrize("algorithm, options", [("nb", {}), ("rf", {"trees": 10, "depth": 5})])
def test_training(spark, algorithm, options, tmp_path):
    rows = [(i, f"good fine great item{i}" if i % 2 else f"bad poor awful item{i}", i % 2) for i in range(120)]
    models, scores = train(spark.createDataFrame(rows, "id long, chunk string, t int"), ["t"], algorithm, key=["id"], **options)
    assert scores.first().f1 > 0.9
    extracts = spark.createDataFrame([(1, ["good great one"]), (2, ["awful poor one"]), (3, ["other"])], "id long, chunks array<string>")
    assert {r.id: r.t for r in classify(extracts, models, {"t": ["one"]}).collect()} == {1: 1, 2: 0, 3: 0}


def test_training_share_and_document_sample(spark):
    rows = spark.createDataFrame([(i, ["A x"]) for i in range(50)], "id long, chunks array<string>")
    rules_of = RuleSet.of([("A", 1, 1)], ["t"])
    assert trainset.training_set(rows, rules_of, keep=["id"], percent=10).count() == 5
    with pytest.raises(ValueError):
        trainset.training_set(rows, rules_of, keep=["id"], percent=0)
    docs = spark.createDataFrame([(i, None if i % 2 else "Some: text 1", None) for i in range(300)], "id long, text string, other string")
    found = sample.sample_documents(docs, key=["id"], percent=10, most=20).collect()
    assert len(found) == 20 and {(r.text, r.other) for r in found} == {("", ""), ("Some. text", "")}
    assert len(sample.sample_documents(docs, key=["id"]).collect()) == 3
    assert [r[0] for r in spark.createDataFrame([("a  b c",), ("",)], "r string").select(rules.rule_words(F.col("r"))).collect()] == [3, 0]
