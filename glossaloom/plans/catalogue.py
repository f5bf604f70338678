"""The registered queries of the labelling operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import RuleSet, TagSet
from ..functions.clean import ENDS_OF_FILES, MARKS, MARKS_OF_FILES, PARTS_OF_WORDS, clean, clean_file, clean_sample, spell_digits, without_markup
from ..functions.tokens import trim_to_keyword
from ..ml.light import Light, classify_light
from ..ml.train import STOP, classify, train
from ..operators import dataset, embed, explore, extract, metadata, rules, sample, trainset, validate

TAGS = TagSet({"linking": ["that", "with"], "nominal": ["tion"], "legal": ["license", "License"]})
KEYS = ["that", "tion", "with"]
RULES_A = RuleSet.of(
    [("that", 0, 0, 0), ("with", 0, 0, 0), ("tion", 0, 0, 0), ("with the", 1, 1, 0), ("that the", 1, 1, 0), ("ation", 1, 0, 1), ("REGEX:::tion (of|in)", 2, 0, 1)],
    ["linking", "nominal"],
    "rules_a",
)
RULES_STRINGS = RuleSet.of([(r.text, r.priority, r.encoding["linking"], r.encoding["nominal"]) for r in RULES_A.rules[:6]], ["linking", "nominal"], "strings")
RULES_REGEX = RuleSet.of([("REGEX:::tion (of|in)", 2, 0, 1), ("REGEX:::^th[a-z]+ ", 1, 1, 0)], ["linking", "nominal"], "regex")
RULES_TIES = RuleSet.of([("that", 1, 1, 0), ("tion", 1, 0, 1), ("with", 1, 1, 1)], ["linking", "nominal"], "ties")
RULES_LONG = RuleSet.of([("with the", 1, 1, 0), ("that the", 1, 1, 0), ("ation", 1, 0, 1), ("REGEX:::tion (of|in)", 2, 0, 1)], ["linking", "nominal"], "long")
RULES_B = RuleSet.of([("license", 0, 0, 0), ("mit license", 1, 0, 1), ("tion is", 1, 1, 0)], ["nominal", "legal"], "rules_b")
ABBREVIATIONS = {"nd.": "and", "es.": "is"}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registrar(queries: dict[str, Query], sql_texts: dict[str, str]):
    def query(name: str, sql: str | None = None):
        def register(f: Query) -> Query:
            queries[name] = f
            if sql is not None:
                sql_texts[name] = sql
            return f

        return register

    return query


query = registrar(QUERIES, SQL)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", "source", "text")


def _extracts(spark: SparkSession, sf: str, n: int = 6, keys=KEYS, mode: str = "word") -> DataFrame:
    return extract.extract(_docs(spark, sf), keys, n, mode=mode)


# SQL of the steps that queries share ------------------------------------------------------------------------------

_LETTER = r"(^|[^\p{L}\p{N}_])[b-hj-zA-Z]([^\p{L}\p{N}_]|$)"


def _sql_head(t: str) -> str:
    t = f"CASE WHEN contains({t}, '&') THEN trim({t}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE {t} END"
    t = rf"regexp_replace({t}, 'www\S+', ' ', 'g')"
    for _ in range(2):
        t = rf"regexp_replace({t}, '{_LETTER}', '\1 \2', 'g')"
    return rf"regexp_replace({t}, '\p{{Nd}}+', ' ', 'g')"


def _sql_replace(t: str, *pairs: tuple[str, str]) -> str:
    for a, b in pairs:
        t = f"replace({t}, '{a}', '{b}')"
    return t


def _sql_ascii(t: str) -> str:
    return rf"regexp_replace({t}, '[^\x00-\x7F]', '', 'g')"


def _sql_clean(t: str) -> str:
    return _sql_replace(_sql_ascii(_sql_replace(_sql_head(t), *MARKS)), *PARTS_OF_WORDS)


def _sql_any(x: str, keys) -> str:
    return "(" + " OR ".join(f"contains({x}, '{k}')" for k in keys) + ")"


def _sql_extract(n: int = 6, keys=KEYS, mode: str = "word") -> str:
    """CTE ``e`` (doc_id, source, chunks)."""
    if mode == "word":
        words = "list_filter(string_split(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    else:
        words = "list_transform(string_split(regexp_replace(regexp_replace(lower(c), '[^a-z0-9.!?]+', ' ', 'g'), '[.?!]', '. ', 'g'), '.'), lambda x: trim(x))"
    return f"""
g AS (SELECT doc_id, source, {_sql_clean("text")} AS c FROM documents WHERE {_sql_any("text", keys)}),
w AS (SELECT doc_id, source, {words} AS w FROM g),
e AS (SELECT * FROM (SELECT doc_id, source, list_transform(list_filter(range(1, len(w) + 1), lambda i: {_sql_any("w[i]", keys)}), lambda i: array_to_string(w[greatest(i - {n}, 1):i + {n}], ' ')) AS chunks FROM w) WHERE len(chunks) > 0)"""


def _sql_hit(rule, chunk: str) -> str:
    return f"regexp_matches({chunk}, '{rule.pattern.removeprefix('(?U)')}')" if rule.pattern else f"contains({chunk}, '{rule.text}')"


def _sql_tags(rules: RuleSet) -> str:
    """CASE expression of each tag over ``chunks``."""
    won = "CASE " + " ".join(f"WHEN len(list_filter(chunks, lambda c: {_sql_hit(r, 'c')})) > 0 THEN {i}" for i, r in enumerate(rules.by_priority)) + " ELSE -1 END"
    return ", ".join(f"(CASE WHEN ({won}) IN ({', '.join(str(i) for i, r in enumerate(rules.by_priority) if r.encoding[t]) or '-2'}) THEN 1 ELSE 0 END)::INT AS {t}" for t in rules.tags)


def _sql_train(rules: RuleSet, n: int = 6, keys=KEYS) -> str:
    """CTE ``t`` (doc_id, source, pos, chunk, rule, ord, match, tags): positives."""
    rows = ", ".join(f"('{r.text}', {r.order}, {r.priority}, {', '.join(str(r.encoding[t]) for t in rules.tags)})" for r in rules.rules)
    hit = "CASE ord " + " ".join(f"WHEN {r.order} THEN {_sql_hit(r, 'chunk')}" for r in rules.rules) + " END"
    return f"""{_sql_extract(n, keys)},
x AS (SELECT doc_id, source, unnest(range(len(chunks))) AS pos, unnest(chunks) AS chunk FROM e),
r(rule, ord, match, {", ".join(rules.tags)}) AS (VALUES {rows}),
t AS (SELECT doc_id, source, pos::INT AS pos, chunk, rule, ord::INT AS ord, match::INT AS match, {", ".join(f"{t}::INT AS {t}" for t in rules.tags)} FROM x CROSS JOIN r WHERE {hit})"""


def _sql_negatives(rules: RuleSet) -> str:
    """Positives and sampled negatives. The nth chunk without any rule's text is taken if fewer were taken than the share
    ``c`` that the matches before it pay for; with n - c bounded from above, their number is a running minimum."""
    k, tags = len(rules.tags), ", ".join(rules.tags)
    rows = ", ".join(f"('{r.text}', {r.order}, {r.priority}, {', '.join(str(r.encoding[t]) for t in rules.tags)})" for r in rules.rules)
    hit = "CASE ord " + " ".join(f"WHEN {r.order} THEN {_sql_hit(r, 'chunk')}" for r in rules.rules) + " END"
    return f"""WITH {_sql_extract()},
x AS (SELECT doc_id, source, unnest(range(len(chunks))) AS pos, unnest(chunks) AS chunk FROM e),
r(rule, ord, match, {tags}) AS (VALUES {rows}),
a AS (SELECT *, {hit} AS hit, {_sql_any("chunk", [r.text for r in rules.rules])} AS told FROM x CROSS JOIN r),
h AS (SELECT *, coalesce(sum(hit::INT) OVER (PARTITION BY doc_id, ord ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY pos) AS i, ceil(before / {k}) AS c FROM h WHERE NOT hit AND NOT told),
m AS (SELECT *, i + least(0, min(c - i) OVER (PARTITION BY doc_id, ord ORDER BY pos)) AS taken FROM n),
o AS (SELECT *, lag(taken, 1, 0) OVER (PARTITION BY doc_id, ord ORDER BY pos) AS earlier FROM m)
SELECT doc_id, source, pos::INT AS pos, chunk, rule, ord::INT AS ord, match::INT AS match, {", ".join(f"{t}::INT AS {t}" for t in rules.tags)} FROM a WHERE hit
UNION ALL SELECT doc_id, source, pos::INT, chunk, rule, ord::INT, match::INT, {", ".join("0" for _ in rules.tags)} FROM o WHERE taken > earlier"""


# Gates, cleaning, extraction --------------------------------------------------------------------------------------


@query("keyword_gate", "SELECT doc_id, source FROM documents WHERE contains(text, 'license')")
def keyword_gate(spark, sf):
    return extract.keyword_gate(_docs(spark, sf), ["license"]).select("doc_id", "source")


@query("keyword_gate_case", "SELECT doc_id, source FROM documents WHERE contains(lower(text), 'license')")
def keyword_gate_case(spark, sf):
    return extract.keyword_gate(_docs(spark, sf), ["License"], ignore_case=True).select("doc_id", "source")


@query("clean_text", f"SELECT doc_id, {_sql_clean('text')} AS cleaned FROM documents")
def clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", clean(F.col("text")).alias("cleaned"))


_COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


@query("clean_text_sample", f"SELECT doc_id, {_sql_ascii(_sql_replace(_COLLAPSE.format(_sql_head('text')), *MARKS))} AS cleaned FROM documents")
def clean_text_sample(spark, sf):
    return _docs(spark, sf).select("doc_id", clean_sample(F.col("text")).alias("cleaned"))


_PDF_TOKENS = r"regexp_replace(" + _sql_replace(_COLLAPSE.format("regexp_replace(" + _sql_ascii(_sql_replace(_sql_head("text"), *MARKS_OF_FILES)) + r", '[^0-9a-zA-Z.?! ]+', ' ', 'g')"), *ENDS_OF_FILES) + r", '\.{2,}', '.', 'g')"


@query("clean_text_pdf", rf"""
WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split({_PDF_TOKENS}, ' '), lambda x: CASE lower(x) WHEN 'nd.' THEN 'and' WHEN 'es.' THEN 'is' ELSE x END), ' ') AS x FROM documents),
u AS (SELECT doc_id, regexp_replace(x, '(^|[^0-9A-Za-z_])([A-Za-z])\.', '\1\2', 'g') AS x FROM t)
SELECT doc_id, lower(x) AS cleaned FROM u""")
def clean_text_pdf(spark, sf):
    return _docs(spark, sf).select("doc_id", clean_file(F.col("text"), ABBREVIATIONS).alias("cleaned"))


@query("html_to_text")
def html_to_text(spark, sf):
    return _table(spark, sf, "pages").select("page_id", without_markup(F.col("html")).alias("text"))


@query("digits_to_words")
def digits_to_words(spark, sf):
    return _docs(spark, sf).select("doc_id", spell_digits(F.col("text")).alias("text"))


def _extract_query(n: int, mode: str):
    def run(spark, sf):
        return extract.to_text(_extracts(spark, sf, n, mode=mode))

    return run


for _name, _n, _mode in (("extract_word_n6", 6, "word"), ("extract_word_n2", 2, "word"), ("extract_sentence_n1", 1, "sentence")):
    query(_name, f"WITH {_sql_extract(_n, KEYS, _mode)} SELECT doc_id, source, array_to_string(chunks, '|') AS text FROM e")(_extract_query(_n, _mode))


@query("extract_exploded", f"WITH {_sql_extract()} SELECT doc_id, source, unnest(range(len(chunks)))::INT AS pos, unnest(chunks) AS chunk FROM e")
def extract_exploded(spark, sf):
    return extract.exploded(_extracts(spark, sf))


@query("highlight_chunks", f"WITH {_sql_extract()}, x AS (SELECT doc_id, source, unnest(range(len(chunks)))::INT AS pos, unnest(chunks) AS chunk FROM e) SELECT *, contains(chunk, 'that') AS highlight FROM x")
def highlight_chunks(spark, sf):
    return explore.split_chunks(_extracts(spark, sf), ["that"])


# Rules ------------------------------------------------------------------------------------------------------------


def _rules_query(ruleset: RuleSet):
    def run(spark, sf):
        return rules.apply_rules(_extracts(spark, sf), ruleset).drop("chunks")

    return run


for _name, _rules in (("extrapolate_string", RULES_STRINGS), ("extrapolate_regex", RULES_REGEX), ("extrapolate_mixed", RULES_A), ("extrapolate_priority_ties", RULES_TIES)):
    query(_name, f"WITH {_sql_extract()} SELECT doc_id, source, {_sql_tags(_rules)} FROM e")(_rules_query(_rules))


@query("extrapolate_multi_rulefile", f"""WITH {_sql_extract(keys=TAGS.all_keywords())},
a AS (SELECT doc_id, source, {_sql_tags(RULES_A)} FROM e), b AS (SELECT doc_id, {_sql_tags(RULES_B)} FROM e)
SELECT a.doc_id, source, linking, greatest(a.nominal, b.nominal)::INT AS nominal, legal FROM a JOIN b ON a.doc_id = b.doc_id""")
def extrapolate_multi_rulefile(spark, sf):
    return rules.apply_rules(_extracts(spark, sf, keys=TAGS.all_keywords()), [RULES_A, RULES_B]).drop("chunks")


@query("embedding_evidence")
def embedding_evidence(spark, sf):
    return embed.apply_embeddings(_extracts(spark, sf), [RULES_A], TAGS, 0.2).select("doc_id", *TAGS.keywords, *(F.array_join(f"{t}_evidence", "|").alias(f"{t}_evidence") for t in TAGS.keywords))


# Many rules: the words and pairs of words of the benchmark, which are some thousand -------------------------------------

_MANY = """r AS (SELECT rule, CASE WHEN contains(rule, ' ') THEN 2 ELSE length(rule) % 2 END AS prio, (md5(rule) < '8')::INT AS nominal, (md5(rule) >= '8')::INT AS linking
FROM (SELECT DISTINCT unnest(list_concat(regexp_extract_all(lower(text), '[a-z]{4,}'), regexp_extract_all(lower(text), '[a-z]+ [a-z]+'))) AS rule FROM benchmark)),
k AS (SELECT *, row_number() OVER (ORDER BY rule) AS ord FROM r)"""


def _many_rules(spark, sf) -> RuleSet:
    """A rule file made from the benchmark, which has some hundred items whatever the corpus."""
    words = lambda pattern: F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))
    rows = _table(spark, sf, "benchmark").select(F.explode(F.concat(words("[a-z]{4,}"), words("[a-z]+ [a-z]+"))).alias("rule")).distinct()
    low = (F.md5("rule") < "8").cast("int")
    rows = rows.select("rule", F.when(F.col("rule").contains(" "), 2).otherwise(F.length("rule") % 2).alias("prio"), (1 - low).alias("linking"), low.alias("nominal"))
    return RuleSet.of(sorted(tuple(r) for r in rows.collect()), ["linking", "nominal"], "many")


@query("extrapolate_many_rules", f"""WITH {_sql_extract()}, {_MANY}, x AS (SELECT DISTINCT doc_id, unnest(chunks) AS chunk FROM e),
best AS (SELECT doc_id, first(linking ORDER BY prio DESC, ord) AS linking, first(nominal ORDER BY prio DESC, ord) AS nominal FROM x JOIN k ON contains(chunk, rule) GROUP BY doc_id)
SELECT doc_id, source, coalesce(linking, 0)::INT AS linking, coalesce(nominal, 0)::INT AS nominal FROM e LEFT JOIN best USING (doc_id)""")
def extrapolate_many_rules(spark, sf):
    return rules.apply_rules(_extracts(spark, sf), _many_rules(spark, sf)).drop("chunks")


@query("trainset_many_rules", f"""WITH {_sql_extract()}, {_MANY}, x AS (SELECT doc_id, source, unnest(range(len(chunks)))::INT AS pos, unnest(chunks) AS chunk FROM e)
SELECT doc_id, source, pos, rule, count(*) OVER (PARTITION BY rule) AS uses, prio::INT AS match, linking, nominal FROM x JOIN k ON contains(chunk, rule)""")
def trainset_many_rules(spark, sf):
    found = trainset.training_set(_extracts(spark, sf), _many_rules(spark, sf), keep=["doc_id", "source"]).drop("ord", "chunk")
    uses = found.groupBy("rule").agg(F.count("*").alias("uses"))
    return found.join(F.broadcast(uses), "rule")  # a row for each rule, so no row of the others moves


# Training rows ----------------------------------------------------------------------------------------------------

_TRAIN = "doc_id, source, pos, chunk, rule, ord, match, linking, nominal"


def _train(spark, sf, negatives=False):
    return trainset.training_set(_extracts(spark, sf), RULES_LONG if negatives else RULES_A, negatives=negatives, keep=["doc_id", "source"])


@query("trainset_positive", f"WITH {_sql_train(RULES_A)} SELECT {_TRAIN} FROM t")
def trainset_positive(spark, sf):
    return _train(spark, sf)


@query("trainset_dedupe", f"WITH {_sql_train(RULES_A)} SELECT {_TRAIN} FROM (SELECT *, row_number() OVER (PARTITION BY source, chunk ORDER BY match DESC, ord, doc_id, pos) AS n FROM t) WHERE n = 1")
def trainset_dedupe(spark, sf):
    return trainset.dedupe(_train(spark, sf), ["doc_id", "pos"], ["source"])


@query("trainset_negative", _sql_negatives(RULES_LONG))
def trainset_negative(spark, sf):
    return _train(spark, sf, negatives=True)


# Exploration and samples ------------------------------------------------------------------------------------------


@query("explore_chunks", f"WITH {_sql_extract()}, x AS (SELECT unnest(chunks) AS chunk FROM e) SELECT chunk, count(*) AS count FROM x WHERE contains(chunk, 'that') GROUP BY chunk")
def explore_chunks(spark, sf):
    return explore.chunk_counts(_extracts(spark, sf), ["that"])


_TRIMMED = f"""WITH {_sql_extract()}, x AS (SELECT unnest(chunks) AS chunk FROM e), s AS (SELECT string_split(chunk, ' ') AS s FROM x WHERE {_sql_any("chunk", KEYS)}),
m AS (SELECT array_to_string(s[greatest(len(s) // 2 - 1, 0) + 1:len(s) // 2 + 2], ' ') AS chunk FROM s), c AS (SELECT chunk, count(*) AS count FROM m GROUP BY chunk)"""


@query("explore_trimmed", _TRIMMED + " SELECT chunk, count FROM c")
def explore_trimmed(spark, sf):
    return explore.chunk_counts(_extracts(spark, sf), KEYS, 1)


@query("explore_top_chunks", _TRIMMED + " SELECT chunk, count FROM c ORDER BY count DESC, chunk LIMIT 100")
def explore_top_chunks(spark, sf):
    return explore.top_chunks(explore_trimmed(spark, sf), 100)


@query("explore_random", _TRIMMED + " SELECT chunk, count FROM c ORDER BY md5('42' || chunk), chunk LIMIT 100")
def explore_random(spark, sf):
    return explore.random_chunks(explore_trimmed(spark, sf), 100)


@query("preview_first", "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 100")
def preview_first(spark, sf):
    return explore.preview(_table(spark, sf, "documents").select("doc_id", "lang", "source"), x=100, order=["doc_id"])


@query("preview_random", "SELECT doc_id, lang, source FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 100")
def preview_random(spark, sf):
    return explore.preview(_table(spark, sf, "documents").select("doc_id", "lang", "source"), "RANDOM", 100, key=["doc_id"])


_WORDS = "SELECT word AS chunk, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY word ORDER BY count DESC, chunk LIMIT 50"


@query("explore_frequent_words", _WORDS)
def explore_frequent_words(spark, sf):
    words = _docs(spark, sf).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("chunk"))
    return explore.frequent_chunks(words, 50)


@query("highlight_table", f"WITH {_sql_extract()} SELECT doc_id, array_to_string(list_filter(range(1, len(chunks) + 1), lambda i: contains(chunks[i], 'that')), ',') AS marked, chunks[1] AS chunk_1, chunks[2] AS chunk_2 FROM e ORDER BY md5('42|' || doc_id), doc_id LIMIT (SELECT floor(count(*) * 0.1 + 0.5)::BIGINT FROM e)")
def highlight_table(spark, sf):
    found = explore.highlight_table(_extracts(spark, sf), ["that"], key=["doc_id"])
    return found.select("doc_id", F.array_join("marked", ",").alias("marked"), "chunk_1", "chunk_2")


@query("sampled_ids", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def sampled_ids(spark, sf):
    return sample.by_ids(_docs(spark, sf).select("doc_id", "source"), _table(spark, sf, "labels").where("toxic = 1"), id="doc_id")


@query("sample_rows", "SELECT doc_id, source FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT (SELECT floor(count(*) * 0.1 + 0.5)::BIGINT FROM documents)")
def sample_rows(spark, sf):
    return sample.sample_rows(_docs(spark, sf).select("doc_id", "source"), 10, key=["doc_id"])


@query("sample_per_source", """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY source) AS c FROM documents)
WHERE r <= floor(c * 0.1 + 0.5)""")
def sample_per_source(spark, sf):
    return sample.sample_rows_by(_docs(spark, sf).select("doc_id", "source"), "source", 10, key=["doc_id"])


@query("sample_files", "SELECT url FROM pages ORDER BY md5('42|' || url), url LIMIT (SELECT floor(count(*) * 0.1)::BIGINT FROM pages)")
def sample_files(spark, sf):
    return sample.sample_files(_table(spark, sf, "pages").select("url"), 10, path="url")


@query("split_train", "SELECT doc_id, CASE WHEN ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT * 100 < 80 * 4294967296 THEN 'train' ELSE 'test' END AS part FROM documents")
def split_train(spark, sf):
    a, b = sample.split(_docs(spark, sf).select("doc_id"), 80, key=["doc_id"])
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))


# Validation -------------------------------------------------------------------------------------------------------

_QUOTA = f"""WITH {_sql_train(RULES_A)}, c AS (SELECT rule, count(*) AS count FROM t GROUP BY rule),
v AS (SELECT rule, count, 100 + 5 * (SELECT count(*) FROM c) AS wanted, floor(count / (SELECT sum(count) FROM c) * (100 + 5 * (SELECT count(*) FROM c)) + 5) AS v FROM c),
q AS (SELECT rule, count, (CASE WHEN v > 5 THEN greatest(floor((v - 5) / (SELECT sum(v) FROM v WHERE v > 5) * wanted), 5) ELSE v END)::BIGINT AS quota FROM v)"""


@query("rule_counts", f"WITH {_sql_train(RULES_A)} SELECT rule, count(*) AS count FROM t GROUP BY rule")
def rule_counts(spark, sf):
    return validate.rule_counts(_train(spark, sf))


@query("validation_quota", _QUOTA + " SELECT rule, count, quota FROM q")
def validation_quota(spark, sf):
    return validate.quotas(rule_counts(spark, sf))


@query("validation_sample", _QUOTA + f""", k AS (SELECT t.*, row_number() OVER (PARTITION BY rule ORDER BY md5('42|' || doc_id || '|' || pos || '|' || ord), doc_id, pos, ord) AS r FROM t)
SELECT {_TRAIN} FROM k JOIN q USING (rule) WHERE r <= quota""")
def validation_sample(spark, sf):
    return validate.validation_sample(_train(spark, sf), key=["doc_id", "pos", "ord"]).drop("truth")


_SCORED = f"WITH {_sql_extract()}, p AS (SELECT l.quality AS truth, linking AS predicted FROM labels l JOIN (SELECT doc_id, {_sql_tags(RULES_A)} FROM e) USING (doc_id)), c AS (SELECT count(*) FILTER (truth = 1 AND predicted = 1) AS tp, count(*) FILTER (truth = 0 AND predicted = 1) AS fp, count(*) FILTER (truth = 1 AND predicted = 0) AS fn, count(*) FILTER (truth = 0 AND predicted = 0) AS tn FROM p)"


def _scored(spark, sf):
    tagged = rules.apply_rules(_extracts(spark, sf), RULES_A).select("doc_id", F.col("linking").alias("predicted"))
    return _table(spark, sf, "labels").select("doc_id", F.col("quality").alias("truth")).join(tagged, "doc_id")


@query("score_metrics", _SCORED + " SELECT round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 3) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 3) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 3) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 3) AS f1 FROM c")
def score_metrics(spark, sf):
    return validate.score(_scored(spark, sf))


@query("confusion_matrix", _SCORED + ", u AS (SELECT unnest(['TN', 'FP', 'FN', 'TP']) AS label, unnest([tn, fp, fn, tp]) AS n, tp + fp + fn + tn AS a FROM c) SELECT label, n, round(coalesce(n * 100.0 / nullif(a, 0), 0), 2)::DOUBLE AS pct FROM u")
def confusion_matrix(spark, sf):
    return validate.confusion_matrix(_scored(spark, sf))


# Rule files and metadata ------------------------------------------------------------------------------------------


@query("new_rule_file", "SELECT DISTINCT unnest(['that', 'with', 'tion']) AS rule, 0 AS prio, 0 AS linking, 0 AS nominal")
def new_rule_file(spark, sf):
    table = spark.createDataFrame([(t, k) for t, keys in TAGS.keywords.items() for k in keys], "tag string, keyword string")
    return metadata.new_rule_file(table, ["linking", "nominal"])


@query("metadata_ids", "SELECT source || '_' || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) AS id, doc_id::VARCHAR AS filename FROM (SELECT source, doc_id::VARCHAR AS doc_id FROM documents)")
def metadata_ids(spark, sf):
    files = _docs(spark, sf).select(F.col("source").alias("dir"), F.col("doc_id").cast("string").alias("filename"))
    return metadata.metadata_ids(files)


@query("table_changes", "(SELECT doc_id, quality, 'removed' AS change FROM labels WHERE toxic = 1) UNION ALL (SELECT doc_id, 1 - quality AS quality, 'added' AS change FROM labels WHERE toxic = 1)")
def table_changes(spark, sf):
    labels = _table(spark, sf, "labels")
    before = labels.select("doc_id", "quality")
    return metadata.changes(before, labels.select("doc_id", F.when(F.col("toxic") == 1, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality")))


@query("cell_changes", """WITH b AS (SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1)
SELECT doc_id, 1 AS nth, unnest(['quality', 'toxic']) AS "column", unnest([quality::VARCHAR, toxic::VARCHAR]) AS old, NULL::VARCHAR AS new, 'removed' AS change FROM b WHERE quality = 0
UNION ALL SELECT doc_id, 1, 'quality', quality::VARCHAR, NULL, 'changed' FROM b WHERE quality <> 0
UNION ALL SELECT -1 - doc_id, 1, unnest(['quality', 'toxic']), NULL, unnest([quality::VARCHAR, toxic::VARCHAR]), 'added' FROM b""")
def cell_changes(spark, sf):
    """Toxic documents of low quality go, those of high quality lose it, and each toxic one is added once more."""
    labels = _table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    after = labels.where("NOT (toxic = 1 AND quality = 0)").withColumn("quality", F.when(F.col("toxic") == 0, F.col("quality")))
    added = labels.where("toxic = 1").withColumn("doc_id", -1 - F.col("doc_id"))
    return metadata.cell_changes(labels, after.unionByName(added), ["doc_id"])


@query("row_counts", "SELECT 'documents' AS name, count(*) AS rows FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'labels', count(*) FROM labels")
def row_counts(spark, sf):
    return metadata.row_counts({t: _table(spark, sf, t) for t in ("documents", "pages", "labels")})


@query("common_columns", "SELECT unnest(['text']) AS name")
def common_columns(spark, sf):
    names = metadata.common_columns([_table(spark, sf, t) for t in ("documents", "conversations", "benchmark")])
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("union_inputs", "SELECT 'documents' AS parent, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id || '_' || turn, text FROM conversations UNION ALL SELECT 'benchmark', item_id::VARCHAR, text FROM benchmark")
def union_inputs(spark, sf):
    of = lambda t, key: _table(spark, sf, t).select(F.lit(t).alias("parent"), key.cast("string").alias("id"), "text")
    return of("documents", F.col("doc_id")).unionByName(of("conversations", F.concat_ws("_", "conv_id", "turn"))).unionByName(of("benchmark", F.col("item_id")))


# Datasets ---------------------------------------------------------------------------------------------------------


def _tagged(spark, sf):
    return rules.apply_rules(_extracts(spark, sf), RULES_A).drop("chunks")


_META = f"WITH {_sql_extract()}, g2 AS (SELECT doc_id, {_sql_tags(RULES_A)} FROM e)"


@query("metadata_join", _META + " SELECT l.doc_id, quality, coalesce(linking, 0)::INT AS linking, coalesce(nominal, 0)::INT AS nominal FROM labels l LEFT JOIN g2 USING (doc_id)")
def metadata_join(spark, sf):
    return dataset.join_metadata(_table(spark, sf, "labels").select("doc_id", "quality"), _tagged(spark, sf), RULES_A.tags, id="doc_id")


@query("existing_antijoin", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def existing_antijoin(spark, sf):
    return dataset.not_stored(_docs(spark, sf).select("doc_id", "source"), _table(spark, sf, "labels"), id="doc_id")


@query("dedupe_first", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM conversations) WHERE n = 1")
def dedupe_first(spark, sf):
    return dataset.keep_first(_table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["turn", "role"], id="conv_id")


@query("dataset_final", _META + " SELECT d.doc_id, d.source, d.n_chars::DOUBLE AS n_chars, coalesce(linking, 0)::INT AS linking, coalesce(nominal, 0)::INT AS nominal FROM documents d LEFT JOIN g2 USING (doc_id) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def dataset_final(spark, sf):
    stored = _table(spark, sf, "labels").where("toxic = 1")
    return dataset.create_dataset(_table(spark, sf, "documents").select("doc_id", "source", "n_chars"), _tagged(spark, sf), RULES_A.tags, {"doc_id": "INTEGER", "source": "TEXT", "n_chars": "REAL"}, id="doc_id", stored=stored)


# Vectors ----------------------------------------------------------------------------------------------------------


def _means(spark, sf):
    long = _table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "value"))
    return long.groupBy("label", "pos").agg(F.avg(F.col("value").cast("double")).alias("mean"))


_MEANS = "m AS (SELECT label, pos, avg(value) AS mean FROM (SELECT label, unnest(range(len(embedding)))::INT AS pos, unnest(embedding)::DOUBLE AS value FROM embeddings) GROUP BY label, pos)"


@query("embedding_class_vector", f"WITH {_MEANS} SELECT label, pos, round(mean, 6) AS mean FROM m")
def embedding_class_vector(spark, sf):
    return _means(spark, sf).select("label", "pos", F.round("mean", 6).alias("mean"))


@query("embedding_cosine_match", f"""WITH {_MEANS}, c AS (SELECT label AS class, list(mean ORDER BY pos) AS vector FROM m GROUP BY label),
s AS (SELECT vec_id, label, class, list_cosine_similarity(embedding::DOUBLE[], vector) AS cosine FROM embeddings CROSS JOIN c)
SELECT vec_id, label, class, round(cosine, 6) AS cosine, (cosine > 0.6)::INT AS tag FROM s""")
def embedding_cosine_match(spark, sf):
    classes = _means(spark, sf).groupBy(F.col("label").alias("class")).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("v"))
    classes = classes.select("class", F.transform("v", lambda x: x["mean"]).alias("vector"))
    told = embed.cosines(_table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), classes, "c")
    pairs = told.select("vec_id", "label", F.inline("c"))
    return pairs.select("vec_id", "label", "class", F.round("cosine", 6).alias("cosine"), (F.col("cosine") > 0.6).cast("int").alias("tag"))


@query("embedding_best_class", f"""WITH {_MEANS}, c AS (SELECT label AS class, list(mean ORDER BY pos) AS vector FROM m GROUP BY label),
s AS (SELECT vec_id, label, class, list_cosine_similarity(embedding::DOUBLE[], vector) AS cosine FROM embeddings CROSS JOIN c)
SELECT vec_id, label, class, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, class) AS n FROM s) WHERE n = 1""")
def embedding_best_class(spark, sf):
    classes = _means(spark, sf).groupBy(F.col("label").alias("class")).agg(F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("v"))
    classes = classes.select("class", F.transform("v", lambda x: x["mean"]).alias("vector"))
    found = embed.best_class(_table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), classes)
    return found.select("vec_id", "label", "class", F.round("cosine", 6).alias("cosine"))


# Trimming and classifiers -----------------------------------------------------------------------------------------


@query("proc_trim_keywords", f"""WITH {_sql_extract()}, x AS (SELECT doc_id, unnest(range(len(chunks)))::INT AS pos, unnest(chunks) AS chunk FROM e),
s AS (SELECT doc_id, pos, chunk, list_filter(string_split(chunk, ' '), lambda t: t <> 'the' AND t <> 'of') AS s FROM x),
i AS (SELECT *, list_min(list_concat(list_transform(list_filter(range(len(s)), lambda k: contains(s[k + 1], 'that')), lambda k: [abs(6 - k), 0, k]), list_transform(list_filter(range(len(s)), lambda k: contains(s[k + 1], 'tion')), lambda k: [abs(6 - k), 1, k]))) AS b FROM s),
j AS (SELECT *, coalesce(b[3], len(s) // 2) AS m FROM i)
SELECT doc_id, pos, array_to_string(s[greatest(m - 2, 0) + 1:least(length(chunk), m + 2) + 1], ' ') AS trimmed FROM j""")
def proc_trim_keywords(spark, sf):
    return extract.exploded(_extracts(spark, sf)).select("doc_id", "pos", trim_to_keyword(F.col("chunk"), ["that", "tion"], stop=["the", "of"]).alias("trimmed"))


def _metrics(spark, sf, algorithm):
    rows = trainset.dedupe(_train(spark, sf, negatives=True), ["doc_id", "pos"])
    return train(rows, ["linking", "nominal"], algorithm)


def _sql_bayes() -> str:
    """CTEs of the training in SQL: ``d`` (tag, word, weight), ``b`` (tag, bias), ``i`` (word, idf), ``k`` (chunk, label of each tag, part)."""
    stop = ", ".join(f"'{w}'" for w in STOP)
    both = " UNION ALL ".join(f"SELECT chunk, first, '{t}' AS tag, {t} AS y FROM k" for t in ("linking", "nominal"))
    return f"""t AS ({_sql_negatives(RULES_LONG)}),
k AS (SELECT *, ('0x' || substr(md5('42|' || chunk), 1, 8))::BIGINT * 100 < 80 * 4294967296 AS first FROM (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY match DESC, ord, doc_id, pos) AS n FROM t) WHERE n = 1),
f AS (SELECT chunk, first, word, count(*) AS tf FROM (SELECT chunk, first, unnest(regexp_extract_all(chunk, '[a-z0-9]{{2,}}')) AS word FROM k) WHERE word NOT IN ({stop}) GROUP BY ALL),
i AS (SELECT word, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM f, (SELECT count(*) AS n FROM k WHERE first) WHERE first GROUP BY word),
x AS (SELECT chunk, first, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY chunk)) AS v FROM f JOIN i USING (word)),
l AS ({both}),
s AS (SELECT tag, y, word, sum(v) AS s FROM x JOIN l USING (chunk) WHERE x.first GROUP BY ALL),
a AS (SELECT tag, word, coalesce(sum(s) FILTER (y = 1), 0) AS s1, coalesce(sum(s) FILTER (y = 0), 0) AS s0 FROM (SELECT DISTINCT tag, word FROM l, i) LEFT JOIN s USING (tag, word) GROUP BY ALL),
d AS (SELECT tag, word, ln((s1 + 1) / (sum(s1) OVER z + count(*) OVER z)) - ln((s0 + 1) / (sum(s0) OVER z + count(*) OVER z)) AS weight FROM a WINDOW z AS (PARTITION BY tag)),
b AS (SELECT tag, ln((count(*) FILTER (y = 1) + 1) / (count(*) FILTER (y = 0) + 1)) AS bias FROM l WHERE first GROUP BY tag)"""


_TOLD = "SELECT l.tag, l.chunk, y AS truth, (bias + coalesce(sum(v * weight), 0) > 0)::INT AS predicted FROM l JOIN b USING (tag) LEFT JOIN (x JOIN d USING (word)) ON x.chunk = l.chunk AND d.tag = l.tag WHERE NOT l.first GROUP BY l.tag, l.chunk, y, bias"


@query("nb_train_metrics", f"""WITH {_sql_bayes()}, p AS ({_TOLD}), c AS (SELECT tag, count(*) FILTER (truth = 1 AND predicted = 1) AS tp, count(*) FILTER (truth = 0 AND predicted = 1) AS fp, count(*) FILTER (truth = 1 AND predicted = 0) AS fn, count(*) FILTER (truth = 0 AND predicted = 0) AS tn FROM p GROUP BY tag)
SELECT tag AS class, 'NB_100-' || tag AS name, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 3) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 3) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 3) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 3) AS f1 FROM c""")
def nb_train_metrics(spark, sf):
    return _metrics(spark, sf, "nb")[1]


@query("rf_train_metrics")
def rf_train_metrics(spark, sf):
    return _metrics(spark, sf, "rf")[1]


_CLASSIFIED = f"""WITH {_sql_extract()}, {_sql_bayes()}, u AS (SELECT DISTINCT doc_id, unnest(chunks) AS chunk FROM e), q AS (SELECT DISTINCT chunk FROM u),
g1 AS (SELECT chunk, word, count(*) AS tf FROM (SELECT chunk, unnest(regexp_extract_all(chunk, '[a-z0-9]{{2,}}')) AS word FROM q) GROUP BY ALL),
g2 AS (SELECT chunk, word, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY chunk)) AS v FROM g1 JOIN i USING (word)),
g3 AS (SELECT q.chunk, b.tag, bias + coalesce(sum(v * weight), 0) > 0 AS yes FROM q CROSS JOIN b LEFT JOIN (g2 JOIN d USING (word)) ON g2.chunk = q.chunk AND d.tag = b.tag GROUP BY q.chunk, b.tag, bias),
g4 AS (SELECT doc_id, max((tag = 'linking' AND yes AND {_sql_any("u.chunk", TAGS.keywords["linking"])})::INT) AS linking, max((tag = 'nominal' AND yes AND {_sql_any("u.chunk", TAGS.keywords["nominal"])})::INT) AS nominal FROM u JOIN g3 USING (chunk) GROUP BY doc_id)
SELECT e.doc_id, e.source, linking, nominal FROM e JOIN g4 USING (doc_id)"""


@query("classify_docs", _CLASSIFIED)
def classify_docs(spark, sf):
    models, _ = _metrics(spark, sf, "nb")
    found = classify(_extracts(spark, sf), models, TAGS.keywords)
    return found.select("doc_id", "source", *models)


@query("classify_docs_light", _CLASSIFIED)
def classify_docs_light(spark, sf):
    """The same by plain weights: no ML transforms, and no shuffle."""
    models, _ = _metrics(spark, sf, "nb")
    return classify_light(_extracts(spark, sf), Light.of(models), TAGS.keywords).select("doc_id", "source", *models)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
