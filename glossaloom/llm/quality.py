"""Quality rules with cross-document line frequency; DataFrame functions only.

Two rules look at a document alone: it has too few words, or too many of its
words stand in word windows that it repeats. The third looks across documents:
lines are normalised (lower case, white space collapsed) and hashed, and for
each host the distinct documents that hold a line are counted. Exact copies of
a text are one document here, as a text that is copied often has no line that
is common for its host. A line is above the limit when more than
``line_min_docs`` documents and more than ``line_percent`` per cent of the
host's documents hold it. Such lines are removed, and a document is rejected as
depleted when more than ``depleted_percent`` per cent of its words, or all but
``min_words`` of them, were removed.

The lines of all documents are hashed once, into a table of (host, text, line,
words) by hashes. Counts are grouped by (host, line) with partial sums, so a hot
host spreads over its lines and a hot line is summed before it is moved. The
flagged lines are written before they are joined, so that a hot one is dealt over
several tasks by the adaptive skew join. What a text loses in a host is summed
once for all its copies, and only texts that may lose something are moved.

Null texts have no words, hold no line and fail the first rule; empty ones are
texts of no words. Texts of any length are handled whole. A null host is the
host "". Every row is judged by its own text and host, so rows that repeat an
id, or have none, are judged like others. An empty table gives an empty one.
Extra columns pass through whatever their names; a column that is named like a
result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import sieved, unused, written

WHITE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 20
WINDOW = 8
REPEAT_PERCENT = 30
LINE_MIN_DOCS = 20
LINE_PERCENT = 1
DEPLETED_PERCENT = 50

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, WHITE + "+")))


def lines_of(text: Column) -> Column:
    """Array of (no, l): the number of each line with a word, and the line with its white space collapsed."""
    squeezed = F.regexp_replace(text, r"\x20[\x20\x09\x0B-\x0D]+|[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*", " ")
    return F.filter(F.transform(F.split(squeezed, "\n"), lambda x, i: F.struct(i.alias("no"), F.btrim(x).alias("l"))), lambda x: x["l"] != "")


def n_words(line: Column) -> Column:
    """Words of a line whose white space is collapsed."""
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _repeat_words(hashed: Column, n: Column, window: int) -> Column:
    """Words in windows of the hashed words that are found twice or more."""
    windows = F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*(F.get(hashed, i + j) for j in range(window))))

    def positions(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        same = lambda s, a, b: F.coalesce(F.get(s, a)["x"] == F.get(s, b)["x"], F.lit(False))
        return let(placed, lambda s: F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: ((j > 0) & same(s, j - 1, j)) | same(s, j, j + 1)), lambda j: F.get(s, j)["i"])))

    covered = lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0).cast("long"), lambda acc, j: acc + F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - F.get(p, j), F.lit(window))))
    of = lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), let(positions(w), covered)).otherwise(F.lit(0).cast("long"))
    return F.when(n >= window, let(windows, of)).otherwise(F.lit(0).cast("long"))


def counts(text: Column, window: int = WINDOW) -> Column:
    """The counts of a text alone, as a struct."""
    text = F.coalesce(text, F.lit(""))
    some = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _repeat_words(h, F.size(h), window)).alias("n_repeat_words")))
    return F.struct(
        by_words.alias("by_words"),
        F.length(F.regexp_replace(text, WHITE + "+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(some, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def _host(host: str) -> Column:
    return F.coalesce(F.col(host).cast("string"), F.lit(""))


def _line_table(docs: DataFrame, text: str, host: str) -> DataFrame:
    """(h, body, no, line, n): for every line with a word its host, text, number, own hash and words."""
    hashed = F.transform(lines_of(F.lower("t")), lambda x: F.struct(x["no"].alias("no"), F.xxhash64(x["l"]).alias("line"), n_words(x["l"]).alias("n")))
    rows = docs.where(F.col(text).isNotNull()).select(_host(host).alias("h"), F.col(text).alias("t"))
    return rows.select("h", F.xxhash64("t").alias("body"), F.explode(hashed).alias("l")).select("h", "body", "l.no", "l.line", "l.n")


def _flagged_lines(docs: DataFrame, lines: DataFrame, text: str, host: str, min_docs: int, percent: int) -> DataFrame:
    """(h, line): lines above the limit of their host."""
    held = lines.groupBy("h", "line").agg(F.count_distinct("body").alias("n")).where(F.col("n") > min_docs)
    if percent:
        hosts = docs.where(F.col(text).isNotNull()).select(_host(host).alias("h"), F.xxhash64(text).alias("body")).groupBy("h").agg(F.count_distinct("body").alias("all"))
        held = held.join(hosts, "h").where(100 * F.col("n") > percent * F.col("all"))
    return held.select("h", "line")


def judge(docs: DataFrame, *, text: str = "text", host: str = "source", min_words: int = MIN_WORDS, window: int = WINDOW, repeat_percent: int = REPEAT_PERCENT, line_min_docs: int = LINE_MIN_DOCS, line_percent: int = LINE_PERCENT, depleted_percent: int = DEPLETED_PERCENT, clean: bool = False) -> DataFrame:
    """``docs`` with the counts, base_failed, n_removed_words and kept; with ``clean``, flagged lines are taken out of ``text``."""
    lines = written(_line_table(docs, text, host), "lines")
    flagged = written(_flagged_lines(docs, lines, text, host, line_min_docs, line_percent), "flagged")
    some, _ = sieved(lines, "line", flagged, "line")
    # copies of a text have the same lines of the same numbers, which a set holds once
    gone = some.join(flagged.hint("merge"), ["h", "line"]).groupBy("h", "body").agg(F.collect_set(F.struct("no", "n")).alias("lines"))
    gone = written(gone, "gone")
    keep = [c for c in docs.columns if c not in (*COUNTS, "base_failed", "n_removed_words", "kept") and (clean or c != text)]
    h, body, lost, own = unused(docs.columns, "h", "body", "lost", "own")
    gone = gone.select(F.col("h").alias(h), F.col("body").alias(body), F.col("lines").alias(lost))
    some, others = sieved(docs, F.when(F.col(text).isNotNull(), F.xxhash64(text)), gone, body)
    some = some.join(gone.hint("merge"), (_host(host) == gone[h]) & (F.xxhash64(text) == gone[body]), "left").drop(h, body)
    rows = some.unionByName(others.withColumn(lost, F.lit(None).cast(gone.schema[lost].dataType)))
    rows = rows.withColumn(own, let(counts(F.col(text), window), lambda x: x))  # bound, so that its uses do not repeat it
    n = F.col(f"{own}.by_words.n_words")
    removed = F.coalesce(F.aggregate(lost, F.lit(0).cast("long"), lambda total, x: total + x["n"]), F.lit(0).cast("long"))
    cleaned = F.when(F.col(lost).isNull(), F.col(text)).otherwise(_without(F.col(text), F.transform(lost, lambda x: x["no"]))).alias(text)
    failed = (n < min_words) | (100 * F.col(f"{own}.by_words.n_repeat_words") > repeat_percent * n)
    depleted = (removed > 0) & ((100 * removed > depleted_percent * n) | (n - removed < min_words))
    return rows.select(
        *(cleaned if c == text else c for c in keep), n.alias("n_words"), f"{own}.word_chars", f"{own}.n_symbols", f"{own}.n_dup_lines", F.col(f"{own}.by_words.n_repeat_words").alias("n_repeat_words"),
        removed.alias("n_removed_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"),
    )


def _without(text: Column, numbers: Column) -> Column:
    """Text without the lines of these numbers."""
    return let(F.split(text, "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), numbers), lambda i: F.get(x, i)), "\n"))
