"""Line dedup by winnowing over line hashes; DataFrame functions only.

A document is the sequence of its lines that hold a word, each hashed after
its white space is collapsed. The steps:

1. Select. Of every ``run`` lines in a row the smallest hash is selected, so any
   ``run`` lines that two places share have a selected line in common. Lines of
   half of ``whole`` words are selected as well, as every shorter run of
   ``whole`` words holds one. Only the selected lines are stored, with the
   hashes of the ``run - 1`` lines before and after them.
2. Join. Fingerprints that occur once are dropped; each of the others is joined
   to its earliest place (smallest id, then line).
3. Extend. The match of the two places grows to both sides as long as the lines
   are equal. It is a repeated run, and goes from the later place, if it has
   ``run`` lines or ``whole`` words. Matches that overlap grow into the whole
   repeated passage, however long.
4. Runs around a fingerprint that are not part of that match may repeat some
   other place. They are told by the hash of their lines and their earliest
   place, so a common line in ever different surroundings makes no pairs.

Counts and earliest places are partial sums. They are written before they are
joined, so that a hot fingerprint is dealt over several tasks by the adaptive
skew join. Texts that lose nothing are not moved.

Null texts stay null and empty ones empty. Texts of any length are handled
whole, as arrays of hashes. Ids should be distinct; rows that repeat an id are
one place (lines do not repeat themselves across them), and each loses what any
of them loses. A null id comes before all others, and its row is not cut. An
empty table gives an empty one. Extra columns pass through whatever their
names; n_lines and n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .quality import let, lines_of, n_words
from .shared import sieved, unused, written

RUN = 3
WHOLE = 50


def _lines(text: Column) -> Column:
    """Array of (no, h, n): number, hash and words of each line with a word."""
    return F.transform(lines_of(text), lambda x: F.struct(x["no"].alias("no"), F.xxhash64(x["l"]).alias("h"), n_words(x["l"]).alias("n")))


def _selected(lines: Column, run: int, whole: int) -> Column:
    """Array of positions: the first smallest hash of every ``run`` lines, and lines of half of ``whole`` words."""

    def least(h: Column) -> Column:
        window = lambda i: F.slice(h, i + 1, run)
        return F.transform(F.sequence(F.lit(0), F.size(h) - run), lambda i: let(window(i), lambda w: (i + F.array_position(w, F.array_min(w)) - 1).cast("int")))

    at = F.when(F.size(lines) >= run, let(F.transform(lines, lambda x: x["h"]), least)).otherwise(F.array().cast("array<int>"))
    long = F.filter(F.transform(lines, lambda x, i: F.when(2 * x["n"] >= whole, i)), lambda i: i.isNotNull())
    return F.array_distinct(F.concat(at, long))


def _fingerprints(docs: DataFrame, id: str, text: str, run: int, whole: int) -> DataFrame:
    """(id, pos, fp, around): selected lines with (no, h, n) of the run - 1 lines on either side, null beyond the ends."""
    near = range(1 - run, run)
    of = lambda lines: F.transform(_selected(lines, run, whole), lambda i: F.struct(i.alias("pos"), F.get(lines, i)["h"].alias("fp"), F.array(*(F.when(i + j >= 0, F.get(lines, F.greatest(i + j, F.lit(0)))) for j in near)).alias("around")))
    rows = docs.select(F.col(id).alias("id"), F.explode(let(_lines(F.col(text)), of)).alias("s"))
    return rows.select("id", "s.pos", "s.fp", "s.around")


def _common(own: Column, other: Column, run: int, step: int) -> Column:
    """How many neighbours of a fingerprint on one side are equal, next ones first."""
    same = lambda j: F.coalesce(F.get(own, F.lit(run - 1 + step * j))["h"] == F.get(other, F.lit(run - 1 + step * j)), F.lit(False))
    out = F.lit(0)
    for j in range(run - 1, 0, -1):
        out = F.when(same(j), 1 + out).otherwise(0)
    return out


def repeated_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", run: int = RUN, whole: int = WHOLE) -> DataFrame:
    """(id, gone): numbers of the lines of each document that stand in a later repeated run."""
    found = written(_fingerprints(docs, id, text, run, whole), "fingerprints")
    place = F.struct("id", "pos")
    hashes = F.transform("around", lambda x: x["h"]).alias("hashes")
    first = found.groupBy("fp").agg(F.min(F.struct("id", "pos", hashes)).alias("first"), F.count("*").alias("held")).where("held > 1")
    first = written(first.select("fp", "first"), "first")
    some, _ = sieved(found, "fp", first, "fp")
    met = some.join(first.hint("merge"), "fp")
    met = met.withColumn("left", _common(F.col("around"), F.col("first.hashes"), run, -1)).withColumn("right", _common(F.col("around"), F.col("first.hashes"), run, 1))
    met = met.withColumn("later", place > F.struct("first.id", "first.pos"))
    inside = lambda a, b: F.slice("around", a + run, b - a + 1)  # noqa: E731  lines at a to b, counted from the fingerprint
    words = lambda lines: F.aggregate(lines, F.lit(0), lambda n, x: n + x["n"])
    numbers = lambda lines: F.transform(lines, lambda x: x["no"])

    # runs around the fingerprint that the match does not hold: (a, b), counted from the fingerprint
    spans = [(1 - run + j, j) for j in range(run)] + [(1 - size + j, j) for size in range(1, run) for j in range(size)]
    least = lambda a, b: F.array_min(F.transform(inside(F.lit(a), F.lit(b)), lambda x: x["h"]))

    def rest(a: int, b: int) -> Column:
        lines = inside(F.lit(a), F.lit(b))
        own = F.get(F.col("around"), F.lit(a + run - 1)).isNotNull() & F.get(F.col("around"), F.lit(b + run - 1)).isNotNull()
        asked = least(a, b) == F.col("fp") if b - a + 1 == run else (words(lines) >= whole)
        settled = (F.lit(a) >= -F.col("left")) & (F.lit(b) <= F.col("right"))
        # the earliest place is kept too: it may be the earliest of a run that other places share
        return F.when(own & asked & ~settled, F.struct((F.col("pos") + a).alias("pos"), F.xxhash64(*(F.get(F.col("around"), F.lit(j + run - 1))["h"] for j in range(a, b + 1))).alias("g"), numbers(lines).alias("no")))

    extended = inside(-F.col("left"), F.col("right"))
    joined = F.when(F.col("later") & ((F.col("left") + F.col("right") + 1 >= run) | (words(extended) >= whole)), numbers(extended))
    met = written(met.select("id", joined.alias("no"), F.filter(F.array(*(rest(a, b) for a, b in spans)), lambda x: x.isNotNull()).alias("rest")), "matches")

    runs = met.where(F.size("rest") > 0).select("id", F.explode("rest").alias("r")).select("id", "r.pos", "r.g", "r.no")
    place = F.struct("id", "pos")
    earliest = written(runs.groupBy("g").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a < b").select("g", "a"), "earliest")
    other = runs.join(earliest.hint("merge"), "g").where(place > F.col("a")).select("id", "no")
    gone = met.where("no is not null").select("id", "no").unionByName(other)
    return gone.select("id", F.explode("no").alias("no")).groupBy("id").agg(F.collect_set("no").alias("gone"))


def dedupe_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", run: int = RUN, whole: int = WHOLE) -> DataFrame:
    """``docs`` with later repeated runs of lines taken out of ``text``, n_lines (with a word) and n_removed."""
    gone = written(repeated_lines(docs, id=id, text=text, run=run, whole=whole), "gone")
    of, lost = unused(docs.columns, "of", "lost")
    gone = gone.select(F.col("id").alias(of), F.col("gone").alias(lost))
    keep = [c for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    some, others = sieved(docs, id, gone, of)
    some = some.join(gone.hint("merge"), some[id] == gone[of], "left").drop(of)
    rows = some.unionByName(others.withColumn(lost, F.lit(None).cast("array<int>")))
    n_lines = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    left = let(F.split(F.col(text), "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(lost)), lambda i: F.get(x, i)), "\n"))
    return rows.select(*keep, F.when(F.col(lost).isNull(), F.col(text)).otherwise(left).alias(text), n_lines.cast("long").alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_removed"))
