"""Language identification by fusing evidence in a Bayesian way.

For each row, log probabilities of every language are added up:

* text: byte trigrams under each language's smoothed counts. The mean is
  weighed by the number of trigrams, ``TEXT_WEIGHT`` at most, as neighbouring
  trigrams are not independent;
* markup: the declared language (``<html lang=...>``) is right with probability
  ``DECLARED_RIGHT``;
* address suffix: a country suffix speaks its language with probability
  ``SUFFIX_RIGHT``;
* host prior: expected counts of languages, summed by host, domain and suffix
  by grouped aggregation, each level smoothed by ``SMOOTHING`` counts of the
  level above, and the last by a uniform prior. A row's own share is left out.

Trigram counts are fitted on a sample of at most ``fit_rows`` labelled rows,
those of the smallest hash of all their columns, which is found from counts
alone. The host counts cover all rows. They are kept as one row for each host,
written, and joined by host; a hot host is dealt over several tasks by the
adaptive skew join.

Null and empty texts have no text evidence and get what the rest says; a row
without a host shares the prior of all rows. Texts of any length are read
whole, in blocks. Ties go to the language that comes first by name. Rows are
told apart by nothing but what they hold, so repeated rows get the same result,
each less its own share. Empty tables give empty ones. Extra columns pass
through whatever their names; a column that is named like a result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from glossaloom.functions.hashes import smallest

from .shared import unused, written
from .words import lower_ascii, text_bytes

BUCKETS = 1 << 16
FIT_ROWS = 2000
TEXT_WEIGHT = 60.0
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.7
SMOOTHING = 5.0

#: Languages of country suffixes.
COUNTRY = {"de": "de", "at": "de", "ch": "de", "li": "de", "fr": "fr", "be": "fr", "mc": "fr", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "pe": "es", "uk": "en", "us": "en", "ie": "en", "au": "en", "nz": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "se": "sv", "dk": "da", "no": "no", "fi": "fi", "jp": "ja", "ru": "ru", "cn": "zh"}
#: Second-level suffixes under which domains are registered.
SECOND_LEVEL = frozenset("co com org net ac gov edu".split())

# what is left open ends with the text, and a tag ends where another begins, so that no text is read twice
_INVISIBLE = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[^<>]*>?", re.S | re.I)
_DECLARED = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)
#: Working columns, one struct for each row.
_OWN = "glossaloom evidence"
_BLOCK = 2_000_000


def visible_text(html: str | None) -> str:
    if not html:
        return ""
    text = _INVISIBLE.sub(" ", html)
    return unescape(text) if "&" in text else text


def declared_language(html: str | None) -> str | None:
    m = _DECLARED.search(html) if html else None
    return m[1].lower() if m else None


def host_levels(host: str | None) -> tuple[str, str, str]:
    """Host, registered domain and suffix."""
    host = (host or "").lower().rstrip(".")
    parts = host.split(".")
    if len(parts) < 2:
        return host, host, ""
    n = 2 if len(parts) > 2 and len(parts[-1]) == 2 and parts[-2] in SECOND_LEVEL else 1
    return host, ".".join(parts[-n - 1 :]), parts[-1]


def _keys(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Trigram buckets of blocks of rows: first row, buckets, their ends by row."""
    data, ends = text_bytes(column)
    fold, first, rows = lower_ascii(), 0, len(ends) - 1
    while first < rows:
        last = min(rows, max(first + 1, int(np.searchsorted(ends, ends[first] + _BLOCK, "right")) - 1))
        part = ends[first : last + 1]
        d = fold[data[part[0] : part[-1]]].astype(np.uint32)
        # each row's last two bytes start no trigram of their own
        keys = ((d[:-2] * np.uint32(0x9E3779B1)) ^ (d[1:-1] * np.uint32(0x85EBCA77)) ^ (d[2:] * np.uint32(0xC2B2AE3D))) if len(d) > 2 else np.zeros(0, np.uint32)
        yield first, (keys >> np.uint32(16)).astype(np.int64), part - part[0]
        first = last


class TextModel:
    """Log probabilities of trigram buckets by language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + 0.5
        self.log = np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32)

    def scores(self, column: pa.Array) -> np.ndarray:
        """Weighed log likelihood of each row under each language."""
        out = np.zeros((len(column), len(self.languages)))
        for first, keys, ends in _keys(column):
            begin, end = ends[:-1], np.maximum(ends[1:] - 2, ends[:-1])
            n = end - begin
            for k in range(len(self.languages)):
                total = np.concatenate([[0.0], np.cumsum(self.log[k][keys], dtype=np.float64)])
                end = np.minimum(end, len(keys))
                begin = np.minimum(begin, len(keys))
                mean = (total[end] - total[begin]) / np.maximum(n, 1)
                out[first : first + len(n), k] = mean * np.minimum(n, TEXT_WEIGHT)
        return out


def fit(labelled: DataFrame, *, text: str = "text", language: str = "lang", fit_rows: int = FIT_ROWS) -> TextModel:
    """Fit trigram counts on at most ``fit_rows`` labelled rows."""
    labelled = labelled.where(F.col(language).isNotNull() & F.col(text).isNotNull())
    chosen = labelled.where(smallest(labelled, F.xxhash64(*labelled.columns), fit_rows))
    sample = chosen.select(F.col(language).alias("l"), F.col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, keys, ends in _keys(batch.column(1)):
                for i in range(len(ends) - 1):
                    own = keys[ends[i] : max(ends[i], ends[i + 1] - 2)]
                    totals[names[first + i]] = totals.get(names[first + i], 0) + np.bincount(own, minlength=BUCKETS)
        for name, n in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n.astype("<i8").tobytes()], pa.binary())], names=["l", "n"])

    counts: dict[str, np.ndarray] = {}
    for row in sample.mapInArrow(count, "l string, n binary").collect():  # one array of fixed size for each language
        counts[row.l] = counts.get(row.l, 0) + np.frombuffer(row.n, "<i8")
    languages = sorted(counts) or ["und"]
    return TextModel(languages, np.stack([counts[k] for k in languages]) if counts else np.zeros((1, BUCKETS)))


def _evidence(model: TextModel, keep: list[str], is_html: bool):
    languages = model.languages
    place = {k: i for i, k in enumerate(languages)}

    def said(name: str | None, right: float) -> np.ndarray:
        if name not in place or len(languages) == 1:
            return np.zeros(len(languages))
        out = np.full(len(languages), np.log((1 - right) / (len(languages) - 1)))
        out[place[name]] = np.log(right)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            if is_html:
                raw = column.to_pylist()
                column = pa.array([visible_text(x) for x in raw], pa.string())
                declared = [declared_language(x) for x in raw]
            else:
                declared = [None] * batch.num_rows
            levels = [host_levels(h) for h in batch.column(len(keep) + 1).to_pylist()]
            total = model.scores(column)
            for i, (name, level) in enumerate(zip(declared, levels, strict=True)):
                if name:
                    total[i] += said(name, DECLARED_RIGHT)
                if level[2] in COUNTRY:
                    total[i] += said(COUNTRY[level[2]], SUFFIX_RIGHT)
            own = np.exp(total - total.max(1, keepdims=True)) if len(total) else total
            own = own / own.sum(1, keepdims=True) if len(own) else own
            flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(languages), pa.int32()), pa.array(x.ravel()))
            parts = [*(pa.array([x[j] for x in levels], pa.string()) for j in range(3)), flat(total), flat(np.round(own, 6))]
            own_ = pa.StructArray.from_arrays(parts, names=list("hdseo"))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), own_], names=[*keep, _OWN])

    return run


def evidence(rows: DataFrame, model: TextModel, *, text: str, host: str, is_html: bool = False) -> DataFrame:
    """``rows`` (without text and host) with their levels, evidence and expected languages, for ``fuse``."""
    keep = [c for c in rows.columns if c not in (text, host, "language", "confidence")]
    lists = T.ArrayType(T.DoubleType())
    own = T.StructType().add("h", "string").add("d", "string").add("s", "string").add("e", lists).add("o", lists)
    schema = T.StructType([rows.schema[c] for c in keep]).add(_OWN, own)
    given, read = unused(keep, "text", "host")
    given = rows.select(*keep, F.col(text).alias(given), F.col(host).cast("string").alias(read))
    return given.mapInArrow(_evidence(model, keep, is_html), schema)


def _host_priors(shares: DataFrame, n: int) -> DataFrame:
    """(h, hn, dn, sn, gn): expected counts of each language by host, domain, suffix and in all, one row for each host."""
    # sums of rounded shares as whole numbers do not depend on the order of rows
    host = written(shares.groupBy("h", "d", "s").agg(*(F.sum(F.round(F.col("o")[k] * 1_000_000).cast("long")).alias(f"h{k}") for k in range(n))), "hosts")
    sums = lambda by, name: host.groupBy(*by).agg(*(F.sum(f"h{k}").alias(f"{name}{k}") for k in range(n)))
    domains, suffixes = written(sums(["d", "s"], "d"), "domains"), written(sums(["s"], "s"), "suffixes")
    levels = host.join(domains.hint("merge"), ["d", "s"]).join(suffixes.hint("merge"), "s").crossJoin(F.broadcast(sums([], "g")))  # one row
    return written(levels.select("h", *(F.array(*(F.col(f"{x}{k}") / 1e6 for k in range(n))).alias(f"{x}n") for x in "hdsg")), "priors")


def fuse(rows: DataFrame, model: TextModel) -> DataFrame:
    """Add the host prior; gives language and confidence."""
    n = len(model.languages)
    rows = written(rows, "evidence")
    keep = [c for c in rows.columns if c not in (_OWN, "language", "confidence")]
    shares = rows.select(f"`{_OWN}`.*")
    levels = _host_priors(shares, n)
    met = rows.select(F.struct(*keep).alias("row") if keep else F.lit(None).alias("row"), F.col(f"`{_OWN}`").alias("own")).withColumn("h", F.col("own.h"))
    met = met.join(levels.hint("merge"), "h")
    prior = F.transform(F.col("own.o"), lambda x: F.lit(1.0 / n))
    for x in "gsdh":
        left = F.zip_with(f"{x}n", "own.o", lambda a, b: F.greatest(a - b, F.lit(0.0)))
        met = met.withColumn("left", left).withColumn("all", F.aggregate("left", F.lit(0.0), lambda a, b: a + b))
        met = met.withColumn("prior", F.zip_with("left", prior, lambda a, p: (a + SMOOTHING * p) / (F.col("all") + SMOOTHING)))
        prior = F.col("prior")
    met = met.withColumn("total", F.zip_with("own.e", "prior", lambda e, p: e + F.log(p)))
    met = met.withColumn("best", F.array_max("total"))
    language = F.get(F.array(*map(F.lit, model.languages)), (F.array_position("total", F.col("best")) - 1).cast("int"))
    confidence = F.round(1 / F.aggregate(F.transform("total", lambda x: F.exp(x - F.col("best"))), F.lit(0.0), lambda a, b: a + b), 4)
    return met.select(*(F.col("row").getField(c).alias(c) for c in keep), language.alias("language"), confidence.alias("confidence"))
