"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .decontaminate import decontaminate
from .html_extract import extract_text
from .language_id import evidence, fit, fuse
from .line_dedup import dedupe_lines
from .manifest import manifest
from .mixing import taken
from .ngram_join import join_classes
from .quality import judge
from .secret_scan import KINDS, scan
from .sentencepiece import Vocabulary, round_trip
from .source_audit import audit
from .substring_dedup import dedupe_substrings
from .token_counts import Unigram, count_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    """A public vocabulary file; the folder is a parameter of the environment."""
    return os.path.join(os.environ.get("GLOSSALOOM_TOKENIZERS", "/opt/tokenizers"), name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their source and pages by their host; doc_id or page_id is null."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = fit(docs)
    of_docs = evidence(docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", "source"), model, text="text", host="source")
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    of_pages = evidence(pages.select(F.lit(None).cast("long").alias("doc_id"), "page_id", "html", host.alias("host")), model, text="html", host="host", is_html=True)
    return fuse(of_docs.unionByName(of_pages), model)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM late),
k AS (SELECT x.doc_id, count(gone.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY x.i) FILTER (gone.i IS NULL), '') AS kept
      FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d) x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""



def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), Unigram.load(_vocabulary("piece_bpe_32k.model")))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("secrets", lambda x: ~x["learned"])
    count = lambda kind: F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"), F.array_join(F.transform("secrets", shown), ",").alias("spans"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), Vocabulary.load(_vocabulary("piece_bpe_32k.model")))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""



def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedupe_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS no, unnest(lines) AS line FROM d),
s AS (SELECT doc_id, no, line, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS k, regexp_replace(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS n
      FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
m AS (SELECT *, len(string_split(n, ' ')) AS w FROM s),
r AS (SELECT a.doc_id, a.no AS n1, [a.no, b.no, c.no] AS nos, a.n || chr(10) || b.n || chr(10) || c.n AS g
      FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN m c ON a.doc_id = c.doc_id AND c.k = a.k + 2
      UNION ALL SELECT a.doc_id, a.no, [a.no, b.no], a.n || chr(10) || b.n FROM m a JOIN m b ON a.doc_id = b.doc_id AND b.k = a.k + 1 WHERE a.w + b.w >= 50
      UNION ALL SELECT doc_id, no, [no], n FROM m WHERE w >= 50),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, n1) AS place FROM r),
gone AS (SELECT DISTINCT doc_id, unnest(nos) AS no FROM o WHERE place > 1),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.no) FILTER (gone.no IS NULL) AS kept, count(gone.no) AS n_removed,
             count(*) FILTER (regexp_matches(line, '[^\\x20\\x09-\\x0D]')) AS n_lines
      FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.no = gone.no GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.lines IS NULL THEN NULL ELSE sha256(coalesce(kept, '')) END AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(id) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""



def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS h, text AS raw, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, h, raw, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
l AS (SELECT * FROM (SELECT doc_id, h, raw, unnest(range(len(string_split(t, chr(10))))) AS no, unnest(string_split(t, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
ln AS (SELECT doc_id, h, raw, line, regexp_replace(lower(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS n FROM l),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
host AS (SELECT h, count(DISTINCT raw) AS a FROM d GROUP BY h),
flagged AS (SELECT ln.h, n FROM ln JOIN host ON ln.h = host.h GROUP BY ln.h, n, a HAVING count(DISTINCT raw) > 20 AND 100 * count(DISTINCT raw) > 1 * a),
gone AS (SELECT doc_id, sum(len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'))) AS n FROM ln JOIN flagged USING (h, n) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
      FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words,
       NOT base_failed AND NOT (n_removed_words > 0 AND (100 * n_removed_words > 50 * n_words OR n_words - n_removed_words < 20)) AS kept
FROM b
"""


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN (SELECT lang, term FROM k) USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (gn.n + l.v)::HUGEINT AS p,
             1 + 1000000000::HUGEINT * (k.n + 1)::HUGEINT // (l.n + l.v)::HUGEINT AS q
      FROM gn JOIN l ON l.lang = gn.lang JOIN k ON k.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) WHERE part = 'pair' OR rank <= 200
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose id has a checksum that 3 divides are folded with a tampered text."""
    found = manifest(table(spark, sf_dir, "documents"), tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_language_id": op1_language_id, "op2_substring_dedup": op2_substring_dedup, "op3_token_counts": op3_token_counts, "op4_secret_scan": op4_secret_scan, "op5_sentencepiece": op5_sentencepiece, "op6_ngram_join": op6_ngram_join, "op7_line_dedup": op7_line_dedup, "op8_decontaminate": op8_decontaminate, "op9_quality": op9_quality, "op10_html_extract": op10_html_extract, "op11_source_audit": op11_source_audit, "op12_merkle_manifest": op12_merkle_manifest, "op13_source_mix": op13_source_mix}


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": OP2_SQL, "op6_ngram_join": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_decontaminate": OP8_SQL, "op9_quality": OP9_SQL, "op11_source_audit": OP11_SQL}
