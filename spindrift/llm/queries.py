"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import encode_decode
from . import quality_model, secret_scan
from .common import table
from .compact_windows import repeated_passages
from .decontaminate import leaks
from .html_extract import fit, main_text
from .lexical_search import search
from .ngram_join import near_duplicates
from .quality_rules import quality_rules
from .source_divergence import divergence
from .suffix_dedup import remove_repeats
from .token_counts import token_counts
from .warc_audit import audit, to_records


def tokenizer_path(name: str) -> str:
    """Path of a public tokenizer's file; it stays where it is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.quality_scores(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return main_text(pages, fit(pages))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_left_words"
    )


def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a replica that lost every 997th record and has one byte changed in every 499th."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    damaged = F.when(F.col("page_id") % 499 == 7, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    replica = pages.filter(F.coalesce(F.col("page_id") % 997 != 11, F.lit(True))).withColumn("html", damaged)
    found = audit(to_records(pages), to_records(replica))
    return found.filter("status in ('corrupt', 'missing', 'extra')").select(F.col("number").alias("page_id"), "file", "offset", "length", "status", "digest", "replica_digest")


def op8_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, secret_scan.fit(docs), with_text=False)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("removed")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_model": op1_quality_model,
    "op2_bpe_codec": op2_bpe_codec,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_counts": op4_token_counts,
    "op5_decontaminate": op5_decontaminate,
    "op6_html_extract": op6_html_extract,
    "op7_warc_audit": op7_warc_audit,
    "op8_compact_windows": op8_compact_windows,
    "op9_secret_scan": op9_secret_scan,
    "op10_quality_rules": op10_quality_rules,
    "op11_lexical_search": op11_lexical_search,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE = {
    "op7_warc_audit": r"""
WITH p AS (SELECT page_id AS n, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
q AS (SELECT n, url, html, CASE WHEN n % 499 = 7 THEN '#' || html[2:] ELSE html END AS other FROM p),
rec AS (SELECT n, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || n || '>' || chr(13) || chr(10)
   || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head, html, other FROM q),
full_ AS (SELECT n, head || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS r1,
   head || strlen(other) || chr(13) || chr(10) || chr(13) || chr(10) || other || chr(13) || chr(10) || chr(13) || chr(10) AS r2 FROM rec),
h AS (SELECT n, n // 1024 AS file, strlen(r1) AS length, sha256(r1) AS d1, CASE WHEN n % 997 = 11 THEN NULL ELSE sha256(r2) END AS d2 FROM full_),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM h)
SELECT n AS page_id, CAST(file AS BIGINT) AS file, CAST(off AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length,
   CASE WHEN d2 IS NULL THEN 'missing' ELSE 'corrupt' END AS status, d1 AS digest, d2 AS replica_digest
FROM o WHERE d2 IS NULL OR d1 <> d2
""",
    "op5_decontaminate": r"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
dt AS (SELECT doc_id, t, list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM d),
it AS (SELECT DISTINCT item_id, text AS t, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
masks(m, o) AS (VALUES (0, [0,1,2,3,4,5,6]), (1, [0,1,3,4,6,8,9]), (2, [0,2,3,5,6,7,9]), (3, [0,1,2,5,7,8,9]), (4, [0,1,2,6,7,8,9])),
ds AS (SELECT doc_id, t, pos, m, list_transform(o, lambda k: w[pos + k + 1]) AS seed FROM (SELECT *, unnest(range(0, len(w) - 9)) AS pos FROM dt WHERE len(w) >= 10), masks),
iz AS (SELECT item_id, t, pos AS p, m, list_transform(o, lambda k: w[pos + k + 1]) AS seed FROM (SELECT *, unnest(range(0, len(w) - 9)) AS pos FROM it WHERE len(w) >= 10), masks),
hits AS (SELECT doc_id, ds.t AS t, item_id, iz.t AS u, pos - p AS g, count(*) AS n_seeds FROM ds JOIN iz USING (m, seed) GROUP BY ALL),
al AS (SELECT row_number() OVER () AS r, h.*, dt.w AS dw, it.w AS iw, greatest(-g, 0) AS f FROM hits h JOIN dt ON dt.doc_id = h.doc_id AND dt.t = h.t JOIN it ON it.item_id = h.item_id AND it.t = h.u),
cells AS (SELECT r, k, CASE WHEN dw[g + f + k + 1] = iw[f + k + 1] THEN 1 ELSE -3 END AS x
          FROM (SELECT *, unnest(range(0, least(len(iw) - f, len(dw) - g - f))) AS k FROM al)),
sums AS (SELECT r, 0 AS e, 0 AS s FROM al UNION ALL SELECT r, k + 1, sum(x) OVER (PARTITION BY r ORDER BY k) FROM cells),
low AS (SELECT r, e, s, min(s) OVER (PARTITION BY r ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo FROM sums),
best AS (SELECT r, max(s - lo) AS score FROM low WHERE e > 0 GROUP BY r),
ends AS (SELECT b.r, min(l.e) AS e, any_value(b.score) AS score FROM best b JOIN low l ON l.r = b.r AND l.e > 0 AND l.s - l.lo = b.score GROUP BY b.r),
runs AS (SELECT ends.r AS r, ends.e AS e, ends.score AS score, max(sums.e) AS st FROM ends JOIN low ON low.r = ends.r AND low.e = ends.e
         JOIN sums ON sums.r = ends.r AND sums.e < ends.e AND sums.s = low.lo GROUP BY 1, 2, 3),
eq AS (SELECT r, count(CASE WHEN x = 1 THEN 1 END) AS n_equal FROM cells GROUP BY r),
full_ AS (SELECT doc_id, t, item_id, u, max(n_equal) OVER (PARTITION BY doc_id, t, item_id, u) AS n_equal, len(iw) AS n_item, (score + 3 * (e - st)) // 4 AS n_matched, e - st AS n_aligned, g + f + st AS doc_start, f + st AS item_start, n_seeds
          FROM al JOIN runs USING (r) JOIN eq USING (r)),
one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, t, item_id, u ORDER BY n_matched DESC, n_aligned DESC, doc_start, item_start DESC, n_seeds DESC) AS q FROM full_)
SELECT doc_id, item_id, CAST(doc_start AS BIGINT) AS doc_start, CAST(doc_start + n_aligned AS BIGINT) AS doc_end, CAST(item_start AS BIGINT) AS item_start,
  CAST(n_matched AS BIGINT) AS n_matched, CAST(n_aligned AS BIGINT) AS n_aligned, CAST(n_item AS BIGINT) AS n_item, n_seeds, n_equal
FROM one WHERE q = 1 AND (n_matched >= 13 OR greatest(n_matched, n_equal) >= 0.8 * n_item)
""",
    "op10_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(source, chr(0) || 'null') AS host FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM
          (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c >= 2) GROUP BY r),
base AS (SELECT w.r, doc_id, host, t, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
           length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
ln AS (SELECT r, host, doc_id, t, unnest(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(t), '[0-9]', '0', 'g'),
           '[\x20\x09\x0B-\x0D]+', ' ', 'g')), ' ?\n ?'), lambda x: x <> '')) AS line FROM d),
lines AS (SELECT r, host, doc_id, t, line, len(string_split(line, ' ')) AS w, count(*) AS c FROM ln GROUP BY ALL),
per_line AS (SELECT host, line, count(DISTINCT t) AS n_docs, min(doc_id) AS first_id FROM lines GROUP BY ALL),
per_host AS (SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY ALL),
common AS (SELECT host, line, first_id FROM per_line JOIN per_host USING (host) WHERE n_docs > greatest(20, 0.10 * host_docs)),
removed AS (SELECT r, sum(w * c) AS rw, sum(c) AS rl FROM lines JOIN common USING (host, line) WHERE doc_id <> first_id GROUP BY r),
f AS (SELECT base.*, coalesce(rw, 0) AS rw, coalesce(rl, 0) AS rl, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base LEFT JOIN removed USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (rw > 0 AND (n_words - rw < 10 OR n_words - rw < 0.3 * n_words)) AS kept,
  CAST(rl AS BIGINT) AS n_removed_lines, CAST(n_words - rw AS BIGINT) AS n_left_words
FROM f
""",
    "op11_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
all_ AS (SELECT count(*) AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
v AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, all_ GROUP BY term),
s AS (SELECT item_id, text, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score FROM i JOIN p USING (term) JOIN v USING (term), all_ GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 10
""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
v AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(*) >= 3), size_ AS (SELECT lang, count(*) AS vv FROM v GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang AS lang, g.source AS source, v.term AS term, coalesce(s.n, 0)::HUGEINT AS n FROM g JOIN v USING (lang) LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM t GROUP BY ALL) s ON s.lang = g.lang AND s.source = g.source AND s.term = v.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + vv)::HUGEINT AS p FROM c JOIN size_ USING (lang)),
a AS (SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + vv)::HUGEINT AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL) JOIN size_ USING (lang)),
pairs AS (SELECT x.lang AS lang, x.source AS source, 'pair' AS part, y.source AS item, coalesce(sum((px.p - py.p) * (px.p - py.p) // py.p), 0) AS value
  FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN p px ON px.lang = x.lang AND px.source = x.source LEFT JOIN p py ON py.lang = y.lang AND py.source = y.source AND py.term = px.term GROUP BY ALL),
terms AS (SELECT p.lang AS lang, source, 'term' AS part, p.term AS item, (p - q) * (p - q) // q AS value FROM p JOIN a USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
""",
}
