"""One query for each operator, applied with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from salmoura.llm import (
    benchmark_scan, bpe, fingerprints, hard_negatives, html_text, line_dedup, near_dup, periodic_runs, quality, secrets, shards,
    topk, warc,
)
from salmoura.llm.registry import ENTRIES, Entry, query, table

__all__ = ["ENTRIES", "Entry"]


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_fingerprints")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, folder, "documents"))


@query("op2_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_main_text")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extracted(table(spark, folder, "pages"))


@query("op4_hamming_join")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), words=2, percent=80)


@query("op5_bpe")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), word_vocabulary(), with_ids=False)


@query("op6_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, folder, "pages"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)


@query("op7_benchmark_scan", rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(ws)) AS size,
    array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
grams AS (
  SELECT doc_id, i, size, array_to_string(ws[i : i + size - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)),
hits AS (SELECT doc_id, i, size, item FROM grams JOIN windows USING (size, gram)),
places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark_scan.flagged(
        benchmark_scan.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), unnamed=True)
    )


_ENDS = "' ' || chr(9) || chr(13) || chr(11) || chr(12)"


@query("op8_line_dedup", f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS site, text FROM documents),
pages AS (SELECT DISTINCT site, text FROM d WHERE text IS NOT NULL),
totals AS (SELECT site, count(*) AS pages FROM pages GROUP BY site),
listed AS (
  SELECT site, line FROM (
    SELECT DISTINCT site, text, trim(unnest(string_split(text, chr(10))), {_ENDS}) AS line FROM pages)
  JOIN totals USING (site) WHERE line <> '' GROUP BY site, line, pages
  HAVING count(*) >= {line_dedup.LEAST} AND count(*) * 100 > pages * {line_dedup.PERCENT}),
lines AS (
  SELECT doc_id, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM d WHERE text IS NOT NULL),
marked AS (
  SELECT l.doc_id, l.line, l.i, b.line IS NULL AS kept
  FROM lines l LEFT JOIN listed b ON l.site = b.site AND trim(l.line, {_ENDS}) = b.line),
joined AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kept), '') AS text,
    count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, j.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
FROM d LEFT JOIN joined j USING (doc_id)
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text", "source")
    return line_dedup.cleaned(documents).select(
        F.col("_0").alias("doc_id"), F.col("__text").alias("text"), F.col("__lines").alias("n_lines"),
        F.col("__dropped").alias("n_dropped"),
    )


@query("op9_shards")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return shards.sharded(table(spark, folder, "documents"))


@query("op10_secrets")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scanned(table(spark, folder, "documents"))


def _usable(scale: int) -> str:
    return f"""
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


@query("op11_hard_negatives", f"""
WITH u AS ({_usable(256)}),
v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, e FROM u WHERE label IS NOT NULL),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10
""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    moved = (F.col("label").cast("bigint") + 1) % 10
    vectors = table(spark, folder, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label").cast("bigint")).alias("label")
    )
    return hard_negatives.mined(vectors.filter("vec_id % 100 = 0"), vectors)


@query("op12_exact_topk", f"""
WITH v AS ({_usable(64)}),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return topk.nearest(vectors.filter("vec_id % 20 = 0"), vectors)


def _planted(documents: DataFrame) -> DataFrame:
    """doc_id and text; where crc32(doc_id) is divisible by 10, words from some place on repeat the ones found there."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10).cast("bigint"), F.size("words").cast("bigint")
    a = F.when(n > 0, g % F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
    # the word of place i is the one of place least(i, a + pmod(i - a, p)) from a on
    at = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.element_at(
        "words", (F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i) + 1).cast("int")))
    chosen = F.when(h % 10 == 0, words)
    return documents.select("doc_id", "text", chosen.alias("words")).select("*", a.alias("a"), p.alias("p")).select(
        "doc_id", F.when(n > 0, F.array_join(at, " ")).otherwise(F.col("text")).alias("text")
    )


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.with_runs(_planted(table(spark, folder, "documents")))
    longest = F.array_max(F.transform("__runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("__runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("__runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("best", longest).select(
        F.col("_0").alias("doc_id"), F.size("__runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("__collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
