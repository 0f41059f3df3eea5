"""Line dedup by site-relative frequency.

Per site, a line's pages are counted and divided by the site's pages; lines above the ratio are boilerplate of
that site and dropped from its texts. A page is a distinct text of the site, so many fetches of one page do not
make its lines boilerplate. Lines are compared without blanks at their ends; blank lines are kept.

A site has at most (mean distinct lines of a page) / ratio boilerplate lines, so the list of a site is bounded
however many pages it has; lists meet the texts by a join on the site. Lines are compared by 64-bit hashes, only
with the list of their own site.

Defined results: a missing site is the site ''; a null text stays null and is no page; a text of nothing but
boilerplate becomes ''; repeated rows are one page and are all cleaned; lines of fewer than ``least`` pages stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from salmoura.llm.common import let, small, written
from salmoura.names import col

PERCENT = 5  # a line on more than this share of a site's pages is boilerplate
LEAST = 3    # pages a line must be on at least
_ENDS = " \t\r\x0b\x0c"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_ENDS))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(
    pages: DataFrame, *, site: str = "source", text: str = "text", percent: int = PERCENT, least: int = LEAST
) -> DataFrame:
    """Per site with boilerplate: ``_site`` and ``_listed``, the hashes of its boilerplate lines."""
    hashed = F.array_distinct(F.transform(
        F.filter(F.transform(_lines(col(text)), _trimmed), lambda line: line != ""), lambda line: F.xxhash64(line)
    ))
    distinct = (
        pages.filter(col(text).isNotNull())
        .select(F.coalesce(col(site).cast("string"), F.lit("")).alias("_site"),
                F.xxhash64(col(text)).alias("_page"), hashed.alias("_hashes"))
        .groupBy("_site", "_page").agg(F.first("_hashes").alias("_hashes"))
    )
    # one pass: the number of pages of a site travels as the count of a null line
    counted = (
        distinct.select("_site", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "_hashes")).alias("_line"))
        .groupBy("_site", "_line").agg(F.count(F.lit(1)).alias("_n"))
        .filter((F.col("_n") >= least) | F.col("_line").isNull())
    )
    totals = counted.filter("_line IS NULL").select("_site", F.col("_n").alias("_pages"))
    return (
        counted.filter("_line IS NOT NULL").join(totals, "_site")
        .filter(F.col("_n") * 100 > F.col("_pages") * percent)
        .groupBy("_site").agg(F.collect_set("_line").alias("_listed"))
    )


def cleaned(
    pages: DataFrame, *, site: str = "source", text: str = "text", percent: int = PERCENT, least: int = LEAST
) -> DataFrame:
    """Columns of ``pages`` as _0, _1, ..., the cleaned text as ``__text``, and the numbers ``__lines``, ``__dropped``."""
    listed, _ = written(boilerplate(pages, site=site, text=text, percent=percent, least=least))
    plain = pages.select(
        *[col(c).alias(f"_{i}") for i, c in enumerate(pages.columns)],
        F.coalesce(col(site).cast("string"), F.lit("")).alias("_site"),
    )
    body = F.col(f"_{pages.columns.index(text)}")
    kept = let(F.coalesce("_listed", F.array().cast("array<bigint>")), lambda out: F.filter(
        F.col("__all"), lambda line: (_trimmed(line) == "") | ~F.array_contains(out, F.xxhash64(_trimmed(line)))
    ))
    joined = plain.join(small(listed, 100_000), "_site", "left").withColumn("__all", _lines(body))
    kept = F.when(F.col("_listed").isNull(), F.col("__all")).otherwise(kept)
    return joined.withColumn("__kept", kept).select(
        *plain.columns[:-1],
        F.when(body.isNotNull(), F.array_join("__kept", "\n")).alias("__text"),
        F.coalesce(F.size("__all"), F.lit(0)).cast("bigint").alias("__lines"),
        (F.coalesce(F.size("__all"), F.lit(0)) - F.coalesce(F.size("__kept"), F.lit(0))).cast("bigint").alias("__dropped"),
    )


def without_boilerplate(documents: DataFrame, *, text: str = "text", length: str = "n_chars", **options) -> DataFrame:
    """``documents`` with cleaned texts (and their length, where that column is there)."""
    found = cleaned(documents, text=text, **options)
    out = []
    for i, c in enumerate(documents.columns):
        if c == text:
            out.append(F.col("__text").alias(c))
        elif c == length:
            kind = documents.schema[c].dataType
            out.append(F.when(F.col("__dropped") > 0, F.length("__text").cast(kind)).otherwise(F.col(f"_{i}")).alias(c))
        else:
            out.append(F.col(f"_{i}").alias(c))
    return found.select(*out)
