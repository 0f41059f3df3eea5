"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range (one in ``SCALE``), whatever the length of the
text. Sketches of one scale merge by union, and their overlap estimates containment and similarity, also between texts of
very unequal length; two sketches are compared at the coarser of their scales. An estimate of a share s from n shingles
has a standard error of about sqrt(s (1 - s) SCALE / n): 0.05 or less from 400 shingles on, 0.1 from 100; a text of a few
shingles may keep none.

Everything is built-in column functions. Words are parted by blanks and the controls 9 to 13 and lower-cased; a text
of fewer words than a shingle needs has one shingle of all its words.

Defined results: null counts as the empty text; texts without words have an empty sketch; empty sketches are alike (1.0) to
one another and unlike (0.0) all others; the likeness of sketches with nothing left at the coarser scale is 0.0, of
equal sketches 1.0. Equal texts have equal fingerprints. Rows without id come after all others, rows of one
id are ordered by their text; an empty table gives an empty result; a single row is its own next document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from salmoura.functions.running import bucket_of
from salmoura.llm.common import let
from salmoura.names import col

WORDS = 5
SCALE = 4


def sketch(text: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """(scale, hashes): the sketch of a text."""
    split = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def hashed(found: Column) -> Column:
        begins = F.slice(found, F.lit(1), F.greatest(F.size(found) - F.lit(words - 1), F.lit(1)))
        # beyond the end of a short text there is null, which hashing passes over
        return F.array_distinct(F.transform(
            begins, lambda w, i: F.xxhash64(w, *[F.get(found, i + k) for k in range(1, words)])
        ))

    kept = F.array_sort(below(let(split, hashed), F.lit(scale)))
    return F.struct(F.lit(scale).alias("scale"), kept.alias("hashes"))


def below(hashes: Column, scale: Column) -> Column:
    """Hashes in the lowest ``scale``-th of the range of non-negative and negative numbers taken together."""
    least = F.lit(-(1 << 63))
    limit = least + F.floor(F.lit(float(1 << 63)) / scale * 2).cast("bigint")
    return F.filter(hashes, lambda h: h < limit)


def shown(found: Column) -> Column:
    """A sketch as text: its scale, then its hashes in order."""
    return F.concat_ws(":", found["scale"].cast("string"), F.array_join(
        F.transform(found["hashes"], lambda h: F.lower(F.hex(h))), ","
    ))


def _overlap(a: Column, b: Column, measure) -> Column:
    scale = F.greatest(a["scale"], b["scale"])

    def at(s: Column) -> Column:
        return F.when((s["scale"] == scale) | (scale == 1), s["hashes"]).otherwise(below(s["hashes"], scale))

    def compared(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        both = F.size(F.array_intersect(x, y))
        return measure(both, F.size(x), F.size(y))

    # equal sketches are alike even if empty
    return F.when((a["scale"] == b["scale"]) & (a["hashes"] == b["hashes"]), F.lit(1.0)).otherwise(
        let(F.struct(at(a).alias("x"), at(b).alias("y")), compared)
    )


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity (shared shingles over all) of the sketched texts, 0 to 1."""
    return _overlap(a, b, lambda both, x, y: F.coalesce(
        F.try_divide(both.cast("double"), (x + y - both).cast("double")), F.lit(0.0)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has, 0 to 1."""
    return _overlap(a, b, lambda both, x, y: F.coalesce(
        F.try_divide(both.cast("double"), x.cast("double")), F.lit(0.0)))


def merge(a: Column, b: Column) -> Column:
    """The sketch of two texts together, at the coarser scale."""
    scale = F.greatest(a["scale"], b["scale"])

    def at(s: Column) -> Column:
        return F.when((s["scale"] == scale) | (scale == 1), s["hashes"]).otherwise(below(s["hashes"], scale))

    return F.struct(scale.alias("scale"), F.array_sort(F.array_union(at(a), at(b))).alias("hashes"))


def with_next(documents: DataFrame, doc_id: str, text: str, buckets: int | None = None) -> DataFrame:
    """id, text, sketch and the next document's text and sketch, by descending id, after the last the first.

    Ids are cut into ranges at ids that occur (read off a sketch of their distribution), one range a window
    partition. The first row of a range is then known by its id alone: it is the range's upper end, and is also
    sent to the range above, where it follows that range's last row. So texts are shuffled once, and no
    order over the whole table is needed.
    """
    spark = documents.sparkSession
    if buckets is None:
        buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ids = documents.select(
        F.coalesce(col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("_id"), col(doc_id).alias("_key"),
        F.coalesce(col(text).cast("string"), F.lit("")).alias("_text"),
    )
    marks = [i / buckets for i in range(1, buckets)]
    cuts = ids.agg(F.percentile_approx("_id", marks, max(10_000, 10 * buckets)).alias("cuts")).first()["cuts"]
    cut = bucket_of(F.col("_id"), sorted(set(cuts or [])))  # cuts may be rounded, the upper ends are not
    ends = sorted(r["end"] for r in ids.groupBy(cut.alias("_cut")).agg(F.max("_id").alias("end")).collect())
    own = bucket_of(F.col("_id"), [e + 1 for e in ends[:-1]])
    top = F.col("_id").isin(ends)
    above = F.when(F.col("_range") == len(ends) - 1, F.lit(0)).otherwise(F.col("_range") + 1)
    here = F.struct(F.col("_range").alias("at"), F.lit(0).alias("guest"))
    there = F.struct(above.alias("at"), F.lit(1).alias("guest"))
    rows = ids.withColumns({"_range": own, "_top": top}).select(
        "_key", "_id", "_text", F.inline(F.when(F.col("_top"), F.array(here, there)).otherwise(F.array(here)))
    )
    # sketched only where the texts have arrived, so that no hashes are shuffled
    rows = rows.repartition("at").withColumn("_sketch", sketch(F.col("_text")))
    order = Window.partitionBy("at").orderBy("guest", F.desc("_id"), F.xxhash64("_text"), "_text")
    following = F.lead(F.struct("_text", "_sketch")).over(order)
    return rows.withColumn("_next", following).filter("guest = 0").select(
        F.col("_key").alias(doc_id), F.col("_text").alias("text"), F.col("_sketch").alias("sketch"),
        F.col("_next._text").alias("next_text"), F.col("_next._sketch").alias("next_sketch"),
    )


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down, in code points) replaced by the beginning of the next."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def fingerprinted(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and the likeness to it and to the next document."""
    rows = with_next(documents, doc_id, text).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        col(doc_id), F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"), "sketch", "next_sketch",
        sketch(F.col("edited")).alias("edited_sketch"),
    )
    mine, changed, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        col(doc_id), "n_chars", "edited_sha256", shown(mine).alias("fingerprint"),
        shown(changed).alias("edited_fingerprint"), likeness(mine, changed).alias("near_edited"),
        likeness(mine, following).alias("near_next"), containment(mine, changed).alias("held_by_edited"),
    )
