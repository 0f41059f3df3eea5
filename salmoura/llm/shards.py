"""Sharding by jump consistent hashing, with gapless slots.

A row's shard follows from its id and the number of shards alone. Starting at shard 0, a row jumps from shard b to
floor((b + 1) / u) with u uniform in (0, 1], until that is no shard any more; the random numbers come from a
hash of id and b. One more shard therefore takes rows only into itself, one in n + 1 of each. The number
of jumps grows with the logarithm of the number of shards.

Slots number the rows of a shard from 0 without gaps. Each shard is cut into parts by hash, the parts' counts are
summed up in order, and each part numbers its own rows; no shard is ever one task.

Defined results: a null text has no bytes, so size 1 and the checksum of nothing; rows without id share one key;
rows repeating an id share its shard and have slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from salmoura.names import col

SHARDS = 16
_STEPS = 64  # more jumps than this do not occur in practice; a second loop goes on if they do


def jump(key: Column, shards: int, steps: int = _STEPS) -> Column:
    """The shard of a 64-bit key among ``shards``."""
    bits = 31

    def step(at: Column, _: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, at["next"]), 64 - bits) + 1
        landed = F.floor((at["next"] + 1) * F.lit(float(1 << bits)) / draw).cast("bigint")
        return F.when(at["next"] >= shards, at).otherwise(
            F.struct(at["next"].alias("shard"), landed.alias("next"))
        )

    start = F.struct(F.lit(0).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("next"))
    some = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, steps))), start, step)
    if shards > steps:
        some = F.transform(F.array(some), lambda at: F.when(at["next"] >= shards, at).otherwise(
            F.aggregate(F.sequence(F.lit(steps + 1), F.lit(shards)), at, step)
        ))[0]
    return some["shard"].cast("int")


def sharded(
    documents: DataFrame, shards: int = SHARDS, *, doc_id: str = "doc_id", text: str = "text",
    parts: int | None = None,
) -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, and its shard if there were one more."""
    spark = documents.sparkSession
    if parts is None:  # of each shard, so that all parts together are several for each shuffle partition
        parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions", "200")) // 2)
    key = F.xxhash64(col(doc_id))
    rows = documents.select(
        col(doc_id).alias("_id"),
        (F.coalesce(F.octet_length(col(text)), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        jump(key, shards).alias("shard"), jump(key, shards + 1).alias("grown_shard"),
    ).withColumn("_part", F.pmod(F.xxhash64("_id", "size", "text_crc32", F.lit("part")), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    # at most shards x parts rows
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_part").orderBy("_id", "size", "text_crc32")
    numbered = rows.withColumn("_i", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["shard", "_part"]).select(
        F.col("_id").alias(doc_id), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_before") + F.col("_i")).cast("bigint").alias("slot"), "grown_shard",
    )
