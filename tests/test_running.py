import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from salmoura.functions.running import BUCKET, bucket_of, equal_splits, running_totals


def test_buckets_count_splits_at_or_below(spark):
    splits = [1.0, 2.0, 5.0]
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 1.5, 2.0, 4.9, 5.0, 9.0)], "x double")
    got = [r.b for r in df.select(bucket_of(F.col("x"), splits).alias("b")).collect()]
    assert got == [0, 1, 1, 2, 2, 3, 3]


def test_no_splits_is_one_bucket(spark):
    assert spark.range(2).select(bucket_of(F.col("id"), []).alias("b")).distinct().count() == 1


def test_running_totals_match_cumsum(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 3000), "x": rng.normal(0, 1, 3000) ** 5})
    pdf["v"] = rng.integers(0, 10, 3000)
    df = spark.createDataFrame(pdf)
    splits = equal_splits(df, "x", 16)
    bucketed = df.withColumn(BUCKET, bucket_of(F.col("x"), splits))
    got = running_totals(bucketed, ["g"], [F.col("x")], {"before": "v"}).toPandas()
    got = got.sort_values(["g", "x"]).reset_index(drop=True)
    want = pdf.sort_values(["g", "x"]).reset_index(drop=True)
    assert (got.before == want.groupby("g").v.cumsum() - want.v).all()
    assert (got.before_all == want.groupby("g").v.transform("sum")).all()
    assert got[BUCKET].nunique() > 4


def test_equal_splits_of_skewed_values_are_balanced(spark):
    df = spark.range(20_000).select(F.pow(F.rand(3), F.lit(9.0)).alias("x"))
    splits = equal_splits(df, "x", 10)
    sizes = df.groupBy(bucket_of(F.col("x"), splits)).count().toPandas()["count"]
    assert len(sizes) == 10 and sizes.max() < 4_000
