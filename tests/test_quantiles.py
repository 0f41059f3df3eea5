import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from salmoura.functions import quantiles as Q
from salmoura.functions.quantiles import band, grouped, whole_table


def skewed(seed=5):
    """Group 0 holds a third of the rows; one variable has few values, one has gaps and both signs."""
    rng = np.random.default_rng(seed)
    n = 9_000
    k = np.where(np.arange(n) % 3 == 0, 0, rng.integers(1, 400, n))
    x = np.exp(rng.normal(0, 3, n)) * rng.choice([-1.0, 0.0, 1.0], n, p=[0.2, 0.1, 0.7])
    x[rng.random(n) < 0.3] = np.nan
    return pd.DataFrame({"k": k, "x": x, "y": rng.integers(0, 6, n).astype(float)})


def frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


WANTED = {"x25": ("x", 0.25), "x50": ("x", 0.5), "x90": ("x", 0.9), "y50": ("y", 0.5), "x0": ("x", 0.0), "x100": ("x", 1.0)}


def expected(pdf):
    g = pdf.groupby("k")
    return pd.DataFrame({
        "x25": g.x.quantile(0.25), "x50": g.x.median(), "x90": g.x.quantile(0.9), "y50": g.y.median(),
        "x0": g.x.min(), "x100": g.x.max(), "n": g.size(),
    })


@pytest.mark.parametrize("large", [0, 50, 1_000, 100_000])
def test_matches_brute_force(spark, large):
    """All groups by histogram, some of them, the one that holds a third of the rows, none."""
    pdf = skewed()
    got = grouped(frame(spark, pdf), ["k"], [F.count(F.lit(1)).alias("n")], WANTED, large)
    got, want = got.toPandas().set_index("k").sort_index(), expected(pdf)
    assert len(got) == len(want)
    for c in want:
        np.testing.assert_allclose(got[c], want[c], rtol=1e-12, equal_nan=True)


def test_bands_keep_the_order_of_values(spark):
    values = sorted({
        *np.nextafter(2.0 ** np.arange(-1074, 1024, 37.0), np.inf), *2.0 ** np.arange(-1074, 1024, 37.0),
        *np.linspace(-3, 3, 501), 5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), -5e-324,
    })
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", band(F.col("v")).alias("b"))
    bands = [r.b for r in sorted(df.collect())]
    assert bands == sorted(bands) and len(set(bands)) > 500
    nan = spark.createDataFrame([(float("nan"),)], "v double").select(band(F.col("v"))).first()[0]
    assert nan > bands[-1]


def test_a_group_that_holds_all_rows_spreads_over_the_tasks(spark):
    """No sort or shuffle holds the whole group: what meets in one task are its bands, then the values of one band."""
    df = spark.range(60_000).select(F.lit(0).alias("k"), F.exp(F.rand(1) * 9).alias("x"), F.lit(None).cast("double").alias("y"))
    percentiles = {"m": ("x", 0.5), "y": ("y", 0.5)}
    got = grouped(df, ["k"], [F.count("k").alias("n")], percentiles, large=1_000)
    row = got.first()
    assert row.m == pytest.approx(df.toPandas().x.median(), rel=1e-12) and row.n == 60_000 and row.y is None
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan.split("Union")[0] and plan.count("Window") == 3
    values = df.select(band(F.col("x")).alias("b")).groupBy("b").count()
    assert values.agg(F.max("count")).first()[0] < 60_000 / 100


def test_small_groups_are_sent_once(spark):
    df = spark.range(5_000).select((F.col("id") % 700).alias("k"), F.rand(2).alias("x"))
    got = grouped(df, ["k"], [], {"m": ("x", 0.5), "q": ("x", 0.9)})
    plan = got._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange") == 1 and "Window" not in initial


@pytest.mark.parametrize("large", [10, 100_000])
def test_group_of_equal_values_and_group_without_values(spark, large):
    df = spark.range(4_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 2 == 0, 7.5).alias("x"))
    got = {r.k: (r.n, r.m) for r in grouped(df, ["k"], [F.count("k").alias("n")], {"m": ("x", 0.5)}, large).collect()}
    assert got == {0: (2_000, 7.5), 1: (2_000, None)}


@pytest.mark.parametrize("large", [10, 100_000])
def test_whole_table(spark, large):
    pdf = skewed()
    row = whole_table(frame(spark, pdf), {"m": ("x", 0.5)}, large).first()
    assert row.m == pytest.approx(pdf.x.median(), rel=1e-12)


def test_small_groups_are_not_counted_one_by_one(spark, monkeypatch):
    """Where no slot of the keys' hashes is large, no group is; in slots that are, groups are counted by themselves."""
    rows = [("big" if i % 3 else f"k{i % 50}", float((i * 7) % 23) if i % 5 else None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, v double")
    seen = []
    keep = Q._by_histogram
    monkeypatch.setattr(Q, "_by_histogram", lambda df, *a: seen.append(df.select("k").distinct().count()) or keep(df, *a))
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    for slots, large, heavy in ((1 << 16, 900, []), (1 << 16, 100, [1]), (2, 100, [1]), (2, 900, [])):
        monkeypatch.setattr(Q, "SLOTS", slots)
        seen.clear()
        got = {r.k: r.m for r in Q.grouped(df, ["k"], [], {"m": ("v", 0.5)}, large).collect()}
        assert got == want and seen == heavy
