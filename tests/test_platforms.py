"""Waste, water, analysis and temporal operators on hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from salmoura import names as N
from salmoura.operators import analysis as A, temporal as T, waste as Ws, water as Wt

WASTE = f"`{N.PLATFORM}` string, {N.MONTH} date, `{N.WASTE_TYPE}` string, `{N.MASS}` double"


def m(year, month):
    return date(year, month, 1)


@pytest.fixture
def waste(spark):
    return spark.createDataFrame([
        ("A", m(2020, 3), "BORRA OLEOSA COM NORM", 10.0),
        ("A", m(2020, 1), "borra oleosa", 5.0),
        ("A", m(2020, 6), "Borra Oleosa com Norm (x)", 2.0),
        ("B", m(2020, 2), "BORRA OLEOSA", 3.0),
        ("B", m(2020, 9), "borra oleosa normal", 4.0),   # any NORM text is not oily
        ("C", m(2020, 2), "SUCATA", 7.0),                 # neither class
        ("D", m(2020, 2), None, None),
        (None, m(2020, 2), "BORRA OLEOSA", 1.0),
    ], WASTE)


def test_flags(waste):
    rows = {r[N.PLATFORM]: r for r in Ws.platform_flags(waste).collect()}
    assert set(rows) == {"A", "B", "C", "D"}
    a, b, c, d = (rows[k] for k in "ABCD")
    assert (a.TEM_NORM, a.TEM_OLEOSA, a.MASSA_TOTAL, a.MASSA_CLASSIFICADA_KG) == (1, 0, 17.0, 12.0)
    assert (b.TEM_NORM, b.TEM_OLEOSA, b.MASSA_OLEOSA_KG) == (0, 1, 3.0)
    assert (c.TEM_OLEOSA, c.MASSA_CLASSIFICADA_KG, c.TIPO_MASSA) == (0, 0.0, Ws.WITHOUT_NORM)
    assert d.MASSA_TOTAL == 0.0


def test_summary_agrees_with_separate_steps(waste):
    flags = Ws.platform_flags(waste)
    period = Ws.class_period(Ws.flagged_waste(waste, flags))
    both = flags.join(period, N.PLATFORM, "left")
    summary = Ws.platform_summary(waste).select(*both.columns)
    assert sorted(summary.collect(), key=str) == sorted(both.collect(), key=str)
    rows = {r[N.PLATFORM]: (r.DATA_MIN, r.DATA_MAX) for r in summary.collect()}
    assert rows == {
        "A": (m(2020, 3), m(2020, 6)), "B": (m(2020, 2), m(2020, 2)),
        "C": (None, None), "D": (None, None),
    }


def test_append_is_strictly_newer(spark):
    a = spark.createDataFrame([("f", m(2020, 1)), ("g", m(2020, 3))], "FCDR string, Mes date")
    b = spark.createDataFrame([(m(2020, 2),), (m(2020, 3),), (m(2020, 4),), (None,)], "Mes date")
    rows = Ws.append_newer(a, b).collect()
    assert [(r.FCDR, r.Mes) for r in rows] == [
        ("f", m(2020, 1)), ("g", m(2020, 3)), (None, m(2020, 4))
    ]


TESTS = (
    "_ordem long, SIGLA string, Mes date, POCO string, CAMPO string, QW_M3D double, QO_M3D double, "
    "BSW double, `BÁRIO` double, `ESTRÔNCIO` double, SALINIDADE double"
)


@pytest.fixture
def tests(spark):
    return spark.createDataFrame([
        # flow and chemistry of one well on different rows
        (0, "A", m(2020, 1), "w2", None, 10.0, 1.0, 50.0, None, None, None),
        (1, "A", m(2020, 1), "w2", "G", None, None, None, 4.0, 2.0, 100.0),
        (2, "A", m(2020, 1), "w2", "F", 30.0, 3.0, 70.0, 6.0, None, None),
        (3, "A", m(2020, 1), "w1", None, 60.0, 2.0, 10.0, 20.0, 0.0, -5.0),
        (4, "A", m(2020, 1), "w3", "Z", 0.0, 2.0, 10.0, 9.0, 9.0, 9.0),
        (5, "A", m(2020, 6), "w1", None, None, None, None, None, None, None),
        (6, "B", m(2020, 3), "w1", None, 5.0, None, None, None, None, 1.0),
        (7, None, m(2020, 3), "w1", "F", 5.0, None, None, None, None, 1.0),
        (8, "B", m(2020, 4), None, "F", 5.0, None, None, None, None, 1.0),
        (9, "B", None, "w1", "F", 5.0, None, None, None, None, 1.0),
    ], TESTS)


def test_platform_months(tests):
    rows = {(r.SIGLA, r.Mes.month): r for r in Wt.platform_months(tests).collect()}
    assert set(rows) == {(s, k) for s in "AB" for k in range(1, 7)}
    first = rows["A", 1]
    assert first.CAMPO == "G"                       # first field of the first well that has one
    assert (first.QW_M3D, first.QO_M3D, first.BSW, first.N_POCOS) == (80.0, 6.0, 10.0, 3)
    assert first.BARIO == pytest.approx((5 * 20 + 20 * 60) / 80)
    assert first.ESTRONCIO == 2.0 and first.SALINIDADE == 100.0
    assert first.QW_mensal_m3 == 80.0 * 31
    assert first.BARIO_kg_mes == pytest.approx(first.BARIO * 80 * 31 / 1000)
    # chemistry is carried two months, flow is not
    assert [rows["A", k].ESTRONCIO for k in range(1, 7)] == [2.0, 2.0, 2.0, None, None, None]
    assert rows["A", 2].QW_M3D is None and rows["A", 2].BARIO_kg_mes is None
    assert rows["A", 2].dias_mes == 29 and rows["A", 2].N_POCOS is None
    assert rows["A", 6].QW_M3D is None and rows["A", 6].N_POCOS == 1
    assert rows["B", 3].SALINIDADE == 1.0 and rows["B", 1].SALINIDADE is None


def test_crowded_wells_and_platforms(spark):
    """One well-month and one platform-month with a large share of all rows."""
    n = 6_000
    many = spark.range(n).select(
        F.col("id").alias(N.INGEST_ORDER),
        F.when(F.col("id") % 3 == 0, "A").otherwise(F.concat(F.lit("S"), F.col("id") % 40)).alias("SIGLA"),
        F.lit(m(2020, 1)).alias("Mes"),
        F.when(F.col("id") % 6 == 0, F.concat(F.lit("w"), F.col("id"))).otherwise("w").alias("POCO"),
        F.concat(F.lit("F"), F.col("id") % 7).alias("CAMPO"),
        *[F.round(F.rand(i) * 100, 2).alias(c) for i, c in enumerate(
            ["QW_M3D", "QO_M3D", "BSW", "BÁRIO", "ESTRÔNCIO", "SALINIDADE"])],
    ).toPandas()
    wells = Wt.well_months(spark.createDataFrame(many)).toPandas().set_index(["SIGLA", "POCO"])
    want = many.groupby(["SIGLA", "POCO"])
    assert len(wells) == len(want)
    for c in ("QW_M3D", "BSW", "BÁRIO"):
        assert wells[c].to_dict() == pytest.approx(want[c].median().to_dict())
    assert wells["CAMPO"].to_dict() == want["CAMPO"].first().to_dict()
    months = Wt.platform_months(spark.createDataFrame(many)).toPandas().set_index("SIGLA")
    assert months["BSW"].to_dict() == pytest.approx(want["BSW"].median().groupby("SIGLA").median().to_dict())
    with pytest.raises(ValueError, match="order"):
        Wt.well_months(spark.createDataFrame(many.drop(columns=N.INGEST_ORDER)))


MONTHS = (
    f"`{N.PLATFORM}` string, Mes date, QW_mensal_m3 double, QO_mensal_m3 double, BARIO double, "
    "ESTRONCIO double, SALINIDADE double"
)


def months(spark, rows):
    return spark.createDataFrame(rows, MONTHS)


@pytest.fixture
def series(spark):
    rows = [("A", m(2020, k), 10.0 * k, 10.0, 1.0 * k, 2.0, 3.0) for k in range(1, 8)]
    rows += [("B", m(2020, 1), 1.0, 1.0, None, 0.0, None), ("B", m(2020, 3), None, None, 1.0, 1.0, 1.0)]
    rows += [("C", m(2020, 2), 1.0, 1.0, 1.0, 1.0, 1.0)]
    return months(spark, rows)


def test_window_and_nearest(waste, series):
    summary = Ws.platform_summary(waste)
    window = A.cut_to_period(series, summary, "janela")
    assert sorted(r.Mes.month for r in window.collect() if r[N.PLATFORM] == "A") == [3, 4, 5, 6]
    nearest = {r[N.PLATFORM]: r.Mes.month for r in A.cut_to_period(series, summary, "data").collect()}
    assert nearest == {"A": 3, "B": 1}          # equally far: the earlier month; C has no class
    with pytest.raises(ValueError):
        A.cut_to_period(series, summary, "outro")


def test_nearest_outside_the_series(spark, waste):
    late = months(spark, [("A", m(2021, k), 1.0, 1.0, 1.0, 1.0, 1.0) for k in (1, 2)])
    early = months(spark, [("A", m(2019, k), 1.0, 1.0, 1.0, 1.0, 1.0) for k in (1, 2)])
    summary = Ws.platform_summary(waste)
    assert A.cut_to_period(late, summary).first().Mes == m(2021, 1)
    assert A.cut_to_period(early, summary).first().Mes == m(2019, 2)


def test_analysis_table(waste, series):
    rows = {r[N.PLATFORM]: r for r in A.analysis_table(waste, series, "janela").collect()}
    assert set(rows) == {"A"}        # B's month lies outside its series, C has no class
    a = rows["A"]
    assert a.SOMA_AGUA_PLAT == 180.0 and a.MEDIANA_BARIO_PLAT == 4.5
    assert a.RELACAO_BARIO_ESTRONCIO == 2.25 and a.TEM_NORM == 1
    bsw = [10.0 * k / (10.0 * k + 10) * 100 for k in (3, 4, 5, 6)]
    assert a.MEDIA_BSW_PLAT == pytest.approx(sum(bsw) / 4)


def test_empty_filler_drops_the_platform(waste, spark):
    filler = months(spark, [("A", m(2020, 3), None, None, 1.0, 1.0, 1.0)])
    assert A.analysis_table(waste, filler, "data").count() == 0


def test_ratio_needs_a_positive_divisor(waste, spark):
    zero = months(spark, [("A", m(2020, 3), 1.0, 1.0, 1.0, 0.0, 1.0)])
    assert A.analysis_table(waste, zero, "data").first().RELACAO_BARIO_ESTRONCIO is None


def test_repeated_month_fails(spark, series):
    twice = series.union(series)
    with pytest.raises(ValueError, match="repeated"):
        A.require_unique_months(twice)
    with pytest.raises(Exception, match="one row per platform and month"):
        A.monthly_by_platform(twice).collect()
    A.require_unique_months(series)


def test_other_platform_names(waste, series):
    renamed = series.withColumnRenamed(N.PLATFORM, N.SITE)
    assert A.analysis_table(waste, renamed, "janela").count() == 1


def test_temporal_table(waste, series):
    full = series.withColumns({N.BSW: F.lit(1.0), N.N_WELLS: F.lit(1)})
    rows = {(r[N.PLATFORM], r.Mes.month): r for r in T.temporal_table(full, waste).collect()}
    assert len(rows) == series.count()
    assert [rows["A", k].TEM_NORM_MES for k in (1, 2, 3)] == [0, None, 1]
    assert [rows["A", k].PRIMEIRO_NORM for k in (1, 3, 6)] == [0, 1, 0]
    assert [rows["A", k].MESES_ATE_NORM for k in (1, 3, 6)] == [2, 0, -3]
    assert rows["B", 1].TEM_NORM == 0 and rows["B", 1].MESES_ATE_NORM is None
    assert rows["B", 1].ELEGIVEL_MODELO is False and rows["B", 1].RELACAO_BA_SR is None
    assert rows["C", 2].TEM_NORM is None and rows["C", 2].PRIMEIRO_NORM == 0
    batch = T.scoring_input(T.temporal_table(full, waste)).collect()
    assert len(batch) == 9 and batch[0].PLATAFORMA == "A"
    assert [(r.PLATAFORMA, r.Mes) for r in batch] == sorted((r.PLATAFORMA, r.Mes) for r in batch)


def test_temporal_table_sums_up_the_waste_once(spark, tmp_path):
    """One aggregate serves both joins; an undated record counts for its platform, but for no month, missing or not."""
    oily, norm = "BORRA OLEOSA", "BORRA OLEOSA COM NORM"
    waste = spark.createDataFrame([
        ("A", date(2020, 1, 1), oily), ("A", date(2020, 2, 1), norm), ("A", None, norm), ("B", None, norm), (None, date(2020, 1, 1), norm),
        ("C", date(2020, 1, 1), "OUTROS"),
    ], f"`{N.PLATFORM}` string, {N.MONTH} date, `{N.WASTE_TYPE}` string")
    waste.write.parquet(str(tmp_path / "w"))
    months = spark.createDataFrame([
        ("A", date(2020, 1, 1)), ("A", date(2020, 2, 1)), ("A", None), ("B", date(2020, 1, 1)), ("C", date(2020, 1, 1)), (None, date(2020, 1, 1)),
    ], f"`{N.PLATFORM}` string, {N.MONTH} date").withColumns({c: F.lit(1.0) for c in N.FEATURES})
    table = T.temporal_table(months, spark.read.parquet(str(tmp_path / "w")), ordered=False)
    got = {(r[N.PLATFORM], r[N.MONTH] and r[N.MONTH].month): (r.TEM_NORM, r.TEM_NORM_MES, r.PRIMEIRO_NORM) for r in table.collect()}
    assert got == {("A", 1): (1, 0, 0), ("A", 2): (1, 1, 1), ("A", None): (1, None, 0), ("B", 1): (1, None, 0), ("C", 1): (None, None, 0),
                   (None, 1): (None, None, 0)}
    assert table.columns[-6:] == ["TEM_NORM", "DATA_PRIMEIRO_NORM", "TEM_NORM_MES", "PRIMEIRO_NORM", "MESES_ATE_NORM", "ELEGIVEL_MODELO"]
    assert "ReusedExchange" in table._jdf.queryExecution().executedPlan().toString()
