"""Waste, water, analysis and temporal operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from salmoura import names as N
from salmoura.checks import proxies as P
from salmoura.checks.registry import D, R, day, number, query, r, shown
from salmoura.functions import columns as K
from salmoura.operators import analysis as A, cleaning as C, temporal as T, waste as Ws, water as Wt
from salmoura.plans import jobs
from salmoura.session import shared_folder
from salmoura.sources import files


def _months(water: DataFrame) -> DataFrame:
    return Wt.platform_months(water).withColumnRenamed(N.CODE, N.PLATFORM)


def months(spark: SparkSession, d: str) -> DataFrame:
    return _months(P.water(spark, d))


def analysis(spark: SparkSession, d: str, mode: str = A.WINDOW) -> DataFrame:
    waste, water = P.waste_and_water(spark, d)
    return A.analysis_table(waste, _months(water), mode)


# ---- waste ----

LOGS_SQL = """log_a AS (SELECT 'F' || plat AS fcdr, * FROM waste WHERE mes < DATE '2000-01-01'),
log_b AS (SELECT * FROM waste WHERE mes >= DATE '1999-10-01'),
appended AS (SELECT * FROM log_a UNION ALL BY NAME
  SELECT * FROM log_b WHERE mes > (SELECT max(mes) FROM log_a))"""


def _two_logs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    both = P.waste(spark, d)
    first = both.filter(F.col(N.MONTH) < "2000-01-01").withColumn(
        N.MANIFEST, F.concat(F.lit("F"), N.col(N.PLATFORM))
    )
    return first, both.filter(F.col(N.MONTH) >= "1999-10-01")


@query("j1_append_newer", P.WITH_WASTE[:-1] + f""", {LOGS_SQL}
SELECT fcdr, {D('mes')} AS mes, plat, tipo, massa FROM appended""")
def _(spark, d):
    rows = Ws.append_newer(*_two_logs(spark, d))
    return shown(rows, fcdr=N.MANIFEST, mes=day(N.MONTH), plat=N.PLATFORM, tipo=N.WASTE_TYPE,
                 massa=N.MASS)


@query("a1_waste_by_type", P.WITH_WASTE + """
SELECT plat, tipo, sum(massa) AS massa FROM waste GROUP BY plat, tipo""")
def _(spark, d):
    return shown(Ws.sum_by(P.waste(spark, d)), plat=N.PLATFORM, tipo=N.WASTE_TYPE, massa=N.MASS)


def flag_columns() -> dict:
    return dict(
        plat=N.PLATFORM, tem_norm=number("TEM_NORM"), tem_oleosa=number("TEM_OLEOSA"),
        massa_total="MASSA_TOTAL", massa_norm="MASSA_NORM_KG", massa_oleosa="MASSA_OLEOSA_KG",
        massa_class="MASSA_CLASSIFICADA_KG", tipo_massa="TIPO_MASSA",
    )


FLAGS_OUT = """plat, tem_norm::DOUBLE AS tem_norm, tem_oleosa::DOUBLE AS tem_oleosa, massa_total,
  massa_norm, massa_oleosa, massa_class, tipo_massa"""


@query("a2_platform_flags", P.WITH_WASTE + f"SELECT {FLAGS_OUT} FROM flags")
def _(spark, d):
    return shown(Ws.platform_flags(P.waste(spark, d)), **flag_columns())


@query("a2_a3_platform_summary", P.WITH_WASTE + f"""
SELECT f.{FLAGS_OUT}, {D('data_min')} AS data_min, {D('data_max')} AS data_max
FROM flags f LEFT JOIN periods p USING (plat)""".replace("f.plat", "plat"))
def _(spark, d):
    summary = Ws.platform_summary(P.waste(spark, d))
    return shown(summary, **flag_columns(), data_min=day("DATA_MIN"), data_max=day("DATA_MAX"))


@query("j2_flagged_waste", P.WITH_WASTE + f"""
SELECT w.plat, {D('mes')} AS mes, tipo, massa, tem_norm::DOUBLE AS tem_norm,
  tem_oleosa::DOUBLE AS tem_oleosa FROM waste w JOIN flags f ON w.plat = f.plat""")
def _(spark, d):
    waste = P.waste(spark, d)
    rows = Ws.flagged_waste(waste, Ws.platform_flags(waste))
    return shown(rows, plat=N.PLATFORM, mes=day(N.MONTH), tipo=N.WASTE_TYPE, massa=N.MASS,
                 tem_norm=number("TEM_NORM"), tem_oleosa=number("TEM_OLEOSA"))


@query("a3_class_period", P.WITH_WASTE + f"""
SELECT plat, {D('data_min')} AS data_min, {D('data_max')} AS data_max FROM periods""")
def _(spark, d):
    waste = P.waste(spark, d)
    periods = Ws.class_period(Ws.flagged_waste(waste, Ws.platform_flags(waste)))
    return shown(periods, plat=N.PLATFORM, data_min=day("DATA_MIN"), data_max=day("DATA_MAX"))


# ---- water ----


@query("a4_well_month_medians", P.WITH_WATER + f"""
SELECT plat, {D('mes')} AS mes, poco, campo, {R('qw')} AS qw, {R('qo')} AS qo, {R('bsw')} AS bsw,
  {R('ba')} AS ba, {R('sr')} AS sr, {R('sal')} AS sal FROM wells""")
def _(spark, d):
    tests = P.water(spark, d)
    wells = Wt.well_months(tests)
    return shown(wells, plat=N.CODE, mes=day(N.MONTH), poco=N.WELL, campo=N.FIELD,
                 qw=r(N.WATER_RATE), qo=r(N.OIL_RATE), bsw=r(N.BSW), ba=r("BÁRIO"),
                 sr=r("ESTRÔNCIO"), sal=r("SALINIDADE"))


@query("a5_weighted_mean", P.WITH_LINES + f"""
SELECT l_suppkey, {R('''sum(l_extendedprice * l_discount) FILTER (WHERE l_discount > 0)
  / sum(l_discount) FILTER (WHERE l_discount > 0)''')} AS media FROM lineitem GROUP BY l_suppkey""")
def _(spark, d):
    mean = Wt.weighted_mean(F.col("l_extendedprice"), F.col("l_discount"))
    return P.table(spark, d, "lineitem").groupBy("l_suppkey").agg(r(mean).alias("media"))


def month_columns() -> dict:
    return dict(
        plat=N.CODE, mes=day(N.MONTH), campo=N.FIELD, qw=r(N.WATER_RATE), qo=r(N.OIL_RATE),
        bsw=r(N.BSW), n_pocos=number(N.N_WELLS), ba=r("BARIO"), sr=r("ESTRONCIO"),
        sal=r("SALINIDADE", 4), dias=number(N.DAYS), qw_mes=r(N.WATER_MONTH, 4),
        qo_mes=r(N.OIL_MONTH, 4),
    )


MONTH_OUT = f"""plat, {D('mes')} AS mes, campo, {R('qw')} AS qw, {R('qo')} AS qo, {R('bsw')} AS bsw,
  n_pocos::DOUBLE AS n_pocos, {R('ba')} AS ba, {R('sr')} AS sr, {R('sal', 4)} AS sal,
  dias::DOUBLE AS dias, {R('qw_mes', 4)} AS qw_mes, {R('qo_mes', 4)} AS qo_mes"""


@query("a6_a7_platform_totals", P.WITH_WATER + f"""
SELECT {MONTH_OUT} FROM (SELECT *, day(last_day(mes)) AS dias, qw * day(last_day(mes)) AS qw_mes,
  qo * day(last_day(mes)) AS qo_mes FROM sparse)""")
def _(spark, d):
    return shown(Wt.platform_totals(Wt.well_months(P.water(spark, d))), **month_columns())


@query("j9_dense_calendar", P.WITH_WATER + f"SELECT {MONTH_OUT} FROM dense")
def _(spark, d):
    return shown(Wt.dense_months(P.water(spark, d)), **month_columns())


@query("w1_carry_forward", P.WITH_WATER + f"SELECT {MONTH_OUT} FROM months")
def _(spark, d):
    return shown(Wt.carry_forward(Wt.dense_months(P.water(spark, d))), **month_columns())


@query("a8_chemical_loads", P.WITH_WATER + f"""
SELECT plat, {D('mes')} AS mes, {R('ba * qw_mes / 1000', 4)} AS ba_kg,
  {R('sr * qw_mes / 1000', 4)} AS sr_kg, {R('sal * qw_mes / 1000', 4)} AS sal_kg FROM months""")
def _(spark, d):
    loads = Wt.platform_months(P.water(spark, d))
    return shown(loads, plat=N.CODE, mes=day(N.MONTH), ba_kg=r("BARIO_kg_mes", 4),
                 sr_kg=r("ESTRONCIO_kg_mes", 4), sal_kg=r("SALINIDADE_kg_mes", 4))


# ---- analysis ----

CUT_OUT = f"""plat, {D('mes')} AS mes, {D('data_min')} AS data_min, {D('data_max')} AS data_max,
  {R('qw')} AS qw, {R('ba')} AS ba"""


def _cut_columns(df: DataFrame) -> DataFrame:
    return shown(df, plat=N.PLATFORM, mes=day(N.MONTH), data_min=day("DATA_MIN"),
                 data_max=day("DATA_MAX"), qw=r(N.WATER_RATE), ba=r("BARIO"))


def _with_periods(waste: DataFrame, water: DataFrame) -> DataFrame:
    periods = Ws.class_period(Ws.flagged_waste(waste, Ws.platform_flags(waste)))
    return A.with_period(_months(water), periods)


def _dated(spark: SparkSession, d: str) -> DataFrame:
    return _with_periods(*P.waste_and_water(spark, d))


@query("j3_with_period", P.WITH_BOTH + f"""
SELECT {CUT_OUT} FROM (SELECT m.*, data_min, data_max FROM months m JOIN periods p
  ON m.plat = p.plat)""")
def _(spark, d):
    return _cut_columns(_dated(spark, d))


@query("j4_within_period", P.WITH_WINDOW + f"SELECT {CUT_OUT} FROM cut")
def _(spark, d):
    return _cut_columns(A.within_period(_dated(spark, d)))


@query("j5_w3_nearest_month", P.WITH_NEAREST + f"""
SELECT {CUT_OUT}, gap::DOUBLE AS gap FROM cut""")
def _(spark, d):
    nearest = A.nearest_month(_dated(spark, d))
    return shown(
        nearest, plat=N.PLATFORM, mes=day(N.MONTH), data_min=day("DATA_MIN"),
        data_max=day("DATA_MAX"), qw=r(N.WATER_RATE), ba=r("BARIO"),
        gap=number("DIFERENCA_MESES"),
    )


@query("a13_cut_to_period", P.WITH_WINDOW + f"SELECT {CUT_OUT} FROM cut")
def _(spark, d):
    summary = Ws.platform_summary(P.waste(spark, d))
    return _cut_columns(A.cut_to_period(months(spark, d), summary, A.WINDOW))


@query("a9_repeated_months", P.WITH_WATER + f"""
SELECT plat, {D('mes')} AS mes, count(*) AS vezes FROM wells GROUP BY plat, mes
HAVING count(*) > 1""")
def _(spark, d):
    wells = P.water(spark, d).select(N.CODE, N.MONTH, N.WELL).distinct()
    found = A.repeated_months(wells.withColumnRenamed(N.CODE, N.PLATFORM))
    return shown(found, plat=N.PLATFORM, mes=day(N.MONTH), vezes="count")


@query("a10_monthly_by_platform", P.WITH_WINDOW + f"""
SELECT plat, {D('mes')} AS mes, {R('agua', 4)} AS agua, {R('oleo', 4)} AS oleo, {R('ba')} AS ba,
  {R('sr')} AS sr, {R('sal', 4)} AS sal, {R('bsw')} AS bsw FROM monthly""")
def _(spark, d):
    monthly = A.monthly_by_platform(A.within_period(_dated(spark, d)))
    return shown(monthly, plat=N.PLATFORM, mes=day(N.MONTH), agua=r("AGUA_PLAT", 4),
                 oleo=r("OLEO_PLAT", 4), ba=r("BARIO_PLAT"), sr=r("ESTRONCIO_PLAT"),
                 sal=r("SALINIDADE_PLAT", 4), bsw=r("BSW_PLAT"))


STATISTICS = (
    "MEDIANA_AGUA MEDIA_AGUA SOMA_AGUA MEDIA_BSW MEDIANA_BSW P25_BSW P75_BSW STD_BSW MEDIANA_BARIO "
    "MEDIA_BARIO STD_BARIO MEDIANA_ESTRONCIO MEDIA_ESTRONCIO STD_ESTRONCIO MEDIANA_SALINIDADE "
    "MEDIA_SALINIDADE STD_SALINIDADE"
).split()
STATISTICS_OUT = ", ".join(f"{R(s.lower(), 4)} AS {s.lower()}" for s in STATISTICS)


def statistics_columns() -> dict:
    return {s.lower(): r(f"{s}_PLAT", 4) for s in STATISTICS}


@query("a11_platform_statistics", P.WITH_WINDOW + f"SELECT plat, {STATISTICS_OUT} FROM stats")
def _(spark, d):
    stats = A.platform_statistics(A.monthly_by_platform(A.within_period(_dated(spark, d))))
    return shown(stats, plat=N.PLATFORM, **statistics_columns())


ANALYSIS_OUT = f"{FLAGS_OUT}, {STATISTICS_OUT}, {R('ba_sr')} AS ba_sr"


def _analysis_columns(df: DataFrame) -> DataFrame:
    return shown(df, **flag_columns(), **statistics_columns(), ba_sr=r("RELACAO_BARIO_ESTRONCIO"))


@query("j6_a12_join_statistics", P.WITH_NEAREST + f"SELECT {ANALYSIS_OUT} FROM analysis")
def _(spark, d):
    waste, water = P.waste_and_water(spark, d)
    flags = Ws.platform_flags(waste)
    stats = A.platform_statistics(A.monthly_by_platform(A.nearest_month(_with_periods(waste, water))))
    return _analysis_columns(A.join_statistics(flags, stats))


@query("a14_analysis_table_window", P.WITH_WINDOW + f"SELECT {ANALYSIS_OUT} FROM analysis")
def _(spark, d):
    return _analysis_columns(analysis(spark, d, A.WINDOW))


@query("a14_analysis_table_nearest", P.WITH_NEAREST + f"SELECT {ANALYSIS_OUT} FROM analysis")
def _(spark, d):
    return _analysis_columns(analysis(spark, d, A.NEAREST))


@query("a24_run_counts", P.WITH_WASTE + """
SELECT count(*) AS linhas, strftime(max(mes), '%Y-%m-%d') AS ultimo_mes FROM waste""")
def _(spark, d):
    watched, seen = jobs.counted(P.waste(spark, d), "waste", F.max(N.MONTH).alias("last"))
    files.write_stage(watched, shared_folder(spark), "waste")
    found = jobs.observed(seen)
    return spark.createDataFrame(
        [(found["rows"], str(found["last"]))], "linhas long, ultimo_mes string"
    )


# ---- stage tables ----


@query("s7_write_stage", P.WITH_WATER + f"SELECT {MONTH_OUT} FROM months")
def _(spark, d):
    written = files.write_stage(
        Wt.platform_months(P.water(spark, d)), shared_folder(spark), jobs.WATER
    )
    return shown(written, **month_columns())


# ---- temporal validation ----

TEMPORAL_SQL = P.WITH_BOTH[:-1] + """, classed AS (
  SELECT plat, mes, norm::INT AS flag FROM tagged WHERE norm OR oily
), by_month AS (SELECT plat, mes, max(flag) AS tem_norm_mes FROM classed GROUP BY plat, mes
), by_platform AS (SELECT plat, max(flag) AS tem_norm FROM classed GROUP BY plat
), firsts AS (SELECT plat, min(mes) AS primeiro FROM by_month WHERE tem_norm_mes = 1 GROUP BY plat
), temporal AS (
  SELECT m.plat, m.mes, sal, ba, sr, qw_mes, qo_mes, bsw, n_pocos,
    CASE WHEN sr > 0 THEN ba / sr END AS ratio, tem_norm_mes, primeiro, tem_norm,
    coalesce(m.mes = primeiro, false)::INT AS eh_primeiro,
    (year(primeiro) - year(m.mes)) * 12 + month(primeiro) - month(m.mes) AS meses_ate,
    sal IS NOT NULL AND ba IS NOT NULL AND sr IS NOT NULL AS elegivel
  FROM months m LEFT JOIN by_month b ON m.plat = b.plat AND m.mes = b.mes
  LEFT JOIN firsts f ON m.plat = f.plat LEFT JOIN by_platform p ON m.plat = p.plat
)
"""
TEMPORAL_OUT = f"""plat, {D('mes')} AS mes, {R('sal', 4)} AS sal, {R('ba')} AS ba, {R('sr')} AS sr,
  {R('ratio')} AS ratio, {R('bsw')} AS bsw, n_pocos::DOUBLE AS n_pocos,
  tem_norm_mes::DOUBLE AS tem_norm_mes, {D('primeiro')} AS primeiro, tem_norm::DOUBLE AS tem_norm,
  eh_primeiro::DOUBLE AS eh_primeiro, meses_ate::DOUBLE AS meses_ate, elegivel"""


def temporal(spark: SparkSession, d: str) -> DataFrame:
    waste, water = P.waste_and_water(spark, d)
    return T.temporal_table(_months(water), waste, ordered=False)


def _temporal_columns(df: DataFrame) -> DataFrame:
    return shown(
        df, plat=N.PLATFORM, mes=day(N.MONTH), sal=r("SALINIDADE", 4), ba=r("BARIO"),
        sr=r("ESTRONCIO"), ratio=r(N.RATIO), bsw=r(N.BSW), n_pocos=number(N.N_WELLS),
        tem_norm_mes=number("TEM_NORM_MES"), primeiro=day("DATA_PRIMEIRO_NORM"),
        tem_norm=number("TEM_NORM"), eh_primeiro=number("PRIMEIRO_NORM"),
        meses_ate=number("MESES_ATE_NORM"), elegivel="ELEGIVEL_MODELO",
    )


@query("a15_monthly_class", TEMPORAL_SQL + f"""
SELECT plat, {D('mes')} AS mes, tem_norm_mes::DOUBLE AS tem_norm_mes FROM by_month""")
def _(spark, d):
    return shown(T.monthly_class(P.waste(spark, d)), plat=N.PLATFORM, mes=day(N.MONTH),
                 tem_norm_mes=number("TEM_NORM_MES"))


@query("a15_platform_class", TEMPORAL_SQL + f"""
SELECT plat, tem_norm::DOUBLE AS tem_norm, {D('primeiro')} AS primeiro
FROM by_platform LEFT JOIN firsts USING (plat)""")
def _(spark, d):
    return shown(T.platform_class(P.waste(spark, d)), plat=N.PLATFORM,
                 tem_norm=number("TEM_NORM"), primeiro=day("DATA_PRIMEIRO_NORM"))


@query("a16_first_occurrence", TEMPORAL_SQL + f"SELECT plat, {D('primeiro')} AS primeiro FROM firsts")
def _(spark, d):
    first = T.first_occurrence(T.monthly_class(P.waste(spark, d)))
    return shown(first, plat=N.PLATFORM, primeiro=day("DATA_PRIMEIRO_NORM"))


@query("a17_j7_temporal_table", TEMPORAL_SQL + f"SELECT {TEMPORAL_OUT} FROM temporal")
def _(spark, d):
    return _temporal_columns(temporal(spark, d))


@query("s8_temporal_from_stages", TEMPORAL_SQL + f"SELECT {TEMPORAL_OUT} FROM temporal")
def _(spark, d):
    folder = shared_folder(spark)
    waste, water = P.waste_and_water(spark, d)
    files.write_stage(_months(water), folder, jobs.WATER)
    files.write_stage(waste, folder, jobs.WASTE)
    return _temporal_columns(T.temporal_table(
        files.read_stage(spark, folder, jobs.WATER), files.read_stage(spark, folder, jobs.WASTE)
    ))


@query("c27_eligible", P.WITH_WATER + f"""
SELECT plat, {D('mes')} AS mes, sal IS NOT NULL AND ba IS NOT NULL AND sr IS NOT NULL AS elegivel
FROM sparse""")
def _(spark, d):
    sparse = Wt.platform_totals(Wt.well_months(P.water(spark, d)))
    return shown(sparse, plat=N.CODE, mes=day(N.MONTH), elegivel=K.complete(N.FEATURES))


@query("c28_first_month_flag", TEMPORAL_SQL + f"""
SELECT b.plat, {D('mes')} AS mes, coalesce(mes = primeiro, false)::INT AS eh_primeiro
FROM by_month b LEFT JOIN firsts f ON b.plat = f.plat""")
def _(spark, d):
    waste = P.waste(spark, d)
    rows = T.monthly_class(waste).join(T.platform_class(waste), N.PLATFORM, "left")
    flag = K.same_month_flag(F.col(N.MONTH), F.col("DATA_PRIMEIRO_NORM"))
    return shown(rows, plat=N.PLATFORM, mes=day(N.MONTH), eh_primeiro=flag)


BATCH_OUT = f"""plat, {D('mes')} AS mes, tem_norm::DOUBLE AS tem_norm,
  tem_norm_mes::DOUBLE AS tem_norm_mes, eh_primeiro::DOUBLE AS eh_primeiro,
  {D('primeiro')} AS primeiro, meses_ate::DOUBLE AS meses_ate, {R('sal', 4)} AS sal,
  {R('ba')} AS ba, {R('sr')} AS sr"""


def _batch_columns(df: DataFrame) -> DataFrame:
    return shown(
        df, plat=N.SITE, mes=day(N.MONTH), tem_norm=number("TEM_NORM"),
        tem_norm_mes=number("TEM_NORM_MES"), eh_primeiro=number("PRIMEIRO_NORM"),
        primeiro=day("DATA_PRIMEIRO_NORM"), meses_ate=number("MESES_ATE_NORM"),
        sal=r("SALINIDADE", 4), ba=r("BARIO"), sr=r("ESTRONCIO"),
    )


@query("a18_scoring_input", TEMPORAL_SQL + f"SELECT {BATCH_OUT} FROM temporal WHERE elegivel")
def _(spark, d):
    return _batch_columns(T.scoring_input(temporal(spark, d)))


@query("s9_batch_files", TEMPORAL_SQL + f"SELECT {BATCH_OUT} FROM temporal WHERE elegivel")
def _(spark, d):
    path = f"{shared_folder(spark)}/entrada.csv"
    files.write_csv(T.scoring_input(temporal(spark, d), ordered=False), path)
    back = C.numeric_columns(
        files.read_table(spark, path), [*N.FEATURES, "TEM_NORM", "TEM_NORM_MES"]
    )
    return _batch_columns(back.withColumns({
        c: F.to_date(c) for c in (N.MONTH, "DATA_PRIMEIRO_NORM")
    }))
