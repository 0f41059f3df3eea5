"""The cleaning jobs over raw tables made of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from salmoura import names as N
from salmoura.checks import proxies as P
from salmoura.checks.cleaning_queries import KINDS, PATHS, PATHS_SQL, TAIL_SQL, TIDY_SQL
from salmoura.checks.platform_queries import MONTH_OUT, month_columns
from salmoura.checks.registry import D, R, day, query, r, shown
from salmoura.operators import water as Wt
from salmoura.plans import jobs


@query("p1_clean_production", f"""
WITH raw AS (SELECT o_orderkey, date_trunc('month', o_orderdate) AS mes,
    day(last_day(o_orderdate)) AS dias,
    CASE o_custkey % 3 WHEN 0 THEN 'P-' || (o_custkey % 70) WHEN 1 THEN 'FPSO-BR'
      ELSE 'UNIDADE SAO JOAO' END AS plat,
    CASE WHEN o_custkey % 5 <> 0 THEN floor(o_totalprice / 100) END AS oleo
  FROM orders), kept AS (
  SELECT *, row_number() OVER (PARTITION BY oleo ORDER BY o_orderkey) AS rn FROM raw)
SELECT o_orderkey, {D('mes')} AS mes, plat, oleo::DOUBLE AS oleo, {R('oleo * dias')} AS oleo_mes,
  {R('2.5 * dias')} AS agua_mes FROM kept WHERE rn = 1""")
def _(spark, d):
    raw = P.table(spark, d, "orders").select(
        "o_orderkey",
        F.date_format("o_orderdate", "yyyy/MM").alias(N.PERIOD),
        F.expr("""CASE o_custkey % 3
          WHEN 0 THEN 'petrobras ' || (o_custkey % 70) || ' (P-' || (o_custkey % 70) || ')'
          WHEN 1 THEN 'FPSO-BRASIL' ELSE 'Unidade São João' END""").alias("Instalação Destino"),
        F.expr("CASE WHEN o_custkey % 5 <> 0 THEN cast(floor(o_totalprice / 100) AS string) END")
        .alias("Óleo (bbl/dia)"),
        F.lit(1.0).alias("Condensado (bbl/dia)"),
        F.lit(2.5).alias("Água (bbl/dia)"),
        F.lit(None).cast("string").alias("Vazia"),
        F.col("o_orderkey").alias(N.INGEST_ORDER),
    )
    rows = jobs.clean_production(raw)
    return shown(rows, o_orderkey="o_orderkey", mes=day(N.MONTH), plat=N.PLATFORM,
                 oleo="Óleo (bbl/dia)", oleo_mes=r("Óleo (bbl/mes)"), agua_mes=r("Água (bbl/mes)"))


@query("p2_clean_waste_a", f"""
WITH {PATHS_SQL}, {TAIL_SQL}, {TIDY_SQL}, named AS (SELECT p_partkey, CASE
    WHEN nome LIKE '%BRASIL%' THEN 'FPBR' WHEN nome LIKE '%MARICA%' THEN 'FPMQT'
    WHEN nome LIKE '%SANTOS%' THEN 'FPCST' WHEN nome LIKE '%PARATY%' THEN 'FPCPY'
""" + r"""    ELSE regexp_replace(nome, '^P(\d+)$', 'P-\1') END AS plat FROM tidy),
""" + f"""kinds AS (SELECT p_partkey, CASE WHEN tipo LIKE '%CATEGORIA I%' THEN 'BORRA OLEOSA COM NORM'
  ELSE tipo END AS tipo FROM (SELECT p_partkey, {KINDS} AS tipo FROM part))
SELECT 'F' || l_orderkey AS fcdr, {D("date_trunc('month', l_shipdate)")} AS mes, plat, tipo,
  l_quantity AS massa FROM lineitem JOIN named ON l_partkey = named.p_partkey
  JOIN kinds ON l_partkey = kinds.p_partkey""")
def _(spark, d):
    lines, parts = (P.table(spark, d, t) for t in ("lineitem", "part"))
    raw = lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.concat(F.lit("F"), F.col("l_orderkey")).alias(N.MANIFEST),
        F.date_format("l_shipdate", "yyyy/M").alias("Dt. Geração"),
        F.expr(PATHS).alias("L. de Atuação da Geradora"),
        F.expr(KINDS).alias("Resíduo"),
        F.col("l_quantity").cast("string").alias("Qtd. Recebida (kg)"),
    )
    rows = jobs.clean_waste_a(raw)
    return shown(rows, fcdr=N.MANIFEST, mes=day(N.MONTH), plat=N.PLATFORM, tipo=N.WASTE_TYPE,
                 massa=N.MASS)


@query("p3_clean_waste_b", f"""
SELECT {D("date_trunc('month', l_shipdate)")} AS mes, s_name AS plat, l_returnflag AS tipo,
  CASE WHEN l_linenumber <> 4 THEN l_quantity END AS massa
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
def _(spark, d):
    lines, suppliers = (P.table(spark, d, t) for t in ("lineitem", "supplier"))
    raw = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(
        F.col("l_shipdate").alias("Data - Geração"),
        F.col("l_returnflag").alias("Resíduo"),
        F.col("s_name").alias("Unidade Operacional"),
        F.when(F.col("l_linenumber") != 4, F.col("l_quantity").cast("string")).otherwise("?")
        .alias("Geração - Kg"),
    )
    rows = jobs.clean_waste_b(raw)
    return shown(rows, mes=day(N.MONTH), plat=N.PLATFORM, tipo=N.WASTE_TYPE, massa=N.MASS)


@query("p4_clean_water_months", P.WITH_WATER.replace(
    "FROM water GROUP", "FROM water WHERE dt >= DATE '2000-01-01' GROUP"
) + f"SELECT {MONTH_OUT} FROM months")
def _(spark, d):
    tests = P.water(spark, d)
    text = {c: N.col(c).cast("string") for c in (N.WATER_RATE, N.OIL_RATE, *N.CHEMISTRY)}
    raw = tests.drop(N.MONTH).withColumns({
        **text,
        N.DATE: F.date_format(N.DATE, "yyyy-MM-dd HH:mm:ss"),
        N.SITE: F.lit(None).cast("string"),
    })
    return shown(Wt.platform_months(jobs.clean_water(raw)), **month_columns())
