"""Waste, water and score tables expressed over the test star schema.

Each proxy exists twice, as DataFrame code and as SQL for the comparison run, with
the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from salmoura import names as N
from salmoura.session import materialise


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    lines, parts, suppliers = (
        table(spark, folder, t) for t in ("lineitem", "part", "supplier")
    )
    return lines.join(parts, lines.l_partkey == parts.p_partkey).join(
        suppliers, lines.l_suppkey == suppliers.s_suppkey
    )


def _waste(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.trunc("l_shipdate", "MM").alias(N.MONTH),
        F.col("s_name").alias(N.PLATFORM),
        F.expr("""CASE WHEN l_suppkey % 3 = 0 AND p_type = 'PROMO' THEN 'BORRA OLEOSA COM NORM'
                       WHEN p_type IN ('LARGE', 'SMALL') THEN 'BORRA OLEOSA'
                       ELSE 'OUTROS' END""").alias(N.WASTE_TYPE),
        F.col("l_quantity").alias(N.MASS),
    )


def _water(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("s_name").alias(N.CODE),
        F.expr("'W' || (l_partkey % 5)").alias(N.WELL),
        F.col("p_brand").alias(N.FIELD),
        F.col("l_shipdate").alias(N.DATE),
        F.trunc("l_shipdate", "MM").alias(N.MONTH),
        F.col("l_quantity").alias(N.WATER_RATE),
        F.expr("l_quantity * (0.5D + l_discount)").alias(N.OIL_RATE),
        F.expr("100 * l_discount").alias(N.BSW),
        F.expr("CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / 1000 END").alias("BÁRIO"),
        F.expr("CASE WHEN l_linenumber % 3 = 0 THEN p_retailprice / 10 END").alias("ESTRÔNCIO"),
        F.expr("CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END").alias("SALINIDADE"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias(
            N.INGEST_ORDER
        ),
    )


def waste(spark: SparkSession, folder: str) -> DataFrame:
    return _waste(_lines(spark, folder))


def water(spark: SparkSession, folder: str) -> DataFrame:
    return _water(_lines(spark, folder))


def waste_and_water(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both tables, of lines that are joined and written once: waste is read by one step and water by two."""
    lines = materialise(_lines(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount",
        "p_brand", "p_type", "p_retailprice", "s_name",
    ))
    return _waste(lines), _water(lines)


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Actual class ``y`` and a probability ``p`` with ties, per document."""
    labels, documents = (table(spark, folder, t) for t in ("labels", "documents"))
    p = F.expr("round(1 / (1 + exp(-(n_chars - 2000) / 1500.0D)), 3)")
    return labels.join(documents, "doc_id").select(
        "doc_id", F.col("quality").alias("y"), p.alias("p")
    )


# ---- the same tables as SQL ----

LINES_SQL = """lines AS (
  SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)"""

WASTE_SQL = """waste AS (
  SELECT date_trunc('month', l_shipdate) AS mes, s_name AS plat,
         CASE WHEN l_suppkey % 3 = 0 AND p_type = 'PROMO' THEN 'BORRA OLEOSA COM NORM'
              WHEN p_type IN ('LARGE', 'SMALL') THEN 'BORRA OLEOSA' ELSE 'OUTROS' END AS tipo,
         l_quantity AS massa
  FROM lines
)"""

WATER_SQL = """water AS (
  SELECT s_name AS plat, 'W' || (l_partkey % 5) AS poco, p_brand AS campo, l_shipdate AS dt,
         date_trunc('month', l_shipdate) AS mes, l_quantity AS qw,
         l_quantity * (0.5::DOUBLE + l_discount) AS qo, 100 * l_discount AS bsw,
         CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice / 1000 END AS ba,
         CASE WHEN l_linenumber % 3 = 0 THEN p_retailprice / 10 END AS sr,
         CASE WHEN l_linenumber % 2 = 1 THEN l_extendedprice END AS sal,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate
  FROM lines
)"""

SCORES_SQL = """scores AS (
  SELECT doc_id, quality AS y, round(1 / (1 + exp(-(n_chars - 2000) / 1500.0::DOUBLE)), 3) AS p
  FROM labels JOIN documents USING (doc_id)
)"""

WELLS_SQL = """wells AS (
  SELECT plat, mes, poco,
         first(campo ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate)
           FILTER (campo IS NOT NULL) AS campo,
         median(qw) AS qw, median(qo) AS qo, median(bsw) AS bsw,
         median(ba) AS ba, median(sr) AS sr, median(sal) AS sal
  FROM water GROUP BY plat, mes, poco
)"""


def _weighted(c: str) -> str:
    ok = f"({c} > 0 AND qw > 0)"
    return f"sum({c} * qw) FILTER {ok} / sum(qw) FILTER {ok}".replace("FILTER (", "FILTER (WHERE ")


WELLS_SQL = WELLS_SQL.replace("FILTER (campo", "FILTER (WHERE campo")

SPARSE_SQL = f"""sparse AS (
  SELECT plat, mes, arg_min(campo, poco) AS campo, sum(qw) AS qw, sum(qo) AS qo,
         median(bsw) AS bsw, count(DISTINCT poco) AS n_pocos,
         {_weighted('ba')} AS ba, {_weighted('sr')} AS sr, {_weighted('sal')} AS sal
  FROM wells GROUP BY plat, mes
)"""

DENSE_SQL = """calendar AS (
  SELECT plat, mes
  FROM (SELECT DISTINCT plat FROM sparse),
       (SELECT unnest(generate_series(min(mes), max(mes), INTERVAL 1 MONTH)) AS mes FROM sparse)
), dense AS (
  SELECT c.plat, c.mes, campo, qw, qo, bsw, n_pocos, ba, sr, sal,
         day(last_day(c.mes)) AS dias, qw * day(last_day(c.mes)) AS qw_mes,
         qo * day(last_day(c.mes)) AS qo_mes
  FROM calendar c LEFT JOIN sparse s ON c.plat = s.plat AND c.mes = s.mes
)"""

MONTHS_SQL = """months AS (
  SELECT plat, mes, campo, qw, qo, bsw, n_pocos, dias, qw_mes, qo_mes,
         last_value(ba IGNORE NULLS) OVER back AS ba,
         last_value(sr IGNORE NULLS) OVER back AS sr,
         last_value(sal IGNORE NULLS) OVER back AS sal
  FROM dense
  WINDOW back AS (PARTITION BY plat ORDER BY mes ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
)"""

FLAGS_SQL = """tagged AS (
  SELECT *, contains(upper(tipo), 'BORRA OLEOSA COM NORM') AS norm,
         contains(upper(tipo), 'BORRA OLEOSA') AND NOT contains(upper(tipo), 'NORM') AS oily
  FROM waste
), flags AS (
  SELECT plat, max(norm::INT) AS tem_norm,
         CASE WHEN max(norm::INT) = 1 THEN 0 ELSE max(oily::INT) END AS tem_oleosa,
         sum(massa) AS massa_total,
         coalesce(sum(massa) FILTER (WHERE norm), 0) AS massa_norm,
         coalesce(sum(massa) FILTER (WHERE oily), 0) AS massa_oleosa,
         CASE WHEN max(norm::INT) = 1 THEN coalesce(sum(massa) FILTER (WHERE norm), 0)
              ELSE coalesce(sum(massa) FILTER (WHERE oily), 0) END AS massa_class,
         CASE WHEN max(norm::INT) = 1 THEN 'Borra oleosa com NORM'
              ELSE 'Borra oleosa sem NORM' END AS tipo_massa
  FROM tagged GROUP BY plat
)"""

PERIODS_SQL = """periods AS (
  SELECT t.plat, min(mes) AS data_min, max(mes) AS data_max
  FROM tagged t JOIN flags f ON t.plat = f.plat
  WHERE (tem_norm = 1 AND norm) OR (tem_oleosa = 1 AND oily)
  GROUP BY t.plat
)"""

WINDOW_SQL = """cut AS (
  SELECT m.*, p.data_min, p.data_max FROM months m JOIN periods p ON m.plat = p.plat
  WHERE m.mes >= p.data_min AND m.mes <= p.data_max
)"""

NEAREST_SQL = """candidates AS (
  SELECT m.*, p.data_min, p.data_max,
         (year(mes) - year(data_min)) * 12 + month(mes) - month(data_min) AS gap
  FROM months m JOIN periods p ON m.plat = p.plat
), chosen AS (
  SELECT plat, mes AS sel FROM (
    SELECT plat, mes, row_number() OVER (PARTITION BY plat ORDER BY abs(gap), gap, mes) AS rn
    FROM candidates) WHERE rn = 1
), cut AS (
  SELECT c.* FROM candidates c JOIN chosen s ON c.plat = s.plat AND c.mes = s.sel
)"""

MONTHLY_SQL = """monthly AS (
  SELECT plat, mes, agua, oleo, ba, sr, sal,
         CASE WHEN agua + oleo > 0 THEN agua / (agua + oleo) * 100 END AS bsw
  FROM (SELECT plat, mes, coalesce(sum(qw_mes), 0) AS agua, coalesce(sum(qo_mes), 0) AS oleo,
               any_value(ba) AS ba, any_value(sr) AS sr, any_value(sal) AS sal
        FROM cut GROUP BY plat, mes)
)"""

STATS_SQL = """stats AS (
  SELECT plat, median(agua) AS mediana_agua, avg(agua) AS media_agua, sum(agua) AS soma_agua,
         avg(bsw) AS media_bsw, median(bsw) AS mediana_bsw, quantile_cont(bsw, 0.25) AS p25_bsw,
         quantile_cont(bsw, 0.75) AS p75_bsw, stddev_samp(bsw) AS std_bsw,
         median(ba) AS mediana_bario, avg(ba) AS media_bario, stddev_samp(ba) AS std_bario,
         median(sr) AS mediana_estroncio, avg(sr) AS media_estroncio,
         stddev_samp(sr) AS std_estroncio,
         median(sal) AS mediana_salinidade, avg(sal) AS media_salinidade,
         stddev_samp(sal) AS std_salinidade
  FROM monthly GROUP BY plat
)"""

ANALYSIS_SQL = """analysis AS (
  SELECT f.*, s.* EXCLUDE (plat),
         CASE WHEN mediana_estroncio > 0 THEN mediana_bario / mediana_estroncio END AS ba_sr
  FROM flags f JOIN stats s ON f.plat = s.plat WHERE media_bsw IS NOT NULL
)"""

MODEL_SQL = """model AS (
  SELECT plat, tem_norm, mediana_salinidade AS sal, mediana_bario AS ba, mediana_estroncio AS sr,
         ba_sr AS ratio
  FROM analysis
  WHERE mediana_salinidade > 0 AND mediana_bario > 0 AND mediana_estroncio > 0 AND ba_sr > 0
)"""

_WASTE = [LINES_SQL, WASTE_SQL, FLAGS_SQL, PERIODS_SQL]
_WATER = [LINES_SQL, WATER_SQL, WELLS_SQL, SPARSE_SQL, DENSE_SQL, MONTHS_SQL]
_TAIL = [MONTHLY_SQL, STATS_SQL, ANALYSIS_SQL, MODEL_SQL]


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(dict.fromkeys(parts)) + "\n"


WITH_LINES = _with(LINES_SQL)
WITH_WASTE = _with(*_WASTE)
WITH_WATER = _with(*_WATER)
WITH_BOTH = _with(*_WATER, *_WASTE)
WITH_WINDOW = _with(*_WATER, *_WASTE, WINDOW_SQL, *_TAIL)
WITH_NEAREST = _with(*_WATER, *_WASTE, NEAREST_SQL, *_TAIL)
WITH_SCORES = _with(SCORES_SQL)
