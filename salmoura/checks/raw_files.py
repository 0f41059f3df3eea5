"""Raw files in the shape of the sources, written from the test tables, and the jobs that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from salmoura import names as N
from salmoura.checks import fits_sql as FS, proxies as P
from salmoura.checks.cleaning_queries import WATER_HEADERS
from salmoura.checks.model_queries import FINAL
from salmoura.checks.platform_queries import (
    ANALYSIS_OUT, TEMPORAL_OUT, TEMPORAL_SQL, _analysis_columns, _temporal_columns,
)
from salmoura.checks.registry import D, R, day, query, r, shown
from salmoura.operators import modelling as L
from salmoura.operators.analysis import WINDOW
from salmoura.plans import jobs
from salmoura.session import shared_folder
from salmoura.sources import files, water_files

PLATFORM = "'P-' || s_suppkey"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    lines, parts, suppliers = (P.table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    return lines.join(parts, lines.l_partkey == parts.p_partkey).join(
        suppliers, lines.l_suppkey == suppliers.s_suppkey
    )


def _write_waste(spark: SparkSession, d: str, folder: str) -> None:
    """Two logs that overlap by three months."""
    kind = F.expr("""CASE WHEN l_suppkey % 3 = 0 AND p_type = 'PROMO' THEN 'BORRA OLEOSA COM NORM'
                          WHEN p_type IN ('LARGE', 'SMALL') THEN 'BORRA OLEOSA' ELSE 'OUTROS' END""")
    month, lines = F.date_format("l_shipdate", "yyyy/M"), _lines(spark, d)
    files.write_csv(lines.filter("l_shipdate < DATE '2000-01-01'").select(
        F.concat(F.lit("F"), "l_orderkey").alias(N.MANIFEST), month.alias("Dt. Geração"),
        F.expr(f"'UO/BS/' || {PLATFORM}").alias("L. de Atuação da Geradora"), kind.alias("Resíduo"),
        F.col("l_quantity").alias("Qtd. Recebida (kg)"), F.lit("linha\num").alias("Observação"),
    ), f"{folder}/sigre.csv")
    files.write_csv(lines.filter("l_shipdate >= DATE '1999-10-01'").select(
        month.alias("Data - Geração"), kind.alias("Resíduo"), F.expr(PLATFORM).alias("Unidade Operacional"),
        F.col("l_quantity").alias("Geração - Kg"),
    ), f"{folder}/scr.csv")


def _write_production(spark: SparkSession, d: str, folder: str) -> None:
    files.write_csv(P.table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy/MM").alias(N.PERIOD),
        F.expr("'petrobras ' || (o_custkey % 70)").alias("Instalação Destino"),
        F.col("o_totalprice").alias("Óleo (bbl/dia)"), F.lit(1.0).alias("Condensado (bbl/dia)"),
        F.lit(2.5).alias("Água (bbl/dia)"),
    ), f"{folder}/sigep.csv")


def _write_water(spark: SparkSession, d: str, folder: str, odd: bool = False) -> None:
    """One CSV file for each name, with three lines before its header; rows in the order of their keys. ``odd`` files
    are Latin-1, with line breaks and quotes in the names of the fields."""
    tests = P.water(spark, d)
    keys = [f"{N.INGEST_ORDER}.{k}" for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")]
    cells = {
        N.FIELD: N.col(N.FIELD), N.WELL: N.col(N.WELL),
        N.CODE: F.concat(F.lit("P-"), F.col(f"{N.INGEST_ORDER}.l_suppkey")),
        N.DATE: F.date_format(N.DATE, "yyyy-MM-dd HH:mm:ss"),
        **{c: N.col(c).cast("string") for c in (N.WATER_RATE, N.OIL_RATE, N.BSW, *N.CHEMISTRY)},
    }
    if odd:
        cells[N.FIELD] = F.concat(F.lit('"'), N.col(N.FIELD), F.lit('\nção ""x"""'))
    header = ",".join(f'"{WATER_HEADERS[c]}"' for c in cells)
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cells.values()])
    count = len(water_files.WATER_FILES)
    body = tests.select(
        (F.col(keys[0]) % count).cast("int").alias("file"), F.lit(4).alias("at"), *[F.col(k) for k in keys], line.alias("value")
    )
    top = spark.range(count).select(
        F.col("id").cast("int").alias("file"),
        F.posexplode(F.array(*map(F.lit, ["Relatório", "", "Filtro,,", header]))).alias("at", "value"),
    )
    both = body.unionByName(top, allowMissingColumns=True).repartitionById(count, F.col("file"))  # one file a task, where hashes put several into one
    names = [k.split(".")[1] for k in keys]
    text = F.encode("value", "ISO-8859-1").cast("string") if odd else F.col("value")
    both.sortWithinPartitions("file", "at", *names).select("file", text.alias("value")).write.partitionBy("file").text(f"{folder}/parts")
    system = spark._jvm.org.apache.hadoop.fs
    at = system.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for i, name in enumerate(water_files.WATER_FILES):
        part = store.globStatus(system.Path(f"{folder}/parts/file={i}/part-*"))[0].getPath()
        store.rename(part, system.Path(f"{folder}/{name}.csv"))


def raw_files(spark: SparkSession, d: str) -> str:
    folder = shared_folder(spark)
    _write_production(spark, d, folder)
    _write_waste(spark, d, folder)
    _write_water(spark, d, folder)
    return folder


def from_files(sql: str) -> str:
    """The SQL of the proxies with what the files change: platform names, dates kept, order of the rows."""
    return (
        sql.replace("s_name AS plat", "'P-' || s_suppkey AS plat")
        .replace("FROM water GROUP", "FROM water WHERE dt >= DATE '2000-01-01' GROUP")
        .replace("first(campo ORDER BY l_orderkey,", "first(campo ORDER BY l_orderkey % 17, l_orderkey,")
    )


@query("s4_below_preamble", from_files(P.WITH_LINES[:-1]) + f""", {from_files(P.WATER_SQL)}
SELECT l_orderkey % 17 AS arquivo, plat, poco, campo, {D('dt')} AS data, {R('qw')} AS qw,
  {R('qo')} AS qo, {R('bsw')} AS bsw, {R('ba')} AS ba, {R('sr')} AS sr, {R('sal')} AS sal FROM water""")
def _(spark, d):
    return _water_read(spark, d, odd=False)


@query("s2_s3_latin1_line_breaks", from_files(P.WITH_LINES[:-1]) + f""", {from_files(P.WATER_SQL)}
SELECT l_orderkey % 17 AS arquivo, plat, poco, campo || chr(10) || 'ção "x"' AS campo, {D('dt')} AS data, {R('qw')} AS qw,
  {R('qo')} AS qo, {R('bsw')} AS bsw, {R('ba')} AS ba, {R('sr')} AS sr, {R('sal')} AS sal FROM water""")
def _(spark, d):
    return _water_read(spark, d, odd=True)


def _water_read(spark: SparkSession, d: str, odd: bool) -> DataFrame:
    folder = shared_folder(spark)
    _write_water(spark, d, folder, odd)
    tests = water_files.read_water_tests(spark, folder, needed=water_files.NEEDED)
    names = F.array(*[F.lit(f + ".csv") for f in water_files.WATER_FILES])
    number = {c: r(N.col(c).cast("double")) for c in (N.WATER_RATE, N.OIL_RATE, N.BSW, *N.CHEMISTRY)}
    return shown(
        tests, arquivo=F.array_position(names, F.col(N.SOURCE_FILE)) - 1, plat=N.CODE, poco=N.WELL,
        campo=N.FIELD, data=day(F.to_date(F.substring(N.col(N.DATE), 1, 10))), qw=number[N.WATER_RATE],
        qo=number[N.OIL_RATE], bsw=number[N.BSW], ba=number["BÁRIO"], sr=number["ESTRÔNCIO"],
        sal=number["SALINIDADE"],
    )


@query("p5_analysis_job", from_files(P.WITH_WINDOW) + f"SELECT {ANALYSIS_OUT} FROM analysis")
def _(spark, d):
    tables = jobs.analysis_job(spark, raw_files(spark, d), shared_folder(spark), WINDOW)
    return _analysis_columns(tables[jobs.ANALYSIS])


@query("p6_training_job", from_files(FS.with_final(FINAL, P.WITH_NEAREST)) + " UNION ALL ".join(
    f"SELECT '{v}' AS variavel, {R(f'b{j}', 4)} AS coeficiente, {R(f'exp(b{j})', 4)} AS odds FROM f_fit"
    for j, v in enumerate(N.FEATURES, 1)))
def _(spark, d):
    model = jobs.training_job(spark, raw_files(spark, d), shared_folder(spark))
    return shown(L.coefficients(spark, model.numbers), variavel="VARIAVEL",
                 coeficiente=r("COEFICIENTE_PADRONIZADO", 4), odds=r("ODDS_RATIO", 4))


@query("p7_temporal_job", from_files(TEMPORAL_SQL) + f"SELECT {TEMPORAL_OUT} FROM temporal")
def _(spark, d):
    out = shared_folder(spark)
    jobs.clean_sources(spark, raw_files(spark, d), out)
    return _temporal_columns(jobs.temporal_job(spark, out, f"{out}/entrada.csv"))


@query("p8_scoring_job", from_files(
    P.WITH_NEAREST[:-1] + TEMPORAL_SQL[len(P.WITH_BOTH) - 1:].rstrip() + f", {FS.final_sql(FINAL)}"
) + f"""
SELECT plat, {D('mes')} AS mes, {R('ratio')} AS ratio, (p > 0.5)::INT AS predicao, {R('p', 4)} AS prob
FROM (SELECT plat, mes, ratio, {FS.probability(FINAL)} AS p FROM temporal, f_fit WHERE elegivel)""")
def _(spark, d):
    raw, out = raw_files(spark, d), shared_folder(spark)
    jobs.training_job(spark, raw, out)
    jobs.temporal_job(spark, out, f"{out}/entrada.csv")
    scored = jobs.scoring_job(spark, f"{out}/modelo_norm", f"{out}/entrada.csv", f"{out}/saida.csv")
    return shown(scored, plat=N.SITE, mes=day(F.to_date(N.MONTH)), ratio=r(N.RATIO),
                 predicao="PREDICAO_NORM", prob=r("PROB_NORM", 4))
