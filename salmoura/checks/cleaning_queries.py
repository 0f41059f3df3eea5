"""Sources, cleaning steps and column functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from salmoura import names as N
from salmoura.checks import proxies as P
from salmoura.checks.registry import D, R, day, number, query, r, shown
from salmoura.functions import columns as K, platform_names as PN
from salmoura.operators import cleaning as C
from salmoura.plans import jobs
from salmoura.session import shared_folder
from salmoura.sources import files, water_files

# ---- sources and sinks ----

ORDERS = "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp_ntz"
ORDER_SQL = f"""SELECT o_orderkey AS pedido, o_custkey AS cliente, {R('o_totalprice')} AS valor,
  {D('o_orderdate')} AS data FROM orders"""


def _orders(df: DataFrame) -> DataFrame:
    return shown(df, pedido="o_orderkey", cliente="o_custkey", valor=r("o_totalprice"),
                 data=day("o_orderdate"))


def _order_columns(spark: SparkSession, d: str) -> DataFrame:
    return P.table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"
    )


@query("s1_read_table_csv", ORDER_SQL)
def _(spark, d):
    path = f"{shared_folder(spark)}/orders.csv"
    files.write_csv(_order_columns(spark, d), path)
    return _orders(files.read_table(spark, path, ORDERS))


@query("s1_read_table_parquet", ORDER_SQL)
def _(spark, d):
    return _orders(files.read_table(spark, f"{d}/orders.parquet"))


@query("s2_latin1_fallback", r"""
SELECT doc_id, regexp_replace(text, '[^\x{00}-\x{FF}]', '?', 'g') AS texto FROM documents""")
def _(spark, d):
    path = f"{shared_folder(spark)}/documents.csv"
    text = F.regexp_replace("text", r"[^\x{00}-\x{FF}]", "?")
    P.table(spark, d, "documents").select("doc_id", text.alias("texto")).write.option(
        "header", True
    ).option("encoding", "ISO-8859-1").option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.read_table(spark, path, "doc_id long, texto string", multi_line=True)


@query("s1_csv_line_breaks", "SELECT doc_id, text AS texto FROM documents")
def _(spark, d):
    path = f"{shared_folder(spark)}/documents.csv"
    files.write_csv(P.table(spark, d, "documents").select("doc_id", F.col("text").alias("texto")), path)
    return files.read_table(spark, path, "doc_id long, texto string", multi_line=True)


@query("s1_parquet_markers", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'NA' WHEN 1 THEN 'None'
  ELSE text END AS texto FROM documents""")
def _(spark, d):
    path = f"{shared_folder(spark)}/documents.parquet"
    text = F.expr("CASE doc_id % 3 WHEN 0 THEN 'NA' WHEN 1 THEN 'None' ELSE text END")
    P.table(spark, d, "documents").select("doc_id", text.alias("texto")).write.parquet(path)
    return files.read_table(spark, path)


@query("s2_utf8_with_replacement_character", "SELECT doc_id, chr(65533) || ' Água ' || text AS texto FROM documents")
def _(spark, d):
    path = f"{shared_folder(spark)}/documents.csv"
    text = F.concat(F.lit("\ufffd Água "), "text")
    files.write_csv(P.table(spark, d, "documents").select("doc_id", text.alias("texto")), path)
    return files.read_table(spark, path, "doc_id long, texto string", multi_line=True)


WATER_HEADERS = {
    N.FIELD: "Nome do Campo", N.WELL: "Nome do Poço", N.CODE: "Sigla da Plataforma",
    N.DATE: "Data", N.WATER_RATE: "Qw (m³/d)", N.OIL_RATE: " Qo (m³/d) ", N.BSW: "BSW (%)",
    "BÁRIO": "Teor [BÁRIO] mg/L", "ESTRÔNCIO": "[ESTRÔNCIO]",
    "SALINIDADE": "Água [SALINIDADE DA ÁGUA (MG DE NACL/L)]",
}


def _water_files(spark: SparkSession, d: str) -> DataFrame:
    """The water proxy cut into the seventeen files, with the headers such files have."""
    folder = shared_folder(spark)
    lines = P.water(spark, d).withColumn(
        "_file", F.col(f"{N.INGEST_ORDER}.l_orderkey") % len(water_files.WATER_FILES)
    ).drop(N.MONTH, N.INGEST_ORDER)
    headed = lines.withColumnsRenamed(WATER_HEADERS).withColumn("Código do Ensaio", F.lit("x"))
    headed.write.partitionBy("_file").parquet(f"{folder}/parts")  # the lines are joined once, not once a file
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    schema = headed.drop("_file").schema
    for i, file in enumerate(water_files.WATER_FILES):
        part, to = f"{folder}/parts/_file={i}", f"{folder}/{file}.parquet"
        if file == "SPH" or not store.exists(path(part)):
            rows = spark.read.schema(schema).parquet(part) if store.exists(path(part)) else spark.createDataFrame([], schema)
            (rows.drop("[ESTRÔNCIO]") if file == "SPH" else rows).write.parquet(to)
        else:
            store.rename(path(part), path(to))
    return water_files.read_water_tests(spark, folder, suffix=".parquet")


@query("s3_water_files", P.WITH_LINES[:-1] + f""", {P.WATER_SQL}
SELECT l_orderkey % 17 AS arquivo, plat, poco, campo, {D('dt')} AS data, {R('qw')} AS qw,
  {R('qo')} AS qo, {R('bsw')} AS bsw, {R('ba')} AS ba,
  CASE WHEN l_orderkey % 17 <> 13 THEN {R('sr')} END AS sr, {R('sal')} AS sal FROM water""")
def _(spark, d):
    tests = _water_files(spark, d)
    position = F.array_position(
        F.array(*[F.lit(f + ".parquet") for f in water_files.WATER_FILES]), F.col(N.SOURCE_FILE)
    ) - 1
    return shown(
        tests, arquivo=position, plat=N.CODE, poco=N.WELL, campo=N.FIELD, data=day(N.DATE),
        qw=r(N.WATER_RATE), qo=r(N.OIL_RATE), bsw=r(N.BSW), ba=r("BÁRIO"), sr=r("ESTRÔNCIO"),
        sal=r("SALINIDADE"),
    )


HEADED_SQL = " UNION ALL ".join(
    f"SELECT {i} AS posicao, '{h}' AS cabecalho, '{c}' AS coluna, count({s}) AS preenchidos FROM water"
    for s, c, h, i in (
        ("campo", N.FIELD, "Nome do Campo", 2), ("poco", N.WELL, "Nome do Poço", 1),
        ("plat", N.CODE, "Sigla da Plataforma", 0), ("dt", N.DATE, "Data", 3),
        ("qw", N.WATER_RATE, "Qw (m³/d)", 4), ("qo", N.OIL_RATE, " Qo (m³/d) ", 5),
        ("bsw", N.BSW, "BSW (%)", 6), ("ba", "BÁRIO", "Teor [BÁRIO] mg/L", 7),
        ("sr", "ESTRÔNCIO", "[ESTRÔNCIO]", 8),
        ("sal", "SALINIDADE", "Água [SALINIDADE DA ÁGUA (MG DE NACL/L)]", 9),
    )
)


@query("s5_header_names", P.WITH_LINES[:-1] + f", {P.WATER_SQL} {HEADED_SQL}")
def _(spark, d):
    tests = P.water(spark, d).drop(N.MONTH, N.INGEST_ORDER).withColumn("Ensaio [BÁRIO]", F.lit(1))
    headed = tests.withColumnsRenamed(WATER_HEADERS)
    found = water_files.used_columns(headed.columns)
    return headed.agg(F.array(*[
        F.struct(F.lit(i).alias("posicao"), F.lit(headed.columns[i]).alias("cabecalho"), F.lit(c).alias("coluna"),
                 F.count(N.col(headed.columns[i])).alias("preenchidos"))
        for c, i in found.items()
    ]).alias("usadas")).select(F.inline("usadas"))


@query("s6_byte_order_mark", """SELECT p_partkey AS chave, p_name || ' é' AS nome, 'EFBBBF' AS marca FROM part""")
def _(spark, d):
    """The rows read back, next to the first bytes that all files have (more than one value is an error)."""
    path = f"{shared_folder(spark)}/part.csv"
    parts = P.table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" é")).alias("p_name"))
    files.write_csv(parts.repartition(3), path)
    marks = spark.read.format("binaryFile").load(f"{path}/*.csv").select(F.hex(F.substring("content", 1, 3)).alias("marca")).distinct()
    back = files.read_table(spark, path, "p_partkey long, p_name string")
    return back.select(F.col("p_partkey").alias("chave"), F.col("p_name").alias("nome"), marks.scalar().alias("marca"))


@query("s6_write_csv", """SELECT p_partkey AS chave, p_name AS nome, p_retailprice AS preco
FROM part""")
def _(spark, d):
    path = f"{shared_folder(spark)}/part.csv"
    files.write_csv(P.table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    back = C.numeric_columns(files.read_table(spark, path), ["p_retailprice"])
    return shown(back, chave=F.col("p_partkey").cast("long"), nome="p_name", preco="p_retailprice")


# ---- cleaning ----

@query("c1_parse_dates", f"""
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS dt FROM orders)
SELECT o_orderkey AS pedido, day(last_day(dt))::DOUBLE AS dias, year(dt)::DOUBLE AS ano,
  {D("date_trunc('month', dt)")} AS mes FROM t""")
def _(spark, d):
    month = F.date_format("o_orderdate", "yyyy/M")
    text = F.when(F.col("o_orderkey") % 7 == 0, F.concat(month, F.lit("/01"))).otherwise(month)
    df = P.table(spark, d, "orders").select("o_orderkey", text.alias(N.PERIOD))
    parsed = C.parse_dates(df)
    return shown(parsed, pedido="o_orderkey", dias=number(N.DAYS), ano=number("Ano"),
                 mes=day(N.MONTH))


@query("c1_parse_dates_inferred", f"""
SELECT o_orderkey AS pedido, {D("date_trunc('month', o_orderdate)")} AS mes FROM orders""")
def _(spark, d):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    df = P.table(spark, d, "orders").select("o_orderkey", text.alias(N.PERIOD))
    return shown(C.parse_dates(df, pattern=None), pedido="o_orderkey", mes=day(N.MONTH))


@query("c1_parse_dates_short", f"""
SELECT o_orderkey AS pedido, {D("date_trunc('month', o_orderdate)")} AS mes, day(o_orderdate)::INT AS dia FROM orders""")
def _(spark, d):
    text = F.date_format("o_orderdate", "M/d/yyyy H:mm")
    df = P.table(spark, d, "orders").select("o_orderkey", text.alias(N.PERIOD))
    # the first value must tell month from day
    first = df.orderBy((F.split(N.PERIOD, "/")[1].cast("int") > 12).desc(), "o_orderkey")
    return shown(C.parse_dates(first, pattern=None), pedido="o_orderkey", mes=day(N.MONTH), dia=F.dayofmonth(N.PERIOD))


@query("c2_drop_empty_columns", """SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_linenumber = 1 THEN l_quantity END AS algum FROM lineitem""")
def _(spark, d):
    lines = P.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.lit(None).cast("double").alias("vazio"),
        F.when(F.col("l_linenumber") == 1, F.col("l_quantity")).alias("algum"),
        F.when(F.col("l_quantity") < 0, F.lit("x")).alias("vazio_tambem"),
    )
    return C.drop_empty_columns(lines)


@query("c3_drop_missing", P.WITH_LINES[:-1] + f""", {P.WATER_SQL}
SELECT l_orderkey, l_linenumber, plat, {R('ba')} AS ba, {R('sr')} AS sr FROM water
WHERE ba IS NOT NULL AND sr IS NOT NULL""")
def _(spark, d):
    rows = C.drop_missing(P.water(spark, d), ["BÁRIO", "ESTRÔNCIO"])
    return shown(
        rows, l_orderkey=F.col(f"{N.INGEST_ORDER}.l_orderkey"),
        l_linenumber=F.col(f"{N.INGEST_ORDER}.l_linenumber"),
        plat=N.CODE, ba=r("BÁRIO"), sr=r("ESTRÔNCIO"),
    )


@query("c4_keep_first", """
SELECT o_orderkey, chave, o_totalprice AS valor FROM (
  SELECT *, row_number() OVER (PARTITION BY chave ORDER BY o_orderkey) AS rn
  FROM (SELECT *, CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS chave FROM orders)
) WHERE rn = 1""")
def _(spark, d):
    orders = P.table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("chave"),
        F.col("o_totalprice").alias("valor"),
    )
    return C.keep_first(orders, ["chave"], [F.col("o_orderkey")])


@query("c4_keep_first_many_files", """
SELECT o_orderkey, chave FROM (
  SELECT o_orderkey, o_custkey % 100 AS chave, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS rn
  FROM orders) WHERE rn = 1""")
def _(spark, d):
    path = f"{shared_folder(spark)}/orders.parquet"
    orders = P.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("chave"))
    # the first file is small, and Spark reads the largest first; the others hold ranges of the keys, named in their order
    few = orders.orderBy("o_orderkey").limit(20)
    few.coalesce(1).write.parquet(f"{path}/a.parquet")
    rest = orders.join(F.broadcast(few.select("o_orderkey")), "o_orderkey", "left_anti")
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rest.repartitionByRange(ranges, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(f"{path}/b.parquet")
    both = spark.read.parquet(f"{path}/a.parquet", f"{path}/b.parquet").withColumn(N.INGEST_ORDER, files.ingest_order())
    return C.keep_first(both, ["chave"], [F.col(N.INGEST_ORDER)]).drop(N.INGEST_ORDER)


@query("c5_rename_columns", 'SELECT s_suppkey AS chave, s_name AS "LOCAL DA GERAÇÃO" FROM supplier')
def _(spark, d):
    suppliers = P.table(spark, d, "supplier").select("s_suppkey", "s_name")
    return C.rename_columns(suppliers, {"s_name": N.PLATFORM, "s_suppkey": "chave", "x": "y"})


@query("c6_numeric_columns", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 5 IN (0, 1, 2, 3) THEN NULL
  ELSE l_quantity END AS valor FROM lineitem""")
def _(spark, d):
    kind = F.col("l_partkey") % 5
    text = (
        F.when(kind == 0, "n/d").when(kind == 1, "NaN").when(kind == 2, "Infinity")
        .when(kind == 3, F.concat(F.col("l_quantity").cast("string"), F.lit("d")))
        .otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("string")))
    )
    lines = P.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", text.alias("valor")
    )
    return C.numeric_columns(lines, ["valor", "ausente"])


@query("c7_drop_invalid_dates", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {D('l_shipdate')} AS data FROM lineitem
WHERE l_linenumber <> 3 AND l_shipdate >= DATE '2000-01-01'""")
def _(spark, d):
    lines = P.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_linenumber") != 3, F.col("l_shipdate")).alias(N.DATE),
    )
    rows = C.drop_invalid_dates(lines)
    return shown(rows, l_orderkey="l_orderkey", l_linenumber="l_linenumber",
                 l_partkey="l_partkey", data=day(N.DATE))


@query("c8_project", "SELECT o_custkey, o_orderstatus FROM orders")
def _(spark, d):
    return C.project(P.table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


@query("c9_exact_platform_code", """
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'FPCST' WHEN 1 THEN 'FPSO-BR' WHEN 2 THEN 'CAPX'
  WHEN 3 THEN 'FPSO-ESP' ELSE s_name END AS codigo FROM supplier""")
def _(spark, d):
    name = F.expr("""CASE s_suppkey % 5 WHEN 0 THEN 'FPSO CIDADE DE SANTOS'
      WHEN 1 THEN 'FPSO-BRASIL' WHEN 2 THEN 'FPSO CAPIXABA' WHEN 3 THEN 'ESPADARTE FPSO'
      ELSE s_name END""")
    return shown(P.table(spark, d, "supplier"), s_suppkey="s_suppkey", codigo=PN.exact_code(name))


@query("c10_numbered_platform", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'P-' || p_size WHEN 1 THEN 'P-' || p_size
  WHEN 2 THEN p_name || ' P-' || p_size ELSE p_name END AS codigo FROM part""")
def _(spark, d):
    name = F.expr("""CASE p_partkey % 4
      WHEN 0 THEN 'PETROBRAS ' || (p_size + 1) || ' (P-' || p_size || ')'
      WHEN 1 THEN 'Petrobras  ' || p_size || ' ()'
      WHEN 2 THEN p_name || ' petrobras ' || p_size ELSE p_name END""")
    return shown(P.table(spark, d, "part"), p_partkey="p_partkey",
                 codigo=PN.numbered_platform(name))


@query("c11_fold_accents", """
SELECT doc_id, upper(strip_accents(replace(text, 'ß', 'ss'))) AS texto FROM documents""")
def _(spark, d):
    text = F.upper(PN.fold_accents(F.col("text")))
    return shown(P.table(spark, d, "documents"), doc_id="doc_id", texto=text)


@query("c12_monthly_production", f"""
SELECT o_orderkey, {R('o_totalprice * dias', 4)} AS oleo, {R('o_totalprice / 10 * dias', 4)} AS cond,
  {R('o_custkey::DOUBLE * dias', 4)} AS agua
FROM (SELECT *, day(last_day(o_orderdate)) AS dias FROM orders)""")
def _(spark, d):
    orders = P.table(spark, d, "orders").select(
        "o_orderkey",
        F.dayofmonth(F.last_day("o_orderdate")).alias(N.DAYS),
        F.col("o_totalprice").alias("Óleo (bbl/dia)"),
        (F.col("o_totalprice") / 10).alias("Condensado (bbl/dia)"),
        F.col("o_custkey").cast("double").alias("Água (bbl/dia)"),
    )
    made = jobs.monthly_production(orders)
    return shown(made, o_orderkey="o_orderkey", oleo=r("Óleo (bbl/mes)", 4),
                 cond=r("Condensado (bbl/mes)", 4), agua=r("Água (bbl/mes)", 4))


PATHS = """CASE p_partkey % 12
  WHEN 0 THEN 'UO/BS/FPSO CIDADE DE SANTOS' WHEN 1 THEN 'X/P' || p_size
  WHEN 2 THEN 'X/P-' || p_size WHEN 3 THEN 'X/FPSOBRASIL'
  WHEN 4 THEN 'X/FPSO ' || p_name || ' (MV' || p_size || ')' WHEN 5 THEN 'X/SS-' || p_size
  WHEN 6 THEN 'X/' || p_name WHEN 7 THEN 'FPSO ANTES/CAPX' WHEN 8 THEN 'X/FPCIDADE DE PARATY'
  WHEN 9 THEN 'X/FPSO  CIDADE  DE MARICA' WHEN 10 THEN 'X/FPSO ' || p_name || '   norte ' END"""
PATHS_SQL = f"paths AS (SELECT p_partkey, {PATHS} AS caminho FROM part)"
TAIL_SQL = r"""tails AS (SELECT p_partkey, trim(upper(coalesce(nullif(regexp_extract(
  list_last(string_split(caminho, '/')), 'FPSO[^/]+|P-\d+|P\d+|SS-\d+|CDAN|CAPX|FP\w+'), ''),
  'OUTROS'))) AS nome FROM paths)"""
TIDY_SQL = r"""tidy AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(nome,
  '\(.*?\)', '', 'g'), '^FPSO([A-Z])', 'FPSO \1'), '\s+', ' ', 'g') AS nome FROM tails)"""


@query("c13_platform_from_path", f"WITH {PATHS_SQL}, {TAIL_SQL} SELECT p_partkey, nome FROM tails")
def _(spark, d):
    return shown(P.table(spark, d, "part"), p_partkey="p_partkey",
                 nome=PN.platform_from_path(F.expr(PATHS)))


@query("c14_tidy_platform",
       f"WITH {PATHS_SQL}, {TAIL_SQL}, {TIDY_SQL} SELECT p_partkey, nome FROM tidy")
def _(spark, d):
    return shown(P.table(spark, d, "part"), p_partkey="p_partkey",
                 nome=PN.tidy_platform(PN.platform_from_path(F.expr(PATHS))))


@query("c15_waste_platform_code", f"""WITH {PATHS_SQL}, {TAIL_SQL}, {TIDY_SQL}
SELECT p_partkey, CASE WHEN nome LIKE '%BRASIL%' THEN 'FPBR' WHEN nome LIKE '%MARICA%' THEN 'FPMQT'
  WHEN nome LIKE '%SANTOS%' THEN 'FPCST' WHEN nome LIKE '%PARATY%' THEN 'FPCPY'
  """ + r"""ELSE regexp_replace(nome, '^P(\d+)$', 'P-\1') END AS nome FROM tidy""")
def _(spark, d):
    return shown(P.table(spark, d, "part"), p_partkey="p_partkey",
                 nome=PN.waste_platform(F.expr(PATHS)))


KINDS = """CASE p_partkey % 7
  WHEN 0 THEN 'BORRA OLEOSA COM NORM (CATEGORIA I - ETIQUETA BRANCA)'
  WHEN 1 THEN 'BORRA OLEOSA COM NORM (CATEGORIA II - ETIQUETA AMARELA)'
  WHEN 2 THEN ' borra oleosa ' WHEN 3 THEN 'Borra Oleosa normal' WHEN 4 THEN p_type
  WHEN 5 THEN 'borra oleosa com norm ' || p_name END"""


@query("c16_waste_type", f"""
SELECT p_partkey, CASE WHEN tipo LIKE '%CATEGORIA I%' THEN 'BORRA OLEOSA COM NORM' ELSE tipo END
  AS tipo FROM (SELECT p_partkey, {KINDS} AS tipo FROM part)""")
def _(spark, d):
    return shown(P.table(spark, d, "part"), p_partkey="p_partkey", tipo=PN.waste_type(F.expr(KINDS)))


@query("c17_waste_predicates", f"""
SELECT p_partkey, coalesce(tipo ILIKE '%BORRA OLEOSA COM NORM%', false) AS norm,
  coalesce(tipo ILIKE '%BORRA OLEOSA%' AND tipo NOT ILIKE '%NORM%', false) AS oleosa
FROM (SELECT p_partkey, {KINDS} AS tipo FROM part)""")
def _(spark, d):
    kind = F.expr(KINDS)
    return shown(P.table(spark, d, "part"), p_partkey="p_partkey", norm=K.is_contaminated(kind),
                 oleosa=K.is_oily(kind))


@query("c18_conditional_values", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS massa,
  CASE WHEN l_discount > 0 THEN {R('l_tax / l_discount')} END AS razao FROM lineitem""")
def _(spark, d):
    return shown(
        P.table(spark, d, "lineitem"), l_orderkey="l_orderkey", l_linenumber="l_linenumber",
        l_partkey="l_partkey",
        massa=K.value_where(F.col("l_returnflag") == "R", F.col("l_quantity")),
        razao=r(K.ratio(F.col("l_tax"), F.col("l_discount"))),
    )


@query("c19_complete_cases", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS a, l_tax AS b FROM lineitem
WHERE l_partkey % 9 NOT IN (0, 1, 2, 3)""")
def _(spark, d):
    kind = F.col("l_partkey") % 9
    infinity = F.lit(float("inf"))
    a = F.when(kind == 0, infinity).when(kind == 1, -infinity).when(
        kind == 2, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    lines = P.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", a.alias("a"),
        F.when(kind != 3, F.col("l_tax")).alias("b"),
    )
    return C.complete_cases(lines, ["a", "b"])


@query("c20_all_positive", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount > 0 AND l_tax > 0""")
def _(spark, d):
    lines = P.table(spark, d, "lineitem").filter(K.all_positive(["l_discount", "l_tax"]))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey")


@query("c21_log10", f"SELECT l_orderkey, l_linenumber, l_partkey, {R('log10(l_quantity)')} AS log_a,"
       f" {R('log10(l_extendedprice)')} AS log_b FROM lineitem")
def _(spark, d):
    return shown(P.table(spark, d, "lineitem"), l_orderkey="l_orderkey",
                 l_linenumber="l_linenumber", l_partkey="l_partkey",
                 log_a=r(F.log10("l_quantity")), log_b=r(F.log10("l_extendedprice")))


@query("c22_class_label", """
SELECT doc_id, CASE quality WHEN 1 THEN 'Com NORM' WHEN 0 THEN 'Sem NORM' END AS classe
FROM labels""")
def _(spark, d):
    return shown(P.table(spark, d, "labels"), doc_id="doc_id",
                 classe=K.class_label(F.col("quality")))


@query("c23_outcome_label", """
SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'Verdadeiro positivo'
  WHEN quality = 0 AND toxic = 0 THEN 'Verdadeiro negativo'
  WHEN quality = 0 AND toxic = 1 THEN 'Falso positivo'
  WHEN quality = 1 AND toxic = 0 THEN 'Falso negativo' ELSE 'Não classificado' END AS resultado
FROM (SELECT doc_id, quality, CASE WHEN doc_id % 11 <> 0 THEN toxic END AS toxic FROM labels)""")
def _(spark, d):
    predicted = F.when(F.col("doc_id") % 11 != 0, F.col("toxic"))
    return shown(P.table(spark, d, "labels"), doc_id="doc_id",
                 resultado=K.outcome_label(F.col("quality"), predicted))


@query("c24_marker_size", f"""
WITH t AS (SELECT c_custkey, ln(1 + greatest(c_acctbal - 1000, 0)) AS m FROM customer)
SELECT c_custkey, {R('6 + 22 * m / greatest((SELECT max(m) FROM t), 1)')} AS tamanho FROM t""")
def _(spark, d):
    customers = P.table(spark, d, "customer").withColumn("massa", F.col("c_acctbal") - 1000)
    log = F.log1p(F.greatest(F.col("massa"), F.lit(0.0)))
    largest = customers.agg(F.max(log).alias("m")).scalar()
    return shown(customers, c_custkey="c_custkey",
                 tamanho=r(K.marker_size(F.col("massa"), largest)))


@query("c25_bubble_size", f"""
SELECT c_custkey, {R('35 + 35 * sqrt(greatest(c_acctbal - 1000, 0))')} AS tamanho FROM customer""")
def _(spark, d):
    return shown(P.table(spark, d, "customer"), c_custkey="c_custkey",
                 tamanho=r(K.bubble_size(F.col("c_acctbal") - 1000)))


@query("c26_month_difference", """
SELECT l_orderkey, l_linenumber, l_partkey, meses::DOUBLE AS meses, abs(meses)::DOUBLE AS distancia
FROM (SELECT *, (year(l_shipdate) - 1998) * 12 + month(l_shipdate) - 6 AS meses FROM lineitem)""")
def _(spark, d):
    gap = K.months_between(F.col("l_shipdate"), F.to_date(F.lit("1998-06-15")))
    return shown(P.table(spark, d, "lineitem"), l_orderkey="l_orderkey",
                 l_linenumber="l_linenumber", l_partkey="l_partkey", meses=number(gap),
                 distancia=number(F.abs(gap)))


CHECKED = """lido AS (SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_linenumber % 4 <> 0 THEN l_quantity - 2 END AS salinidade,
  l_discount AS bario, l_tax AS estroncio FROM lineitem)"""


@query("c29_check_inputs", f"""WITH {CHECKED}
SELECT l_orderkey, l_linenumber, l_partkey, CASE
  WHEN salinidade IS NULL OR salinidade <= 0
    THEN 'salinidade deve ser um valor positivo e maior que zero'
  WHEN bario <= 0 THEN 'bario deve ser um valor positivo e maior que zero'
  WHEN estroncio <= 0 THEN 'estroncio deve ser um valor positivo e maior que zero' END AS motivo
FROM lido""")
def _(spark, d):
    lines = P.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_linenumber") % 4 != 0, F.col("l_quantity") - 2).alias("SALINIDADE"),
        F.col("l_discount").alias("BARIO"), F.col("l_tax").alias("ESTRONCIO"),
    )
    return shown(C.check_inputs(lines), l_orderkey="l_orderkey", l_linenumber="l_linenumber",
                 l_partkey="l_partkey", motivo="MOTIVO_REJEICAO")


@query("c30_rounded_text", """
SELECT l_suppkey, round(avg(l_extendedprice), 3) AS media,
  format('{:.3f} ± {:.3f}', avg(l_discount), stddev_samp(l_discount)) AS texto
FROM lineitem GROUP BY l_suppkey""")
def _(spark, d):
    lines = P.table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.round(F.avg("l_extendedprice"), 3).alias("media"),
        K.mean_sd_text(F.avg("l_discount"), F.stddev_samp("l_discount")).alias("texto"),
    )
    return lines


@query("w2_sort_rows", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def _(spark, d):
    lines = P.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    return C.sort_rows(lines, ["l_suppkey", "l_partkey"])
