from datetime import date

import pytest
from pyspark.sql import functions as F

from salmoura import names as N
from salmoura.functions import platform_names as PN
from salmoura.operators import cleaning as C
from salmoura.plans import jobs


def texts(spark, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in df.orderBy("i").select(make(F.col("t")).alias("o")).collect()]


def test_production_platform(spark):
    cases = {
        **PN.PRODUCTION_CODES,
        "PETROBRAS 58 (P-58)": "P-58", "petrobras 66": "P-66", "Petrobras 10 (p-11": "P-11",
        "petrobras 7 ()": "P-7", "Estação São João": "ESTACAO SAO JOAO", None: None,
        "fpso brasil": "FPSO BRASIL",
    }
    assert texts(spark, list(cases), PN.production_platform) == list(cases.values())


def test_waste_platform_works_out_the_name_once_a_row(spark):
    rows = spark.createDataFrame([("UO/BS/P58",)], "path string").select(PN.waste_platform(F.col("path")).alias("p"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("regexp_extract(") <= 2  # twelve times when each condition had its own copy
    assert rows.first().p == "P-58"


def test_waste_platform(spark):
    cases = {
        "UO/BS/FPSO CIDADE DE SANTOS": "FPCST", "X/P58": "P-58", "X/P-58": "P-58",
        "X/FPSOBRASIL": "FPBR", "X/FPSO XPTO (MV29)": "FPSO XPTO ", "X/SS-11": "SS-11",
        "X/none": "OUTROS", None: "OUTROS", "X/FPÇA": "FPÇA", "P-10/terra": "OUTROS",
        "X/FPSO  NITEROI": "FPCNI", "X/CAPX": "CAPX",
    }
    assert texts(spark, list(cases), PN.waste_platform) == list(cases.values())


def test_waste_type(spark):
    assert texts(spark, [PN.CONTAMINATED_LABELS[1], "OUTRO", None], PN.waste_type) == [
        "BORRA OLEOSA COM NORM", "OUTRO", None
    ]


def test_month_pattern_nulls_what_does_not_fit(spark):
    values = ["2024/5", "2024/02", "2024/13", "2024-05", "2024/05/01", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, `{N.PERIOD}` string")
    rows = C.parse_dates(df).orderBy("i").collect()
    assert [r[N.MONTH] for r in rows] == [date(2024, 5, 1), date(2024, 2, 1), None, None, None, None]
    assert [r[N.DAYS] for r in rows][:2] == [31, 29]


def test_inferred_pattern_follows_first_value(spark):
    df = spark.createDataFrame([(0, None), (1, "2024-03-09"), (2, "09/03/2024")], "i int, DATA string")
    rows = C.parse_dates(df, "DATA", None).orderBy("i").collect()
    assert [r[N.MONTH] for r in rows] == [None, date(2024, 3, 1), None]


def test_numbers(spark):
    values = ["1.5", " 2 ", "1d", "NaN", "-inf", "abc", None, "1e3"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = C.numeric_columns(df, ["v", "absent"]).orderBy("i").collect()
    assert [r.v for r in rows] == [1.5, 2.0, None, None, None, None, None, 1000.0]


def test_keep_first_treats_missing_keys_as_one(spark):
    df = spark.createDataFrame(
        [(0, None, "a"), (1, 2.0, "b"), (2, None, "c"), (3, 2.0, "d")], "i int, k double, v string"
    )
    rows = C.keep_first(df, ["k"], [F.col("i")]).orderBy("i").collect()
    assert [(r.i, r.v) for r in rows] == [(0, "a"), (1, "b")]


def test_sort_puts_missing_last(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (1, 3)], "a int, b int")
    assert [r.a for r in C.sort_rows(df, ["a"]).collect()] == [1, 2, None]


def test_invalid_dates(spark):
    df = spark.createDataFrame(
        [(date(1999, 12, 31),), (date(2000, 1, 1),), (None,)], "DATA date"
    )
    assert [r.DATA for r in C.drop_invalid_dates(df).collect()] == [date(2000, 1, 1)]


def test_split_inputs(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 3.0), (0.0, 2.0, 3.0), (1.0, None, 3.0), (1.0, 2.0, -1.0)],
        "SALINIDADE double, BARIO double, ESTRONCIO double",
    )
    usable, rejected = C.split_inputs(df)
    assert usable.count() == 1
    reasons = sorted(r.MOTIVO_REJEICAO.split()[0] for r in rejected.collect())
    assert reasons == ["bario", "estroncio", "salinidade"]


def test_production_rows(spark):
    schema = (
        f"{N.INGEST_ORDER} long, `{N.PERIOD}` string, `Instalação Destino` string, "
        "`Óleo (bbl/dia)` string, `Condensado (bbl/dia)` double, `Água (bbl/dia)` double, vazia string"
    )
    raw = spark.createDataFrame([
        (0, "2024/02", "FPSO BRASIL", "10", 1.0, 2.0, None),
        (1, "2024/03", "OUTRA", "10.0", 5.0, 5.0, None),      # same oil rate: dropped
        (2, "2024/13", "petrobras 66", None, 1.0, 1.0, None),  # no oil rate, bad month
        (3, "2024/01", None, None, 1.0, 1.0, None),            # second missing rate: dropped
    ], schema)
    rows = jobs.clean_production(raw).orderBy(N.PLATFORM).collect()
    assert [r[N.PLATFORM] for r in rows] == ["FPSO-BR", "P-66"]
    assert rows[0]["Óleo (bbl/mes)"] == 290.0 and rows[1]["Água (bbl/mes)"] is None
    assert "vazia" not in rows[0].asDict()


def test_drop_unplaced_rows(spark):
    schema = (
        f"{N.INGEST_ORDER} long, `{N.PERIOD}` string, `Instalação Destino` string, "
        "`Óleo (bbl/dia)` double, `Condensado (bbl/dia)` double, `Água (bbl/dia)` double"
    )
    raw = spark.createDataFrame(
        [(0, "2024/02", None, 1.0, 1.0, 1.0), (1, "2024/02", "A", 2.0, 1.0, 1.0)], schema
    )
    assert jobs.clean_production(raw).count() == 2
    assert jobs.clean_production(raw, drop_unplaced=True).count() == 1


@pytest.mark.parametrize("value", [float("inf"), float("nan")])
def test_complete_cases_drop_non_finite(spark, value):
    df = spark.createDataFrame([(1.0,), (value,)], "v double")
    assert C.complete_cases(df, ["v"]).count() == 1


@pytest.mark.parametrize("first, day", [
    ("2020-03-05 10:00:00.500", (2020, 3, 5)), ("2020-03-05 10:00", (2020, 3, 5)), ("5/3/2020", (2020, 5, 3)),
    ("25/3/2020 8:05", (2020, 3, 25)), (" 2020/3/5 ", (2020, 3, 5)), ("2020-03-05T10:00:00", (2020, 3, 5)),
])
def test_dates_are_read_by_the_form_of_the_first(spark, first, day):
    df = spark.createDataFrame([(first,)], "d string")
    got = C.parse_dates(df, "d", None).first().d
    assert (got.year, got.month, got.day) == day


def test_an_unknown_first_date_is_an_error(spark):
    with pytest.raises(ValueError, match="no known date pattern"):
        C.parse_dates(spark.createDataFrame([("soon",)], "d string"), "d", None)
    assert C.parse_dates(spark.createDataFrame([(None,)], "d string"), "d", None).first().d is None


def test_a_column_with_a_value_in_the_first_rows_is_not_counted(spark):
    df = spark.range(0, 20_000, 1, 1).select(
        F.when(F.col("id") == 19_000, F.raise_error(F.lit("counted")).cast("int")).otherwise(1).alias("full"),
        F.when(F.col("id") == 19_999, 1).alias("late"), F.lit(None).cast("int").alias("never"),
    )
    assert C.drop_empty_columns(df).columns == ["full", "late"]
    assert C.drop_empty_columns(df.limit(0)).columns == []
    assert C.drop_empty_columns(df.select("late", "full")).columns == ["late", "full"]


def test_a_text_is_read_as_a_number_once(spark):
    values = ["1.5", "1.", "2F ", "3D", "0x1p3", "Infinity", "1e999", "٣", "7\t", "", " "]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(1)
    rows = C.numeric_columns(df, ["v"])
    assert rows._jdf.queryExecution().executedPlan().toString().count("try_cast(") == 1
    assert [r.v for r in rows.orderBy("i").collect()] == [1.5, 1.0, None, None, 8.0, None, None, None, 7.0, None, None]


def test_waste_platform_in_generated_code(spark):
    paths = ["UO/BS/FPSO CIDADE DE SANTOS", "X/P58", "X/none", "", "X/", None, "X/FPSO XPTO (MV29)", "X/FPSO  NITEROI ", "X/FP", "P-1/P-2"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(paths)], "i int, p string").repartition(1)
    both = PN.with_waste_platform(df, "p", "q").withColumn("r", PN.waste_platform(F.col("p")))
    rows = both.orderBy("i").collect()
    assert [r.q for r in rows] == [r.r for r in rows]
    assert [r.q for r in rows] == ["FPCST", "P-58", "OUTROS", "OUTROS", "OUTROS", "OUTROS", "FPSO XPTO ", "FPCNI", "OUTROS", "P-2"]
    plan = PN.with_waste_platform(df, "p", "q")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("regexp_extract(") == 1
