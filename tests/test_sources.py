import csv
import random

import pytest
from pyspark.errors import AnalysisException

from salmoura import names as N
from salmoura.plans import jobs
from salmoura.sources import files, records, water_files as WF


def test_suffix_and_missing_path(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        files.read_table(spark, str(tmp_path / "a.xlsx"))
    with pytest.raises(AnalysisException):
        files.read_table(spark, str(tmp_path / "a.csv"))
    with pytest.raises(AnalysisException):
        files.read_table(spark, str(tmp_path / "a.parquet"))


def test_latin1_is_found_and_read_again(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("Água;x\n".replace(";", ",").encode("latin1") + "São João,1\n".encode("latin1"))
    row = files.read_table(spark, str(path)).first()
    assert row.asDict() == {"Água": "São João", "x": "1"}


def test_utf8_with_mark_and_missing_values(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("nome,v\n\"a, \"\"b\"\"\",NaN\nNA, 2\n", encoding="utf-8-sig")
    rows = files.read_table(spark, str(path), ordered=True).orderBy(N.INGEST_ORDER).collect()
    assert [(r.nome, r.v) for r in rows] == [('a, "b"', None), (None, " 2")]


def test_csv_round_trip_keeps_blanks_quotes_and_nulls(spark, tmp_path):
    df = spark.createDataFrame([("FPSO XPTO ", 1.5), ('a "q", b', None)], "p string, v double")
    path = files.write_csv(df, str(tmp_path / "o.csv"))
    back = files.read_table(spark, path, "p string, v double")
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)
    files.write_csv(df.limit(1), path)
    assert files.read_table(spark, path).count() == 1


def test_cells_with_line_breaks(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('nome,v\n"x\n""y"", z",1\n"", 5" pipe\n"a"",",2\n', encoding="utf-8")
    rows = [(r.nome, r.v) for r in files.read_table(spark, str(path), multi_line=True).collect()]
    assert rows == [('x\n"y", z', "1"), (None, ' 5" pipe'), ('a",', "2")]
    with pytest.raises(ValueError, match="line breaks"):
        files.read_table(spark, str(path))
    plain = tmp_path / "b.csv"
    plain.write_text('nome,v\n"a, ""b""",1\n"""",2\n5" pipe,3\n', encoding="utf-8")
    assert [r.nome for r in files.read_table(spark, str(plain)).collect()] == ['a, "b"', '"', '5" pipe']


def test_parquet_texts_are_no_markers_and_headers_must_match(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    spark.createDataFrame([("NA", float("nan")), ("None", 1.0), (None, 2.0)], "t string, v double").write.parquet(path)
    rows = files.read_table(spark, path).collect()
    assert sorted(((r.t, r.v) for r in rows), key=str) == [("NA", None), ("None", 1.0), (None, 2.0)]
    csv = tmp_path / "h.csv"
    csv.write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_table(spark, str(csv), "a string, b string").collect()


def test_ingest_order_over_files_of_unequal_size(spark, tmp_path):
    for name, n in (("part-0", 1), ("part-1", 3_000)):
        (tmp_path / "o.csv").mkdir(exist_ok=True)
        (tmp_path / "o.csv" / f"{name}.csv").write_text("k,v\n" + "".join(f"a,{name}-{i}\n" for i in range(n)))
    df = files.read_table(spark, str(tmp_path / "o.csv"), ordered=True)
    assert df.orderBy(N.INGEST_ORDER).first().v == "part-0-0"


def test_a_folder_has_no_preamble(spark, tmp_path):
    (tmp_path / "w.csv").mkdir()
    with pytest.raises(ValueError, match="single file"):
        WF.read_below_preamble(spark, str(tmp_path / "w.csv"))


@pytest.mark.parametrize("header, column", [
    ("Nome do Campo", N.FIELD), (" Data ", N.DATE), ("Qw (m³/d)", N.WATER_RATE),
    ("Teor de [BÁRIO] (mg/L)", "BÁRIO"), ("x [ ESTRÔNCIO ] y", "ESTRÔNCIO"),
    ("[SALINIDADE DA ÁGUA (MG DE NACL/L)]", "SALINIDADE"), ("SALINIDADE", "SALINIDADE"),
    ("Ensaio [BÁRIO]", None), ("[FERRO]", None), ("Código", None),
])
def test_headers(header, column):
    assert WF.column_for(header) == column


def test_two_headers_for_one_column():
    with pytest.raises(ValueError, match="two headers"):
        WF.used_columns(["[BÁRIO]", "BÁRIO"])


def test_preamble_is_skipped(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        "Relatório,,\n\n,,filtro\nSigla da Plataforma,\"Qw (m³/d)\",[BÁRIO],Ensaio [BÁRIO]\n"
        "A,\"1,5\",2,x\n\nRelatório,,\nB,3,,\n", encoding="utf-8",
    )
    rows = WF.read_water_file(spark, str(path)).orderBy(N.INGEST_ORDER).collect()
    assert [(r.SIGLA, r.QW_M3D, r["BÁRIO"]) for r in rows] == [
        ("A", "1,5", "2"), ("Relatório", None, None), ("B", "3", None)
    ]


def test_preamble_of_a_file_in_many_splits(spark, tmp_path):
    path = tmp_path / "a.csv"
    body = "".join(f"P{i:05d},{i}\n" for i in range(20_000))
    path.write_text("a\nb\nc\nSigla da Plataforma,Qw (m³/d)\n" + body, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = WF.read_water_file(spark, str(path))
        assert df.rdd.getNumPartitions() > 4
        codes = [r.SIGLA for r in df.orderBy(N.INGEST_ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert codes == [f"P{i:05d}" for i in range(20_000)]


def test_files_are_joined_by_name(spark, tmp_path):
    head = "x\ny\nz\n"
    (tmp_path / "a.csv").write_text(head + "Sigla da Plataforma,[BÁRIO]\nA,1\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text(head + "[ESTRÔNCIO],Sigla da Plataforma\n2,B\n", encoding="utf-8")
    rows = WF.read_water_tests(spark, str(tmp_path), ["a", "b"]).orderBy(N.INGEST_ORDER).collect()
    assert [(r.SIGLA, r["BÁRIO"], r["ESTRÔNCIO"], r._arquivo) for r in rows] == [
        ("A", "1", None, "a.csv"), ("B", None, "2", "b.csv")
    ]
    with pytest.raises(AnalysisException):
        WF.read_water_tests(spark, str(tmp_path), ["a", "c"]).count()
    with pytest.raises(ValueError):
        WF.read_water_file(spark, str(tmp_path / "a.xlsx"))


def odd_table(rng, n):
    """Cells with line breaks, quotes, commas and blanks, some of them empty or missing."""
    parts = ["a", "é", "x y", '"', '""', ",", "\n", "\n\n", "\r\n", " ", "", 'end"', "1.5"]
    return [["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(3)] + [str(i)] for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_split_records_equal_one_reader(spark, tmp_path, seed, encoding):
    """A file of many splits with line breaks in cells, read by several tasks, cell by cell as Python's reader does."""
    rows = odd_table(random.Random(seed), 300)
    with open(tmp_path / "t.csv", "w", encoding=encoding, newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([["um", "dois\nlinhas", "três", "n"], *rows])
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "700")
    try:
        df = files.read_csv(spark, str(tmp_path / "t.csv"), multi_line=True, ordered=True)
        assert df.columns[:4] == ["um", "dois\nlinhas", "três", "n"]
        got = [[x or "" for x in r[:4]] for r in df.orderBy(N.INGEST_ORDER).collect()]
        assert records._raw(spark, str(tmp_path / "t.csv")).select("block").distinct().count() > 5
    finally:
        spark.conf.set(key, before)
    assert [r[3] for r in got] == [r[3] for r in rows]
    assert got == rows


@pytest.mark.parametrize("short", [0, 4096])
def test_records_of_long_cells_are_read_without_sending_lines(spark, tmp_path, monkeypatch, short):
    """Cells that reach over several splits; their parts come by the driver, or by a join of tables where they are long."""
    rows = [[f"{i}", "\n".join(f"linha {j} de {i}" for j in range(400 if i % 7 == 3 else 2)), "x"] for i in range(60)]
    with open(tmp_path / "t.csv", "w", newline="") as out:
        csv.writer(out, lineterminator="\n").writerows([["n", "texto", "z"], *rows])
    monkeypatch.setattr(records, "SHORT", short)
    key, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(key, "900")
    try:
        df = files.read_csv(spark, str(tmp_path / "t.csv"), multi_line=True, ordered=True)
        got = [list(r[:3]) for r in df.orderBy(N.INGEST_ORDER).collect()]
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert short == 0 or "Exchange" not in plan and "Window" not in plan
    finally:
        spark.conf.set(key, before)
    assert got == rows


def test_a_quote_within_an_unquoted_cell_opens_nothing(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n5" pipe,1\n"x\ny",2\n6" pipe,3\n,"z\n"\n', encoding="utf-8")
    got = [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv"), multi_line=True).collect()]
    assert sorted(got, key=repr) == sorted([('5" pipe', "1"), ("x\ny", "2"), ('6" pipe', "3"), (None, "z\n")], key=repr)


def test_folder_of_files_with_line_breaks(spark, tmp_path):
    df = spark.range(40).selectExpr("cast(id as string) as id", "concat('a\nb', id) as texto").repartition(5)
    files.write_csv(df, str(tmp_path / "t.csv"))
    got = files.read_csv(spark, str(tmp_path / "t.csv"), "id string, texto string", multi_line=True)
    assert got.exceptAll(df).isEmpty() and got.count() == 40
    with pytest.raises(ValueError, match="the header of"):
        files.read_csv(spark, str(tmp_path / "t.csv"), "id string, text string", multi_line=True)


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_water_file_keeps_all_cells(spark, tmp_path, encoding):
    head = 'Relatório,"de\n\n\nNome do Campo,Nome do Poço,Sigla da Plataforma,Data,Qw (m³/d),"Teor [BÁRIO]"\n'
    body = '"Campo\nlongo",P1,"A ""x""",2020-01-01,"1,5",2\nCamp\xe3o,P2,B,2020-02-01,3,\n\n'
    (tmp_path / "w.csv").write_bytes((head + body).encode(encoding))
    rows = [tuple(r)[:-1] for r in WF.read_water_file(spark, str(tmp_path / "w.csv")).orderBy(N.INGEST_ORDER).collect()]
    assert rows == [("Campo\nlongo", "P1", 'A "x"', "2020-01-01", "1,5", "2"), ("Camp\xe3o", "P2", "B", "2020-02-01", "3", None)]


def test_water_file_without_needed_headers_is_an_error(spark, tmp_path):
    (tmp_path / "w.csv").write_text("a\nb\nc\nNome do Campo,Data\nx,2020-01-01\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no header for SIGLA, POCO"):
        WF.read_water_file(spark, str(tmp_path / "w.csv"), WF.NEEDED)


def test_csv_files_begin_with_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("é", 1), ("b\nc", 2)], "nome string, v int").repartition(2)
    files.write_csv(df, str(tmp_path / "o.csv"))
    parts = [p.read_bytes() for p in (tmp_path / "o.csv").glob("*.csv")]
    assert parts and all(p.startswith(b"\xef\xbb\xbfnome,v") for p in parts)
    assert spark.read.option("header", True).csv(str(tmp_path / "o.csv")).columns == ["nome", "v"]
    back = files.read_csv(spark, str(tmp_path / "o.csv"), "nome string, v int", multi_line=True)
    assert sorted(tuple(r) for r in back.collect()) == [("b\nc", 2), ("é", 1)]
    files.write_csv(df, str(tmp_path / "o.csv"), mark=False)
    assert all(p.read_bytes().startswith(b"nome,v") for p in (tmp_path / "o.csv").glob("*.csv"))
    with pytest.raises(ValueError, match="must be quoted"):
        files.write_csv(df.withColumnRenamed("nome", "a,b"), str(tmp_path / "o.csv"))


def test_water_lines_are_parsed_once_and_files_looked_through_together(spark, tmp_path, monkeypatch):
    head = "x\ny\nz\nSigla da Plataforma,Nome do Poço,Data,[BÁRIO]\n"
    for name in "ab":
        (tmp_path / f"{name}.csv").write_text(head + f"{name},NA,1999-12-31,1\n{name},w,2000-01-01,nan\n{name},w,,3\n", encoding="utf-8")
    (tmp_path / "c.csv").write_bytes((head + "ç,w,2001-01-01,4\n").encode("latin-1"))
    asked, facts = [], records.facts
    monkeypatch.setattr(records, "facts", lambda spark, *paths: asked.append(len(paths)) or facts(spark, *paths))
    tests = jobs.clean_water(WF.read_water_tests(spark, str(tmp_path), ["a", "b", "c"], needed=WF.NEEDED))
    assert asked == [3]
    plan = tests._jdf.queryExecution().executedPlan().toString()
    # the date's filter had a parser and a date of its own
    assert plan.count("from_csv(") == plan.count("gettimestamp(") == 3
    got = [(r.SIGLA, r.POCO, r["BÁRIO"], r._arquivo) for r in tests.orderBy(N.INGEST_ORDER).collect()]
    assert got == [("a", "w", None, "a.csv"), ("b", "w", None, "b.csv"), ("ç", "w", 4.0, "c.csv")]


def test_a_quote_after_a_latin1_letter_closes_its_cell(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes('a,b\n"x\nç",1\n"y\né",2\nç,3\n'.encode("latin-1"))
    got = [tuple(r) for r in files.read_csv(spark, str(tmp_path / "t.csv"), multi_line=True).collect()]
    assert sorted(got) == [("x\nç", "1"), ("y\né", "2"), ("ç", "3")]


def test_states_of_lines(spark):
    """Lines with no quote or one are told without a regular expression, and as those with more are."""
    lines = {"": (0, 1), "a,b": (0, 1), '"a': (1, 0), 'a,"b': (1, 0), 'a"b': (0, 0), 'b",c': (0, 0), 'b","c': (1, 1), '"a",b': (0, 0),
             '""': (0, 1), '""a': (0, 1), 'a""",b': (0, 0), '5" x,"y': (1, 1), 'é"\r': (0, 0), 'x,"a","b\r': (1, 1)}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    got = records._with_ends(df).orderBy("i").collect()
    assert {r.value: (r._o, r._i) for r in got} == lines
