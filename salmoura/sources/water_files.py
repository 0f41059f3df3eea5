"""The water-test files: headers on the fourth line, differing from file to file."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from salmoura import names as N
from salmoura.sources import records
from salmoura.sources.files import missing_as_null

PREAMBLE_LINES = 3

# fixed values: names of the water-test files, without suffix
WATER_FILES = [
    "ABL-1", "ABL-JUB-1", "ABL-JUB-2", "BC_BR", "JUB-1", "JUB-JUB", "MLS-1", "MLS-2", "MRL-1",
    "MRL-2", "RO-1", "RO-2", "RO-3", "SPH", "TUP", "URG", "VD-AB-1",
]

# fixed values: header -> column (and, below, the brackets around a parameter)
FIXED_HEADERS = {
    "Nome do Campo": N.FIELD,
    "Nome do Poço": N.WELL,
    "Nome da Plataforma": N.SITE,
    "Sigla da Plataforma": N.CODE,
    "Data": N.DATE,
    "Qw (m³/d)": N.WATER_RATE,
    "Qo (m³/d)": N.OIL_RATE,
    "BSW (%)": N.BSW,
}
CHEMISTRY_ALIASES = {"SALINIDADE DA ÁGUA (MG DE NACL/L)": "SALINIDADE"}
NUMERIC = [N.WATER_RATE, N.OIL_RATE, N.BSW, *N.CHEMISTRY]
NEEDED = [N.CODE, N.WELL, N.DATE]  # without them a test belongs to no well and month
TARGETS = [*FIXED_HEADERS.values(), *N.CHEMISTRY]


def parameter_name(header: str) -> str:
    """Text in square brackets (else the whole header), with aliases resolved."""
    bracketed = re.search(r"\[([^\]]+)\]", header)
    name = (bracketed.group(1) if bracketed else header).strip()
    return CHEMISTRY_ALIASES.get(name, name)


def column_for(header: str) -> str | None:
    """Column a header stands for, or None if it is not used."""
    name = header.strip()
    if name in FIXED_HEADERS:
        return FIXED_HEADERS[name]
    if "ensaio" in name.lower():
        return None
    parameter = parameter_name(header)
    return parameter if parameter in N.CHEMISTRY else None


def used_columns(headers: Sequence[str]) -> dict[str, int]:
    """Column -> position of its header. Two headers for one column are an error."""
    found: dict[str, int] = {}
    for position, header in enumerate(headers):
        column = column_for(header)
        if column is None:
            continue
        if column in found:
            raise ValueError(f"two headers stand for {column}: {headers[found[column]]}, {header}")
        found[column] = position
    return found


def read_below_preamble(
    spark: SparkSession, path: str, skip: int = PREAMBLE_LINES, known: records.Facts | None = None
) -> tuple[list[str], DataFrame]:
    """(headers, rows) of one CSV file (no folder) whose header follows ``skip`` other lines.

    Rows have text columns ``c0, c1, ...`` and their place ``_ordem``. Text is UTF-8, or Latin-1 where the file is no
    valid UTF-8; cells may hold line breaks. The file is read by splits. ``known`` is what is known of the file already.
    """
    known = records.facts(spark, path)[0] if known is None else known
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        raise ValueError(f"a single file is needed, not a folder: {path}")
    read = records.records if known.open_cells else records.plain_records
    found, firsts = read(spark, path, known.utf8, skip)
    try:
        headers = records.headers(firsts)
    except ValueError as none:
        raise ValueError(f"no header line in {path}") from none
    schema = ", ".join(f"c{i} string" for i in range(len(headers)))
    return headers, records.parsed(found, schema, F.struct("block", "n")).withColumnRenamed("_place", N.INGEST_ORDER)


def read_water_file(spark: SparkSession, path: str, needed: Sequence[str] = ()) -> DataFrame:
    """Used columns of one water-test file, CSV or Parquet, all named as in the data model. Without a header for
    one of the ``needed`` columns it is an error."""
    return missing_as_null(_used(spark, path, needed), texts=path.endswith(".csv"))


def _used(spark: SparkSession, path: str, needed: Sequence[str], known: records.Facts | None = None) -> DataFrame:
    """As :func:`read_water_file`, with missing markers left as they are."""
    if path.endswith(".parquet"):
        df = spark.read.parquet(path).withColumn(
            N.INGEST_ORDER, F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
        )
        headers = [c for c in df.columns if c != N.INGEST_ORDER]
        source = {i: N.col(h) for i, h in enumerate(headers)}
    elif path.endswith(".csv"):
        headers, df = read_below_preamble(spark, path, known=known)
        source = {i: F.col(f"c{i}") for i in range(len(headers))}
    else:
        raise ValueError(f"unsupported format: {path}")
    found = used_columns(headers)
    absent = [c for c in needed if c not in found]
    if absent:
        raise ValueError(f"no header for {', '.join(absent)} in {path}: {headers}")
    used = [source[found[c]].alias(c) for c in TARGETS if c in found]
    return df.select(*used, N.INGEST_ORDER)


def read_water_tests(
    spark: SparkSession,
    folder: str,
    files: Sequence[str] = tuple(WATER_FILES),
    suffix: str = ".csv",
    needed: Sequence[str] = (),
) -> DataFrame:
    """All water-test files as one table, tagged with their file; any missing file is an error. CSV files are all looked
    through in one pass.

    ``_ordem`` orders rows by file, then by position within the file.
    """
    paths, csv = [f"{folder.rstrip('/')}/{name}{suffix}" for name in files], suffix.endswith(".csv")
    known = records.facts(spark, *paths) if csv and paths else [None] * len(paths)
    parts = [
        (_used(spark, path, needed, k) if csv else read_water_file(spark, path, needed)).withColumns({
            N.SOURCE_FILE: F.lit(name + suffix),
            N.INGEST_ORDER: F.struct(F.lit(i).alias("file"), F.col(N.INGEST_ORDER).alias("row")),
        })
        for i, (name, path, k) in enumerate(zip(files, paths, known))
    ]
    tests = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return missing_as_null(tests) if csv else tests
