"""Tables in files: CSV and Parquet readers, CSV and Parquet sinks, model folders."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from salmoura import names as N
from salmoura.functions.columns import finite
from salmoura.sources import records

# fixed values: cell texts that mean "missing" in a CSV file
MISSING_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def _suffix(path: str) -> str:
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in (".csv", ".parquet"):
        raise ValueError(f"unsupported format: {suffix or path}")
    return suffix


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def missing_as_null(df: DataFrame, texts: bool = True) -> DataFrame:
    """Missing markers of text columns (if ``texts``) and NaN or infinities of floating columns as null."""
    marked = _text_columns(df) if texts else []
    text = {c: F.when(~N.col(c).isin(MISSING_MARKERS), N.col(c)) for c in marked}
    floating = {
        f.name: finite(N.col(f.name))
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns({**text, **floating}) if text or floating else df


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """CSV with a header. Text is read as UTF-8, or as Latin-1 where the file is no valid UTF-8.

    Without a schema all columns are text, to be coerced by name later on; with one, its names must be
    those of the header. Files are split, also where cells hold line breaks; those are an error unless ``multi_line``
    allows them. ``ordered`` adds the place of each row as ``_ordem``.
    """
    (known,) = records.facts(spark, path)
    if known.open_cells and not multi_line:
        raise ValueError(f"cells with line breaks in {path}: read it with multi_line=True")
    if known.open_cells:
        return _read_records(spark, path, schema, known.utf8, ordered)
    reader = spark.read.option("header", True).option("encoding", "UTF-8" if known.utf8 else "ISO-8859-1")
    reader = reader.option("inferSchema", False).option("escape", '"').option("enforceSchema", False)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.withColumn(N.INGEST_ORDER, ingest_order()) if ordered else df


def _read_records(
    spark: SparkSession, path: str, schema: T.StructType | str | None, utf8: bool, ordered: bool
) -> DataFrame:
    found, firsts = records.records(spark, path, utf8)
    names = records.headers(firsts)
    if schema is None:
        kinds = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        seen = [n.lower() for n in names]
        names = [f"{n}{i}" if seen.count(n.lower()) > 1 else n or f"_c{i}" for i, n in enumerate(names)]
    else:
        given = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        if given.fieldNames() != names:
            raise ValueError(f"the header of {path} is {names}, not {given.fieldNames()}")
        kinds = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(given)])
    rows = records.parsed(found, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds), records.place())
    df = rows.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("_place").alias(N.INGEST_ORDER))
    return df if ordered else df.drop(N.INGEST_ORDER)


def ingest_order() -> Column:
    """Place of a row in its source: file, block of the file, row of the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    ordered: bool = False,
    multi_line: bool = False,
) -> DataFrame:
    """Read a table by the suffix of its path.

    A missing path raises Spark's AnalysisException, another suffix ValueError.
    ``ordered`` adds the place of each row, in the order of files and lines, as ``_ordem``.
    Texts that stand for missing values do so in CSV only.
    """
    is_csv = _suffix(path) == ".csv"
    if is_csv:
        df = read_csv(spark, path, schema, multi_line, ordered)
    else:
        df = (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)
        df = df.withColumn(N.INGEST_ORDER, ingest_order()) if ordered else df
    return missing_as_null(df, texts=is_csv)


def write_csv(df: DataFrame, path: str, mark: bool = True) -> str:
    """Overwrite a folder of CSV part files with headers. With ``mark`` each begins with the byte-order mark of UTF-8, by
    which spreadsheet programs know the encoding; readers of this package and of Spark pass over it. A first column whose
    name must be quoted cannot follow the mark and is an error."""
    first, *others = df.columns
    if mark and any(c in first for c in ',"\r\n'):
        raise ValueError(f"the first column {first!r} must be quoted: rename it, or write without a byte-order mark")
    marked = df.select(N.col(first).alias(f"\ufeff{first}"), *[N.col(c) for c in others]) if mark else df
    writer = marked.write.mode("overwrite").option("header", True).option("escape", '"')
    blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    writer.options(**blanks).csv(path)
    return path


def _versions(spark: SparkSession, folder: str, name: str = "*") -> list[tuple[int, str, bool]]:
    """(number, path, whether it is complete) of all versions of a stage, or of all stages."""
    system = spark._jvm.org.apache.hadoop.fs
    at = system.Path(f"{folder.rstrip('/')}/{name}.parquet/version=*")
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [entry.getPath() for entry in store.globStatus(at) or []]
    # Spark writes this file after everything else
    return [(int(f.getName().split("=")[1]), f.toString(), store.exists(system.Path(f, "_SUCCESS"))) for f in found]


def begin_run(spark: SparkSession, folder: str, resume: bool = False) -> int:
    """The version that a run gives its stages: a new one, or to resume the last run that one's."""
    last = max((number for number, *_ in _versions(spark, folder)), default=0)
    return max(last, 1) if resume else last + 1


def has_stage(spark: SparkSession, folder: str, name: str, version: int) -> bool:
    return any(number == version and complete for number, _, complete in _versions(spark, folder, name))


def write_stage(df: DataFrame, folder: str, name: str, version: int | None = None) -> DataFrame:
    """Write a stage table as Parquet and go on from what was written.

    Each write makes a version of its own (``version`` or the next number). Readers see it once it is complete; until then,
    and after a write that failed, they see the one before, which stays until the next version is complete.
    """
    spark = df.sparkSession
    known = _versions(spark, folder, name)
    if version is None:
        version = max((number for number, *_ in known), default=0) + 1
    path = f"{folder.rstrip('/')}/{name}.parquet/version={version}"
    df.write.mode("overwrite").parquet(path)
    before = max((number for number, _, complete in known if complete and number < version), default=version)
    for number, old, _ in known:
        if number < before:
            at = spark._jvm.org.apache.hadoop.fs.Path(old)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return spark.read.parquet(path)


def read_stage(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The last complete version of a stage."""
    return spark.read.parquet(stage_path(spark, folder, name))


def stage_path(spark: SparkSession, folder: str, name: str) -> str:
    complete = [(number, path) for number, path, done in _versions(spark, folder, name) if done]
    if not complete:
        raise FileNotFoundError(f"no complete stage {name} in {folder}")
    return max(complete)[1]


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
