"""Row and column cleaning steps shared by all sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from salmoura import names as N
from salmoura.functions.columns import as_double, complete, finite

# fixed values: date patterns tried, in this order, on the first value of a text column; one letter of day,
# month, hour, minute or second reads one or two digits
_DAYS = ["yyyy-M-d", "yyyy/M/d", "M/d/yyyy", "d/M/yyyy", "M-d-yyyy", "d-M-yyyy"]
_TIMES = ["", " H:m:s", " H:m:s.SSSSSSSSS", " H:m", "'T'H:m:s", "'T'H:m:s.SSSSSSSSS", "'T'H:m"]
DATE_PATTERNS = [day + time for day in _DAYS for time in _TIMES]
MONTH_PATTERN = "yyyy/M"
EARLIEST_DATE = "2000-01-01"
FIRST_ROWS = 1000  # a column with a value in these is not counted


def _parsed(c: Column, pattern: str) -> Column:
    if "H" in pattern:
        return F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")
    return F.try_to_date(c, pattern).cast("timestamp_ntz")


def infer_date_pattern(df: DataFrame, column: str) -> str:
    """The first known pattern that fits the first non-missing value; an error if none does."""
    text = F.trim(N.col(column))
    row = df.select(text.alias("v")).filter("v is not null").limit(1).select(
        "v", *[_parsed(F.col("v"), p).alias(f"p{i}") for i, p in enumerate(DATE_PATTERNS)]
    ).first()
    if row is None:  # nothing to parse
        return DATE_PATTERNS[0]
    fits = [p for i, p in enumerate(DATE_PATTERNS) if row[f"p{i}"] is not None]
    if not fits:
        raise ValueError(f"no known date pattern fits the first value of {column}: {row['v']}")
    return fits[0]


def parse_dates(
    df: DataFrame, column: str = N.PERIOD, pattern: str | None = MONTH_PATTERN
) -> DataFrame:
    """Parse a date column (unparseable text becomes null) and add days in month, year and month.

    With ``pattern=None`` one pattern is inferred from the first value. Columns that
    are dates already pass through.
    """
    if isinstance(df.schema[column].dataType, T.StringType):
        parsed = _parsed(F.trim(N.col(column)), pattern or infer_date_pattern(df, column))
        df = df.withColumn(column, parsed)
    day = N.col(column).cast("date")
    return df.withColumns({
        N.DAYS: F.dayofmonth(F.last_day(day)),
        "Ano": F.year(day),
        N.MONTH: F.trunc(day, "MM"),
    })


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop the columns without any value. One value is enough to keep a column, and most show one in the first rows;
    those that do not are counted over all rows, in one pass."""
    if not df.columns:
        return df
    known = [N.col(c).isNotNull().alias(f"n{i}") for i, c in enumerate(df.columns)]
    first = df.select(*known).head(FIRST_ROWS)
    left = [c for i, c in enumerate(df.columns) if not any(r[i] for r in first)]
    if not left:
        return df
    counts = df.agg(*[F.count(N.col(c)).alias(f"n{i}") for i, c in enumerate(left)]).first()
    empty = {c for c, n in zip(left, counts) if n == 0}
    return df.select(*[N.col(c) for c in df.columns if c not in empty])


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.filter(complete(subset))


def keep_first(df: DataFrame, subset: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row in ``order`` of every key; missing keys are equal to each other.

    An aggregate rather than a window: a key with a large share of the rows is
    reduced before the shuffle.
    """
    rows = df.groupBy(*[N.col(k).alias(f"_k{i}") for i, k in enumerate(subset)]).agg(
        F.min_by(F.struct(*[N.col(c) for c in df.columns]), F.struct(*order)).alias("_row")
    )
    return rows.select("_row.*")


def rename_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(columns)


def sort_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sort with missing values last. All other columns break ties, which fixes the
    order of equal rows and lets a value with many rows spread over range partitions."""
    rest = [c for c in df.columns if c not in columns]
    return df.orderBy(*[N.col(c).asc_nulls_last() for c in [*columns, *rest]])


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of the columns that exist, as finite doubles; other text becomes null."""
    kinds = dict(df.dtypes)
    present = [c for c in columns if c in kinds]
    # in two steps, so that a text is read as a number once, not once to compare it and once more for its value
    read = df.withColumns({c: as_double(N.col(c), kinds[c] == "string") for c in present})
    return read.withColumns({c: finite(N.col(c)) for c in present})


def drop_invalid_dates(
    df: DataFrame, column: str = N.DATE, earliest: str = EARLIEST_DATE
) -> DataFrame:
    """Rows dated on or after ``earliest``. The column goes through a generator: what makes it (a parsed text) is worked
    out once, while a plain filter would be moved below it, with a copy of its own."""
    kept = [F.explode(F.array(N.col(c))).alias(c) if c == column else N.col(c) for c in df.columns]
    return df.select(*kept).filter(N.col(column) >= F.to_date(F.lit(earliest)))


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[N.col(c) for c in columns])


def without_infinities(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN and infinities of floating columns as null."""
    kinds = dict(df.dtypes)
    floating = [c for c in columns if kinds[c] in ("double", "float")]
    return df.withColumns({c: finite(N.col(c)) for c in floating}) if floating else df


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return without_infinities(df, columns).filter(complete(columns))


def rejection_reason(features: Sequence[str] = N.FEATURES) -> Column:
    """Name of the first input that is missing or not above zero; null for a usable row."""
    return F.coalesce(*[
        F.when(
            finite(N.col(f)).isNull() | (N.col(f) <= 0),
            F.lit(f"{f.lower()} deve ser um valor positivo e maior que zero"),
        )
        for f in features
    ])


def check_inputs(df: DataFrame, features: Sequence[str] = N.FEATURES) -> DataFrame:
    """Add ``MOTIVO_REJEICAO``, null where all features can be scored."""
    return df.withColumn("MOTIVO_REJEICAO", rejection_reason(features))


def split_inputs(
    df: DataFrame, features: Sequence[str] = N.FEATURES
) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows with their reason)"""
    checked = check_inputs(df, features)
    reason = F.col("MOTIVO_REJEICAO")
    return checked.filter(reason.isNull()).drop(reason), checked.filter(reason.isNotNull())
