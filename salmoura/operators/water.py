"""Water tests to a dense platform-month series.

Flow and chemistry of one well often sit on different test rows, so a well is
first summed up per month (medians) and only then weighed against the other
wells of its platform.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from salmoura import names as N
from salmoura.functions.columns import finite
from salmoura.functions.quantiles import grouped
from salmoura.session import materialise

MONTHS_CARRIED = 2
WELL_MONTH = [N.CODE, N.MONTH, N.WELL]
PLATFORM_MONTH = [N.CODE, N.MONTH]


def _present(df: DataFrame) -> dict[str, str]:
    return {c: plain for c, plain in N.CHEMISTRY.items() if c in df.columns}


def _known_wells(tests: DataFrame) -> DataFrame:
    return tests.dropna(subset=WELL_MONTH)


def well_months(tests: DataFrame) -> DataFrame:
    """One row per platform, month and well: first field named (by ``_ordem``, which is needed), medians of
    rates and chemistry."""
    if N.INGEST_ORDER not in tests.columns:
        raise ValueError(f"water tests need their order in {N.INGEST_ORDER}")
    first_field = F.min_by(N.col(N.FIELD), F.when(N.col(N.FIELD).isNotNull(), N.col(N.INGEST_ORDER)))
    measured = [N.WATER_RATE, N.OIL_RATE, N.BSW, *_present(tests)]
    wanted = [*WELL_MONTH, N.FIELD, N.INGEST_ORDER, *measured]
    return grouped(
        _known_wells(tests).select(*[N.col(c) for c in wanted]),
        WELL_MONTH,
        [first_field.alias(N.FIELD)],
        {c: (c, 0.5) for c in measured},
    )


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of the positive finite values, weighted by the positive finite weights; null if none."""
    value, weight = finite(value), finite(weight)
    usable = (value > 0) & (weight > 0)
    return F.try_divide(
        F.sum(F.when(usable, value * weight)), F.sum(F.when(usable, weight))
    )


def platform_totals(wells: DataFrame) -> DataFrame:
    """One row per platform and month that has tests, with monthly volumes.

    Field of the first well that names one; rates add up (null if no well has any);
    chemistry is weighted by water rate.
    """
    chemistry = _present(wells)
    named = F.when(N.col(N.FIELD).isNotNull(), N.col(N.WELL))
    months = grouped(
        wells,
        PLATFORM_MONTH,
        [
            F.min_by(N.col(N.FIELD), named).alias(N.FIELD),
            F.sum(N.WATER_RATE).alias(N.WATER_RATE),
            F.sum(N.OIL_RATE).alias(N.OIL_RATE),
            F.count(N.WELL).alias(N.N_WELLS),  # rows are unique per well
            *[
                weighted_mean(N.col(c), N.col(N.WATER_RATE)).alias(plain)
                for c, plain in chemistry.items()
            ],
        ],
        {N.BSW: (N.BSW, 0.5)},
    )
    days = F.dayofmonth(F.last_day(N.MONTH))
    return months.select(
        N.CODE, N.MONTH, N.FIELD, N.WATER_RATE, N.OIL_RATE, N.BSW, N.N_WELLS,
        *chemistry.values(),
        days.alias(N.DAYS),
        (F.col(N.WATER_RATE) * days).alias(N.WATER_MONTH),
        (F.col(N.OIL_RATE) * days).alias(N.OIL_MONTH),
    )


def dense_calendar(months: DataFrame, span: DataFrame | None = None) -> DataFrame:
    """Every platform gets every month between the first and last month of ``span``.

    Each row emits itself and the empty months up to the platform's next row; the
    first row of a platform also emits the empty months before it. That needs one
    shuffle by platform and no join against a calendar; the span is a scalar subquery.
    """
    span = months if span is None else span
    ends = span.agg(F.struct(F.min(N.MONTH).alias("start"), F.max(N.MONTH).alias("end")).alias("m")).scalar()
    start, end = ends["start"], ends["end"]
    along = Window.partitionBy(N.CODE).orderBy(N.MONTH)
    following = F.lead(N.MONTH).over(along)
    from_month = F.when(F.row_number().over(along) == 1, start).otherwise(F.col(N.MONTH))
    to_month = F.when(following.isNotNull(), F.add_months(following, -1)).otherwise(end)
    values = [c for c in months.columns if c not in (N.CODE, N.MONTH, N.DAYS)]
    spread = months.withColumns({"_from": from_month, "_to": to_month}).withColumn(
        "_month", F.explode(F.sequence("_from", "_to", F.expr("interval 1 month")))
    )
    own = F.col("_month") == F.col(N.MONTH)
    return spread.select(
        N.CODE,
        F.col("_month").alias(N.MONTH),
        *[F.when(own, N.col(c)).alias(c) for c in values],
        F.dayofmonth(F.last_day("_month")).alias(N.DAYS),
    )


def carry_forward(
    dense: DataFrame, columns: list[str] | None = None, months: int = MONTHS_CARRIED
) -> DataFrame:
    """Fill missing chemistry from at most ``months`` rows back within the platform."""
    columns = [c for c in (columns or N.CHEMISTRY.values()) if c in dense.columns]
    back = (
        Window.partitionBy(N.CODE).orderBy(N.MONTH).rowsBetween(-months, Window.currentRow)
    )
    return dense.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in columns})


def chemical_loads(months: DataFrame) -> DataFrame:
    """Kilograms per month of each chemical (mg/L times m³, over 1000)."""
    present = [c for c in N.CHEMISTRY.values() if c in months.columns]
    return months.withColumns({
        f"{c}_kg_mes": F.col(c) * F.col(N.WATER_MONTH) / 1000 for c in present
    })


def dense_months(tests: DataFrame) -> DataFrame:
    """Platform totals of every month of the calendar. The wells' months are written once: totals and the calendar's
    span read them from there, and the tests are read by no other step."""
    wells = materialise(well_months(tests))
    return dense_calendar(platform_totals(wells), span=wells)


def platform_months(tests: DataFrame) -> DataFrame:
    """Dense platform-month table of water tests."""
    return chemical_loads(carry_forward(dense_months(tests)))
