"""Running totals over a whole table without putting it into one window partition.

Rows are split into value buckets of about equal size, the few bucket totals are
summed in order, and each bucket adds its own rows on top of what came before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from salmoura.names import col
from salmoura.session import materialise

BUCKET = "_balde"
MOST_BUCKETS = 1024  # default limit of a list of splits, which travels in the plan


def equal_splits(
    df: DataFrame, column: str, buckets: int | None = None, most: int = MOST_BUCKETS
) -> list[float]:
    """Ascending split values that cut ``column`` into about equally many rows.

    By default there are as many as shuffle partitions, ``most`` at most. It is fetched once and then used
    as literals, so that every use of the buckets agrees.
    """
    if buckets is None:
        parallel = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        buckets = min(most, max(8, parallel))
    marks = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.approxQuantile(column, marks, 0.25 / buckets)))


def bucket_of(value: Column, splits: Sequence[float]) -> Column:
    """Number of splits at or below ``value``, as a tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(splits[middle]), tree(low, middle)).otherwise(
            tree(middle + 1, high)
        )

    return tree(0, len(splits))


def running_totals(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], totals: dict[str, str]
) -> DataFrame:
    """Add, for each (output, column) of ``totals``, two columns to a bucketed table:
    ``output`` = total over all earlier rows of the group, ``output_all`` = total of the group.

    ``df`` has a ``_balde`` column that agrees with ``order``.
    """
    group = [col(b) for b in by]
    sums = df.groupBy(*group, BUCKET).agg(
        *[F.sum(col(c)).alias(f"_s_{out}") for out, c in totals.items()]
    )
    whole = Window.partitionBy(*group, F.lit(0))
    earlier = whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *group,
        BUCKET,
        *[F.coalesce(F.sum(f"_s_{o}").over(earlier), F.lit(0)).alias(f"_o_{o}") for o in totals],
        *[F.sum(f"_s_{o}").over(whole).alias(f"{o}_all") for o in totals],
    )
    inside = (
        Window.partitionBy(*group, F.col(BUCKET))
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    added = df.join(offsets, [*by, BUCKET])
    return added.withColumns({
        o: F.col(f"_o_{o}") + F.coalesce(F.sum(col(c)).over(inside), F.lit(0))
        for o, c in totals.items()
    }).drop(*[f"_o_{o}" for o in totals])


def positions(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add the 0-based position of each row in ``order`` over the whole table.

    Rows are cut into ranges of the whole order, so equal first columns spread as well. The ranges are written,
    as what they hold must not change when a task runs again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = materialise(df.repartitionByRange(parts, *order).withColumns({
        BUCKET: F.spark_partition_id(), "_one": F.lit(1)
    }))
    return running_totals(ranged, [], order, {name: "_one"}).drop(BUCKET, "_one", f"{name}_all")
