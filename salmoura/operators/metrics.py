"""Evaluation of scored rows: ROC, Youden threshold, AUC, confusion metrics.

All functions take a table with an actual class (0/1) and a score, plus grouping
columns ``by`` (a model, a fold) or none. Scores are first reduced to distinct
values, then cumulated in value buckets, so no window holds a whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from salmoura.functions.columns import mean_sd_text
from salmoura.functions.running import BUCKET, bucket_of, equal_splits, running_totals
from salmoura.names import col

METRICS = ["AUC", "ACURACIA", "PRECISAO", "SENSIBILIDADE", "ESPECIFICIDADE", "F1_SCORE"]
COUNTS = ["VP", "FP", "VN", "FN"]


def cumulated_scores(
    scored: DataFrame,
    actual: str,
    score: str,
    by: Sequence[str] = (),
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """One row per distinct score: positives and negatives at it (``pos``, ``neg``), below it
    (``pos_below``, ``neg_below``) and overall (``pos_below_all``, ``neg_below_all``).

    ``splits`` are bucket limits of the score; they are looked up if not given.
    """
    known = scored.filter(col(score).isNotNull() & col(actual).isNotNull())
    splits = equal_splits(known, score) if splits is None else splits
    distinct = known.groupBy(*[col(b) for b in by], col(score).alias("limiar")).agg(
        F.sum(col(actual).cast("long")).alias("pos"),
        F.sum(1 - col(actual).cast("long")).alias("neg"),
    )
    return running_totals(
        distinct.withColumn(BUCKET, bucket_of(F.col("limiar"), splits)),
        by,
        [F.col("limiar")],
        {"pos_below": "pos", "neg_below": "neg"},
    ).drop(BUCKET)


def threshold_points(cumulated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate of calling everything at or above each score positive."""
    tp = F.col("pos_below_all") - F.col("pos_below")
    fp = F.col("neg_below_all") - F.col("neg_below")
    return cumulated.select(
        *[col(b) for b in by],
        "limiar",
        F.try_divide(fp.cast("double"), F.col("neg_below_all").cast("double")).alias("fpr"),
        F.try_divide(tp.cast("double"), F.col("pos_below_all").cast("double")).alias("tpr"),
    )


def roc_points(scored: DataFrame, actual: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """All points of the ROC curve, with the origin (no threshold) for each group."""
    points = threshold_points(cumulated_scores(scored, actual, score, by), by)
    groups = scored.select(*[col(b) for b in by]).distinct() if by else scored.sparkSession.range(1)
    origin = groups.select(
        *[col(b) for b in by],
        F.lit(None).cast("double").alias("limiar"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return origin.unionByName(points)


def curve_summary(
    scored: DataFrame,
    actual: str,
    score: str,
    by: Sequence[str] = (),
    splits: Sequence[float] | None = None,
) -> DataFrame:
    """Youden threshold and area under the ROC curve, from one cumulation of the scores.

    The threshold is the score with the largest tpr - fpr, the highest one if several are
    best. The area is the share of (positive, negative) pairs in the right order, ties
    counting half. Both are null where a class is absent.
    """
    cumulated = cumulated_scores(scored, actual, score, by, splits)
    positives, negatives = (F.col(f"{c}_below_all").cast("double") for c in ("pos", "neg"))
    tpr = F.try_divide((F.col("pos_below_all") - F.col("pos_below")).cast("double"), positives)
    fpr = F.try_divide((F.col("neg_below_all") - F.col("neg_below")).cast("double"), negatives)
    pairs = F.col("pos").cast("double") * (
        F.col("neg_below").cast("double") + F.col("neg").cast("double") / 2
    )
    j = tpr - fpr
    return cumulated.groupBy(*[col(b) for b in by]).agg(
        F.max(F.when(j.isNotNull(), F.struct(j.alias("j"), "limiar"))).alias("_best"),
        F.try_divide(F.sum(pairs), F.max(positives) * F.max(negatives)).alias("AUC"),
    ).select(
        *[col(b) for b in by],
        F.col("_best.limiar").alias("LIMIAR_YOUDEN"),
        F.col("_best.j").alias("J_YOUDEN"),
        "AUC",
    )


def youden_threshold(
    scored: DataFrame, actual: str, score: str, by: Sequence[str] = ()
) -> DataFrame:
    return curve_summary(scored, actual, score, by).drop("AUC")


def auc(scored: DataFrame, actual: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return curve_summary(scored, actual, score, by).drop("LIMIAR_YOUDEN", "J_YOUDEN")


def confusion_aggregates(actual: Column, predicted: Column) -> list[Column]:
    def count(a: int, p: int, name: str) -> Column:
        hit = (actual == a) & (predicted == p)
        return F.count(F.when(hit, 1)).alias(name)

    return [count(1, 1, "VP"), count(0, 1, "FP"), count(0, 0, "VN"), count(1, 0, "FN")]


def with_rates(counts: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall, specificity and F1 to confusion counts.

    Precision, recall and F1 are 0 where undefined; specificity is missing without negatives.
    """
    tp, fp, tn, fn = (F.col(c).cast("double") for c in COUNTS)

    def zero(numerator: Column, denominator: Column) -> Column:
        return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))

    return counts.withColumns({
        "ACURACIA": F.try_divide(tp + tn, tp + fp + tn + fn),
        "PRECISAO": zero(tp, tp + fp),
        "SENSIBILIDADE": zero(tp, tp + fn),
        "ESPECIFICIDADE": F.try_divide(tn, tn + fp),
        "F1_SCORE": zero(2 * tp, 2 * tp + fp + fn),
    })


def confusion(
    scored: DataFrame, actual: str, predicted: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts per group for a predicted class."""
    known = scored.withColumn("_predicted", predicted)
    return known.groupBy(*[col(b) for b in by]).agg(
        *confusion_aggregates(col(actual), F.col("_predicted"))
    )


def specificity(
    scored: DataFrame, actual: str, predicted: Column, by: Sequence[str] = ()
) -> DataFrame:
    rates = with_rates(confusion(scored, actual, predicted, by))
    return rates.select(*[col(b) for b in by], "ESPECIFICIDADE")


def fold_summary(per_fold: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample standard deviation and ``mean ± sd`` text of each metric over the folds."""
    means = per_fold.groupBy(*[col(b) for b in by]).agg(
        *[F.avg(m).alias(f"{m}_MEDIA_FOLDS") for m in METRICS],
        *[F.stddev_samp(m).alias(f"{m}_DP_FOLDS") for m in METRICS],
    )
    return means.withColumns({
        f"{m}_MEDIA_DP": mean_sd_text(F.col(f"{m}_MEDIA_FOLDS"), F.col(f"{m}_DP_FOLDS"))
        for m in METRICS
    })


def best_first(models: DataFrame, metric: str = "AUC") -> DataFrame:
    return models.orderBy(F.col(metric).desc_nulls_last(), "MODELO")


def best_model(models: DataFrame, metric: str = "AUC") -> DataFrame:
    return best_first(models, metric).limit(1)
