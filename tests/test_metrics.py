import numpy as np
import pytest
from pyspark.sql import functions as F

from salmoura.operators import metrics as M


def scored(spark, rows):
    return spark.createDataFrame(rows, "g int, y int, p double")


def brute(y, p):
    y, p = np.array(y), np.array(p)
    best, threshold = -2.0, None
    for t in sorted(set(p), reverse=True):
        j = ((p >= t) & (y == 1)).sum() / (y == 1).sum() - ((p >= t) & (y == 0)).sum() / (y == 0).sum()
        if j > best:
            best, threshold = j, t
    wins = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    return threshold, np.mean(wins)


def test_curve_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 500)
    p = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    g = rng.integers(0, 2, 500)
    df = scored(spark, [(int(a), int(b), float(c)) for a, b, c in zip(g, y, p)])
    whole = M.curve_summary(df, "y", "p").first()
    threshold, area = brute(y, p)
    assert whole.LIMIAR_YOUDEN == threshold and whole.AUC == pytest.approx(area)
    for row in M.curve_summary(df, "y", "p", ["g"]).collect():
        threshold, area = brute(y[g == row.g], p[g == row.g])
        assert row.LIMIAR_YOUDEN == threshold and row.AUC == pytest.approx(area)


def test_highest_threshold_wins_a_tie(spark):
    df = scored(spark, [(0, 1, 0.9), (0, 0, 0.8), (0, 1, 0.7), (0, 0, 0.1)])
    assert M.youden_threshold(df, "y", "p").first().LIMIAR_YOUDEN == 0.9


def test_one_class_has_no_threshold(spark):
    row = M.curve_summary(scored(spark, [(0, 1, 0.2), (0, 1, 0.4)]), "y", "p").first()
    assert row.LIMIAR_YOUDEN is None and row.AUC is None


def test_roc_points_run_from_origin_to_one(spark):
    df = scored(spark, [(0, 1, 0.9), (0, 0, 0.9), (0, 1, 0.2), (0, 0, 0.1)])
    points = sorted((r.fpr, r.tpr) for r in M.roc_points(df, "y", "p").collect())
    assert points == [(0.0, 0.0), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]


def test_rates_without_predictions_or_negatives(spark):
    df = scored(spark, [(0, 1, 0.1), (0, 1, 0.2)])
    row = M.with_rates(M.confusion(df, "y", (F.col("p") >= 0.5).cast("int"))).first()
    assert (row.VP, row.FN, row.PRECISAO, row.SENSIBILIDADE, row.F1_SCORE) == (0, 2, 0.0, 0.0, 0.0)
    assert row.ESPECIFICIDADE is None and row.ACURACIA == 0.0


def test_fold_summary(spark):
    columns = ", ".join(f"{m} double" for m in M.METRICS)
    df = spark.createDataFrame([(0.5,) * 6, (0.7,) * 6], columns)
    row = M.fold_summary(df).first()
    assert row.AUC_MEDIA_FOLDS == pytest.approx(0.6)
    assert row.F1_SCORE_MEDIA_DP == "0.600 ± 0.141"


def test_best_model(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", None)], "MODELO string, AUC double")
    assert M.best_model(df).first().MODELO == "b"
