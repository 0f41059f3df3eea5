import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from salmoura import names as N
from salmoura.operators import modelling as L, scoring as S
from salmoura.session import materialise
from salmoura.sources import files


def sample(n=240, seed=3):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.35).astype(int)
    pdf = pd.DataFrame({
        N.PLATFORM: [f"P{i}" for i in range(n)], N.TARGET: y,
        "SALINIDADE": 10 ** rng.normal(4.5 + 0.2 * y, 0.3), "BARIO": 10 ** rng.normal(1 + 0.3 * y, 0.4),
        "ESTRONCIO": 10 ** rng.normal(2, 0.2, n),
    })
    pdf[N.RATIO] = pdf.BARIO / pdf.ESTRONCIO
    return pdf


@pytest.fixture(scope="module")
def data(spark):
    return materialise(spark.createDataFrame(sample()))


def newton(x, y):
    """Minimum of half the squared weights plus the summed balanced loss, intercept free."""
    z = (x - x.mean(0)) / x.std(0)
    n = len(y)
    s = np.where(y == 1, n / (2 * (y == 1).sum()), n / (2 * (y == 0).sum()))
    a, ridge = np.c_[z, np.ones(n)], np.diag([1.0] * z.shape[1] + [0.0])
    b = np.zeros(a.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-a @ b))
        b -= np.linalg.solve((a * (s * q * (1 - q))[:, None]).T @ a + ridge, a.T @ (s * (q - y)) + ridge @ b)
    return b, 1 / (1 + np.exp(-a @ b))


def test_fit_matches_newton(spark, data):
    pdf = sample()
    fitted = L.train_final(data)
    weights, p = newton(np.log10(pdf[N.FEATURES].to_numpy()), pdf[N.TARGET].to_numpy())
    np.testing.assert_allclose([*fitted.numbers.weights, fitted.numbers.intercept], weights, atol=1e-9)
    scored = S.score_batch(data, fitted.numbers).toPandas().set_index(N.PLATFORM)
    np.testing.assert_allclose(scored.loc[pdf[N.PLATFORM], "PROB_NORM"], p, atol=1e-9)
    table = L.coefficients(spark, fitted.numbers).collect()
    assert [r.VARIAVEL for r in table] == N.FEATURES
    assert table[1].ODDS_RATIO == pytest.approx(np.exp(table[1].COEFICIENTE_PADRONIZADO))


def test_saved_model_scores_alike(spark, data, tmp_path):
    fitted = L.train_final(data)
    files.save_model(fitted.pipeline, str(tmp_path / "model"))
    rows = data.unionByName(spark.createDataFrame(
        [("zero", 0, 0.0, 1.0, 1.0, 1.0), ("null", 0, None, 1.0, 0.0, 1.0)], data.schema
    ))
    loaded = files.load_model(str(tmp_path / "model"))
    a, b = (
        {r[N.PLATFORM]: r for r in S.score_batch(rows, m).collect()} for m in (fitted.numbers, loaded)
    )
    assert set(a) == set(b) and len(a) == 242
    for k, row in a.items():
        assert b[k].PREDICAO_NORM == row.PREDICAO_NORM
        if row.PROB_NORM is None:
            assert b[k].PROB_NORM is None
        else:
            assert b[k].PROB_NORM == pytest.approx(row.PROB_NORM, rel=1e-12)
    assert a["zero"].PROB_NORM is None and a["zero"].PREDICAO_NORM is None
    assert a["null"].RELACAO_BA_SR is None


def test_folds_are_balanced_and_stable(spark, data):
    folded = L.assign_folds(data, 5)
    sizes = folded.groupBy(N.TARGET, "FOLD").count().toPandas()
    spread = sizes.groupby(N.TARGET)["count"].agg(["min", "max"])
    assert (spread["max"] - spread["min"]).max() <= 1 and len(sizes) == 10
    again = L.assign_folds(data.repartition(7), 5)
    assert folded.select(N.col(N.PLATFORM), "FOLD").exceptAll(again.select(N.col(N.PLATFORM), "FOLD")).isEmpty()


def test_evaluate_against_numpy(spark, data):
    result = L.evaluate(data, N.FEATURES, 4)
    pdf = result.predictions.toPandas()
    for k in range(4):
        train, held = pdf[pdf.FOLD != k], pdf[pdf.FOLD == k]
        x = np.log10(train[N.FEATURES].to_numpy())
        b, _ = newton(x, train[N.TARGET].to_numpy())
        z = (np.log10(held[N.FEATURES].to_numpy()) - x.mean(0)) / x.std(0)
        np.testing.assert_allclose(held.PROB_NORM, 1 / (1 + np.exp(-(z @ b[:-1] + b[-1]))), atol=1e-9)
    pooled, folds = result.pooled.first(), result.per_fold.collect()
    assert pooled.VP + pooled.FP + pooled.VN + pooled.FN == 240 == sum(r.N_TESTE for r in folds)
    assert all(r.N_TREINO + r.N_TESTE == 240 for r in folds)
    y, p = pdf[N.TARGET].to_numpy(), pdf.PROB_NORM.to_numpy()
    wins = (p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])
    assert pooled.AUC == pytest.approx(wins.mean())
    assert (pdf.CLASSE_PREVISTA == (p >= result.threshold)).all()


def test_given_folds_are_kept(spark, data):
    given = data.withColumn("FOLD", (F.crc32(N.col(N.PLATFORM)) % 3).cast("int"))
    prepared, folds = L.with_folds(given, 6)
    assert folds == [0, 1, 2] and prepared.select("FOLD").exceptAll(given.select("FOLD")).isEmpty()


def test_compare_models(spark, data):
    table, results = L.compare_models(data, 3)
    rows = table.collect()
    assert [r.AUC for r in rows] == sorted((r.AUC for r in rows), reverse=True)
    assert {r.MODELO: r.N_VARIAVEIS for r in rows} == {k: len(v) for k, v in L.MODELS.items()}
    assert set(results) == set(L.MODELS) and "±" in rows[0].AUC_MEDIA_DP


def test_all_fits_of_a_comparison_together_equal_each_alone(spark, data):
    prepared, folds = L.with_folds(data, 3)
    lists = list(L.MODELS.values())
    for features, together in zip(lists, L.fit_folds(prepared, lists, folds)):
        for k in folds:
            alone = L.fit(prepared.filter(F.col("FOLD") != k), features).numbers
            np.testing.assert_allclose(
                [*together[k].weights, together[k].intercept], [*alone.weights, alone.intercept], atol=1e-10)


def test_extreme_tables_converge(spark):
    """Separated classes, a constant feature, a rare class with an outlier: steps are halved where they overshoot."""
    rng = np.random.default_rng(8)
    for kind in ("separated", "constant", "rare"):
        y = (np.arange(300) % (60 if kind == "rare" else 2) == 0).astype(int)
        x = 10 ** (rng.normal(size=(300, 2)) * 0.1 + (4 * y[:, None] if kind == "separated" else 0))
        if kind == "constant":
            x[:, 1] = 3.0
        if kind == "rare":
            x[0] = (1e30, 1e-30)
        df = materialise(spark.createDataFrame(pd.DataFrame({N.TARGET: y, "a": x[:, 0], "b": x[:, 1]})))
        fitted = L.fit(df, ["a", "b"]).numbers
        z = np.log10(x) - np.array(fitted.means)
        z /= np.array(fitted.deviations)
        n = len(y)
        s = np.where(y == 1, n / (2 * y.sum()), n / (2 * (1 - y).sum()))
        b = np.array([*fitted.weights, fitted.intercept])
        p = 1 / (1 + np.exp(-(np.c_[z, np.ones(n)] @ b)))
        gradient = np.c_[z, np.ones(n)].T @ (s * (p - y)) + np.array([1.0, 1.0, 0.0]) * b
        assert np.abs(gradient).max() < 1e-6


def test_guards(spark, data):
    with pytest.raises(ValueError, match="no valid rows"):
        L.evaluate(data.limit(0), N.FEATURES)
    with pytest.raises(ValueError, match="both classes"):
        L.evaluate(data.filter(f"{N.TARGET} = 1"), N.FEATURES)
    one = data.filter(f"{N.TARGET} = 1").limit(1).unionByName(data.filter(f"{N.TARGET} = 0"))
    with pytest.raises(ValueError, match="too few"):
        L.evaluate(one, N.FEATURES)


def test_model_table_keeps_complete_positive_rows(spark):
    schema = f"`{N.PLATFORM}` string, TEM_NORM int, " + ", ".join(f"{c} double" for c in L.MODEL_COLUMNS)
    df = spark.createDataFrame([
        ("a", 1, 100.0, 10.0, 1.0, 10.0), ("b", 1, 100.0, None, 1.0, 10.0),
        ("c", 0, 100.0, 0.0, 1.0, 0.0), ("d", 0, float("inf"), 1.0, 1.0, 1.0),
    ], schema)
    row, = L.model_table(df).collect()
    assert row[N.PLATFORM] == "a" and row.LOG_SALINIDADE == 2.0 and row.LOG_BARIO == 1.0


def test_requests(spark, data):
    numbers = L.train_final(data).numbers
    rows = data.select(N.col(N.PLATFORM), *N.FEATURES).limit(3).unionByName(
        spark.createDataFrame([("bad", -1.0, 1.0, 1.0)], f"`{N.PLATFORM}` string, SALINIDADE double, BARIO double, ESTRONCIO double")
    )
    answers, rejected = S.score_requests(rows, numbers)
    assert rejected.first()[N.PLATFORM] == "bad" and answers.count() == 3
    for r in answers.collect():
        assert r.PROB_SEM_NORM + r.PROB_COM_NORM == pytest.approx(1, abs=2e-4)
        assert r.PREDICAO_NORM == int(r.PROB_COM_NORM > 0.5)


def test_classes_must_be_zero_and_one(spark):
    def counts(*labels):
        return L.class_counts(spark.createDataFrame([(x,) for x in labels], "TEM_NORM int"))

    assert counts(0, 1, 1) == {0: 1, 1: 2}
    for wrong in ((0, 1, 2), (0, 1, None), (1, 1), ()):
        with pytest.raises(ValueError):
            counts(*wrong)


@pytest.mark.parametrize("fold", ["id % 2 * 2", "0", "id", "CASE WHEN id > 3 THEN NULL ELSE 1 END"])
def test_given_folds_are_checked(spark, fold):
    df = spark.range(150).selectExpr("cast(id % 2 AS int) AS TEM_NORM", f"{fold} AS FOLD")
    with pytest.raises(ValueError):
        L.with_folds(df, 3)
