import numpy as np
import pytest
from pyspark.sql import functions as F

from salmoura import names as N
from salmoura.operators import charts as G, hull as H
from salmoura.operators.scoring import LogisticModel

MODEL = LogisticModel(("SALINIDADE", "RELACAO_BA_SR"), (1.0, 0.0), (1.0, 1.0), (1.0, -1.0), 0.0)


def points(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "x double, y double")


def corners(spark, rows, parts=5):
    return [(r.x, r.y) for r in H.convex_hull(points(spark, rows).repartition(parts)).orderBy("pos").collect()]


def test_hull_of_a_square(spark):
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    inner = [(1, 1), (1, 0), (0.5, 1.5), (2, 1), (0, 0)]
    assert corners(spark, square + inner) == square


def test_hull_of_many_points(spark):
    rng = np.random.default_rng(0)
    cloud = rng.normal(size=(5_000, 2))
    found = corners(spark, cloud.tolist(), 7)
    sides = list(zip(found, found[1:] + found[:1]))
    for (ax, ay), (bx, by) in sides:      # every point on or left of every side
        cross = (bx - ax) * (cloud[:, 1] - ay) - (by - ay) * (cloud[:, 0] - ax)
        assert cross.min() > -1e-9
    assert set(found) <= {tuple(p) for p in cloud.tolist()}


def test_hull_of_a_circle_stays_spread_out(spark):
    """100,000 corners: all are found, in order, and no task holds more than a few sides' worth."""
    n = 100_000
    df = spark.range(n).repartition(8).select(
        F.cos(F.col("id") * (2 * np.pi / n)).alias("x"), F.sin(F.col("id") * (2 * np.pi / n)).alias("y")
    )
    hull = H.convex_hull(df)
    rows = np.array([tuple(r) for r in hull.orderBy("pos").select("x", "y").collect()])
    assert len(rows) >= n - n // 1000      # neighbours are nearly in line: rounding hides a few
    angle = np.unwrap(np.arctan2(rows[:, 1], rows[:, 0]))
    assert (np.diff(angle) > 0).all() and angle[-1] - angle[0] < 2 * np.pi
    assert [r.pos for r in hull.select("pos").orderBy("pos").limit(3).collect()] == [0, 1, 2]
    tests = spark.createDataFrame([(0.0, 0.0), (0.99, 0.0), (1.01, 0.0), (0.7, 0.72), (-1.0, 0.0), (None, 0.0)], "a double, b double")
    marked = H.mark_inside(tests, F.col("a"), F.col("b"), hull, "dentro")
    got = {r.a: r.dentro for r in marked.collect()}
    assert got == {0.0: True, 0.99: True, 1.01: False, 0.7: False, -1.0: True, None: False}


def test_position_of_missing_and_equal_scores(spark):
    rows = [(f"k{i:03}", 1, None if i % 10 == 0 else 0.5 if i % 2 else i / 100, 1) for i in range(100)]
    df = spark.createDataFrame(rows, f"`{N.PLATFORM}` string, TEM_NORM int, PROB_NORM double, CLASSE_PREVISTA int")
    got = {r[N.PLATFORM]: r.POSICAO for r in G.regression_result(df.repartition(7)).collect()}
    ordered = sorted(rows, key=lambda r: (r[2] is None, r[2] or 0.0, r[0]))
    assert got == {r[0]: i for i, r in enumerate(ordered)}


@pytest.mark.parametrize("rows", [[], [(0, 0), (1, 1)], [(0, 0), (1, 1), (2, 2), (3, 3)], [(1, 1)] * 4])
def test_no_hull_without_area(spark, rows):
    df = points(spark, rows or [(0, 0)]).limit(len(rows))
    assert H.convex_hull(df).count() == 0


ANALYSIS = (
    f"`{N.PLATFORM}` string, TEM_NORM int, TEM_OLEOSA int, MEDIA_BSW_PLAT double, "
    "MEDIANA_BSW_PLAT double, MEDIANA_SALINIDADE_PLAT double, MEDIANA_BARIO_PLAT double, "
    "MEDIANA_ESTRONCIO_PLAT double, RELACAO_BARIO_ESTRONCIO double, PROB_NORM double, "
    "MASSA_CLASSIFICADA_KG double, TIPO_MASSA string"
)


def row(name, norm, x, y, oily=0, bsw=50.0, prob=0.5, mass=1.0):
    return (name, norm, oily, bsw, bsw, 10.0, x, y, x / y, prob, mass, "t")


@pytest.fixture
def analysis(spark):
    return spark.createDataFrame([
        row("n1", 1, 1.0, 1.0, bsw=30.0), row("n2", 1, 100.0, 1.0), row("n3", 1, 100.0, 100.0),
        row("n4", 1, 1.0, 100.0, mass=-3.0), row("in", 0, 10.0, 10.0, oily=1, bsw=10.0),
        row("edge", 0, 1.0, 10.0, oily=1), row("out", 0, 1000.0, 10.0),
        row("unscored", 0, 1000.0, 10.0, prob=None),
    ], ANALYSIS)


def test_similar_platforms(analysis):
    marked = {r[N.PLATFORM]: r.PERFIL_SEMELHANTE for r in H.mark_similar(
        analysis, "MEDIANA_BARIO_PLAT", "MEDIANA_ESTRONCIO_PLAT").collect()}
    assert marked == {"in": True, "edge": True, "out": False, "unscored": False}
    pairs = {r.PAR for r in H.similar_platforms(analysis).collect()}
    assert pairs == {"BARIO_ESTRONCIO"}      # salinity is constant, so the others have no area


def test_nothing_is_similar_without_a_hull(analysis):
    few = analysis.filter("TEM_NORM = 0 OR `LOCAL DA GERAÇÃO` = 'n1'")
    marked = H.mark_similar(few, "MEDIANA_BARIO_PLAT", "MEDIANA_ESTRONCIO_PLAT")
    assert not any(r.PERFIL_SEMELHANTE for r in marked.collect())


def test_bsw_bars(analysis):
    bars = G.bsw_bars(analysis).collect()
    assert [r[N.PLATFORM] for r in bars][:2] == ["in", "n1"] and len(bars) == 6
    assert {r.REFERENCIA for r in bars} == {30.0}
    with pytest.raises(ValueError):
        G.bsw_bars(analysis, "outro")


def test_chemistry_3d(analysis):
    rows = {r[N.PLATFORM]: r for r in G.chemistry_3d(analysis).collect()}
    assert "unscored" not in rows and len(rows) == 7
    assert rows["n4"].MASSA_CLASSIFICADA_KG == 0.0 and rows["n4"].TAMANHO_MARCADOR == 6.0
    assert rows["n1"].SALINIDADE_Z == 0.0        # constant column is only centred
    assert np.mean([r.BSW_Z for r in rows.values()]) == pytest.approx(0, abs=1e-12)
    assert np.std([r.BSW_Z for r in rows.values()]) == pytest.approx(1)


def test_boxplots(spark):
    rng = np.random.default_rng(4)
    values = np.round(np.exp(rng.normal(0, 1, 1200)), 3)
    df = spark.createDataFrame(
        [row(str(i), int(i % 3 == 0), float(v), 1.0) for i, v in enumerate(values)], ANALYSIS
    )
    boxes = {(r.GRUPO, r.VARIAVEL): r for r in G.boxplots(df).collect()}
    assert len(boxes) == 8
    v = values[np.arange(1200) % 3 != 0]
    q1, q3 = np.quantile(v, [0.25, 0.75])
    box = boxes["Sem NORM", "BARIO"]
    assert (box.q1, box.mediana, box.q3) == pytest.approx((q1, np.median(v), q3))
    assert box.haste_superior == v[v <= q3 + 1.5 * (q3 - q1)].max()
    assert box.haste_inferior == v[v >= q1 - 1.5 * (q3 - q1)].min()
    with pytest.raises(ValueError):
        G.boxplots(df.select("TEM_NORM"))


def test_correlation(spark):
    df = spark.createDataFrame(
        [row(str(i), 1, float(i), float(100 - i)) for i in range(1, 20)], ANALYSIS
    )
    got = {(r.VARIAVEL_X, r.VARIAVEL_Y): r.CORRELACAO for r in G.chemical_correlation(df).collect()}
    assert got["Bário", "Estrôncio"] == pytest.approx(-1) == got["Estrôncio", "Bário"]
    assert got["Bário", "Bário"] == pytest.approx(1) and got["Bário", "Salinidade"] is None


def test_surface(spark):
    df = spark.createDataFrame([(1.0, 10.0), (100.0, 10.0)], "SALINIDADE double, RELACAO_BA_SR double")
    features = ["SALINIDADE", "RELACAO_BA_SR"]
    rows = G.probability_surface(df, MODEL, features, 5).orderBy("linha", "coluna").collect()
    assert len(rows) == 25
    x = np.log10([r.SALINIDADE for r in rows[:5]])
    np.testing.assert_allclose(x, np.linspace(-0.24, 2.24, 5))
    y = np.log10([r.RELACAO_BA_SR for r in rows[::5]])
    np.testing.assert_allclose(y, np.linspace(1 - 0.024, 1 + 0.024, 5))
    assert rows[0].PROB_NORM == pytest.approx(1 / (1 + np.exp(-(x[0] - 1 - y[0]))))
    with pytest.raises(ValueError, match="not supported"):
        G.feature_grid(df, ["SALINIDADE"])
    with pytest.raises(ValueError, match="positive"):
        G.feature_grid(df.filter("SALINIDADE < 0"), features)


def test_regression_result(spark):
    df = spark.createDataFrame(
        [("a", 1, 0.9, 1), ("b", 0, 0.1, 0), ("c", 0, 0.8, 1), ("d", 1, 0.1, 0), ("e", 1, 0.5, None)],
        f"`{N.PLATFORM}` string, TEM_NORM int, PROB_NORM double, CLASSE_PREVISTA int",
    )
    rows = sorted(G.regression_result(df).collect(), key=lambda r: r.POSICAO)
    assert [r[N.PLATFORM] for r in rows] == ["b", "d", "e", "c", "a"]
    assert [r.POSICAO for r in rows] == list(range(5))
    assert rows[2].RESULTADO == "Não classificado" and rows[1].RESULTADO == "Falso negativo"


def test_cards_need_predictions():
    with pytest.raises(ValueError):
        G.confusion_cards({})
