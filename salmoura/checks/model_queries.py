"""Modelling, evaluation, scoring and chart tables over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from salmoura import names as N
from salmoura.checks import fits_sql as FS, proxies as P
from salmoura.checks.platform_queries import TEMPORAL_SQL, analysis, temporal
from salmoura.checks.registry import D, R, day, query, r, shown
from salmoura.operators import charts as G, hull as H, metrics as M, modelling as L, scoring as S
from salmoura.operators import temporal as T
from salmoura.operators.analysis import NEAREST
from salmoura.session import materialise, shared_folder
from salmoura.sources import files

# a model given by its numbers, so that SQL can score with it as well
GIVEN = S.LogisticModel(
    ("SALINIDADE", "BARIO", "ESTRONCIO"), (4.6, 1.5, 1.9), (0.05, 0.06, 0.01),
    (0.8, -0.5, 0.3), -0.2,
)
MARGIN_SQL = """(-0.2 + 0.8 * ((log10(sal) - 4.6) / 0.05) - 0.5 * ((log10(ba) - 1.5) / 0.06)
  + 0.3 * ((log10(sr) - 1.9) / 0.01))"""
PROB_SQL = f"1 / (1 + exp(-{MARGIN_SQL}))"
GIVEN_FOLDS = 4


def model_data(spark: SparkSession, d: str) -> DataFrame:
    return L.model_table(analysis(spark, d))


# ---- modelling ----


@query("m1_model_table", P.WITH_WINDOW + f"""
SELECT plat, tem_norm, {R('sal', 4)} AS sal, {R('ba')} AS ba, {R('sr')} AS sr, {R('ratio')} AS ratio,
  {R('log10(sal)')} AS log_sal, {R('log10(ba)')} AS log_ba, {R('log10(sr)')} AS log_sr,
  {R('log10(ratio)')} AS log_ratio FROM model""")
def _(spark, d):
    return shown(
        model_data(spark, d), plat=N.PLATFORM, tem_norm=N.TARGET, sal=r("SALINIDADE", 4),
        ba=r("BARIO"), sr=r("ESTRONCIO"), ratio=r(N.RATIO), log_sal=r("LOG_SALINIDADE"),
        log_ba=r("LOG_BARIO"), log_sr=r("LOG_ESTRONCIO"), log_ratio=r("LOG_RELACAO_BA_SR"),
    )


@query("m2_balanced_weight", f"""
SELECT doc_id, {R('count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY quality))')} AS peso
FROM labels""")
def _(spark, d):
    labels = P.table(spark, d, "labels").withColumnRenamed("quality", N.TARGET)
    weight = L.balanced_weight(L.class_counts(labels))
    return shown(labels, doc_id="doc_id", peso=r(weight))


@query("a23_class_counts", "SELECT quality AS classe, count(*) AS linhas FROM labels GROUP BY quality")
def _(spark, d):
    counts = L.class_counts(P.table(spark, d, "labels").withColumnRenamed("quality", N.TARGET))
    L.fold_count(counts, GIVEN_FOLDS)
    return spark.createDataFrame(sorted(counts.items()), "classe int, linhas long")


FINAL = FS.MODELS_SQL["Salinidade + Bário + Estrôncio"]
FINAL_SCORED = FS.with_final(FINAL) + f"""
SELECT plat, (p > 0.5)::INT AS predicao, {R('p', 4)} AS prob
FROM (SELECT plat, {FS.probability(FINAL)} AS p FROM model, f_fit)"""


@query("m3_m4_final_fit", FINAL_SCORED)
def _(spark, d):
    data = materialise(model_data(spark, d))
    scored = S.score_batch(data, L.train_final(data).numbers)
    return shown(scored, plat=N.PLATFORM, predicao="PREDICAO_NORM", prob=r("PROB_NORM", 4))


@query("m5_coefficients", FS.with_final(FINAL) + " UNION ALL ".join(
    f"SELECT '{v}' AS variavel, {R(f'b{j}', 4)} AS coeficiente, {R(f'exp(b{j})', 4)} AS odds FROM f_fit"
    for j, v in enumerate(N.FEATURES, 1)))
def _(spark, d):
    model = L.train_final(materialise(model_data(spark, d)))
    table = L.coefficients(spark, model.numbers)
    return shown(table, variavel="VARIAVEL", coeficiente=r("COEFICIENTE_PADRONIZADO", 4),
                 odds=r("ODDS_RATIO", 4))


@query("m6_stratified_folds", """
SELECT doc_id, quality AS classe, ((row_number() OVER (
  PARTITION BY quality ORDER BY md5(doc_id || '42')) - 1)
  % least(4, (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))))::INT + 1 AS fold
FROM labels""")
def _(spark, d):
    labels = P.table(spark, d, "labels").withColumns({
        N.TARGET: F.col("quality"), "chave": F.col("doc_id").cast("string")
    })
    folds = L.fold_count(L.class_counts(labels), GIVEN_FOLDS)
    return shown(L.assign_folds(labels, folds, "chave"), doc_id="doc_id", classe="quality",
                 fold="FOLD")


ONE_MODEL = {"e0": FINAL}


@query("m7_held_out_probability", FS.with_evaluation(ONE_MODEL, 6) + f"""
SELECT plat, fold::INT AS fold, {R('p', 4)} AS prob FROM e0_held""")
def _(spark, d):
    result = L.evaluate(model_data(spark, d), N.FEATURES, 6)
    return shown(result.predictions, plat=N.PLATFORM, fold="FOLD", prob=r("PROB_NORM", 4))


# ---- evaluation of given scores ----

CURVE_SQL = P.WITH_SCORES[:-1] + """, grouped AS (
  SELECT doc_id % 3 AS grupo, y, p FROM scores
), curve AS (
  SELECT grupo, p, sum(sum(y)) OVER above AS tp, sum(sum(1 - y)) OVER above AS fp,
    sum(sum(y)) OVER whole AS pos, sum(sum(1 - y)) OVER whole AS neg
  FROM grouped GROUP BY grupo, p
  WINDOW above AS (PARTITION BY grupo ORDER BY p DESC ROWS UNBOUNDED PRECEDING),
         whole AS (PARTITION BY grupo)
), rates AS (
  SELECT grupo, p, fp::DOUBLE / neg::DOUBLE AS fpr, tp::DOUBLE / pos::DOUBLE AS tpr FROM curve
)
"""


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    return P.scores(spark, d).withColumn("grupo", F.col("doc_id") % 3)


@query("m8_youden_threshold", CURVE_SQL + f"""
SELECT grupo, limiar, {R('j')} AS j FROM (SELECT grupo, p AS limiar, tpr - fpr AS j,
  row_number() OVER (PARTITION BY grupo ORDER BY tpr - fpr DESC, p DESC) AS rn FROM rates)
WHERE rn = 1""")
def _(spark, d):
    best = M.youden_threshold(_grouped(spark, d), "y", "p", ["grupo"])
    return shown(best, grupo="grupo", limiar="LIMIAR_YOUDEN", j=r("J_YOUDEN"))


@query("m9_roc_points", CURVE_SQL + f"""
SELECT grupo, p AS limiar, {R('fpr')} AS fpr, {R('tpr')} AS tpr FROM rates
UNION ALL SELECT DISTINCT grupo, NULL::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM grouped""")
def _(spark, d):
    points = M.roc_points(_grouped(spark, d), "y", "p", ["grupo"])
    return shown(points, grupo="grupo", limiar="limiar", fpr=r("fpr"), tpr=r("tpr"))


AUC_SQL = """areas AS (
  SELECT grupo, (sum(rank_p) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0)
    / (sum(y) * sum(1 - y)) AS auc
  FROM (SELECT grupo, y, rank() OVER (PARTITION BY grupo ORDER BY p)
      + (count(*) OVER (PARTITION BY grupo, p) - 1) / 2.0 AS rank_p FROM grouped)
  GROUP BY grupo
)
"""


@query("m10_auc", CURVE_SQL[:-1] + f", {AUC_SQL} SELECT grupo, {R('auc')} AS auc FROM areas")
def _(spark, d):
    return shown(M.auc(_grouped(spark, d), "y", "p", ["grupo"]), grupo="grupo", auc=r("AUC"))


COUNTS_SQL = """counts AS (
  SELECT grupo, count(*) FILTER (WHERE y = 1 AND p >= 0.9) AS vp,
    count(*) FILTER (WHERE y = 0 AND p >= 0.9) AS fp,
    count(*) FILTER (WHERE y = 0 AND p < 0.9) AS vn,
    count(*) FILTER (WHERE y = 1 AND p < 0.9) AS fn
  FROM grouped GROUP BY grupo
), measures AS (
  SELECT *, (vp + vn)::DOUBLE / (vp + fp + vn + fn) AS acuracia,
    CASE WHEN vp + fp > 0 THEN vp::DOUBLE / (vp + fp) ELSE 0 END AS precisao,
    CASE WHEN vp + fn > 0 THEN vp::DOUBLE / (vp + fn) ELSE 0 END AS sensibilidade,
    CASE WHEN vn + fp > 0 THEN vn::DOUBLE / (vn + fp) END AS especificidade,
    CASE WHEN 2 * vp + fp + fn > 0 THEN 2 * vp::DOUBLE / (2 * vp + fp + fn) ELSE 0 END AS f1
  FROM counts
)
"""
MEASURES_OUT = ", ".join(
    f"{R(m)} AS {m}" for m in ("acuracia", "precisao", "sensibilidade", "especificidade", "f1")
)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(_grouped(spark, d), "y", (F.col("p") >= 0.9).cast("int"), ["grupo"])


def _measures() -> dict:
    return dict(acuracia=r("ACURACIA"), precisao=r("PRECISAO"), sensibilidade=r("SENSIBILIDADE"),
                especificidade=r("ESPECIFICIDADE"), f1=r("F1_SCORE"))


@query("m11_confusion_counts",
       CURVE_SQL[:-1] + f", {COUNTS_SQL} SELECT grupo, vp, fp, vn, fn FROM counts")
def _(spark, d):
    return shown(_counts(spark, d), grupo="grupo", vp="VP", fp="FP", vn="VN", fn="FN")


@query("m12_rates", CURVE_SQL[:-1] + f", {COUNTS_SQL} SELECT grupo, {MEASURES_OUT} FROM measures")
def _(spark, d):
    return shown(M.with_rates(_counts(spark, d)), grupo="grupo", **_measures())


@query("m13_specificity", CURVE_SQL[:-1] + f""", {COUNTS_SQL}
SELECT grupo, {R('especificidade')} AS especificidade FROM measures""")
def _(spark, d):
    found = M.specificity(
        _grouped(spark, d), "y", (F.col("p") >= 0.9).cast("int"), ["grupo"]
    )
    return shown(found, grupo="grupo", especificidade=r("ESPECIFICIDADE"))


def _per_group(spark: SparkSession, d: str) -> DataFrame:
    areas = M.auc(_grouped(spark, d), "y", "p", ["grupo"])
    return M.with_rates(_counts(spark, d)).join(areas, "grupo")


SUMMARY_SQL = CURVE_SQL[:-1] + f", {AUC_SQL}, {COUNTS_SQL}, "


@query("m14_fold_summary", SUMMARY_SQL[:-2] + f"""
SELECT {R('avg(auc)')} AS auc_media, {R('stddev_samp(auc)')} AS auc_dp, {R('avg(f1)')} AS f1_media,
  {R('stddev_samp(f1)')} AS f1_dp, {R('avg(especificidade)')} AS esp_media,
  format('{{:.3f}} ± {{:.3f}}', avg(acuracia), stddev_samp(acuracia)) AS acuracia
FROM measures JOIN areas USING (grupo)""")
def _(spark, d):
    return shown(
        M.fold_summary(_per_group(spark, d)), auc_media=r("AUC_MEDIA_FOLDS"),
        auc_dp=r("AUC_DP_FOLDS"), f1_media=r("F1_SCORE_MEDIA_FOLDS"), f1_dp=r("F1_SCORE_DP_FOLDS"),
        esp_media=r("ESPECIFICIDADE_MEDIA_FOLDS"), acuracia="ACURACIA_MEDIA_DP",
    )


@query("m15_evaluate", FS.with_evaluation(ONE_MODEL, 6) + f"""
SELECT fold::INT AS FOLD, (SELECT count(*) FROM e0_held) - n AS N_TREINO, n AS N_TESTE, {FS.ROUNDED}, {FS.COUNTS}
FROM e0_folds""")
def _(spark, d):
    result = L.evaluate(model_data(spark, d), N.FEATURES, 6)
    return result.per_fold.select(
        "FOLD", "N_TREINO", "N_TESTE", *[r(m, 4).alias(m) for m in M.METRICS], *M.COUNTS
    )


@query("m16_compare_models", FS.with_evaluation(FS.MODELS_SQL, 6) + " UNION ALL ".join(f"""
SELECT '{name}' AS MODELO, {len(f)} AS N_VARIAVEIS, {FS.ROUNDED}, {FS.COUNTS}, {R('limiar', 4)} AS LIMIAR_YOUDEN,
  {FS.spread(i)} FROM e{i}_all""" for i, (name, f) in enumerate(FS.MODELS_SQL.items())))
def _(spark, d):
    table, _ = L.compare_models(model_data(spark, d), 6)
    return table.select(
        "MODELO", "N_VARIAVEIS", *[r(m, 4).alias(m) for m in M.METRICS], *M.COUNTS,
        r("LIMIAR_YOUDEN", 4).alias("LIMIAR_YOUDEN"), *[f"{m}_MEDIA_DP" for m in M.METRICS],
    )


@query("j8_probability_lookup", P.WITH_WINDOW + f"""
SELECT a.plat, {R(PROB_SQL)} AS prob FROM analysis a LEFT JOIN model m ON a.plat = m.plat""")
def _(spark, d):
    table = materialise(analysis(spark, d))  # a stage in the jobs; both sides of the join read it
    scored = L.model_table(table).withColumn("PROB_NORM", GIVEN.probability())
    return shown(L.with_probability(table, scored), plat=N.PLATFORM, prob=r("PROB_NORM"))


RANKED_SQL = CURVE_SQL[:-1] + f", {AUC_SQL}"


@query("w7_best_group", RANKED_SQL + f"""
SELECT 'g' || grupo AS modelo, {R('auc')} AS auc FROM areas ORDER BY auc DESC, 1 LIMIT 1""")
def _(spark, d):
    areas = M.auc(_grouped(spark, d), "y", "p", ["grupo"])
    named = areas.withColumn("MODELO", F.concat(F.lit("g"), F.col("grupo")))
    return shown(M.best_model(named), modelo="MODELO", auc=r("AUC"))


@query("w8_g12_metric_heatmap", SUMMARY_SQL[:-2] + f"""
SELECT 'g' || grupo AS modelo, {R('auc')} AS auc, {MEASURES_OUT}
FROM measures JOIN areas USING (grupo) ORDER BY precisao DESC""")
def _(spark, d):
    named = _per_group(spark, d).withColumn("MODELO", F.concat(F.lit("g"), F.col("grupo")))
    return shown(G.metric_heatmap(named), modelo="MODELO", auc=r("AUC"), **_measures())


# ---- scoring ----

SCORED_OUT = f"""plat, {D('mes')} AS mes, {R('ratio')} AS ratio, (prob > 0.5)::INT AS predicao,
  {R('prob')} AS prob"""


@query("m17_score_batch", TEMPORAL_SQL + f"""
SELECT {SCORED_OUT} FROM (SELECT *, {PROB_SQL} AS prob FROM temporal WHERE elegivel)""")
def _(spark, d):
    scored = S.score_batch(T.scoring_input(temporal(spark, d), ordered=False), GIVEN)
    return shown(scored, plat=N.SITE, mes=day(N.MONTH), ratio=r(N.RATIO),
                 predicao="PREDICAO_NORM", prob=r("PROB_NORM"))


@query("m18_score_requests", f"""
WITH pedidos AS (SELECT l_orderkey * 10 + l_linenumber AS doc, l_extendedprice AS sal,
  l_quantity - 2 AS ba, 80 + l_discount AS sr FROM lineitem)
SELECT doc, (p > 0.5)::INT AS predicao, round(1 - p, 4) + 0.0 AS sem, round(p, 4) + 0.0 AS com, NULL::VARCHAR AS motivo
FROM (SELECT doc, {PROB_SQL} AS p FROM pedidos WHERE sal > 0 AND ba > 0 AND sr > 0)
UNION ALL
SELECT doc, NULL, NULL, NULL, CASE WHEN sal > 0 THEN CASE WHEN ba > 0 THEN 'estroncio' ELSE 'bario' END ELSE 'salinidade' END
  || ' deve ser um valor positivo e maior que zero'
FROM pedidos WHERE NOT (sal > 0 AND ba > 0 AND sr > 0)""")
def _(spark, d):
    requests = shown(
        P.table(spark, d, "lineitem"), doc=F.col("l_orderkey") * 10 + F.col("l_linenumber"),
        SALINIDADE="l_extendedprice", BARIO=F.col("l_quantity") - 2,
        ESTRONCIO=80 + F.col("l_discount"),
    )
    answers, rejected = S.score_requests(requests, GIVEN)
    both = answers.unionByName(rejected, allowMissingColumns=True)
    return shown(both, doc="doc", predicao="PREDICAO_NORM", sem="PROB_SEM_NORM",
                 com="PROB_COM_NORM", motivo="MOTIVO_REJEICAO")


@query("s10_saved_model", FINAL_SCORED)
def _(spark, d):
    data = materialise(model_data(spark, d))
    path = f"{shared_folder(spark)}/modelo_norm"
    files.save_model(L.train_final(data).pipeline, path)
    scored = S.score_batch(data, files.load_model(path))
    return shown(scored, plat=N.PLATFORM, predicao="PREDICAO_NORM", prob=r("PROB_NORM", 4))


LIMITS_SQL = """limits AS (
  SELECT a0 - 0.12 * greatest(b0 - a0, 0.2) AS low0, b0 + 0.12 * greatest(b0 - a0, 0.2) AS high0,
         a1 - 0.12 * greatest(b1 - a1, 0.2) AS low1, b1 + 0.12 * greatest(b1 - a1, 0.2) AS high1, fixo
  FROM (SELECT log10(min(sal)) AS a0, log10(max(sal)) AS b0, log10(min(ba)) AS a1,
               log10(max(ba)) AS b1, median(sr) AS fixo FROM model)
)"""
GRID_SQL = f"""{LIMITS_SQL}, grid AS (
  SELECT i AS coluna, j AS linha, pow(10, low0 + i * (high0 - low0) / 239) AS sal,
         pow(10, low1 + j * (high1 - low1) / 239) AS ba, fixo AS sr
  FROM limits, (SELECT unnest(range(240))::INT AS i), (SELECT unnest(range(240))::INT AS j)
)"""


@query("a22_log_limits", P.WITH_WINDOW[:-1] + f""", {LIMITS_SQL}
SELECT {R('low0')} AS low0, {R('high0')} AS high0, {R('low1')} AS low1, {R('high1')} AS high1
FROM limits""")
def _(spark, d):
    limits = G.log_limits(model_data(spark, d), ["SALINIDADE", "BARIO"])
    return limits.select(*[r(c).alias(c) for c in limits.columns])


@query("j10_feature_grid", P.WITH_WINDOW[:-1] + f""", {GRID_SQL}
SELECT coluna, linha::BIGINT AS linha, {R('sal', 3)} AS sal, {R('ba', 4)} AS ba, {R('sr', 4)} AS sr
FROM grid""")
def _(spark, d):
    grid = G.feature_grid(materialise(model_data(spark, d)), N.FEATURES)
    return shown(grid, coluna="coluna", linha=F.col("linha").cast("long"),
                 sal=r("SALINIDADE", 3), ba=r("BARIO", 4), sr=r("ESTRONCIO", 4))


@query("m19_g11_probability_surface", P.WITH_WINDOW[:-1] + f""", {GRID_SQL}
SELECT coluna, linha::BIGINT AS linha, {R(PROB_SQL)} AS prob FROM grid""")
def _(spark, d):
    surface = G.probability_surface(materialise(model_data(spark, d)), GIVEN, N.FEATURES)
    return shown(surface, coluna="coluna", linha=F.col("linha").cast("long"), prob=r("PROB_NORM"))


# ---- chart tables ----

SCORED_ANALYSIS_SQL = P.WITH_WINDOW[:-1] + f""", scored AS (
  SELECT a.*, {PROB_SQL} AS prob FROM analysis a LEFT JOIN
    (SELECT plat, sal, ba, sr FROM model) m ON a.plat = m.plat
)"""


def scored_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Analysis table with a probability for the platforms that have all chemistry."""
    table = analysis(spark, d)
    probability = S.LogisticModel(
        ("MEDIANA_SALINIDADE_PLAT", "MEDIANA_BARIO_PLAT", "MEDIANA_ESTRONCIO_PLAT"),
        GIVEN.means, GIVEN.deviations, GIVEN.weights, GIVEN.intercept,
    ).probability()
    usable = F.least(
        "MEDIANA_SALINIDADE_PLAT", "MEDIANA_BARIO_PLAT", "MEDIANA_ESTRONCIO_PLAT", "RELACAO_BARIO_ESTRONCIO"
    ) > 0
    return table.withColumn("PROB_NORM", F.when(usable, probability))


@query("g1_scatter_matrix", P.WITH_NEAREST + f"""
SELECT plat, CASE tem_norm WHEN 1 THEN 'Com NORM' ELSE 'Sem NORM' END AS classe,
  {R('mediana_bario')} AS ba, {R('mediana_estroncio')} AS sr, {R('mediana_salinidade', 4)} AS sal,
  {R('ba_sr')} AS ratio FROM analysis
WHERE mediana_bario IS NOT NULL AND mediana_estroncio IS NOT NULL
  AND mediana_salinidade IS NOT NULL AND ba_sr IS NOT NULL""")
def _(spark, d):
    rows = G.scatter_matrix(analysis(spark, d, NEAREST))
    return shown(rows, plat=N.PLATFORM, classe="Classificação", ba=r("MEDIANA_BARIO_PLAT"),
                 sr=r("MEDIANA_ESTRONCIO_PLAT"), sal=r("MEDIANA_SALINIDADE_PLAT", 4),
                 ratio=r("RELACAO_BARIO_ESTRONCIO"))


def _z(c: str) -> str:
    return R(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()")


@query("g2_chemistry_3d", SCORED_ANALYSIS_SQL + f"""
SELECT plat, CASE tem_norm WHEN 1 THEN 'Com NORM' ELSE 'Sem NORM' END AS norm, {R('prob')} AS prob,
  {R('massa_class / 1000')} AS massa_t,
  {R('6 + 22 * ln(1 + massa_class) / greatest(max(ln(1 + massa_class)) OVER (), 1)')} AS tamanho,
  {_z('mediana_salinidade')} AS sal_z, {_z('ba_sr')} AS ratio_z, {_z('media_bsw')} AS bsw_z
FROM scored WHERE prob IS NOT NULL AND mediana_salinidade IS NOT NULL AND ba_sr IS NOT NULL""")
def _(spark, d):
    rows = G.chemistry_3d(materialise(scored_analysis(spark, d)))
    return shown(rows, plat=N.PLATFORM, norm="NORM", prob=r("PROB_NORM"),
                 massa_t=r("MASSA_CLASSIFICADA_T"), tamanho=r("TAMANHO_MARCADOR"),
                 sal_z=r("SALINIDADE_Z"), ratio_z=r("RELACAO_BA_SR_Z"), bsw_z=r("BSW_Z"))


@query("w5_z_scores", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {_z('l_quantity')} AS a, {_z('l_extendedprice')} AS b,
  0.0::DOUBLE AS c FROM lineitem""")
def _(spark, d):
    lines = P.table(spark, d, "lineitem").withColumn("fixo", F.lit(3.0))
    rows = G.z_scores(lines, {"l_quantity": "a", "l_extendedprice": "b", "fixo": "c"})
    return shown(rows, l_orderkey="l_orderkey", l_linenumber="l_linenumber",
                 l_partkey="l_partkey", a=r("a"), b=r("b"), c="c")


BOX_SQL = """long AS (UNPIVOT (SELECT CASE tem_norm WHEN 1 THEN 'Com NORM' ELSE 'Sem NORM' END AS grupo,
    sal AS "SALINIDADE", ba AS "BARIO", sr AS "ESTRONCIO", ratio AS "RELACAO_BA_SR" FROM model)
  ON "SALINIDADE", "BARIO", "ESTRONCIO", "RELACAO_BA_SR" INTO NAME variavel VALUE valor
), boxes AS (
  SELECT grupo, variavel, count(*) AS n, quantile_cont(valor, 0.25) AS q1, median(valor) AS mediana,
    quantile_cont(valor, 0.75) AS q3 FROM long GROUP BY grupo, variavel
)"""


@query("a21_g3_boxplots", P.WITH_WINDOW[:-1] + f""", {BOX_SQL}
SELECT grupo, variavel, n, {R('q1', 4)} AS q1, {R('mediana', 4)} AS mediana, {R('q3', 4)} AS q3,
  {R('least(min(valor) FILTER (WHERE valor >= q1 - 1.5 * (q3 - q1)), q1)', 4)} AS inferior,
  {R('greatest(max(valor) FILTER (WHERE valor <= q3 + 1.5 * (q3 - q1)), q3)', 4)} AS superior
FROM long JOIN boxes USING (grupo, variavel) GROUP BY grupo, variavel, n, q1, mediana, q3""")
def _(spark, d):
    boxes = G.boxplots(materialise(analysis(spark, d)))
    return shown(boxes, grupo="GRUPO", variavel="VARIAVEL", n="n", q1=r("q1", 4),
                 mediana=r("mediana", 4), q3=r("q3", 4), inferior=r("haste_inferior", 4),
                 superior=r("haste_superior", 4))


@query("a19_chemical_correlation", P.WITH_WINDOW[:-1] + """, vars AS (
  SELECT unnest(['Estrôncio', 'Salinidade', 'Bário']) AS v
), valores AS (
  SELECT plat, v, CASE v WHEN 'Estrôncio' THEN mediana_estroncio WHEN 'Salinidade'
    THEN mediana_salinidade ELSE mediana_bario END AS x FROM analysis, vars
), pares AS (
  SELECT a.v AS va, b.v AS vb, a.x AS xa, b.x AS xb FROM valores a JOIN valores b
    ON a.plat = b.plat WHERE a.x IS NOT NULL AND b.x IS NOT NULL
), postos AS (
  SELECT va, vb, rank() OVER (PARTITION BY va, vb ORDER BY xa)
      + (count(*) OVER (PARTITION BY va, vb, xa) - 1) / 2.0 AS ra,
    rank() OVER (PARTITION BY va, vb ORDER BY xb)
      + (count(*) OVER (PARTITION BY va, vb, xb) - 1) / 2.0 AS rb FROM pares
)""" + f"""
SELECT va AS variavel_x, vb AS variavel_y, {R('corr(ra, rb)')} AS correlacao
FROM postos GROUP BY va, vb""")
def _(spark, d):
    table = G.chemical_correlation(materialise(analysis(spark, d)))
    return shown(table, variavel_x="VARIAVEL_X", variavel_y="VARIAVEL_Y",
                 correlacao=r("CORRELACAO"))


@query("a19_spearman_with_ties", f"""
SELECT {R('corr(ra, rb)')} AS correlacao FROM (
  SELECT rank() OVER (ORDER BY l_quantity)
      + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS ra,
    rank() OVER (ORDER BY l_extendedprice)
      + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rb FROM lineitem)""")
def _(spark, d):
    lines = P.table(spark, d, "lineitem")
    return shown(G.spearman(lines, "l_quantity", "l_extendedprice"), correlacao=r("corr"))


@query("g4_similarity_rows", P.WITH_NEAREST + f"""
SELECT plat, tem_norm, {R('media_bsw')} AS bsw, {R('mediana_bario')} AS x,
  {R('mediana_estroncio')} AS y FROM analysis WHERE mediana_bario > 0 AND mediana_estroncio > 0""")
def _(spark, d):
    x, y = H.SIMILARITY_PAIRS["BARIO_ESTRONCIO"]
    rows = H.similarity_rows(analysis(spark, d, NEAREST), x, y)
    return shown(rows, plat=N.PLATFORM, tem_norm=N.TARGET, bsw=r("MEDIA_BSW_PLAT"), x=r(x), y=r(y))


def hull_sides_sql(points: str) -> str:
    """``sides`` of the hull of a table of x and y: pairs with all other points on the left."""
    return f"""outer_points AS MATERIALIZED (
  SELECT x, min(y) AS y FROM {points} GROUP BY x UNION SELECT x, max(y) FROM {points} GROUP BY x
), sides AS MATERIALIZED (
  SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM outer_points a, outer_points b
  WHERE (a.x <> b.x OR a.y <> b.y) AND NOT EXISTS (SELECT 1 FROM outer_points c
    WHERE (c.x <> a.x OR c.y <> a.y) AND (c.x <> b.x OR c.y <> b.y)
      AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) <= 0))"""


@query("g5_convex_hull", f"""
WITH points AS (SELECT log10(l_quantity) AS x, log10(l_extendedprice) AS y FROM lineitem),
{hull_sides_sql('points')}, turned AS (
  SELECT *, atan2(ay - avg(ay) OVER (), ax - avg(ax) OVER ()) AS angle FROM sides
), first AS (SELECT angle AS zero FROM turned ORDER BY ax, ay LIMIT 1)
SELECT row_number() OVER (ORDER BY (angle - zero + 4 * pi()) % (2 * pi())) - 1 AS pos,
  {R('ax')} AS x, {R('ay')} AS y FROM turned, first""")
def _(spark, d):
    points = H.log_points(P.table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return shown(H.convex_hull(points), pos="pos", x=r("x"), y=r("y"))


SQUARE = [(0.6, 4.2), (1.2, 4.0), (1.6, 4.4), (1.1, 4.8)]


def _cross(a: tuple, b: tuple) -> str:
    dx, dy = b[0] - a[0], b[1] - a[1]
    return (f"{dx!r}::DOUBLE * (y - {a[1]}::DOUBLE) - {dy!r}::DOUBLE * (x - {a[0]}::DOUBLE)"
            f" >= -1e-9 * sqrt({dx * dx + dy * dy!r}::DOUBLE)")


@query("g6_inside_polygon", f"""
SELECT l_orderkey, l_linenumber, l_partkey,
  {' AND '.join(_cross(a, b) for a, b in zip(SQUARE, SQUARE[1:] + SQUARE[:1]))} AS dentro
FROM (SELECT *, log10(l_quantity) AS x, log10(l_extendedprice) AS y FROM lineitem)""")
def _(spark, d):
    corners = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(SQUARE)], "pos long, x double, y double")
    marked = H.mark_inside(
        P.table(spark, d, "lineitem"), F.log10("l_quantity"), F.log10("l_extendedprice"), corners, "dentro"
    )
    return marked.select("l_orderkey", "l_linenumber", "l_partkey", "dentro")


PAIRS_SQL = {
    "BARIO_ESTRONCIO": ("mediana_bario", "mediana_estroncio"),
    "SALINIDADE_BARIO": ("mediana_salinidade", "mediana_bario"),
    "SALINIDADE_ESTRONCIO": ("mediana_salinidade", "mediana_estroncio"),
    "SALINIDADE_RELACAO_BA_SR": ("mediana_salinidade", "ba_sr"),
}


def similar_sql(x: str, y: str) -> str:
    """A query of the clean platforms with both values above zero, and whether the hull holds them."""
    return f"""(WITH both_known AS (
  SELECT plat, tem_norm, media_bsw, {x} AS vx, {y} AS vy, log10({x}) AS x, log10({y}) AS y
  FROM analysis WHERE {x} > 0 AND {y} > 0
), points AS (SELECT x, y FROM both_known WHERE tem_norm = 1), {hull_sides_sql('points')}
SELECT plat, media_bsw, vx, vy, (SELECT count(*) FROM sides) > 2 AND NOT EXISTS (
  SELECT 1 FROM sides WHERE (bx - ax) * (c.y - ay) - (b_y - ay) * (c.x - ax)
    < -1e-9 * sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay))) AS semelhante
FROM both_known c WHERE tem_norm = 0)"""


@query("g7_similar_clean", P.WITH_WINDOW + f"""
SELECT plat, {R('vx')} AS x, {R('vy')} AS y, semelhante
FROM {similar_sql(*PAIRS_SQL['BARIO_ESTRONCIO'])}""")
def _(spark, d):
    x, y = H.SIMILARITY_PAIRS["BARIO_ESTRONCIO"]
    marked = H.mark_similar(materialise(analysis(spark, d)), x, y)
    return shown(marked, plat=N.PLATFORM, x=r(x), y=r(y), semelhante="PERFIL_SEMELHANTE")


@query("g8_similarity_regions", P.WITH_WINDOW + " UNION ALL ".join(f"""
SELECT '{name}' AS par, plat, {R('media_bsw')} AS bsw, {R('vx')} AS x, {R('vy')} AS y
FROM {similar_sql(*pair)} WHERE semelhante""" for name, pair in PAIRS_SQL.items()))
def _(spark, d):
    found = H.similar_platforms(materialise(analysis(spark, d)))
    return shown(found, par="PAR", plat=N.PLATFORM, bsw=r("MEDIA_BSW_PLAT"), x=r("X"), y=r("Y"))


def _evaluation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pooled metric row and group metrics of the given scores."""
    scored = P.scores(spark, d)
    pooled = M.with_rates(M.confusion(scored, "y", (F.col("p") >= 0.9).cast("int")))
    return pooled.withColumns({
        "AUC": M.auc(scored, "y", "p").scalar(), "LIMIAR_YOUDEN": F.lit(0.9)
    }), M.fold_summary(_per_group(spark, d))


@query("g9_confusion_card", SUMMARY_SQL[:-2] + f""", whole AS (
  SELECT sum(vp)::BIGINT AS vp, sum(fp)::BIGINT AS fp, sum(vn)::BIGINT AS vn, sum(fn)::BIGINT AS fn
  FROM counts)
SELECT vp, fp, vn, fn, vp + fp + vn + fn AS total, vp + vn AS acertos,
  {R('vp::DOUBLE / (vp + fn)')} AS sensibilidade, {R('vn::DOUBLE / (vn + fp)')} AS especificidade,
  {R('(vp + vn)::DOUBLE / (vp + fp + vn + fn)')} AS acuracia,
  (SELECT format('{{:.0f}}% ± {{:.0f}}%', 100 * avg(f1), 100 * stddev_samp(f1)) FROM measures)
    AS f1_texto,
  (SELECT format('{{:.2f}} ± {{:.2f}}', avg(auc), stddev_samp(auc)) FROM areas) AS auc_texto
FROM whole""")
def _(spark, d):
    card = G.confusion_card("g", *_evaluation(spark, d))
    return shown(card, vp="VP", fp="FP", vn="VN", fn="FN", total="TOTAL", acertos="ACERTOS",
                 sensibilidade=r("SENSIBILIDADE"), especificidade=r("ESPECIFICIDADE"),
                 acuracia=r("ACURACIA"), f1_texto="F1_SCORE_MEDIA_DP", auc_texto="AUC_MEDIA_DP")


def _card_sql(i: int, name: str) -> str:
    texts = FS.spread(i, "{:.0f}% ± {:.0f}%", 100).replace(
        "(SELECT format('{:.0f}% ± {:.0f}%', 100 * avg(auc) + 1e-9, 100 * stddev_samp(auc) + 1e-9)",
        "(SELECT format('{:.2f} ± {:.2f}', avg(auc) + 1e-9, stddev_samp(auc) + 1e-9)",
    )
    return f"""SELECT '{name}' AS MODELO, {FS.COUNTS}, (vp + fp + vn + fn)::BIGINT AS TOTAL,
  (vp + vn)::BIGINT AS ACERTOS, {R('sensibilidade', 4)} AS SENSIBILIDADE, {R('especificidade', 4)} AS ESPECIFICIDADE,
  {R('acuracia', 4)} AS ACURACIA, {R('auc', 4)} AS AUC, {R('limiar', 4)} AS LIMIAR_YOUDEN, {texts} FROM e{i}_all"""


@query("g9_model_cards", FS.with_evaluation(FS.MODELS_SQL, 6) + " UNION ALL ".join(
    _card_sql(i, name) for i, name in enumerate(FS.MODELS_SQL)))
def _(spark, d):
    _, results = L.compare_models(model_data(spark, d), 6)
    cards = G.confusion_cards(results)
    return cards.select(*[
        r(c, 4).alias(c) if kind == "double" else F.col(c) for c, kind in cards.dtypes
    ])


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    return P.scores(spark, d).withColumns({
        N.TARGET: F.col("y"), "CLASSE_PREVISTA": (F.col("p") >= 0.9).cast("int")
    })


@query("w4_g10_regression_result", P.WITH_SCORES + """
SELECT doc_id, p, row_number() OVER (ORDER BY p, doc_id) - 1 AS posicao,
  CASE WHEN y = 1 AND p >= 0.9 THEN 'Verdadeiro positivo'
    WHEN y = 0 AND p < 0.9 THEN 'Verdadeiro negativo' WHEN y = 0 THEN 'Falso positivo'
    ELSE 'Falso negativo' END AS resultado FROM scores""")
def _(spark, d):
    placed = G.regression_result(_predicted(spark, d), "doc_id", "p")
    return shown(placed, doc_id="doc_id", p="p", posicao="POSICAO", resultado="RESULTADO")


@query("g10_regression_rates", P.WITH_SCORES + f"""
SELECT {R('''(SELECT (sum(rp) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0)
    / (sum(y) * sum(1 - y)) FROM (SELECT y, rank() OVER (ORDER BY p)
      + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp FROM scores))''')} AS auc,
  {R('avg((p >= 0.9)::INT) FILTER (WHERE y = 1)')} AS sensibilidade,
  {R('avg((p < 0.9)::INT) FILTER (WHERE y = 0)')} AS especificidade FROM scores""")
def _(spark, d):
    rates = G.regression_rates(_predicted(spark, d), "p")
    return shown(rates, auc=r("AUC"), sensibilidade=r("SENSIBILIDADE"),
                 especificidade=r("ESPECIFICIDADE"))


GROUPS_SQL = """groups AS (
  SELECT *, 'NORM' AS grupo FROM analysis WHERE tem_norm = 1
  UNION ALL SELECT *, 'OLEOSA' FROM analysis WHERE tem_oleosa = 1 AND tem_norm = 0
)"""


@query("j11_class_groups", P.WITH_NEAREST[:-1] + f""", {GROUPS_SQL}
SELECT grupo, plat, {R('media_bsw')} AS bsw FROM groups""")
def _(spark, d):
    rows = G.class_groups(analysis(spark, d, NEAREST))
    return shown(rows, grupo="GRUPO", plat=N.PLATFORM, bsw=r("MEDIA_BSW_PLAT"))


@query("a20_bsw_reference", P.WITH_WINDOW + f"""
SELECT {R('min(media_bsw)')} AS referencia FROM analysis WHERE tem_norm = 1""")
def _(spark, d):
    return shown(G.bsw_reference(analysis(spark, d)), referencia=r("REFERENCIA"))


@query("w6_g13_bsw_bars", P.WITH_WINDOW[:-1] + f""", {GROUPS_SQL}
SELECT plat, grupo, {R('media_bsw')} AS media, {R('mediana_bsw')} AS mediana,
  (SELECT {R('min(media_bsw)')} FROM analysis WHERE tem_norm = 1) AS referencia
FROM groups ORDER BY mediana_bsw, plat""")
def _(spark, d):
    bars = G.bsw_bars(analysis(spark, d))
    return shown(bars, plat=N.PLATFORM, grupo="GRUPO", media=r("MEDIA_BSW_PLAT"),
                 mediana=r("MEDIANA_BSW_PLAT"), referencia=r("REFERENCIA"))
