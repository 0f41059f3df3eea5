"""Weighted logistic regression: preparation, folds, evaluation, comparison, final fit."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from salmoura import names as N
from salmoura.functions.columns import all_positive
from salmoura.functions.running import BUCKET, equal_splits, running_totals
from salmoura.operators import metrics as M
from salmoura.operators.cleaning import complete_cases, numeric_columns
from salmoura.operators.newton import Problem, solve
from salmoura.operators.scoring import LogisticModel
from salmoura.session import materialise

SEED = 42
FOLDS = 4
MOST_FOLDS = 100  # as each fold is a fit of its own
Moments = Sequence[tuple[float, float]]

# fixed values: statistics of the analysis table -> feature names
MODEL_COLUMNS = {
    "MEDIANA_SALINIDADE_PLAT": "SALINIDADE",
    "MEDIANA_BARIO_PLAT": "BARIO",
    "MEDIANA_ESTRONCIO_PLAT": "ESTRONCIO",
    "RELACAO_BARIO_ESTRONCIO": "RELACAO_BA_SR",
}

# fixed values: the models that are compared
MODELS = {
    "Salinidade + Bário + Estrôncio": ["SALINIDADE", "BARIO", "ESTRONCIO"],
    "Salinidade + Relação Ba/Sr": ["SALINIDADE", "RELACAO_BA_SR"],
}


def model_table(analysis: DataFrame) -> DataFrame:
    """Complete rows with positive chemistry, the class as integer, and log10 columns."""
    variables = list(MODEL_COLUMNS.values())
    data = analysis.select(N.col(N.PLATFORM), N.TARGET, *MODEL_COLUMNS).withColumnsRenamed(
        MODEL_COLUMNS
    )
    data = numeric_columns(data, [N.TARGET, *variables])
    usable = complete_cases(data, [N.TARGET, *variables]).filter(all_positive(variables))
    return usable.withColumns({
        N.TARGET: F.col(N.TARGET).cast("int"),
        **{f"LOG_{v}": F.log10(F.col(v)) for v in variables},
    })


def class_counts(data: DataFrame) -> dict[int, int]:
    """Rows per class; an error unless there are rows of the classes 0 and 1 and of no other."""
    label = F.col(N.TARGET)
    seen = data.agg(
        F.count_if(label == 0).alias("zero"), F.count_if(label == 1).alias("one"), F.count(F.lit(1)).alias("n")
    ).first()
    if not seen["n"]:
        raise ValueError("no valid rows: chemistry must be numeric and above zero")
    if not seen["zero"] or not seen["one"]:
        raise ValueError("both classes (0 and 1) are needed")
    if seen["zero"] + seen["one"] != seen["n"]:
        raise ValueError(f"{seen['n'] - seen['zero'] - seen['one']} rows of another class than 0 and 1")
    return {0: seen["zero"], 1: seen["one"]}


def fold_count(counts: dict[int, int], wanted: int) -> int:
    folds = min(wanted, min(counts.values()))
    if folds < 2:
        raise ValueError("too few rows for cross-validation")
    return folds


def balanced_weight(counts: dict[int, int]) -> Column:
    """n / (2 n_class)"""
    total = sum(counts.values())
    one, zero = (F.lit(total / (2.0 * counts[c])) for c in (1, 0))
    return F.when(F.col(N.TARGET) == 1, one).otherwise(zero)


def assign_folds(
    data: DataFrame, folds: int, key: str = N.PLATFORM, seed: int = SEED, by: str = N.TARGET
) -> DataFrame:
    """Stratified folds 1..folds: rank of a seeded hash of the key within the class, modulo.

    Hashes are evenly spread, so their first digits make equal buckets for the ranking.
    """
    hashed = data.withColumn("_hash", F.md5(F.concat(N.col(key), F.lit(str(seed)))))
    bucketed = hashed.withColumns({
        BUCKET: F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"),
        "_one": F.lit(1),
    })
    ranked = running_totals(bucketed, [by], [F.col("_hash")], {"_before": "_one"})
    return ranked.withColumn("FOLD", (F.col("_before") % folds + 1).cast("int")).drop(
        "_hash", BUCKET, "_one", "_before", "_before_all"
    )


def _log_moments(features: Sequence[str], rows: Column) -> list[Column]:
    """Mean and population deviation of each log10 feature over the given rows, as _m0, _s0, ..."""
    logs = [F.when(rows, F.log10(N.col(f))) for f in features]
    return [
        part
        for i, c in enumerate(logs)
        for part in (F.avg(c).alias(f"_m{i}"), F.stddev_pop(c).alias(f"_s{i}"))
    ]


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(
        inputCols=[f"_z{i}" for i in range(len(features))], outputCol="_z", handleInvalid="keep"
    )


def _z_sql(features: Sequence[str], moments: Moments) -> str:
    return ", ".join(
        f"(log10(`{f}`) - {m!r}D) / {s!r}D AS _z{i}"
        for i, (f, (m, s)) in enumerate(zip(features, moments))
    )


@dataclass(frozen=True)
class Fitted:
    """A fitted pipeline to be saved, and its numbers for scoring as plain columns."""

    pipeline: PipelineModel
    numbers: LogisticModel


def as_pipeline(spark: SparkSession, model: LogisticModel) -> PipelineModel:
    """A model as a pipeline of Spark ML: log10 and z-score, a vector, the regression."""
    moments = list(zip(model.means, model.deviations))
    regression = LogisticRegressionModel(spark._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(
        "norm", _py2java(spark.sparkContext, Vectors.dense(model.weights)), model.intercept
    ))
    regression.setFeaturesCol("_z")
    return PipelineModel([
        SQLTransformer(statement=f"SELECT *, {_z_sql(model.features, moments)} FROM __THIS__"),
        _assembler(model.features), regression,
    ])


def fit(train: DataFrame, features: Sequence[str]) -> Fitted:
    """Fit log10 -> z-score -> balanced L2 logistic regression on all rows of ``train``.

    The penalty is half the squared weights on the summed loss, whose row weights n / (2 n_class) sum to n.
    """
    counts = class_counts(train)
    row = train.agg(*_log_moments(features, F.lit(True))).first()
    problem = Problem(tuple(features), _moments(row, features), (counts[0], counts[1]))
    (found,) = solve(train, [problem])
    numbers = _numbers(problem, found)
    return Fitted(as_pipeline(train.sparkSession, numbers), numbers)


def _moments(row, features: Sequence[str]) -> Moments:
    """(mean, deviation) per feature; a constant feature is only centred."""
    return tuple((row[f"_m{i}"], row[f"_s{i}"] or 1.0) for i in range(len(features)))


def _numbers(problem: Problem, found: tuple[tuple[float, ...], float]) -> LogisticModel:
    means, deviations = zip(*problem.moments)
    return LogisticModel(problem.features, means, deviations, *found)


def fit_folds(
    data: DataFrame, models: Sequence[Sequence[str]], folds: Sequence[int]
) -> list[dict[int, LogisticModel]]:
    """For each list of features one model per fold, fitted on the other folds, all of them together.

    Moments and class counts of all training sets come from one aggregation.
    """
    every = sorted({f for features in models for f in features})
    others = {k: F.col("FOLD") != k for k in folds}
    seen = data.agg(*[
        F.struct(
            *_log_moments(every, rows),
            F.count(F.when(rows & (F.col(N.TARGET) == 0), 1)).alias("_c0"),
            F.count(F.when(rows & (F.col(N.TARGET) == 1), 1)).alias("_c1"),
        ).alias(f"k{k}")
        for k, rows in others.items()
    ]).first()
    problems = []
    for features in models:
        for k in folds:
            row = seen[f"k{k}"]
            moments = dict(zip(every, _moments(row, every)))
            problems.append(Problem(tuple(features), tuple(moments[f] for f in features), (row["_c0"], row["_c1"]), k))
    fitted = [_numbers(p, found) for p, found in zip(problems, solve(data, problems))]
    return [dict(zip(folds, fitted[i * len(folds):])) for i in range(len(models))]


def held_out_probability(models: dict[int, LogisticModel]) -> Column:
    """Score of each row by the model of its fold, in one pass and without a union."""
    first, *rest = [(F.col("FOLD") == k, m.probability()) for k, m in models.items()]
    return reduce(lambda w, pair: w.when(*pair), rest, F.when(*first))


@dataclass(frozen=True)
class Evaluation:
    """Cross-validated model: scored rows, one metric row per fold, one pooled metric row."""

    features: list[str]
    folds: int
    threshold: float
    predictions: DataFrame
    per_fold: DataFrame
    pooled: DataFrame


def with_folds(
    data: DataFrame, n_splits: int = FOLDS, seed: int = SEED
) -> tuple[DataFrame, list[int]]:
    """Rows with their fold, written once to the shared folder, and the fold numbers.

    Folds given by the caller are kept. They must be whole numbers in a row, each with both
    classes outside of it.
    """
    data = materialise(data)  # counted, ranked and joined: what makes it runs once
    folds = fold_count(class_counts(data), n_splits)
    if "FOLD" not in data.columns:
        return materialise(assign_folds(data, folds, seed=seed)), list(range(1, folds + 1))
    seen = data.groupBy("FOLD").agg(F.count_if(F.col(N.TARGET) == 1).alias("one"), F.count(F.lit(1)).alias("n"))
    rows = seen.limit(MOST_FOLDS + 1).collect()  # never more than that reach the driver
    numbers = [r["FOLD"] for r in rows]
    if len(rows) > MOST_FOLDS or None in numbers or any(k != int(k) for k in numbers):
        raise ValueError(f"FOLD must hold at most {MOST_FOLDS} whole numbers")
    numbers = sorted(map(int, numbers))
    if len(numbers) < 2 or numbers != list(range(numbers[0], numbers[0] + len(numbers))):
        raise ValueError(f"FOLD must hold at least two numbers in a row, not {numbers}")
    ones, total = sum(r["one"] for r in rows), sum(r["n"] for r in rows)
    for r in rows:
        if r["one"] == ones or r["n"] - r["one"] == total - ones:
            raise ValueError(f"without fold {r['FOLD']} only one class is left")
    return data, numbers


def fold_metrics(predictions: DataFrame, splits: Sequence[float] | None = None) -> DataFrame:
    """Sizes, AUC and confusion metrics of each fold at the pooled threshold."""
    counted = predictions.groupBy("FOLD").agg(
        F.count(F.lit(1)).alias("N_TESTE"),
        *M.confusion_aggregates(F.col(N.TARGET), F.col("CLASSE_PREVISTA")),
    )
    total = predictions.agg(F.count(F.lit(1)).alias("n")).scalar()
    areas = M.curve_summary(predictions, N.TARGET, "PROB_NORM", ["FOLD"], splits)
    return (
        M.with_rates(counted)
        .join(areas, "FOLD")
        .select(
            "FOLD", (total - F.col("N_TESTE")).alias("N_TREINO"), "N_TESTE",
            *M.METRICS, *M.COUNTS,
        )
    )


def evaluate(
    data: DataFrame, features: Sequence[str], n_splits: int = FOLDS, seed: int = SEED
) -> Evaluation:
    """Stratified cross-validation of one model.

    The threshold is chosen on all held-out scores together and applied to each fold.
    """
    prepared, folds = with_folds(data, n_splits, seed)
    return evaluate_prepared(prepared, features, folds)


def evaluate_prepared(
    data: DataFrame, features: Sequence[str], folds: Sequence[int], models: dict[int, LogisticModel] | None = None
) -> Evaluation:
    """Evaluate on rows that have their fold, with the models of the folds if they are there. The metric tables hold one row per fold and one
    row in all, so they are fetched once and kept as literal rows."""
    spark = data.sparkSession
    if models is None:
        (models,) = fit_folds(data, [features], folds)
    scored = data.withColumn("PROB_NORM", held_out_probability(models))
    splits = equal_splits(scored, "PROB_NORM")
    curve = M.curve_summary(scored, N.TARGET, "PROB_NORM", splits=splits).first()
    if curve is None or curve["LIMIAR_YOUDEN"] is None:
        raise ValueError("no valid Youden threshold")
    threshold = curve["LIMIAR_YOUDEN"]
    predictions = scored.withColumn(
        "CLASSE_PREVISTA", (F.col("PROB_NORM") >= F.lit(threshold)).cast("int")
    )
    metrics = fold_metrics(predictions, splits)
    rows = metrics.collect()
    counts = {c: sum(row[c] for row in rows) for c in M.COUNTS}
    pooled = spark.createDataFrame(
        [(*counts.values(), curve["AUC"], threshold)],
        ", ".join(f"{c} long" for c in counts) + ", AUC double, LIMIAR_YOUDEN double",
    )
    return Evaluation(
        list(features), len(folds), threshold, predictions,
        spark.createDataFrame(rows, metrics.schema), M.with_rates(pooled),
    )


def comparison_row(name: str, result: Evaluation) -> DataFrame:
    """Pooled metrics and their spread over the folds, in one row."""
    spread = M.fold_summary(result.per_fold).select(F.struct("*").alias("s")).scalar()
    parts = [f"{m}_{part}" for part in ("MEDIA_FOLDS", "DP_FOLDS", "MEDIA_DP") for m in M.METRICS]
    return result.pooled.select(
        F.lit(name).alias("MODELO"),
        F.lit(len(result.features)).alias("N_VARIAVEIS"),
        *M.METRICS,
        *M.COUNTS,
        "LIMIAR_YOUDEN",
        *[spread[p].alias(p) for p in parts],
    )


def compare_models(
    data: DataFrame,
    n_splits: int = FOLDS,
    models: dict[str, list[str]] | None = None,
    seed: int = SEED,
) -> tuple[DataFrame, dict[str, Evaluation]]:
    """Metric table (best AUC first) and the evaluation of each model, on the same folds."""
    prepared, folds = with_folds(data, n_splits, seed)
    models = models or MODELS

    fitted = fit_folds(prepared, list(models.values()), folds)

    def one(features: list[str], by_fold: dict[int, LogisticModel]) -> Evaluation:
        return evaluate_prepared(prepared, features, folds, by_fold)

    with ThreadPoolExecutor(len(models)) as pool:
        shared = inheritable_thread_target(data.sparkSession)(one)
        results = dict(zip(models, pool.map(shared, models.values(), fitted)))
    rows = [comparison_row(name, result) for name, result in results.items()]
    return M.best_first(reduce(DataFrame.unionByName, rows)), results


def train_final(data: DataFrame, features: Sequence[str] = N.FEATURES) -> Fitted:
    """Model fitted on all rows."""
    return fit(data, list(features))


def coefficients(spark: SparkSession, model: LogisticModel) -> DataFrame:
    """Standardised coefficients and odds ratios, one row per feature."""
    table = spark.createDataFrame(
        list(zip(model.features, model.weights)),
        "VARIAVEL string, COEFICIENTE_PADRONIZADO double",
    )
    return table.withColumn("ODDS_RATIO", F.exp("COEFICIENTE_PADRONIZADO"))


def with_probability(
    analysis: DataFrame, predictions: DataFrame, key: str = N.PLATFORM
) -> DataFrame:
    """Analysis table with the held-out probability of each platform; null where not modelled."""
    return analysis.join(predictions.select(N.col(key), "PROB_NORM"), key, "left")
