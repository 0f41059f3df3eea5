"""Logistic models as column expressions and batch scoring of tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from salmoura import names as N
from salmoura.functions.columns import finite, ratio
from salmoura.operators.cleaning import split_inputs


@dataclass(frozen=True)
class LogisticModel:
    """log10 -> z-score -> logistic regression, with the weights on the z-scores."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def margin(self) -> Column:
        terms = [
            F.lit(w) * ((F.log10(N.col(f)) - F.lit(m)) / F.lit(s))
            for f, m, s, w in zip(self.features, self.means, self.deviations, self.weights)
        ]
        return reduce(lambda a, b: a + b, terms, F.lit(self.intercept))

    def probability(self) -> Column:
        """Probability of class 1; null where a feature is missing or not above zero."""
        return finite(1 / (1 + F.exp(-self.margin())))


def add_scores(scored: DataFrame) -> DataFrame:
    """Add Ba/Sr ratio and predicted class (probability strictly above one half)."""
    return scored.select(
        *[N.col(c) for c in scored.columns if c not in (N.RATIO, "PROB_NORM")],
        ratio(F.col("BARIO"), F.col("ESTRONCIO")).alias(N.RATIO),
        (F.col("PROB_NORM") > 0.5).cast("int").alias("PREDICAO_NORM"),
        "PROB_NORM",
    )


def with_probability_of(
    df: DataFrame, model: PipelineModel | LogisticModel, name: str = "PROB_NORM"
) -> DataFrame:
    """Add the probability of class 1, by the numbers of a model or by a loaded pipeline."""
    if isinstance(model, LogisticModel):
        return df.withColumn(name, model.probability())
    given = [N.col(c) for c in df.columns if c != name]
    probability = finite(vector_to_array("probability")[1])
    return model.transform(df.drop(name)).select(*given, probability.alias(name))


def score_batch(df: DataFrame, model: PipelineModel | LogisticModel) -> DataFrame:
    """Score every row: Ba/Sr ratio, predicted class, probability."""
    return add_scores(with_probability_of(df, model))


def score_requests(
    df: DataFrame, model: PipelineModel | LogisticModel, features: Sequence[str] = N.FEATURES
) -> tuple[DataFrame, DataFrame]:
    """(answers, rejected requests). An answer holds the class and both probabilities, rounded
    to four decimals."""
    usable, rejected = split_inputs(df, features)
    answers = score_batch(usable, model).withColumns({
        "PROB_SEM_NORM": F.round(1 - F.col("PROB_NORM"), 4),
        "PROB_COM_NORM": F.round("PROB_NORM", 4),
    }).drop("PROB_NORM")
    return answers, rejected
