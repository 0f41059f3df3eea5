"""Tables behind the analysts' charts. Drawing is left to other tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from salmoura import names as N
from salmoura.functions.columns import (
    all_positive,
    class_label,
    finite,
    marker_size,
    mean_sd_text,
    outcome_label,
    percent_text,
)
from salmoura.functions.quantiles import grouped, whole_table
from salmoura.functions.running import BUCKET, bucket_of, equal_splits, positions, running_totals
from salmoura.operators import metrics as M
from salmoura.operators.analysis import NEAREST, WINDOW
from salmoura.operators.cleaning import complete_cases, numeric_columns
from salmoura.operators.modelling import MODEL_COLUMNS, Evaluation
from salmoura.operators.scoring import LogisticModel, with_probability_of

# fixed values: the columns shown, in this order
CHEMISTRY = [
    "MEDIANA_BARIO_PLAT", "MEDIANA_ESTRONCIO_PLAT",
    "MEDIANA_SALINIDADE_PLAT", "RELACAO_BARIO_ESTRONCIO",
]
AXES_3D = {
    "MEDIANA_SALINIDADE_PLAT": "SALINIDADE_Z",
    "RELACAO_BARIO_ESTRONCIO": "RELACAO_BA_SR_Z",
    "MEDIA_BSW_PLAT": "BSW_Z",
}
CORRELATED = {
    "Estrôncio": "MEDIANA_ESTRONCIO_PLAT",
    "Salinidade": "MEDIANA_SALINIDADE_PLAT",
    "Bário": "MEDIANA_BARIO_PLAT",
}
GRID = 240
LOG_MARGIN = 0.12
LEAST_LOG_SPAN = 0.2
WHISKER = 1.5


def scatter_matrix(analysis: DataFrame) -> DataFrame:
    """Platform, class and the chemistry columns that are present, complete rows only."""
    present = [c for c in CHEMISTRY if c in analysis.columns]
    rows = analysis.select(N.col(N.PLATFORM), N.TARGET, *present)
    return complete_cases(rows, [N.TARGET, *present]).withColumn(
        "Classificação", class_label(F.col(N.TARGET))
    )


def z_scores(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add population z-scores; a constant column is only centred."""
    moments = F.struct(*[
        part
        for i, c in enumerate(columns)
        for part in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))
    ])
    seen = rows.agg(moments.alias("m")).scalar()

    def z(i: int, c: str) -> Column:
        spread = seen[f"s{i}"]
        return (F.col(c) - seen[f"m{i}"]) / F.when(spread == 0, 1.0).otherwise(spread)

    return rows.withColumns({out: z(i, c) for i, (c, out) in enumerate(columns.items())})


def chemistry_3d(analysis: DataFrame) -> DataFrame:
    """Standardised chemistry of the scored platforms with marker sizes by mass."""
    columns = [
        N.PLATFORM, N.TARGET, "PROB_NORM", "MASSA_CLASSIFICADA_KG", "TIPO_MASSA", *AXES_3D,
    ]
    rows = complete_cases(analysis.select(*[N.col(c) for c in columns]), columns)
    mass = F.greatest(F.col("MASSA_CLASSIFICADA_KG"), F.lit(0.0))
    largest = rows.agg(F.max(F.log1p(mass)).alias("m")).scalar()
    sized = rows.withColumns({
        "NORM": class_label(F.col(N.TARGET)),
        "MASSA_CLASSIFICADA_KG": mass,
        "MASSA_CLASSIFICADA_T": mass / 1000,
        "TAMANHO_MARCADOR": marker_size(mass, largest),
    })
    return z_scores(sized, AXES_3D)


def boxplots(analysis: DataFrame) -> DataFrame:
    """Quartiles and whiskers per class and variable: the furthest values within 1.5
    interquartile ranges of the box, or the edge of the box where that is further out (an
    interpolated quartile may lie beyond the last value that is no outlier)."""
    present = {c: v for c, v in MODEL_COLUMNS.items() if c in analysis.columns}
    if not present:
        raise ValueError("no chemistry variable available")
    variables = list(present.values())
    rows = analysis.select(N.TARGET, *present).withColumnsRenamed(present)
    rows = complete_cases(numeric_columns(rows, [N.TARGET, *variables]), [N.TARGET, *variables])
    rows = rows.filter(all_positive(variables)).withColumn("GRUPO", class_label(F.col(N.TARGET)))
    long = rows.select("GRUPO", F.inline(F.array(*[
        F.struct(F.lit(v).alias("VARIAVEL"), F.col(v).alias("valor")) for v in variables
    ])))
    keys = ["GRUPO", "VARIAVEL"]
    quartiles = {"q1": ("valor", 0.25), "mediana": ("valor", 0.5), "q3": ("valor", 0.75)}
    count = F.count("valor").alias("n")
    # two classes by four variables: the box table has at most eight rows
    boxes = grouped(long, keys, [count], quartiles)
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    value = F.col("valor")
    low = F.min(F.when(value >= F.col("q1") - reach, value))
    high = F.max(F.when(value <= F.col("q3") + reach, value))
    return (
        long.join(F.broadcast(boxes), keys)
        .groupBy(*keys, "n", "q1", "mediana", "q3")
        .agg(low.alias("_low"), high.alias("_high"))
        .select(
            *keys, "n", "q1", "mediana", "q3",
            F.least("_low", "q1").alias("haste_inferior"),
            F.greatest("_high", "q3").alias("haste_superior"),
        )
    )


def _average_ranks(counted: DataFrame, column: str, splits: Sequence[float]) -> DataFrame:
    """Average rank of each distinct value of a column in a table of counted rows."""
    values = counted.groupBy(column).agg(F.sum("_n").alias("_n"))
    ranked = running_totals(
        values.withColumn(BUCKET, bucket_of(F.col(column), splits)),
        [], [F.col(column)], {"_before": "_n"},
    )
    rank = F.col("_before") + (F.col("_n") + 1) / 2
    return ranked.select(
        column, (rank - (F.col("_before_all") + 1) / 2).alias(f"_r_{column}")
    )


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of two columns over the rows that have both, as one value ``corr``.

    Equal pairs are counted first; ranks are centred, so the correlation is a ratio of sums.
    """
    pairs = rows.select(
        finite(F.col(a)).alias("a"), finite(F.col(b)).alias("b")
    ).dropna()
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("_n"))
    ranked = counted
    for c in ("a", "b"):
        ranked = ranked.join(_average_ranks(counted, c, equal_splits(pairs, c)), c)
    n, ra, rb = F.col("_n"), F.col("_r_a"), F.col("_r_b")
    return ranked.agg(
        F.try_divide(F.sum(n * ra * rb), F.sqrt(F.sum(n * ra * ra) * F.sum(n * rb * rb)))
        .alias("corr")
    )


def chemical_correlation(analysis: DataFrame) -> DataFrame:
    """Spearman matrix of the chemistry medians, one row per ordered pair."""
    present = {k: c for k, c in CORRELATED.items() if c in analysis.columns}
    names = list(present)
    # a variable goes with itself by 1, or by nothing if it is constant
    ends = analysis.agg(*[
        F.when(F.min(finite(F.col(c))) < F.max(finite(F.col(c))), 1.0).alias(f"c{i}")
        for i, c in enumerate(present.values())
    ])
    table = ends.select(F.inline(F.array(*[
        F.struct(F.col(f"c{i}").alias("corr"), F.lit(k).alias("VARIAVEL_X"), F.lit(k).alias("VARIAVEL_Y"))
        for i, k in enumerate(names)
    ])))
    for i, first in enumerate(names):
        for second in names[i + 1:]:
            value = spearman(analysis, present[first], present[second])
            sides = {(first, second), (second, first)}
            part = value.select("corr", F.inline(F.array(*[
                F.struct(F.lit(x).alias("VARIAVEL_X"), F.lit(y).alias("VARIAVEL_Y"))
                for x, y in sorted(sides)
            ])))
            table = table.unionByName(part)
    return table.select("VARIAVEL_X", "VARIAVEL_Y", F.col("corr").alias("CORRELACAO"))


def confusion_cards(evaluations: dict[str, Evaluation]) -> DataFrame:
    """Counts, rates, threshold and spread over the folds for the confusion cards."""
    if not evaluations:
        raise ValueError("no model predictions available")
    cards = None
    for name, result in evaluations.items():
        card = confusion_card(name, result.pooled, M.fold_summary(result.per_fold))
        cards = card if cards is None else cards.unionByName(card)
    return cards


def confusion_card(name: str, pooled: DataFrame, summary: DataFrame) -> DataFrame:
    """One card from a pooled metric row and a one-row fold summary."""
    spread = summary.select(F.struct("*").alias("s")).scalar()
    total = F.col("VP") + F.col("FP") + F.col("VN") + F.col("FN")
    hits = F.col("VP") + F.col("VN")

    def text(metric: str) -> Column:
        mean, sd = spread[f"{metric}_MEDIA_FOLDS"], spread[f"{metric}_DP_FOLDS"]
        return mean_sd_text(mean, sd, 2) if metric == "AUC" else percent_text(mean, sd)

    return pooled.select(
        F.lit(name).alias("MODELO"),
        "VP", "FP", "VN", "FN",
        total.alias("TOTAL"),
        hits.alias("ACERTOS"),
        F.try_divide(F.col("VP").cast("double"), (F.col("VP") + F.col("FN")).cast("double")).alias(
            "SENSIBILIDADE"
        ),
        "ESPECIFICIDADE", "ACURACIA", "AUC", "LIMIAR_YOUDEN",
        *[text(m).alias(f"{m}_MEDIA_DP") for m in M.METRICS],
    )


def regression_result(
    predictions: DataFrame, key: str = N.PLATFORM, score: str = "PROB_NORM"
) -> DataFrame:
    """Predictions in ascending order of probability, missing ones last, with their 0-based position
    and outcome."""
    rows = predictions.withColumn(
        "RESULTADO", outcome_label(F.col(N.TARGET), F.col("CLASSE_PREVISTA"))
    )
    return positions(rows, [F.col(score).asc_nulls_last(), N.col(key).asc_nulls_last()], "POSICAO")


def regression_rates(predictions: DataFrame, score: str = "PROB_NORM") -> DataFrame:
    """AUC, sensitivity and specificity shown next to the regression result."""
    counts = M.confusion(predictions, N.TARGET, F.col("CLASSE_PREVISTA"))
    return counts.select(
        M.auc(predictions, N.TARGET, score).scalar().alias("AUC"),
        F.try_divide(F.col("VP").cast("double"), (F.col("VP") + F.col("FN")).cast("double")).alias(
            "SENSIBILIDADE"
        ),
        F.try_divide(F.col("VN").cast("double"), (F.col("VN") + F.col("FP")).cast("double")).alias(
            "ESPECIFICIDADE"
        ),
    )


def log_limits(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Lower and upper log10 limit of each axis, as one row ``low0, high0, ...``.

    The span is at least 0.2 and is widened by 12 % on both sides.
    """
    seen = rows.agg(*[
        part
        for i, c in enumerate(columns)
        for part in (F.log10(F.min(c)).alias(f"a{i}"), F.log10(F.max(c)).alias(f"b{i}"))
    ])
    limits = []
    for i in range(len(columns)):
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        margin = LOG_MARGIN * F.greatest(b - a, F.lit(LEAST_LOG_SPAN))
        limits += [(a - margin).alias(f"low{i}"), (b + margin).alias(f"high{i}")]
    return seen.select(*limits)


def surface_axes(features: Sequence[str]) -> tuple[str, str, list[str]]:
    """(x, y, features held at their median)"""
    known = {
        ("SALINIDADE", "RELACAO_BA_SR"): ("SALINIDADE", "RELACAO_BA_SR", []),
        ("SALINIDADE", "BARIO", "ESTRONCIO"): ("SALINIDADE", "BARIO", ["ESTRONCIO"]),
    }
    if tuple(features) not in known:
        raise ValueError(f"features not supported by the surface: {list(features)}")
    return known[tuple(features)]


def feature_grid(data: DataFrame, features: Sequence[str], size: int = GRID) -> DataFrame:
    """size × size points spaced evenly in log10 around the data, other features at the median."""
    x, y, held = surface_axes(features)
    rows = complete_cases(data.select(*features), features).filter(all_positive(features))
    if rows.isEmpty():
        raise ValueError("no rows with positive values")
    limits = log_limits(rows, [x, y]).select(F.struct("*").alias("l")).scalar()
    cell = F.col("id")
    columns, lines = (cell % size).cast("int"), F.floor(cell / size).cast("int")

    def at(step: Column, i: int) -> Column:
        low, high = limits[f"low{i}"], limits[f"high{i}"]
        return F.pow(F.lit(10.0), low + step * (high - low) / (size - 1))

    grid = data.sparkSession.range(size * size).select(
        columns.alias("coluna"), lines.alias("linha"),
        at(columns, 0).alias(x), at(lines, 1).alias(y),
    )
    if held:
        medians = whole_table(rows, {h: (h, 0.5) for h in held})
        grid = grid.withColumns({h: medians.select(h).scalar() for h in held})
    return grid


def probability_surface(
    data: DataFrame, model: PipelineModel | LogisticModel, features: Sequence[str],
    size: int = GRID,
) -> DataFrame:
    """Probability of class 1 at every point of the feature grid."""
    grid = feature_grid(data, features, size)
    return with_probability_of(grid, model)


def metric_heatmap(models: DataFrame) -> DataFrame:
    """Six metrics per model, best precision first."""
    return M.best_first(models.select("MODELO", *M.METRICS), "PRECISAO")


def class_groups(analysis: DataFrame) -> DataFrame:
    """Contaminated and oily platforms, tagged with their group."""
    contaminated = F.col(N.TARGET) == 1
    oily = (F.col("TEM_OLEOSA") == 1) & (F.col(N.TARGET) == 0)
    group = F.when(contaminated, "NORM").when(oily, "OLEOSA")
    return analysis.withColumn("GRUPO", group).filter(F.col("GRUPO").isNotNull())


def bsw_reference(analysis: DataFrame) -> DataFrame:
    """Lowest mean water cut among contaminated platforms."""
    return analysis.filter(F.col(N.TARGET) == 1).agg(F.min("MEDIA_BSW_PLAT").alias("REFERENCIA"))


def bsw_bars(analysis: DataFrame, mode: str = WINDOW) -> DataFrame:
    """Mean water cut per platform and group in the order of its median, with the reference."""
    if mode not in (WINDOW, NEAREST):
        raise ValueError(f"mode must be '{NEAREST}' or '{WINDOW}'")
    rows = class_groups(analysis).select(
        N.col(N.PLATFORM), "GRUPO", "MEDIANA_BSW_PLAT", "MEDIA_BSW_PLAT"
    )
    return rows.withColumn("REFERENCIA", bsw_reference(analysis).scalar()).orderBy(
        F.col("MEDIANA_BSW_PLAT").asc_nulls_last(), N.col(N.PLATFORM)
    )
