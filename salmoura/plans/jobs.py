"""The jobs a user runs: clean the sources, analyse, train, validate over time, score."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from salmoura import names as N
from salmoura.functions.platform_names import production_platform, waste_type, with_waste_platform
from salmoura.operators import charts, cleaning as C, hull, modelling, scoring
from salmoura.operators.analysis import NEAREST, WINDOW, analysis_table
from salmoura.operators.temporal import scoring_input, temporal_table
from salmoura.operators.waste import append_newer
from salmoura.operators.water import platform_months
from salmoura.session import scratch
from salmoura.sources import files, water_files

log = logging.getLogger(__name__)

PRODUCTION = "sigep_processado"
WASTE_A = "sigre_processado"
WASTE_B = "scr_processado"
WATER = "fenix_processado"
WATER_TESTS = "fenix_ensaios"
WASTE = "base_integrada_residuos"
ANALYSIS = "base_analise"
TEMPORAL = "dataset_teste_temporal"

OIL, CONDENSATE, PRODUCED_WATER = "Óleo", "Condensado", "Água"
FINAL_MODEL = "Salinidade + Bário + Estrôncio"
WASTE_COLUMNS = [N.MONTH, N.PLATFORM, N.WASTE_TYPE, N.MASS]


def counted(df: DataFrame, name: str, *more: Column) -> tuple[DataFrame, Observation]:
    """Count rows while they are written; no pass of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *more), seen


def observed(seen: Observation) -> dict:
    """Observed counts; none where an empty plan was optimised away with its counters."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def _staged(
    spark: SparkSession, build: Callable[[], DataFrame], out: str, name: str, *more: Column, run: int | None = None
) -> DataFrame:
    """The stage that ``build`` makes, written; what ``run`` has finished before is not made again."""
    if run is not None and files.has_stage(spark, out, name, run):
        log.info("%s: finished before", name)
        return files.read_stage(spark, out, name)
    df = build()
    watched, seen = counted(df, name, *more)
    written = files.write_stage(watched, out, name, run)
    log.info("%s: %s, %d columns", name, observed(seen), len(df.columns))
    return written


def monthly_production(df: DataFrame) -> DataFrame:
    """Barrels per month of oil, condensate and water from barrels per day."""
    return df.withColumns({
        f"{p} (bbl/mes)": N.col(f"{p} (bbl/dia)") * N.col(N.DAYS)
        for p in (OIL, CONDENSATE, PRODUCED_WATER)
    })


def clean_production(raw: DataFrame, drop_unplaced: bool = False) -> DataFrame:
    """Production log with platform codes and monthly volumes.

    Rows are unique by oil rate. Rows without a destination stay unless ``drop_unplaced``.
    """
    place = "Instalação Destino"
    df = C.drop_empty_columns(raw)
    df = C.drop_missing(df, [place]) if drop_unplaced else df
    df = C.numeric_columns(df, [f"{p} (bbl/dia)" for p in (OIL, CONDENSATE, PRODUCED_WATER)])
    df = C.keep_first(df, [f"{OIL} (bbl/dia)"], [F.col(N.INGEST_ORDER)]).drop(N.INGEST_ORDER)
    df = C.rename_columns(df, {place: N.PLATFORM})
    df = df.withColumn(N.PLATFORM, production_platform(N.col(N.PLATFORM)))
    return monthly_production(C.parse_dates(df))


def clean_waste_a(raw: DataFrame, pattern: str | None = C.MONTH_PATTERN) -> DataFrame:
    """First waste log, with platform codes out of location paths."""
    used = [N.MANIFEST, "Dt. Geração", "L. de Atuação da Geradora", "Resíduo", "Qtd. Recebida (kg)"]
    df = C.rename_columns(C.drop_empty_columns(C.project(raw, used)), {
        "Dt. Geração": N.PERIOD, "Resíduo": N.WASTE_TYPE, "Qtd. Recebida (kg)": N.MASS,
    })
    df = C.numeric_columns(C.parse_dates(df, pattern=pattern), [N.MASS])
    df = with_waste_platform(df, "L. de Atuação da Geradora", N.PLATFORM).withColumn(N.WASTE_TYPE, waste_type(N.col(N.WASTE_TYPE)))
    return C.project(df, [N.MANIFEST, *WASTE_COLUMNS])


def clean_waste_b(raw: DataFrame, pattern: str | None = C.MONTH_PATTERN) -> DataFrame:
    """Second waste log; its platform names are taken as they are."""
    used = ["Data - Geração", "Resíduo", "Unidade Operacional", "Geração - Kg"]
    df = C.parse_dates(C.drop_empty_columns(C.project(raw, used)), "Data - Geração", pattern)
    df = C.rename_columns(df, {
        "Data - Geração": N.PERIOD, "Resíduo": N.WASTE_TYPE,
        "Unidade Operacional": N.PLATFORM, "Geração - Kg": N.MASS,
    })
    return C.project(C.numeric_columns(df, [N.MASS]), WASTE_COLUMNS)


def clean_water(raw: DataFrame) -> DataFrame:
    """Water tests with valid dates and numeric measurements."""
    df = C.parse_dates(C.drop_empty_columns(raw), N.DATE, None)
    df = C.numeric_columns(C.drop_invalid_dates(df), water_files.NUMERIC)
    missing = [c for c in (N.FIELD, *water_files.NUMERIC) if c not in df.columns]
    kinds = {c: "string" if c == N.FIELD else "double" for c in missing}
    return df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items()}) if missing else df


def production_job(
    spark: SparkSession, raw: str, out: str, file: str = "sigep.csv", run: int | None = None
) -> DataFrame:
    return _staged(spark, lambda: clean_production(
        files.read_table(spark, f"{raw}/{file}", ordered=True, multi_line=True)), out, PRODUCTION, run=run)


def waste_a_job(
    spark: SparkSession, raw: str, out: str, file: str = "sigre.csv", run: int | None = None
) -> DataFrame:
    return _staged(spark, lambda: clean_waste_a(
        files.read_table(spark, f"{raw}/{file}", multi_line=True)), out, WASTE_A, run=run)


def waste_b_job(
    spark: SparkSession, raw: str, out: str, file: str = "scr.csv", run: int | None = None
) -> DataFrame:
    return _staged(spark, lambda: clean_waste_b(
        files.read_table(spark, f"{raw}/{file}", multi_line=True)), out, WASTE_B, run=run)


def water_job(
    spark: SparkSession,
    raw: str,
    out: str,
    names: Sequence[str] = tuple(water_files.WATER_FILES),
    suffix: str = ".csv",
    run: int | None = None,
) -> DataFrame:
    # typed rows are a stage of their own
    tests = _staged(spark, lambda: clean_water(
        water_files.read_water_tests(spark, raw, names, suffix, water_files.NEEDED)), out, WATER_TESTS, run=run)
    span = [F.min(N.MONTH).alias("first"), F.max(N.MONTH).alias("last")]
    return _staged(
        spark, lambda: C.rename_columns(platform_months(tests), {N.CODE: N.PLATFORM}), out, WATER, *span, run=run)


def integrated_waste(spark: SparkSession, out: str, run: int | None = None) -> DataFrame:
    """Both waste logs, cut over at the last month of the first one. The table is not sorted:
    nothing reads it in order."""
    return _staged(spark, lambda: append_newer(
        files.read_stage(spark, out, WASTE_A), files.read_stage(spark, out, WASTE_B),
        ordered=False,
    ), out, WASTE, run=run)


def clean_sources(spark: SparkSession, raw: str, out: str, run: int | None = None) -> None:
    waste_a_job(spark, raw, out, run=run)
    waste_b_job(spark, raw, out, run=run)
    water_job(spark, raw, out, run=run)
    integrated_waste(spark, out, run)


def analysis_job(
    spark: SparkSession,
    raw: str,
    out: str,
    mode: str = WINDOW,
    n_splits: int = 6,
    final_model: str = FINAL_MODEL,
    resume: bool = False,
) -> dict[str, DataFrame]:
    """Everything from raw files to metrics, coefficients and chart tables; all are written.

    ``resume`` goes on with the last run: stages that it finished are read, not made again.
    """
    with scratch(spark):
        run = files.begin_run(spark, out, resume)
        production_job(spark, raw, out, run=run)
        clean_sources(spark, raw, out, run)
        analysis = _staged(
            spark, lambda: analysis_table(
                files.read_stage(spark, out, WASTE), files.read_stage(spark, out, WATER), mode
            ),
            out, ANALYSIS, F.sum(N.TARGET).alias("contaminated"), run=run,
        )
        data = _staged(spark, lambda: modelling.model_table(analysis), out, "base_modelo", run=run)
        comparison, results = modelling.compare_models(data, n_splits)
        comparison = files.write_stage(comparison, out, "comparacao_modelos", run)
        best = results[comparison.orderBy(F.desc("AUC"), "MODELO").first()["MODELO"]]
        chosen = results[final_model]
        scored = modelling.with_probability(analysis, chosen.predictions)
        model = modelling.train_final(data)
        files.save_model(model.pipeline, f"{out}/modelo_norm")

        tables = {
            "coeficientes": modelling.coefficients(spark, model.numbers),
            "metricas_folds": _per_fold(results),
            "01_bsw_plataforma": charts.bsw_bars(scored, mode),
            "02_scatter_matrix": charts.scatter_matrix(scored),
            "03_quimica_3d": charts.chemistry_3d(scored),
            "04_boxplots_quimicos": charts.boxplots(scored),
            "05_regioes_similaridade": hull.similar_platforms(scored),
            "06_matrizes_confusao": charts.confusion_cards(results),
            "07_resultado_regressao": charts.regression_result(best.predictions),
            "07_curva_roc": charts.M.roc_points(best.predictions, N.TARGET, "PROB_NORM"),
            "07_medidas": charts.regression_rates(best.predictions),
            "08_heatmap_metricas": charts.metric_heatmap(comparison),
            "09_superficie_probabilidade": charts.probability_surface(
                data, model.numbers, N.FEATURES
            ),
        }
        written = {name: files.write_stage(df, out, name, run) for name, df in tables.items()}
        return {**written, ANALYSIS: analysis, "comparacao_modelos": comparison}


def _per_fold(results: dict[str, modelling.Evaluation]) -> DataFrame:
    table = None
    for name, result in results.items():
        part = result.per_fold.withColumn("MODELO", F.lit(name))
        table = part if table is None else table.unionByName(part)
    return table


def training_job(
    spark: SparkSession,
    raw: str,
    out: str,
    mode: str = NEAREST,
    features: Sequence[str] = tuple(N.FEATURES),
    resume: bool = False,
) -> modelling.Fitted:
    """Clean, build the analysis table, fit on all of it and save the model. ``resume`` as in :func:`analysis_job`."""
    run = files.begin_run(spark, out, resume)
    clean_sources(spark, raw, out, run)
    analysis = analysis_table(
        files.read_stage(spark, out, WASTE), files.read_stage(spark, out, WATER), mode
    )
    data = files.write_stage(modelling.model_table(analysis), out, "base_treino", run)
    model = modelling.train_final(data, features)
    files.save_model(model.pipeline, f"{out}/modelo_norm")
    return model


def temporal_job(spark: SparkSession, out: str, batch_input: str) -> DataFrame:
    """Temporal validation table and the input of batch scoring, from the stage tables."""
    table = _staged(
        spark, lambda: temporal_table(
            files.read_stage(spark, out, WATER), files.read_stage(spark, out, WASTE), ordered=False
        ), out, TEMPORAL, F.sum(F.col("ELEGIVEL_MODELO").cast("long")).alias("eligible")
    )
    files.write_csv(scoring_input(table), batch_input)
    return table


def scoring_job(
    spark: SparkSession, model_path: str, batch_input: str, batch_output: str
) -> DataFrame:
    """Score a table of platform-months, locally or on any Hadoop path."""
    rows = C.numeric_columns(files.read_table(spark, batch_input), N.FEATURES)
    scored = scoring.score_batch(rows, files.load_model(model_path))
    files.write_csv(scored, batch_output)
    return scored
