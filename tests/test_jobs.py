"""All jobs, from raw files in the shape of the sources to a scored batch."""

import random

import pytest
from pyspark.sql import functions as F

from salmoura import names as N
from salmoura.plans import jobs
from salmoura.sources import files, water_files as WF

PLATFORMS = [f"P-{i}" for i in range(1, 25)]


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    rng = random.Random(7)
    folder = tmp_path_factory.mktemp("raw")
    months = [f"{y}/{m}" for y in (2020, 2021) for m in range(1, 13)]
    write(folder / "sigep.csv", [
        "Período,Instalação Destino,Óleo (bbl/dia),Condensado (bbl/dia),Água (bbl/dia),Vazia",
        *[f"{mes},PETROBRAS {i} (P-{i}),{rng.randint(1, 10**6)},1,2," for mes in months for i in (1, 2)],
    ])
    kinds = ["BORRA OLEOSA COM NORM (CATEGORIA I - ETIQUETA BRANCA)", "BORRA OLEOSA"]
    write(folder / "sigre.csv", [
        "FCDR,Dt. Geração,L. de Atuação da Geradora,Resíduo,Qtd. Recebida (kg)",
        *[f"F{i},{rng.choice(months[2:12])},UO/{p},{kinds[i % 2]},{rng.randint(1, 900)}"
          for i, p in enumerate(PLATFORMS) for _ in range(3)],
    ])
    write(folder / "scr.csv", [
        "Data - Geração,Resíduo,Unidade Operacional,Geração - Kg",
        *[f"{rng.choice(months[10:])},{kinds[1]},{p},{rng.randint(1, 900)}" for p in PLATFORMS],
    ])
    for f, name in enumerate(WF.WATER_FILES):
        rows = [
            f"C{f},w{w},{p},{mes.replace('/', '-')}-{rng.randint(10, 28)},{rng.uniform(1, 90):.2f},"
            f"{rng.uniform(1, 90):.2f},{rng.uniform(0, 100):.1f},{rng.uniform(1, 60) * (1 + (i % 2)):.3f},"
            f"{rng.uniform(50, 150):.3f},{rng.uniform(3e4, 9e4) * (1 + (i % 2) / 2):.1f}"
            for i, p in enumerate(PLATFORMS) if i % len(WF.WATER_FILES) == f
            for mes in ("2020/01", *[f"{m[:5]}{int(m[5:]):02d}" for m in months[1:]]) for w in (1, 2)
        ]
        write(folder / f"{name}.csv", [
            "Relatório", "", "Filtro",
            "Nome do Campo,Nome do Poço,Sigla da Plataforma,Data,Qw (m³/d),Qo (m³/d),BSW (%),"
            "[BÁRIO],[ESTRÔNCIO],[SALINIDADE DA ÁGUA (MG DE NACL/L)]",
            *rows, f"C{f},w1,P-1,1999-01-15,1,1,1,1,1,1",
        ])
    return str(folder)


def test_analysis_then_temporal_then_scoring(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    tables = jobs.analysis_job(spark, raw, out, n_splits=3)

    production = files.read_stage(spark, out, jobs.PRODUCTION)
    assert {r[N.PLATFORM] for r in production.select(N.col(N.PLATFORM)).distinct().collect()} == {"P-1", "P-2"}
    assert "Vazia" not in production.columns

    water = files.read_stage(spark, out, jobs.WATER)
    assert water.count() == 24 * 24 and water.filter("N_POCOS <> 2").isEmpty()
    assert water.agg(F.min("Mes")).first()[0].year == 2020

    last = files.read_stage(spark, out, jobs.WASTE_A).agg(F.max("Mes")).first()[0]
    waste = files.read_stage(spark, out, jobs.WASTE)
    assert waste.filter(F.col("FCDR").isNull() & (F.col("Mes") <= F.lit(last))).isEmpty()

    analysis = tables[jobs.ANALYSIS]
    assert analysis.count() == 24 and analysis.filter("TEM_NORM = 1").count() == 12
    assert tables["comparacao_modelos"].count() == 2 and tables["coeficientes"].count() == 3
    assert tables["metricas_folds"].count() == 6
    assert tables["09_superficie_probabilidade"].count() == 240 * 240
    assert tables["04_boxplots_quimicos"].count() == 8
    assert tables["07_resultado_regressao"].count() == 24
    assert tables["06_matrizes_confusao"].agg(F.sum("TOTAL")).first()[0] == 48

    batch = str(tmp_path / "entrada.csv")
    table = jobs.temporal_job(spark, out, batch)
    assert table.count() == 24 * 24 and table.filter("TEM_NORM = 1").count() == 12 * 24
    scored = jobs.scoring_job(spark, f"{out}/modelo_norm", batch, str(tmp_path / "saida.csv"))
    assert scored.count() == table.filter("ELEGIVEL_MODELO").count()
    assert {"PREDICAO_NORM", "PROB_NORM", N.RATIO, N.SITE} <= set(scored.columns)
    assert scored.filter("try_cast(PROB_NORM AS double) between 0 and 1").count() == scored.count()


def test_training_uses_the_nearest_month(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    fitted = jobs.training_job(spark, raw, out)
    assert fitted.numbers.features == tuple(N.FEATURES)
    assert files.read_stage(spark, out, "base_treino").count() == 24
    assert files.load_model(f"{out}/modelo_norm").stages[-1].numFeatures == 3


def test_missing_source(spark, tmp_path):
    with pytest.raises(Exception):
        jobs.production_job(spark, str(tmp_path), str(tmp_path / "out"))


def test_a_broken_run_leaves_whole_stages_and_is_resumed(spark, raw, tmp_path, monkeypatch):
    """Run 1 is whole. Run 2 breaks at the second stage: readers still see run 1's tables there. Resumed, it makes that stage
    and all after it again, although run 1 has them, and no stage before it."""
    out = str(tmp_path / "out")
    jobs.clean_sources(spark, raw, out, files.begin_run(spark, out))
    whole = files.read_stage(spark, out, jobs.WASTE).count()
    clean_a, clean_b, made = jobs.clean_waste_a, jobs.clean_waste_b, []

    def broken(df):
        return clean_b(df).withColumn(N.MASS, F.raise_error(F.lit("broken")).cast("double"))

    monkeypatch.setattr(jobs, "clean_waste_b", broken)
    with pytest.raises(Exception, match="broken"):
        jobs.clean_sources(spark, raw, out, files.begin_run(spark, out))
    assert files.stage_path(spark, out, jobs.WASTE_A).endswith("version=2")
    assert files.stage_path(spark, out, jobs.WASTE_B).endswith("version=1")
    assert files.read_stage(spark, out, jobs.WASTE_B).count() == len(PLATFORMS)

    monkeypatch.setattr(jobs, "clean_waste_a", lambda df: made.append("a") or clean_a(df))
    monkeypatch.setattr(jobs, "clean_waste_b", lambda df: made.append("b") or clean_b(df))
    jobs.clean_sources(spark, raw, out, files.begin_run(spark, out, resume=True))
    assert made == ["b"]
    for name in (jobs.WASTE_A, jobs.WASTE_B, jobs.WATER_TESTS, jobs.WATER, jobs.WASTE):
        assert files.stage_path(spark, out, name).endswith("version=2")
    assert files.read_stage(spark, out, jobs.WASTE).count() == whole


def test_versions_of_a_stage(spark, tmp_path):
    out = str(tmp_path)
    with pytest.raises(FileNotFoundError, match="no complete stage t"):
        files.read_stage(spark, out, "t")
    for n in (1, 2, 3):
        assert files.write_stage(spark.range(n), out, "t").count() == n
    assert files.read_stage(spark, out, "t").columns == ["id"] and files.read_stage(spark, out, "t").count() == 3
    assert sorted(p.name for p in (tmp_path / "t.parquet").iterdir()) == ["version=2", "version=3"]
    (tmp_path / "t.parquet" / "version=3" / "_SUCCESS").unlink()  # as if its write had not ended
    assert files.read_stage(spark, out, "t").count() == 2
