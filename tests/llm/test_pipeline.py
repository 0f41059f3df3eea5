import re

import numpy as np
import pytest
from odd_tables import documents, stage_tables

import corpus_pipeline as pipeline
from salmoura.llm import quality


def test_stages_in_order():
    assert [name for name, _ in pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "minhash_near_dedup", "benchmark_decontamination", "bpe_encoding",
    ]


@pytest.mark.parametrize("rows", [None, 0])
def test_odd_rows_pass_every_stage(spark, tmp_path, rows):
    folder = stage_tables(spark, str(tmp_path / "tables"))
    docs = documents(spark) if rows is None else documents(spark).limit(rows)
    columns, kinds = docs.columns, docs.dtypes
    for name, stage in pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, folder).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "bpe_encoding":
            assert after.columns == columns and after.dtypes == kinds, name
            assert after.count() <= docs.count()
        docs = after
    assert {"doc_id", "n_tokens", "ids"} <= set(docs.columns)


def test_run_on_a_small_corpus(spark, tmp_path):
    """Good and bad texts, a copy, a near copy, a boilerplate line and a benchmark passage, against brute force."""
    rng = np.random.default_rng(4)
    def prose(n):
        return " ".join("".join(rng.choice(list("abcdefghijklm"), rng.integers(2, 9))) for _ in range(n)).capitalize() + "."
    texts = {i: prose(120) for i in range(60)}
    texts |= {100 + i: re.sub(r"(\w)( |\.)", r"\1*** ", prose(120)) for i in range(40)}
    texts[200], texts[201] = texts[7], texts[8] + " end"
    item = " ".join(texts[20].split()[30:50])
    texts = {i: ("Shared licence line\n" + t if i < 60 else t) for i, t in texts.items()}
    folder = str(tmp_path / "tables")
    spark.createDataFrame(
        [(i, t, "en", "src0", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long"
    ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(140) if i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    found = {r["doc_id"] for r in pipeline.run(spark, folder).collect()}
    assert found == {i for i in range(60) if i != 20}


def test_classifier_rejects_what_it_predicts(spark, tmp_path):
    folder = stage_tables(spark, str(tmp_path / "tables"))
    docs = documents(spark)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = pipeline.STAGES[0][1](spark, docs, folder).count()
    assert kept == quality.classified(docs, labels).filter("predicted = 1").count()
