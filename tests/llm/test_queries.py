"""The registered corpus queries on the smallest test tables, against their SQL where there is some."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from salmoura.checks.compare import compare, connect
from salmoura.llm.entries import ENTRIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2": "doc_id held_out score predicted", "op3": "page_id url text n_chars",
    "op4": "doc_id n_shingles component_id kept", "op5": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6": "page_id payload_bytes payload_digest record_type refers_to",
    "op7": "doc_id n_words n_hit n_items items_sha256 contaminated", "op8": "doc_id text n_lines n_dropped",
    "op9": "doc_id size text_crc32 law shard slot grown_shard",
    "op10": "doc_id n_assign n_access n_hex base_sha256 spans", "pipeline": "doc_id n_tokens",
    "op11": "anchor_id positive_id rank negative_id positive_score negative_score", "op12": "query_id rank vec_id score",
    "op13": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}

pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="no test tables here")


@pytest.mark.parametrize("name", [*ENTRIES, "pipeline"])
def test_query(spark, name):
    run, sql = contract.queries()[name], contract.oracle_sql().get(name)
    result = compare(spark, connect(FOLDER), FOLDER, run, sql)
    assert result["ok"], result.get("why")
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(run(spark, FOLDER).columns)
    if name[:5] in ("op11_", "op12_"):  # searches: compared with their SQL
        assert sql and result["rows"] > 0
        return
    whole = spark.read.parquet(f"{FOLDER}/{'pages' if name[:4] in ('op3_', 'op6_') else 'documents'}.parquet").count()
    assert result["rows"] == whole if name != "pipeline" else 0 < result["rows"] <= whole


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in ENTRIES) == list(range(1, 14))
