import random
import re

import duckdb
from odd_tables import ROWS, documents

import corpus_pipeline as pipeline
from salmoura.checks.compare import compare
from salmoura.llm import benchmark_scan as scan
from salmoura.llm.entries import ENTRIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(text, items, window=10):
    found = WORD.findall((text or "").translate(LOWER))
    hit, named = set(), set()
    for item, body in items:
        words = WORD.findall((body or "").translate(LOWER))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            for j in range(len(found) - size + 1):
                if found[j : j + size] == words[i : i + size]:
                    hit.update(range(j, j + size))
                    named.add(str(item))
    return len(found), len(hit), sorted(named)


def test_equals_brute_force_in_one_part_or_many(spark):
    rng = random.Random(1)
    vocabulary = ["a", "b", "É", "c9", "ß"]
    def text(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 4, 7]))) for i in range(12)] + [(12, None), (3, "a b a"), (99, text(30))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(60, None), (61, ""), (5, text(9))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for part_bytes in (1 << 20, 40):
        rows = scan.contamination(df, benchmark, window=4, part_bytes=part_bytes).collect()
        assert len(rows) == len(docs)
        for r in rows:
            n, hit, named = brute(r["text"], items, 4)
            assert (r["n_words"], sum(h["last"] - h["first"] + 1 for h in r["hits"]), r["items"]) == (n, hit, named)


def test_hits_map_to_the_original_text():
    windows = scan.Windows([("1", "New York")], 10)
    text = "In  NEW--York, and new yorker"
    ranges, _ = windows.scan(scan.words(text))
    assert [text[a:b] for a, b in scan.hit_characters(text, ranges)] == ["NEW--York"]


def test_odd_rows(spark):
    df = documents(spark)
    items = spark.createDataFrame([(1, "third set of words"), (2, None), (None, "one")], "item_id long, text string")
    flags = scan.flagged(scan.contamination(df, items)).collect()
    assert len(flags) == len(ROWS)
    assert {r["doc_id"] for r in flags if r["contaminated"]} == {10}
    kept = scan.without_contaminated(df, items)
    assert kept.columns == df.columns and kept.count() == len(ROWS) - 1
    assert scan.without_contaminated(df, items.limit(0)).count() == len(ROWS)
    assert scan.without_contaminated(df.limit(0), items).count() == 0


def test_items_without_id_hit_like_others(spark, tmp_path):
    """The query against its SQL, and the stage of the pipeline."""
    docs = [(1, "only a known passage here"), (2, "an unnamed passage, and a known passage"), (3, "the other unnamed item"),
            (4, "nothing of it"), (5, "an Unnamed PASSAGE")]
    items = [(7, "a known passage"), (None, "an unnamed passage"), (None, "other unnamed item"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    connection = duckdb.connect()
    for name in ("documents", "benchmark"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    entry = ENTRIES["op7_benchmark_scan"]
    result = compare(spark, connection, str(tmp_path), entry.run, entry.sql)
    assert result["ok"] and result["rows"] == len(docs), result
    flags = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in entry.run(spark, str(tmp_path)).collect()}
    assert flags == {1: (3, 1), 2: (6, 2), 3: (3, 1), 4: (0, 0), 5: (3, 1)}
    assert [r["doc_id"] for r in dict(pipeline.STAGES)["benchmark_decontamination"](spark, df, str(tmp_path)).collect()] == [4]
    benchmark = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    parts = scan.contamination(df, benchmark, unnamed=True, part_bytes=10).collect()
    assert {r["doc_id"]: r["items"] for r in parts} == {1: ["7"], 2: ["7", None], 3: [None], 4: [], 5: [None]}
