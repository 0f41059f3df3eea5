import zlib
from collections import Counter, defaultdict

import pytest
from odd_tables import ROWS, documents
from pyspark.sql import functions as F

from salmoura.llm import shards


@pytest.mark.parametrize("count", [1, 2, 16, 200])
def test_growing_takes_rows_only_into_the_new_shard(spark, count):
    df = spark.range(4000).select(
        shards.jump(F.xxhash64("id"), count).alias("now"), shards.jump(F.xxhash64("id"), count + 1).alias("then"),
        shards.jump(F.xxhash64("id"), count, 3).alias("two_loops"),
    )
    rows = df.collect()
    assert all(r["now"] == r["two_loops"] and 0 <= r["now"] < count for r in rows)
    moved = [r for r in rows if r["now"] != r["then"]]
    assert all(r["then"] == count for r in moved)
    expected = 4000 / (count + 1)
    assert abs(len(moved) - expected) < 5 * expected**0.5
    sizes = Counter(r["now"] for r in rows)
    assert max(sizes.values()) < 4000 / count + 6 * (4000 / count) ** 0.5


def test_odd_rows_and_slots(spark):
    df = documents(spark)
    found = shards.sharded(df, 3, parts=2).collect()
    assert len(found) == len(ROWS)
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 3) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in found if r["doc_id"] == 2}) == 1
    expected = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    assert shards.sharded(df.limit(0)).count() == 0
