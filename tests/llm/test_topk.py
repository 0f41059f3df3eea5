import math
import random

import pytest

from salmoura.llm import topk, vectors

KIND = "vec_id long, embedding array<float>, label int, score long, block long, state int"


def rows_of(rows, spark):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], KIND)


def whole(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [math.floor(scale * x) for x in v]


def brute(queries, candidates, k, scale=64):
    known = [(i, w) for i, v in candidates if i is not None and (w := whole(v, scale)) is not None]
    out = []
    for q, v in queries:
        v = whole(v, scale)
        if q is None or v is None:
            continue
        best = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, w in known if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(spark, queries, candidates, **options):
    result = topk.nearest(rows_of(queries, spark), rows_of(candidates, spark), **options)
    assert result.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in result.collect())


@pytest.mark.parametrize("hot", [0.0, 0.5])
def test_equals_brute_force(spark, hot, monkeypatch):
    """Small grids of many cells; half of all rows one and the same vector; coarse values, so ties everywhere."""
    monkeypatch.setattr(vectors, "LEAST", 40)
    rng = random.Random(3)
    one = [0.25, -0.5, 0.125]
    rows = [(i, one if rng.random() < hot else [rng.randrange(-8, 8) / 16 for _ in range(3)]) for i in range(400)]
    rng.shuffle(rows)
    queries = [r for r in rows if r[0] % 20 == 0]
    assert found(spark, queries, rows, k=20) == brute(queries, rows, 20)


def test_wide_ranges_take_more_rounds(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.randint(0, 5) for _ in range(4)]) for i in range(120)]
    rows = [(i, [float(__import__("numpy").float32(x)) for x in v]) for i, v in rows]
    assert found(spark, rows[:9], rows, k=5) == brute(rows[:9], rows, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, []), (None, [1.0, 1.0]),
            (7, [1.0, 2.0]), (7, [1.0, 2.0]), (8, [0.0, 0.0]), (9, [1.0, 2.0, 3.0]), (-20, [-1.0, -2.0]), (10, [0.015, -0.001])]
    assert found(spark, rows, rows, k=3) == brute(rows, rows, 3)
    assert found(spark, rows[:1], rows, k=50) == brute(rows[:1], rows, 50)  # fewer than k
    assert found(spark, [], rows) == [] and found(spark, rows, []) == []


def test_products_too_large_for_doubles_are_exact_and_beyond_64_bits_an_error(spark):
    big = float(2**27) + 16
    rows = [(1, [big, 1.0]), (2, [big - 16, 3.0]), (3, [big, 2.0]), (4, [1.0, 1.0])]
    assert found(spark, rows, rows, k=2, scale=1) == brute(rows, rows, 2, scale=1)
    with pytest.raises(Exception, match="beyond what whole 64-bit numbers hold"):
        found(spark, [(1, [1e20])], [(2, [1e20])])
