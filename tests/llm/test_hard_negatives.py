import math
import random

import numpy as np
import pytest

from salmoura.llm import hard_negatives, vectors

KIND = "vec_id long, embedding array<float>, label int, rank int, w int, bucket int, positive_id long"


def rows_of(rows, spark):
    return spark.createDataFrame([(i, v, label, 1, 2, 3, 4) for i, v, label in rows], KIND)


def usable(rows, scale=256):
    return [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
            if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]


def brute(anchors, rows, positives=5, negatives=10):
    rows, out = usable(rows), []
    for a, v, label in usable(anchors):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, w, other in rows if i != a)
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(a, pid, rank, s[1], -p, -s[0]) for rank, s in enumerate(fits, 1)]
    return sorted(out)


def found(spark, anchors, rows):
    result = hard_negatives.mined(rows_of(anchors, spark), rows_of(rows, spark))
    assert result.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in result.collect())


@pytest.mark.parametrize("kind", ["spread", "clustered", "one vector", "coarse"])
def test_equals_brute_force(spark, kind, monkeypatch):
    """Lengths that differ, directions near a few centres (where ranges prune), a hot vector, ties."""
    monkeypatch.setattr(vectors, "LEAST", 60)
    rng = np.random.default_rng(5)
    n, dim = 500, 6
    if kind == "clustered":
        centres = rng.normal(size=(12, dim))
        v = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.15
        v *= rng.choice([0.2, 0.7, 1, 1.5], n)[:, None]
    else:
        v = rng.normal(size=(n, dim)) * rng.uniform(0.1, 2, n)[:, None]
    if kind == "one vector":
        v[rng.random(n) < 0.4] = v[0]
    if kind == "coarse":
        v = np.round(v)
    labels = rng.integers(0, 3, n)
    rows = [(int(i), [float(np.float32(x)) for x in v[i]], int(labels[i])) for i in rng.permutation(n)]
    anchors = [r for r in rows if r[0] % 25 == 0]
    assert found(spark, anchors, rows) == brute(anchors, rows)


def test_ranges_prune_and_lose_nothing():
    """Every vector above the threshold is among the feasible pairs, and few others are where directions cluster."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 8))
    centres /= np.sqrt((centres**2).sum(axis=1))[:, None]
    data = np.floor(256 * (centres[rng.integers(0, 40, 2000)] + 0.05 * rng.normal(size=(2000, 8))))
    lengths = np.sqrt((data**2).sum(axis=1))
    orders = np.argsort(data / lengths[:, None], axis=0).T.astype(np.uint16)
    chunk = hard_negatives.Chunk(vectors.block_row(1, np.arange(2000), np.zeros(2000, np.int64), data) | {"orders": orders.tobytes()})
    anchors = data[:20]
    reach = 0.9 * lengths[:20] * lengths.max()
    which, at = chunk.feasible(anchors, lengths[:20], reach)
    pairs = set(zip(which.tolist(), at.tolist()))
    true = {(i, j) for i, j in zip(*np.nonzero(anchors @ data.T >= reach[:, None]))}
    assert true and true <= pairs and len(pairs) < 20 * 2000 / 16
    whole = {(i, j) for i in range(20) for j in range(2000)}
    for share in (-0.5, 0.0, 0.5, 0.999):  # negative thresholds too
        some = chunk.feasible(anchors, lengths[:20], share * lengths[:20] * lengths.max())
        some = whole if some is None else set(zip(some[0].tolist(), some[1].tolist()))
        assert {(i, j) for i, j in zip(*np.nonzero(anchors @ data.T >= share * lengths[:20, None] * lengths.max()))} <= some


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0, 1.9], 1), (2, None, 1), (3, [nan, 1.0], 2), (4, [inf, 1.0], 2), (5, [None, 1.0], 2),
            (6, [], 2), (None, [1.0, 1.0], 2), (7, [0.5, 1.0], 2), (7, [0.5, 1.0], 2), (8, [0.0, 0.0], 2), (9, [0.5, 1.0, 3.0], 3),
            (10, [0.5, 1.0], None), (11, [-1.0, -2.0], 1), (12, [0.0, 0.0], 1), (13, [0.6, 0.9], 3)]
    assert found(spark, rows, rows) == brute(rows, rows)
    assert found(spark, [], rows) == [] and found(spark, rows, []) == []
