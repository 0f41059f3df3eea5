import zlib

import numpy as np
from odd_tables import ROWS, documents

from salmoura.llm import quality


def bags(seed, n):
    """Texts of several passages; a bad text has one bad passage among good ones."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        parts = [" ".join("abcdefgh"[k] * int(rng.integers(1, 7)) for k in rng.integers(0, 8, 90)) for _ in range(3)]
        bad = i % 2 == 0
        if bad:
            parts[rng.integers(0, 3)] = " ".join("ab"[k] * 3 + "$$$" for k in rng.integers(0, 2, 90))
        texts.append("\n".join(parts))
        labels.append(0.0 if bad else 1.0)
    return texts, np.array(labels)


def test_attention_finds_the_passage_that_tells():
    texts, labels = bags(1, 200)
    model = quality.train(*quality.passages(texts), labels)
    others, truth = bags(2, 200)
    scores = model.scores(*quality.passages(others))
    assert ((scores >= 0.5) == truth).mean() > 0.97
    assert ((scores >= 0) & (scores <= 1)).all()


def test_gradient():
    rng = np.random.default_rng(3)
    x, first = rng.normal(size=(7, quality.WIDTH)), np.array([0, 2, 3, 7])
    w = {"W": rng.normal(size=(quality.WIDTH, 4)) / 10, "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)),
         "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "d": rng.normal(size=1)}
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality._forward(w, x, first)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    gradient = quality._gradient(w, x, first, y)
    for name, values in w.items():
        at = tuple(0 for _ in values.shape)
        values[at] += 1e-5
        high = loss()
        values[at] -= 2e-5
        low = loss()
        values[at] += 1e-5
        assert abs((high - low) / 2e-5 - gradient[name][at]) < 1e-6, name


def test_features_do_not_depend_on_neighbours():
    texts = ["", None, "A b", "x " * 500, "é, É!", " "]
    together, first = quality.passages(texts)
    for i, text in enumerate(texts):
        alone, _ = quality.passages([text])
        assert np.array_equal(alone, together[first[i] : first[i + 1]]), repr(text)[:20]
    assert first.tolist() == [0, 1, 2, 3, 9, 10, 11]


def test_odd_rows(spark):
    df = documents(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = quality.classified(df, labels).collect()
    assert len(found) == len(ROWS)
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert len({r["score"] for r in found if r["doc_id"] in (1, 2)}) == 1
    none = labels.limit(0)
    assert {r["score"] for r in quality.classified(df, none).collect()} == {0.5}
    assert quality.accepted(df, none).count() == len(ROWS)
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in found)
    assert quality.classified(df.limit(0), labels).count() == 0


def test_held_out_accuracy_on_the_test_tables(spark):
    from pathlib import Path

    import pytest

    folder = "/root/testdata/sf0.01"
    if not Path(folder).is_dir():
        pytest.skip("no test tables here")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality.classified(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    rows = found.filter("held_out").join(labels, "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)
