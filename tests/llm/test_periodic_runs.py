import hashlib
import random
import zlib

import pytest
from odd_tables import ROWS, documents

from salmoura.llm import periodic_runs
from salmoura.llm.entries import ENTRIES


def brute(words):
    """Runs (start, length, period) by all shifts."""
    found, n = {}, len(words)
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def without(words, runs):
    out = {i for s, length, p in runs for i in range(s + p, s + length)}
    return [w for i, w in enumerate(words) if i not in out]


def text(rng):
    letters = rng.choice([1, 2, 3, 5, 60])
    words = []
    for _ in range(rng.randint(0, 6)):
        kind = rng.random()
        if kind < 0.4:
            words += [b"%d" % rng.randrange(letters) for _ in range(rng.randint(0, 30))]
        elif kind < 0.8:
            p = rng.randint(1, 40)
            unit = [b"%d" % rng.randrange(rng.choice([1, 2, letters])) for _ in range(p)]
            words += (unit * 12)[: rng.randint(0, 11 * p)]
        else:
            words += words[-rng.randint(1, 60):] * rng.randint(1, 6)
    return words[:1500]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed, monkeypatch):
    monkeypatch.setattr(periodic_runs, "_by_shifts", None)  # nothing may fall back to it
    rng = random.Random(seed)
    texts = [text(rng) for _ in range(60)]
    for words, runs in zip(texts, periodic_runs.runs_of(texts)):
        assert [tuple(r) for r in runs.tolist()] == brute(words)
        assert periodic_runs.collapsed(words, runs) == b" ".join(without(words, brute(words)))


def test_words_of_much_structure():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 900:
        a, b = b, b + a
    thue = [b"ab"[bin(i).count("1") % 2 :][:1] for i in range(1024)]
    inner = ([b"a"] * 9 + [b"b"]) * 7 + [b"c"]  # runs inside of runs
    for words in (b, b * 5, thue, thue * 4, inner * 6, [b"x"] * 700):
        assert [tuple(r) for r in next(iter(periodic_runs.runs_of([words]))).tolist()] == brute(words)


def test_colliding_names_are_noticed(monkeypatch):
    words = [b"%d" % (i % 7) for i in range(90)] + [b"x", b"y"]
    monkeypatch.setattr(periodic_runs, "_extended", lambda found, names, length: found + [[0, 1, 0]])
    assert [tuple(r) for r in next(iter(periodic_runs.runs_of([words]))).tolist()] == brute(words)


def test_synchronising_positions_are_consistent_and_dense():
    import numpy as np

    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 3000)
    words[1000:1800] = words[200:1000]
    names, t = periodic_runs.mixed(words.view(np.uint64)), 1
    while t < 16:
        names, t = periodic_runs._doubled(names, t), 2 * t
    found = set(periodic_runs._synchronising(names, np.zeros(len(words), bool), t, len(words)).tolist())
    for i in range(200, 1000 - 2 * t):
        assert (i in found) == (i + 800 in found)
    assert max(b - a for a, b in zip(sorted(found), sorted(found)[1:])) <= t


def expected(doc_id, body):
    words = (body or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join("%d,%d,%d\n" % r for r in runs).encode()), sha(b" ".join(without(words, runs))))


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, b" ".join(text(rng)[:400]).decode().replace("1 ", "1\t\x0b ").replace("2 ", "2\xa0é\x1c ") + "\n") for i in range(-5, 180)]
    rows += [(r[0], r[1][:3000] if r[1] else r[1]) for r in ROWS] + [(10**12, "a b " * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in ENTRIES["op13_periodic_runs"].run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_odd_rows(spark):
    df = documents(spark).selectExpr("*", "'x' AS __runs", "1 AS _0")
    found = periodic_runs.with_runs(df)
    rows = found.collect()
    assert len(rows) == len(ROWS) and found.columns[: len(df.columns)] == [f"_{i}" for i in range(len(df.columns))]
    for r in rows:
        words = (r["_1"] or "").encode().split()
        if len(words) < 3000:
            assert [tuple(x) for x in r[len(df.columns)]] == brute(words)
    assert periodic_runs.with_runs(df.limit(0)).count() == 0
