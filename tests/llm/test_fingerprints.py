import hashlib
import random
import re

from odd_tables import LONG, ROWS, documents
from pyspark.sql import functions as F

from salmoura.llm import fingerprints as fp


def shingles(text, words=5):
    found = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if w]
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_next_and_edited_texts_equal_brute_force(spark):
    rows = [(i * i * 37 % 1009 - 300, f"text {i} " * (i % 9) + "é🎉"[: i % 3]) for i in range(300)]
    rows = list(dict(rows).items())
    rows.append((9_007_199_254_740_993, "an id that a double cannot hold"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: r for r in fp.fingerprinted(df).collect()}
    assert len(found) == len(rows)
    rows.sort(reverse=True)
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = found[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == 1.0 or text != edited


def test_estimates_of_long_texts(spark):
    part = " ".join(LONG.split()[:6000])
    df = spark.createDataFrame([(LONG, part)], "a string, b string").select(
        fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b")
    )
    row = df.select(
        fp.likeness(F.col("a"), F.col("b")), fp.containment(F.col("b"), F.col("a")), F.col("a.scale"),
        F.size("a.hashes"), fp.likeness(F.col("a"), fp.merge(F.col("a"), F.col("b"))),
    ).first()
    a, b = shingles(LONG), shingles(part)
    assert abs(row[0] - likeness(a, b)) < 0.05 and row[1] == 1.0 and row[2] == fp.SCALE and row[4] == 1.0
    assert abs(row[3] / len(a) - 1 / fp.SCALE) < 0.02


def test_one_fraction_for_texts_of_every_length(spark):
    """Hashes kept are a quarter of the shingles at every length, and estimates err as the docstring says."""
    rng = random.Random(2)
    rows = []
    for i, n in enumerate([60, 200, 256, 257, 400, 1500, 6000] * 12):
        a = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        b = a[: n // 2] + [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([n // 2, 10 * n]))]
        rows.append((i, n, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "id long, n long, a string, b string").select("id", "n", "a", "b", fp.sketch(F.col("a")).alias("x"), fp.sketch(F.col("b")).alias("y"))
    found = df.select("n", "a", "b", F.size("x.hashes").alias("kept"), fp.likeness(F.col("x"), F.col("y")).alias("near"),
                      fp.containment(F.col("x"), F.col("y")).alias("held")).collect()
    wrong = []
    for r in found:
        a, b = shingles(r["a"]), shingles(r["b"])
        held = len(a & b) / len(a)
        wrong.append((r["held"] - held) / (held * (1 - held) * fp.SCALE / len(a)) ** 0.5)
        assert abs(r["near"] - likeness(a, b)) < 5 * (0.25 * fp.SCALE / len(a)) ** 0.5
    assert sum(w * w for w in wrong) / len(wrong) < 2 and max(map(abs, wrong)) < 5
    for n in {r["n"] for r in found}:
        some = [r["kept"] / r["n"] for r in found if r["n"] == n]
        assert abs(sum(some) / len(some) - 1 / fp.SCALE) < 4 * (0.1875 / n / len(some)) ** 0.5


def test_odd_rows(spark):
    df = documents(spark)
    found = fp.fingerprinted(df).collect()
    assert len(found) == len(ROWS)
    prints = {}
    for r in found:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[1] == prints[2] and len(prints[1]) == 1 and prints[3] == prints[4] == prints[5] == {f"{fp.SCALE}:"}
    assert prints[1] < prints[None]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert fp.fingerprinted(df.limit(0)).count() == 0
    alone = fp.fingerprinted(spark.createDataFrame([(5, "a b")], "doc_id long, text string")).first()
    assert alone["near_next"] == 1.0
