import random
from itertools import combinations

import numpy as np
import pytest
from odd_tables import PROSE, ROWS, documents

from salmoura.llm import near_dup
from salmoura.llm.shingles import shingle_sets


def sets(text, words):
    found = (text or "").encode().lower().split()
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def brute(rows, words, percent=80):
    """Component of each row by comparing all pairs."""
    found = [(i, sets(t, words)) for i, t in rows]
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        x, y = found[a][1], found[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            old, new = sorted((group[a], group[b]))[::-1]
            group = [new if g == old else g for g in group]
    first = {}
    for (i, _), g in zip(found, group):
        first[g] = min(first.get(g, i), i)
    return {i: (len(s), first[g]) for (i, s), g in zip(found, group)}


def corpus(seed, n=220):
    """Chains of edits: texts near their neighbour in the chain, not always near its first."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    rows, at = [], 0
    while len(rows) < n:
        text = [word() for _ in range(rng.choice([1, 2, 3, 8, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6, 15])):
            rows.append((at, " ".join(text)))
            at += rng.randint(1, 9)
            for _ in range(max(1, len(text) // rng.choice([12, 20, 60]))):
                text[rng.randrange(len(text))] = word()
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_components_equal_brute_force(spark, words):
    rows = corpus(words)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, words=words).collect()}
    assert found == brute(rows, words)


def test_all_pairs_within_the_distance_share_a_key():
    rng = np.random.default_rng(1)
    signature = near_dup.Signature()
    for distance in (0, 1, 30, signature.distance):
        a = rng.integers(0, 1 << 16, (50, signature.hashes)).astype(np.uint16)
        b = a.copy()
        for row in range(50):
            b[row, rng.permutation(signature.hashes)[:distance]] += 1
        shared = [set(x) & set(y) for x, y in zip(signature.keys(a).tolist(), signature.keys(b).tolist())]
        assert all(shared)


def test_symbols_differ_as_often_as_the_sets():
    texts = [" ".join(f"a{i}" for i in range(400)), " ".join(f"a{i}" for i in range(40, 440))]
    x, y = (near_dup.Signature(hashes=1024).of(s) for s in shingle_sets(texts, 1))
    similarity = 360 / 440
    assert abs((x == y).mean() - similarity) < 0.05


def test_shingle_sets_count_like_tuples():
    texts = ["A b a B", "a", "", None, "x\x1cy z", "É é", "p\x0bq\tr  s\n"]
    assert [len(s) for s in shingle_sets(texts, 2)] == [len(sets(t, 2)) for t in texts]


def test_odd_rows(spark):
    df = documents(spark)
    found = near_dup.near_duplicates(df).collect()
    assert len(found) == len(ROWS)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by_id[2]] == [1, 1] and not by_id[2][0]["kept"]
    for lonely in (3, 4, 5, 6, 7):
        assert by_id[lonely][0]["component_id"] == lonely and by_id[lonely][0]["kept"]
    assert by_id[4][0]["n_shingles"] == 0 and by_id[6][0]["n_shingles"] == 1
    kept = near_dup.first_of_each(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert near_dup.first_of_each(df.limit(0)).count() == 0


def edited(n, words, edits, seed=1):
    """``n`` copies of one text, each with edits of its own."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for _ in range(rng.choice(edits)):
            text[rng.randrange(words)] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("edits", [[7], [1, 4, 9], [3]])
def test_groups_of_edited_copies_equal_brute_force(spark, edits):
    """Copies that are near the hub, far from it, and both; where all differ too much nothing is linked."""
    rows = edited(120, 150, edits)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df).collect()}
    assert found == brute(rows, 5)


def test_few_pairs_of_edited_copies_are_compared(spark, monkeypatch):
    """All of a group share keys and none is linked: of n (n - 1) / 2 pairs an eighth at most is looked at."""
    compared, confirmed = [], near_dup._confirmed

    def counting(texts, classes, pairs, words, percent):
        compared.append(pairs.count())
        return confirmed(texts, classes, pairs, words, percent)

    monkeypatch.setattr(near_dup, "_confirmed", counting)
    n = 200
    df = spark.createDataFrame(edited(n, 400, [7]), "doc_id long, text string")
    assert near_dup.near_duplicates(df).filter("kept").count() >= n - 2
    assert compared[0] < n and compared[1] < n * (n - 1) / 16


def with_a_common_line(n, seed=1):
    """``n`` texts that begin with one line and go on with words of their own, each with a cut or lengthened copy."""
    rng = random.Random(seed)
    line, rows = [f"c{i}" for i in range(30)], []
    for i in range(0, 2 * n, 2):
        own = [f"w{rng.randint(0, 150)}" for _ in range(rng.randint(20, 60))]
        cut = len(own) - rng.randint(0, len(own) // 2)
        more = [f"w{rng.randint(0, 150)}" for _ in range(rng.choice([0, 0, 3, 9]))]
        rows += [(i, " ".join(line + own)), (i + 1, " ".join(line + own[:cut] + more))]
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_texts_with_a_common_line_equal_brute_force(spark, words):
    rows = with_a_common_line(120, words)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, words=words).collect()}
    assert found == brute(rows, words)


def test_members_that_can_meet_no_other_are_not_ranked(spark, monkeypatch):
    """Texts that share a line with all others and the rest with none; a few have a copy with edits."""
    ranked, written = [], near_dup.written

    def watching(df):
        result = written(df)
        if "order" in df.columns:
            ranked.extend((r["id"], len(r["order"])) for r in result[0].select("id", "order").collect())
        return result

    monkeypatch.setattr(near_dup, "written", watching)
    rng = random.Random(3)
    line, rows = [f"c{i}" for i in range(30)], []
    for i in range(200):
        rows.append((i, line + [f"w{rng.randint(0, 150)}" for _ in range(40)]))
    for i in range(5):
        rows.append((200 + i, [*rows[i][1][:50], f"x{i}", *rows[i][1][51:]]))
    rows = [(i, " ".join(text)) for i, text in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(df, words=2).collect()}
    assert found == brute(rows, 2)
    # all have words of the family that others have too: 7 of 40 in the mean
    assert len(ranked) <= 20 and sum(n for _, n in ranked) <= 400


def test_one_row_of_each_group_stays(spark):
    t, near, u = PROSE + " end of it", PROSE + " end of all", "all other words that nobody else has written down"
    lone = "an entirely different string of words with no id at all"
    rows = [(1, t, "a"), (2, t, "b"), (2, t, "b"), (2, u, "c"), (None, t, "d"), (None, lone, "e"), (None, lone, "e"),
            (4, u, "f"), (5, near, "g"), (6, None, "h"), (6, None, "h"), (None, "", "i"), (None, "", "i"), (7, "lone", "j"), (7, "lone", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, note string")
    stays = sorted((tuple(r) for r in near_dup.first_of_each(df).collect()), key=repr)
    notes = sorted(r[2] for r in stays)
    assert notes[:-1] == ["a", "c", "e", "h", "h", "i", "i"] + (["g"] if "g" in notes else []) and notes[-1] in "jk"
    found = near_dup.near_duplicates(df).collect()
    assert len(found) == len(rows)
    assert {r["component_id"] for r in found if r["doc_id"] == 4} == {2}
    assert {r["component_id"] for r in found if r["doc_id"] is None and r["n_shingles"] == 7} == {None}
