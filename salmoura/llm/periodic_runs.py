"""Runs of repeated words, found by string synchronising sets.

A run is a stretch of words with smallest period p (words p apart are identical), at least ``least`` words and ``times``
(4) periods long, that no neighbouring word extends. All runs of all texts of a slice are found together, scale by scale
(t = 4, 8, 16, ...), periods from t to 2t - 1 at scale t:

* Windows of t and 2t words have names, each made of the names of its two halves. A position i is *synchronising* if,
  among the names (as hashes) of the windows of t words that begin at i to i + t, the smallest is the first's or the
  last's. Whether it is depends on its 2t words alone, so equal contexts make equal choices.
* Windows within a region of period t / 4 or less are left out of the choice; any other stretch of t positions holds a
  synchronising one. Those regions are the runs of the smaller scales, so they are known by then; periods of 1 to 3
  are found apart from all that, by comparing the words with themselves shifted.
* A run of period p has, in every p positions, a synchronising one, whose context of 2t > p words occurs next exactly p
  later: an earlier occurrence would give the run a smaller period. So next occurrences of equal contexts propose all
  periods. Proposals that overlap are one stretch; names of halves tell how far it goes on at both ends (by less than
  2t), and stretches of four periods are runs.

Each run is compared word by word before it is reported. Should hashes ever have collided, so that one does not hold, the
texts of the slice are searched by all shifts instead.

Defined results: null, empty and blank texts have no words and no runs, their collapsed text is ''; a row has its own
result however often it is repeated; ids are not read, and further columns are passed on; an empty table gives an empty
result. A long text is handled on its own, in memory proportional to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from salmoura.llm.common import batched, text_slices
from salmoura.llm.shingles import mixed
from salmoura.names import col

TIMES = 4   # periods of a run, at least
LEAST = 6   # and words
SMALL = 3   # periods found by shifts
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words as numbers, each text closed by a number of its own; and where each text begins (one more at the end)."""
    numbers: dict[bytes, int] = {}
    joined = []
    for i, words in enumerate(texts):
        joined.extend([numbers.setdefault(w, len(numbers)) for w in words])
        joined.append(-1 - i)
    return np.array(joined, np.int64), np.cumsum([0, *(len(w) + 1 for w in texts)])


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches of True."""
    edges = np.diff(np.concatenate(([False], same, [False])).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _shifted(words: np.ndarray, period: int) -> np.ndarray:
    """Stretches of at least four times ``period``: begin, end, period a row."""
    begin, end = _stretches(words[period:] == words[:-period])
    far = end - begin >= (TIMES - 1) * period
    return np.stack([begin[far], end[far] + period, np.full(int(far.sum()), period)], axis=1)


def _smallest(found: np.ndarray) -> np.ndarray:
    """Of stretches with the same begin and end, the one of the smallest period (the others are its multiples)."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[first]


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` (a power of two) values from each place on."""
    size = 1
    while size < width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    return values


def _synchronising(names: np.ndarray, left_out: np.ndarray, t: int, length: int) -> np.ndarray:
    """The synchronising positions, given the names of the windows of ``t`` words."""
    if length < 2 * t:
        return np.empty(0, np.int64)
    order = mixed(names ^ _TWO)
    order[left_out[: len(order)]] = _NONE
    lowest = np.minimum(_least_of(order, t)[: length - 2 * t + 1], order[t : length - t + 1])
    return np.flatnonzero((lowest != _NONE) & ((lowest == order[: length - 2 * t + 1]) | (lowest == order[t : length - t + 1])))


def _proposed(positions: np.ndarray, contexts: np.ndarray, t: int) -> np.ndarray:
    """Stretches (begin, end, period) on which next occurrences of equal contexts agree, periods from t to 2t - 1."""
    order = np.argsort(contexts, kind="stable")  # positions ascend among equal contexts
    at, name = positions[order], contexts[order]
    period = np.diff(at)
    fits = (name[1:] == name[:-1]) & (period >= t) & (period < 2 * t)
    begin, period = at[:-1][fits], period[fits]
    order = np.lexsort((begin, period))
    begin, period = begin[order], period[order]
    if not len(begin):
        return np.empty((0, 3), np.int64)
    new = np.ones(len(begin), bool)
    new[1:] = (np.diff(period) != 0) | (np.diff(begin) > 2 * t)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    return np.stack([begin[first], begin[last] + 2 * t + period[first], period[first]], axis=1)


def _extended(found: np.ndarray, names: list[np.ndarray], length: int) -> np.ndarray:
    """``found`` as far as its periods go on at both ends, by the names of windows of 1, 2, 4, ... words."""
    begin, end, period = found.T.copy()
    for power in range(len(names) - 1, -1, -1):
        size, of = 1 << power, names[power]
        room = begin >= size
        a = np.where(room, begin - size, 0)
        begin = np.where(room & (of[a] == of[np.minimum(a + period, len(of) - 1)]), a, begin)
        room = end + size <= length
        b = np.where(room, end, 0)
        c = np.where(room, end - period, 0)
        end = np.where(room & (of[np.minimum(b, len(of) - 1)] == of[c]), end + size, end)
    return np.stack([begin, end, period], axis=1)


def _by_scales(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All stretches of four periods and more (begin, end, period), by synchronising sets."""
    runs = _smallest(np.concatenate([_shifted(words, p) for p in range(1, SMALL + 1) if len(words) > p] or [np.empty((0, 3), np.int64)]))
    sizes = np.diff(starts)
    names = [mixed(words.view(np.uint64) ^ _ONE)]
    place = None  # of the words still looked at: texts too short for a scale are taken out
    t = 1
    while True:
        while t < SMALL + 1:
            names.append(_doubled(names[-1], t))
            t *= 2
        long_ = sizes > TIMES * t
        if not long_.any():
            return runs
        if not long_.all():
            keep = np.repeat(long_, sizes)
            place = np.flatnonzero(keep) if place is None else place[keep]
            sizes = sizes[long_]
            # what is named across the gap of a text taken out would be wrong, and so are names from their halves
            names = names[:1]
            names[0] = names[0][keep]
            size = 1
            while size < t:
                names.append(_doubled(names[-1], size))
                size *= 2
        length = int(sizes.sum())
        known = runs
        if place is not None:
            first = np.searchsorted(place, runs[:, 0])
            inside = (first < len(place)) & (place[np.minimum(first, len(place) - 1)] == runs[:, 0])
            known = np.stack([first, first + runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)[inside]
        periodic = known[(known[:, 2] * TIMES <= t) & (known[:, 1] - known[:, 0] >= t)]
        change = np.zeros(length + 1, np.int64)
        np.add.at(change, periodic[:, 0], 1)
        np.add.at(change, periodic[:, 1] - t + 1, -1)
        positions = _synchronising(names[-1], np.cumsum(change[:-1]) > 0, t, length)
        names.append(_doubled(names[-1], t))  # of 2t words
        found = _proposed(positions, names[-1][positions], t)
        found = _extended(found, names[:-1], length)
        found = found[found[:, 1] - found[:, 0] >= TIMES * found[:, 2]]
        if place is not None:
            begin = place[found[:, 0]]
            found = np.stack([begin, begin + found[:, 1] - found[:, 0], found[:, 2]], axis=1)
        runs = _smallest(np.concatenate([runs, found]))
        t *= 2


def _doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Names of windows of twice the ``size`` that ``names`` are of."""
    if len(names) <= size:
        return names[:0]
    return mixed(names[:-size] * _ONE + mixed(names[size:] ^ _TWO))


def _by_shifts(words: np.ndarray) -> np.ndarray:
    return _smallest(np.concatenate([np.empty((0, 3), np.int64), *(_shifted(words, p) for p in range(1, len(words) // TIMES + 1))]))


def _hold(words: np.ndarray, runs: np.ndarray) -> bool:
    """Whether each run repeats word by word and ends where it must."""
    for begin, end, period in runs.tolist():
        if (words[begin : end - period] != words[begin + period : end]).any():
            return False
        if begin and words[begin - 1] == words[begin - 1 + period] or end < len(words) and words[end] == words[end - period]:
            return False
    return True


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> Iterator[np.ndarray]:
    """For each text (a list of words) its runs: start, length, period a row, by start, then period."""
    words, starts = _numbered(texts)
    runs = _by_scales(words, starts)
    if not _hold(words, runs):
        runs = _by_shifts(words)
    runs = runs[runs[:, 1] - runs[:, 0] >= least]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    first = np.searchsorted(runs[:, 0], starts)
    for i in range(len(texts)):
        own = runs[first[i] : first[i + 1]]
        yield np.stack([own[:, 0] - starts[i], own[:, 1] - own[:, 0], own[:, 2]], axis=1)


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run contains after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def with_runs(documents: DataFrame, *, text: str = "text", least: int = LEAST) -> DataFrame:
    """Columns of ``documents`` as _0, _1, ..., then ``__runs`` (start, length, period; by start, then period) and ``__collapsed``."""
    body = documents.columns.index(text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, body):
            raw = pc.fill_null(batch.column(body).cast(pa.binary()), b"").to_pylist()
            texts = [t.split() for t in raw]  # of bytes: at blanks and the controls 9 to 13
            found = list(runs_of(texts, least))
            flat = np.concatenate([np.empty((0, 3), np.int64), *found])
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            each = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUNS.value_type))
            kept = pa.array([collapsed(*x) for x in zip(texts, found)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), each), kept],
                names=[*batch.schema.names, "__runs", "__collapsed"],
            )

    plain = documents.select(*[col(c).alias(f"_{i}") for i, c in enumerate(documents.columns)])
    schema = ", ".join([*(f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(documents.schema)),
                        "__runs array<struct<start:bigint,length:bigint,period:bigint>>", "__collapsed string"])
    return batched(plain).mapInArrow(find, schema)
