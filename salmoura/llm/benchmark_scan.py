"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Words are maximal runs of digits, ASCII letters (lower-cased) and non-ASCII characters. An item gives a
window for every ``window`` consecutive words, or one of all its words if it has fewer. The automaton
holds windows as sequences of word numbers, so a match always begins and ends at words, and one pass
over a text finds all of them, overlapping ones included.

Defined results: a null or wordless text has no words, no hits and no items; a null or wordless item has
no windows; items without id are left out, or with ``unnamed`` (as the query and the pipeline have it) hit like all
others and stand as one null, the last, in the list of items: it counts as an item and is not in the digest; repeated items or rows are each reported; an empty benchmark hits nothing; the columns read
are the id and the text, whatever else the tables hold.

The items are read to the driver in parts of at most ``part_bytes`` of text, each broadcast as its own
automaton source; a text passes through the parts one after another without a shuffle. Texts are never
cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from salmoura.llm.common import batched, slices
from salmoura.names import col

WINDOW = 10
PART_BYTES = 32 << 20

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(
    c if c in _KEPT or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # before lower-casing

_HITS = "array<struct<first:bigint,last:bigint>>"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


class Windows:
    """Automaton over the windows of some items."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            seq = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            size = min(window, len(seq))
            for i in range(len(seq) - size + 1 if seq else 0):
                owners.setdefault(tuple(seq[i : i + size]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for seq, ids in owners.items():
            self.automaton.add_word(seq, (len(seq), tuple(ids)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged hit ranges of word positions (last inclusive), and the items that occur."""
        if self.empty or not found:
            return [], set()
        number = self.number
        sequence = tuple([number.get(w, 0) for w in found])
        ranges: list[tuple[int, int]] = []
        items: set[str | None] = set()
        for last, (size, ids) in self.automaton.iter(sequence):
            ranges.append((last - size + 1, last))
            items.update(ids)
        return merged(ranges), items


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted union of inclusive ranges; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


_BUILT: dict[tuple, Windows] = {}


def _windows(shared, key: tuple, window: int) -> Windows:
    if key not in _BUILT:
        if len(_BUILT) > 4:
            _BUILT.clear()
        _BUILT[key] = Windows(shared.value, window)
    return _BUILT[key]


def _null_last(value: str | None) -> tuple[bool, str]:
    return value is None, value or ""


def _scanner(shared, window: int, text_at: int, schema: pa.Schema):
    key = (hashlib.sha256(repr(shared.value).encode()).hexdigest(), window)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(shared, key, window)
        for batch in slices(batches):
            counts, hits, items = [], [], []
            before = zip(batch.columns[-2].to_pylist(), batch.columns[-1].to_pylist())
            for text, (old_hits, old_items) in zip(batch.column(text_at).to_pylist(), before):
                found = words(text)
                ranges, ids = windows.scan(found)
                counts.append(len(found))
                if old_hits:
                    ranges = merged([*ranges, *((h["first"], h["last"]) for h in old_hits)])
                hits.append([{"first": a, "last": b} for a, b in ranges])
                items.append(sorted(ids.union(old_items), key=_null_last))
            added = [pa.array(x, f.type) for x, f in zip((counts, hits, items), list(schema)[-3:])]
            columns = [*batch.columns[:-3], *added]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return scan


def parts_of(
    benchmark: DataFrame, item: str, text: str, part_bytes: int, unnamed: bool = False
) -> Iterator[list[tuple[str | None, str]]]:
    """Items in parts of about ``part_bytes``, each small enough for the driver and a broadcast."""
    items = benchmark.select(col(item).cast("string").alias("item"), col(text).alias("text")).filter(
        (F.col("item").isNotNull() | F.lit(unnamed)) & F.col("text").isNotNull()
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // part_bytes) or 1
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).distinct().collect()
        yield sorted(((r["item"], r["text"]) for r in rows), key=lambda row: (_null_last(row[0]), row[1]))


def contamination(
    documents: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
    part_bytes: int = PART_BYTES, unnamed: bool = False, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: id, text (and ``keep``), n_words, hits (ranges of word positions), items."""
    spark = documents.sparkSession
    kept = [doc_id, text, *keep]
    found = documents.select(
        *[col(c) for c in kept], F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast(_HITS).alias("hits"),
        F.array().cast("array<string>").alias("items"),
    )
    for part in parts_of(benchmark, item_id, item_text, part_bytes, unnamed):
        schema = _arrow_schema(found)
        found = batched(found).mapInArrow(
            _scanner(spark.sparkContext.broadcast(part), window, 1, schema), found.schema
        )
    return found


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def hit_characters(text: str, hits: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges as (start, end) code points of the original text."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[first][0], at[last][1]) for first, last in hits]


def flagged(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document: counts, digest of the items found, and whether any word is hit."""
    n_hit = F.aggregate(
        "hits", F.lit(0).cast("bigint"), lambda n, h: n + h["last"] - h["first"] + 1
    )
    return found.select(
        col(doc_id), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``documents`` that no benchmark window occurs in, with their own columns.

    Rows are judged by their own text, so the filter is one pass without a join.
    """
    text = options.pop("text", "text")
    others = tuple(c for c in documents.columns if c != text)
    first, *rest = others
    named = documents.select(
        col(text).alias("_t0"), *[col(c).alias(f"_c{i}") for i, c in enumerate(others)]
    )
    found = contamination(
        named, benchmark, doc_id="_c0", text="_t0",
        keep=tuple(f"_c{i + 1}" for i in range(len(rest))), **options,
    ).filter(F.size("hits") == 0)
    back = {c: F.col(f"_c{i}").alias(c) for i, c in enumerate(others)} | {text: F.col("_t0").alias(text)}
    return found.select(*[back[c] for c in documents.columns])
