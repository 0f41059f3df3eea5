"""Records of delimited text files whose quoted cells may hold line breaks, read by many tasks.

A line break ends a record unless it stands inside a quoted cell, and whether it does depends on all lines before. A line turns
"outside at its begin" and "inside at its begin" each into one of the two at its end: it keeps the state, swaps it, or sets
it whatever it was (a quote within an unquoted cell swaps nothing). The state before a line is the one last set, swapped as
often as lines since then swap; a whole split is a line of that kind, too.

So files are read by their splits, twice, each time in the task that reads the split and without sending lines to another:

1. A split tells how it ends for either begin, whether a record begins in it, and its head, the lines before the first
   record if it begins inside. That is one row a split; put in order, they tell how each split begins.
2. A split cuts its lines into records. The heads of the splits that follow are joined to the last record before them.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPLIT = ["file", "block"]
SHORT = 4096  # bytes of a split's head up to which it is joined to its record without a join of tables


@dataclass(frozen=True)
class Facts:
    """What a pass over the raw lines tells: whether all are UTF-8, and whether some quoted cell reaches over its line."""
    utf8: bool
    open_cells: bool


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file, the begin of their split, and numbers that ascend in it."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value",
    )


def _text(utf8: bool) -> Column:
    return F.col("value") if utf8 else F.decode(F.col("value").cast("binary"), "ISO-8859-1")


def _opens(line: Column) -> Column:
    """Whether a line (without doubled quotes) that begins outside of quotes opens a cell and does not close it."""
    rest = F.regexp_replace(line, r'(^|,)"[^"]*"(?=,|\r?$)', "$1")
    return rest.rlike(r'(^|,)"')


def _with_ends(lines: DataFrame) -> DataFrame:
    """Add the state (1: inside) at the end of a line that begins outside, ``_o``, and of one that begins inside, ``_i``.
    Lines with no quote, or with one, need no regular expression."""
    named = [*lines.columns]
    lines, none, one, opens = _quotes(lines)
    inside = F.when(none, 1).when(one, 0).otherwise(_opens(F.concat(F.lit("x"), F.col("_after"))).cast("int"))
    return lines.select(*named, opens.cast("byte").alias("_o"), inside.cast("byte").alias("_i"))


def _quotes(lines: DataFrame) -> tuple[DataFrame, Column, Column, Column]:
    """Lines with what stands ``_after`` their first quote; whether they have none or one, doubled ones aside; and whether
    they open a cell, begun outside of quotes, and do not close it."""
    line, first = F.col("_line"), F.col("_first")
    # a select each: what the next one uses several times is worked out once
    lines = lines.select("*", F.replace("value", F.lit('""'), F.lit("")).alias("_line"))
    lines = lines.select("*", F.instr(line, '"').alias("_first"))
    lines = lines.select("*", F.substring(line, first + 1, F.length(line)).alias("_after"))
    none, one = first == 0, ~F.contains("_after", F.lit('"'))
    begins = (first == 1) | (F.substring(line, first - 1, F.lit(1)) == ",")
    return lines, none, one, F.when(none, False).when(one, begins).otherwise(_opens(line))


def facts(spark: SparkSession, *paths: str) -> list[Facts]:
    """What each of the paths holds, by one pass over all of them."""
    line = F.col("value")
    lines = reduce(DataFrame.union, [spark.read.text(path).select(F.lit(i).alias("at"), "value") for i, path in enumerate(paths)])
    # quotes are looked for character by character: not before invalid text has been made valid
    lines, _, _, opens = _quotes(lines.select("at", F.is_valid_utf8(line).alias("valid"), F.make_valid_utf8(line).alias("value")))
    seen = {r["at"]: r for r in lines.groupBy("at").agg(
        F.bool_and("valid").alias("valid"), F.bool_or(opens).alias("open")).collect()}  # a row a path
    return [Facts(i not in seen or seen[i]["valid"] is not False, i in seen and bool(seen[i]["open"])) for i in range(len(paths))]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int] | None, pa.RecordBatch | None]]:
    """The rows of each split in turn, in parts; ``None`` for the part ends the split."""
    at = None
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        names = pc.fill_null(pc.not_equal(batch.column("file")[1:], batch.column("file")[:-1]), False)
        new = (blocks[1:] != blocks[:-1]) | names.to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:]):
            key = (batch.column("file")[low].as_py(), int(blocks[low]))
            if at is not None and key != at:
                yield at, None
            at = key
            yield key, batch.slice(low, high - low)
    if at is not None:
        yield at, None


def _before(part: pa.RecordBatch, state: int) -> tuple[np.ndarray, int]:
    """State before each line of a part that begins in ``state``, and the state after it."""
    out, inside = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_o", "_i"))
    sets, swaps = out == inside, np.cumsum((out > inside).astype(np.int64))
    last = np.maximum.accumulate(np.where(sets, np.arange(len(out)), -1))
    after = np.where(last < 0, state + swaps, out[last] + swaps - swaps[last]) % 2
    return np.concatenate([[state], after[:-1]]), int(after[-1])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a split: its end for either begin, whether records begin in it if it begins inside, its head for that case, and
    the first record of a file if it ends in its split."""
    ends, begins, head, first, more = [0, 1], False, [], [], 0
    for key, part in _runs(batches):
        if part is not None:
            states, ends[0] = _before(part, ends[0])
            if not key[1] and more < 2:
                at = np.flatnonzero(states == 0)[:2 - more]
                more += at.size
                first += part.column("value").slice(0, int(at[-1]) if more == 2 else part.num_rows).to_pylist()
            states, ends[1] = _before(part, ends[1])
            if not begins:
                at = np.flatnonzero(states == 0)
                begins = at.size > 0
                head += part.column("value").slice(0, int(at[0]) if begins else part.num_rows).to_pylist()
            continue
        yield pa.RecordBatch.from_pylist([{
            "file": key[0], "block": key[1], "end0": ends[0], "end1": ends[1], "begins": begins, "head": "\n".join(head),
            "first": "\n".join(first) if more == 2 or not (key[1] or ends[0]) else None,
        }], TOLD)
        ends, begins, head, first, more = [0, 1], False, [], [], 0


TOLD = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("end0", pa.int32()), ("end1", pa.int32()), ("begins", pa.bool_()), ("head", pa.string()),
    ("first", pa.string()),
])
RECORDS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("text", pa.string()), ("last", pa.bool_())])


def _cut(starts: dict[tuple[str, int], int], tails: dict[tuple[str, int], str]):
    """Step 2: the records of each split, the last one with its tail. ``last`` marks those that a longer tail belongs to."""
    def rows(key: tuple[str, int], n: int, texts: pa.Array) -> pa.RecordBatch:
        size = len(texts)
        return pa.RecordBatch.from_arrays([
            pa.array([key[0]]).take(pa.array(np.zeros(size, np.int64))), pa.array(np.full(size, key[1], np.int64)),
            pa.array(np.arange(n, n + size, dtype=np.int64)), texts, pa.array(np.zeros(size, bool)),
        ], schema=RECORDS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, n, held = None, 0, []  # lines of the record that goes on
        for key, part in _runs(batches):
            if part is not None:
                if state is None:
                    if key not in starts:  # the cluster has grown in between and files are split another way
                        raise ValueError(f"the splits of {key[0]} have changed while it was read: read it again")
                    state = starts[key]
                states, state = _before(part, state)
                first, values = np.flatnonzero(states == 0), part.column("value")
                if not first.size:
                    held += values.to_pylist() if n else []
                    continue
                if n:
                    yield rows(key, n, pa.array(["\n".join(held + values.slice(0, int(first[0])).to_pylist())]))
                if first.size > 1:
                    lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), values)
                    yield rows(key, n + 1, pc.binary_join(lists, "\n"))
                n, held = n + int(first.size), values.slice(int(first[-1])).to_pylist()
                continue
            if n:
                tail = [tails[key]] if key in tails else []
                end = rows(key, n, pa.array(["\n".join(held + tail)]))
                yield end.set_column(4, RECORDS.field("last"), pa.array([True]))
            state, n, held = None, 0, []

    return cut


def records(spark: SparkSession, path: str, utf8: bool = True, skip: int = 0) -> tuple[DataFrame, list[str]]:
    """The records of the files at ``path``: file, block, n (place in the split, from 1), text; and the different texts that
    are the first record of a file. ``skip`` lines at the head of a single file are no records. Blank records are left out,
    but for the first of a file."""
    lines = _raw(spark, path)
    if skip:
        top = lines.limit(skip).collect()
        last = max((r["row"] for r in top), default=-1)
        lines = lines.filter((F.col("block") > 0) | (F.col("row") > last))
    lines = _with_ends(lines.select(*SPLIT, _text(utf8).alias("value")))
    told = lines.mapInArrow(_told, "file string, block bigint, end0 int, end1 int, begins boolean, head string, first string")
    short = F.octet_length("head") <= SHORT
    seen = told.select(
        *SPLIT, "end0", "end1", "begins", short.alias("short"), F.when(short, F.col("head")).alias("head"),
        F.when(F.octet_length("first") <= SHORT, F.col("first")).alias("first"),
    ).collect()
    starts: dict[tuple[str, int], int] = {}
    tails: dict[tuple[str, int], list[str]] = {}
    owners, owner, file = [], None, None
    long: set[tuple[str, int]] = set()  # records whose tails are joined as tables
    for r in sorted(seen, key=lambda r: (r["file"], r["block"])):  # a row a split
        key = (r["file"], r["block"])
        if r["file"] != file:
            state, owner, file = 0, None, r["file"]
        starts[key] = state
        if state and owner:
            tails.setdefault(owner, []).append(r["head"])
            owners.append((*key, owner[1]))
            long |= set() if r["short"] else {owner}
        if not state or r["begins"]:
            owner = key
        state = r["end1"] if state else r["end0"]
    joined = {k: "\n".join(parts) for k, parts in tails.items() if k not in long}
    found = lines.mapInArrow(_cut(starts, joined), "file string, block bigint, n bigint, text string, last boolean")
    if long:
        few = spark.createDataFrame([o for o in owners if (o[0], o[2]) in long], "file string, block bigint, owner bigint")
        ends = told.select(*SPLIT, "head").join(few, SPLIT).groupBy("file", F.col("owner").alias("block")).agg(F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("block", "head"))), lambda r: r["head"]), "\n").alias("tail"))
        found = found.join(ends.withColumn("last", F.lit(True)), [*SPLIT, "last"], "left").withColumn("text", F.concat_ws("\n", "text", "tail"))
    text = F.rtrim("text", F.lit("\r"))
    whole = found.select(*SPLIT, "n", text.alias("text")).filter((F.trim("text") != "") | (F.col("block") == 0) & (F.col("n") == 1))
    firsts = {r["first"] for r in seen if not r["block"]}
    if None in firsts:  # a first record that is long, or reaches over its split
        few = whole.filter("block = 0 AND n = 1").select("text").distinct().limit(2).collect()
        return whole, [r["text"] for r in few]
    return whole, sorted({t.rstrip("\r") for t in firsts})


def plain_records(spark: SparkSession, path: str, utf8: bool = True, skip: int = 0) -> tuple[DataFrame, list[str]]:
    """As :func:`records`, of one file whose cells do not reach over their lines: no shuffle."""
    lines = _raw(spark, path)
    text = F.rtrim(_text(utf8), F.lit("\r"))
    top = lines.limit(skip + 1).select("row", text.alias("text")).collect()  # the first split of a single file comes first
    if len(top) <= skip:
        return lines.limit(0).select(*SPLIT, F.col("row").alias("n"), F.col("value").alias("text")), []
    first = top[skip]["row"]
    below = lines.filter((F.col("block") > 0) | (F.col("row") >= first))
    rows = below.select(*SPLIT, (F.col("row") - first + 1).alias("n"), text.alias("text")).filter((F.trim("text") != "") | (F.col("n") == 1))
    return rows, [top[skip]["text"]]


def headers(firsts: list[str]) -> list[str]:
    """The cells of the first record, which must be the same in all files."""
    if not firsts:
        raise ValueError("no header line")
    if len(firsts) > 1:
        raise ValueError(f"files with different headers: {firsts[0]!r}, {firsts[1]!r}")
    return next(csv.reader(firsts[0].splitlines(keepends=True)), [])


def parsed(found: DataFrame, schema: str, order: Column) -> DataFrame:
    """The records below the headers, parsed into the columns of ``schema``, and their place as ``_place``. Each is parsed
    once: a generator, as a filter on a column would be moved below a plain select, with a parser of its own."""
    body = found.filter("block > 0 OR n > 1")
    return body.select(order.alias("_place"), F.inline(F.array(F.from_csv("text", schema, {"escape": '"'}))))


def place() -> Column:
    """Place of a record in its source: file, split, record of the split."""
    return F.struct("file", "block", F.col("n").cast("bigint").alias("row"))
