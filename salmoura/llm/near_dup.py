"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

Each text becomes the set of its word shingles. Texts with equal sets form a class, found by a digest. A class
has a signature of ``hashes`` symbols of 16 bits; two sets of similarity s differ in about (1 - s) of the
symbols. The signature is cut into chunks so that by the pigeonhole principle any two signatures within
``distance`` differing symbols agree on some chunk up to ``errors`` symbols. All ways to leave out that many
symbols of a chunk are enumerated as keys, so every pair within the distance shares a key: nothing is capped.
With 128 hashes, a pair of similarity 0.8 differs in 25.6 symbols on average (deviation 4.5); the distance of
45 is exceeded with probability 2e-5, and by more similar pairs far more rarely.

Keys are counted first. Most occur once; a bitmap of the others, of bounded size, tells the second pass which keys to send
on (a bit set by chance sends a key that then meets nothing). Links are confirmed on the full sets:

* Each class is compared with one centre of its keys.
* Classes of keys that still hold several components are put into families (connected by keys). A family has a hub, the shingles
  that more than half of its members have, and each member is kept as its difference D from the hub. Two members differ by
  |D(A)| + |D(B)| - 2 |D(A) & D(B)| shingles: if the two differences are small enough they are linked whatever they hold (one
  link to the member nearest to the hub stands for all of these), else they must have some elements of D in common, and
  the least number is known; and as sets of similarity s differ in at most |A| (1 - s) / s shingles, a link leaves out at
  most that many elements of D(A). Elements of one member alone cannot be among the common ones, so members with too many
  of those are linked with no other and go no further. Of the rest, elements of members of several components are counted
  and put in order, and the rarest are joined: a member offers as many of them as leave too few for a link, singly, or
  three at a time where any two members need three.

What is left of the square of a family is the pairs that share rare differences, three of them where that many are needed: for
copies that each have edits of their own these are chance meetings.

Defined results: texts without words and null texts have 0 shingles and are linked with nothing; rows repeating
an id are linked by their own texts, and each row has the component of its own text; a component without any id is
named by null; an empty table gives an empty result; only the id and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from salmoura.llm.common import batched, components, forget, fresh, slices, small, written
from salmoura.llm.shingles import mixed, shingle_sets
from salmoura.names import col


@dataclass(frozen=True)
class Signature:
    hashes: int = 128  # a multiple of 64
    distance: int = 45
    errors: int = 1

    def chunks(self) -> list[np.ndarray]:
        count = -(-(self.distance + 1) // (self.errors + 1))
        return np.array_split(np.arange(self.hashes), count)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        """16-bit symbols of the smallest value under each hash."""
        rng = np.random.default_rng(20)
        factor = rng.integers(0, 1 << 32, self.hashes, dtype=np.uint32)[:, None] | np.uint32(1)
        shift = rng.integers(0, 1 << 32, self.hashes, dtype=np.uint32)[:, None]
        low = np.full(self.hashes, 0xFFFFFFFF, np.uint32)
        values = (shingles >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(values), 8192):
            low = np.minimum(low, (factor * values[at : at + 8192] + shift).min(axis=1))
        return ((low * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)

    def keys(self, symbols: np.ndarray) -> np.ndarray:
        """Keys of signatures (one a row): each chunk without each choice of ``errors`` symbols."""
        place = np.arange(self.hashes, dtype=np.uint64) << np.uint64(16)
        values = mixed(mixed(symbols.astype(np.uint64) + place))
        out = []
        for chunk in self.chunks():
            whole = values[:, chunk].sum(axis=1, dtype=np.uint64)
            for left_out in combinations(chunk, min(self.errors, len(chunk) - 1)):
                key = whole.copy()
                for i in left_out:
                    key -= values[:, i]
                salt = sum((int(i) + 1) * 1009**k for k, i in enumerate([*left_out, chunk[0]]))
                out.append(mixed(key + np.uint64(salt)))
        return np.stack(out, axis=1)


BITMAP = 1 << 28       # bits of the bitmap of shared keys, at most
BITS_A_KEY = 8         # and as many for each of them, below that
_CHUNK = 1 << 18       # bits of a part of the bitmap
TRIPLES = 24           # elements of which all triples are offered


def _signer(words: int, signature: Signature):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)
        for batch in slices(batches):
            n, h1, h2, symbols, bits = [], [], [], [], []
            for shingles in shingle_sets(batch.column(2).to_pylist(), words):
                n.append(len(shingles))
                h1.append(np.sum(mixed(shingles ^ one), dtype=np.uint64))
                h2.append(np.sum(mixed(shingles ^ two), dtype=np.uint64))
                found = signature.of(shingles)
                symbols.append(found.tobytes())
                bits.append(np.packbits((found & 1).astype(bool).reshape(-1, 64), axis=1).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()),
                 pa.array(np.array(h1, np.uint64).view(np.int64)),
                 pa.array(np.array(h2, np.uint64).view(np.int64)), pa.array(symbols, pa.binary()),
                 pa.array(bits, pa.list_(pa.int64()))],
                names=["doc", "t", "n", "h1", "h2", "symbols", "bits"],
            )

    return sign


def _spots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The place of each key in a bitmap of ``bits`` (a power of two)."""
    return (mixed(keys.astype(np.uint64)) >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def _bitmap(shared: DataFrame, count: int) -> np.ndarray:
    """The bitmap of the keys of ``shared``, of bounded size however many they are."""
    bits = _CHUNK
    while bits < min(BITMAP, BITS_A_KEY * count):
        bits *= 2

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = _spots(batch.column(0).to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array((spot // _CHUNK).astype(np.int32)), pa.array((spot % _CHUNK).astype(np.int32))], names=["part", "bit"])

    def joined(table: pa.Table) -> pa.Table:
        flags = np.zeros(_CHUNK, bool)
        flags[table.column("bit").to_numpy()] = True
        return pa.table({"part": table.column("part").slice(0, 1), "map": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    parts = shared.select("key").mapInArrow(spots, "part int, bit int").distinct().groupBy("part").applyInArrow(
        joined, "part int, map binary").collect()
    whole = np.zeros(bits // 8, np.uint8)
    for r in parts:
        whole[r["part"] * _CHUNK // 8 : (r["part"] + 1) * _CHUNK // 8] = np.frombuffer(r["map"], np.uint8)
    return whole


def _keys(signature: Signature, bitmap=None):
    """The keys of signatures; with a bitmap those that it holds."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            if not batch.num_rows:
                continue
            symbols = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16)
            found = signature.keys(symbols.reshape(batch.num_rows, -1))
            counts = np.full(len(found), found.shape[1])
            found = found.ravel()
            if bitmap is not None:
                spot = _spots(found, 8 * len(bitmap.value))
                held = (bitmap.value[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1
                counts = held.reshape(len(counts), -1).sum(axis=1)
                found = found[held]
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int64)))], names=["id", "keys"])

    return keys


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # repeated rows of a task
        for batch in slices(batches):
            ids, digests, texts = (c.to_pylist() for c in batch.columns)
            out = []
            for i, h, s in zip(ids, digests, shingle_sets(texts, words)):
                own = np.sum(mixed(s ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64, keepdims=True)
                if i not in done and own.view(np.int64)[0] == h:
                    done.add(i)
                    out.append((i, s.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.int64()))],
                names=["id", "shingles"],
            )

    return sets


def _sets_of(texts: DataFrame, classes: DataFrame, ids: DataFrame, words: int) -> tuple[DataFrame, str]:
    """The full sets of the classes ``ids`` (written): id, shingles."""
    wanted, at = written(ids.join(classes.select("id", "doc", "t", "h1"), "id"))
    few = small(wanted)
    met = texts.join(few, texts.doc.eqNullSafe(few.doc) & (texts.t == few.t)).select(few.id, few.h1, texts.text)
    again, again_at = written(met.mapInArrow(_sets(words), "id bigint, shingles array<bigint>"))
    forget(texts.sparkSession, at)
    # rows repeated in several tasks
    return again.dropDuplicates(["id"]) if again.count() > again.select("id").distinct().count() else again, again_at


def _confirmed(
    texts: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int
) -> tuple[DataFrame, str]:
    """The pairs (a, b) whose full sets are similar enough, written."""
    sets, at = _sets_of(
        texts, classes, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), words
    )
    joined = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
        .withColumn("both", F.size(F.array_intersect("x", "y")))
    )
    similar = F.col("both") * (100 + percent) >= (F.size("x") + F.size("y")) * percent
    links, path = written(joined.filter(similar).select("a", "b"))
    forget(texts.sparkSession, at)
    return links, path


def _few_bits(a: str, b: str, percent: int) -> Column:
    """Whether few enough of the symbols' lowest bits differ. Sets of similarity s differ in a bit with probability
    (1 - s) / 2; five deviations above that are passed with probability 3e-6 at most."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)
    p, n = (100 - percent) / 200, F.size(a) * 64
    return differ <= n * p + 5.5 * F.sqrt(n * p * (1 - p))


def _offered(size: int):
    """The elements that a member offers, singly or as mixed triples, and the place of the (last) element."""
    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            counts, keys, places = [], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for elements in batch.column(1).to_pylist():
                values = mixed(np.array(elements, np.int64).view(np.uint64))
                picked = np.array(list(combinations(range(len(values)), size)), np.int64).reshape(-1, size)
                keys.append((mixed(values[picked].sum(axis=1, dtype=np.uint64)) if size > 1 else values).view(np.int64))
                places.append(picked[:, -1].astype(np.int32))
                counts.append(len(picked))
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            both = pa.StructArray.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(places))], ["key", "p"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), both)], names=["id", "offers"])

    return offer


def _linked_in_families(
    texts: DataFrame, classes: DataFrame, undecided: DataFrame, words: int, percent: int
) -> tuple[DataFrame, str]:
    """Links between the classes of different components of a family (id, component, family), by their differences
    from the family's hub. The module says how."""
    spark = texts.sparkSession
    sets, sets_at = _sets_of(texts, classes, undecided.select("id"), words)
    placed = sets.join(undecided, "id")
    sizes = undecided.groupBy("family").agg(F.count(F.lit(1)).alias("members"))
    counts = placed.select("family", F.explode("shingles").alias("x")).groupBy("family", "x").agg(F.count(F.lit(1)).alias("f"))
    hubs = counts.join(sizes, "family").filter("2 * f > members").groupBy("family").agg(F.collect_list("x").alias("hub"))
    none = F.array().cast("array<bigint>")
    hub = F.coalesce("hub", none)
    deltas, deltas_at = written(placed.join(hubs, "family", "left").select(
        "id", "component", "family", F.size("shingles").alias("n"),
        F.concat(F.array_except("shingles", hub), F.array_except(hub, F.col("shingles"))).alias("delta"),
    ))
    # A and B are linked if and only if far(A) + far(B) <= 2 (100 + percent) |D(A) & D(B)|
    whole = 2 * (100 + percent)
    facts = deltas.select(
        "id", "component", "family", "n", F.size("delta").alias("d"),
        (F.size("delta") * (100 + percent) - F.col("n") * (100 - percent)).alias("far"),
    )
    three = F.col("far") > (100 + percent) * 2  # any two of these need three common elements
    nearest = facts.groupBy("family").agg(
        F.min(F.struct("far", "id")).alias("first"), F.min(F.when(three, F.col("far"))).alias("least_far"))

    def least(other: str) -> Column:  # common elements that any link needs with a member as far as that, and with any member
        own = (F.col("d") * percent - F.col("n") * (100 - percent)) / max(percent, 1)
        return F.greatest(F.lit(1), F.ceil((F.col("far") + F.col(other)) / whole), F.ceil(own))

    def elements(chosen: DataFrame) -> DataFrame:
        return chosen.select("id", "component", "family", F.explode("delta").alias("x"))

    lone = elements(deltas).groupBy("family", "x").agg(F.min("id").alias("id"), F.max("id").alias("last")).filter(
        "id = last").groupBy("id").agg(F.count(F.lit(1)).alias("lone"))
    placed, placed_at = written(
        facts.join(nearest, "family").join(lone, "id", "left").withColumn("three", three)
        .withColumn("able", F.col("d") - F.coalesce("lone", F.lit(0)) >= least("first.far")).drop("lone"))
    certain = placed.filter((F.col("far") + F.col("first.far") <= 0) & (F.col("id") != F.col("first.id"))).select(
        F.col("first.id").alias("a"), F.col("id").alias("b"))
    able = placed.filter("able").drop("able")
    left = elements(deltas.join(able.select("id"), "id"))
    shared = left.groupBy("family", "x").agg(
        F.count(F.lit(1)).alias("often"), F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low <> high").select("family", "x", "often")
    ranked = left.join(shared, ["family", "x"]).groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("often", "x"))).alias("order"))
    members, members_at = written(
        able.join(ranked, "id", "left").withColumn("order", F.coalesce(F.transform("order", lambda o: o["x"]), none))
        .withColumn("alone", F.col("d") - F.size("order"))
    )

    def prefix(other: str, size: int) -> Column:
        return F.greatest(F.lit(0), F.col("d") - least(other) + size - F.col("alone")).cast("int")

    # far members whose triples are few offer those to each other; pairs with any other member go by single elements
    members = members.withColumn("triples", F.col("three") & (prefix("least_far", 3) <= TRIPLES)).join(
        classes.select("id", "bits"), "id")
    facts = members.select("id", "component", "family", "n", "far", "d", "alone", "bits")

    def offered(chosen: DataFrame, other: str, size: int) -> DataFrame:
        elements = chosen.select("id", F.slice("order", F.lit(1), prefix(other, size)).alias("x"))
        return elements.mapInArrow(_offered(size), "id bigint, offers array<struct<key:bigint,p:int>>").select(
            "id", F.inline("offers")).join(facts, "id")

    def met(one: DataFrame, two: DataFrame, size: int) -> DataFrame:
        two = two.select(*[F.col(c).alias(f"{c}2") for c in two.columns])
        both = F.col("far") + F.col("far2")
        close = (F.greatest("n", "n2") * percent <= F.least("n", "n2") * 100) & (both > 0) & _few_bits("bits", "bits2", percent)
        # the first common elements are among the offers; with what stands behind them there must be enough
        most = (F.col(f"d{i}") - F.col(f"alone{i}") - F.col(f"p{i}") + (size - 1) for i in ("", "2"))
        close = close & (F.least(*most) * whole >= both)
        return one.join(two, (one.family == two.family2) & (one.key == two.key2) & (one.component != two.component2) & close).select(
            F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"))

    triples = offered(members.filter("triples"), "least_far", 3)
    singles = offered(members, "first.far", 1)
    others = offered(members.filter("NOT triples"), "first.far", 1)
    pairs = met(triples, triples, 3).union(met(others, singles, 1))
    pairs, pairs_at = written(pairs.distinct())
    links, links_at = _confirmed(texts, classes, pairs, words, percent)
    result, path = written(links.unionByName(certain))
    forget(spark, sets_at, deltas_at, placed_at, members_at, pairs_at, links_at)
    return result, path


@dataclass(frozen=True)
class Found:
    """Classes of rows and their components: ``rows`` (doc, t, n, h1, h2) has an entry a row, ``classes`` (n, h1, h2, component,
    doc, t) one a class, doc and t being those of the component's first row."""
    rows: DataFrame
    classes: DataFrame


def _components_of_texts(documents: DataFrame, doc_id: str, text: str, words: int, percent: int, signature: Signature) -> Found:
    spark = documents.sparkSession
    texts = documents.select(
        col(doc_id).cast("bigint").alias("doc"), F.xxhash64(col(text)).alias("t"), col(text).alias("text"))
    signed, signed_at = written(batched(texts).mapInArrow(
        _signer(words, signature),
        "doc bigint, t bigint, n bigint, h1 bigint, h2 bigint, symbols binary, bits array<bigint>",
    ))
    # the row of a class with the smallest id; a row without id only where all have none. Numbers of classes follow these
    # ids, so that centres are first texts: originals more often than copies
    classes, classes_at = written(
        signed.filter("n > 0").groupBy("n", "h1", "h2")
        .agg(F.min(F.struct(F.col("doc").isNull().alias("unnamed"), "doc", "t", "symbols", "bits")).alias("_r"))
        .select("n", "h1", "h2", "_r.*").orderBy("unnamed", "doc", "t").withColumn("id", F.monotonically_increasing_id())
    )

    def keyed(bitmap=None) -> DataFrame:
        return classes.select("id", "symbols").mapInArrow(
            _keys(signature, bitmap), "id bigint, keys array<bigint>"
        ).select("id", F.explode("keys").alias("key"))

    shared, shared_at = written(keyed().groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key"))
    bitmap = spark.sparkContext.broadcast(_bitmap(shared, shared.count()))
    likely, likely_at = written(keyed(bitmap))
    centres = likely.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("high")).filter(
        "centre <> high").select("key", "centre")
    members, members_at = written(likely.join(centres, "key"))

    # two sets can only be similar if their sizes are, and if few of the lowest bits of their symbols differ
    facts = classes.select("id", "n", "bits")
    other = facts.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("bits").alias("other"))
    near = (F.greatest("n", "m") * percent <= F.least("n", "m") * 100) & _few_bits("bits", "other", percent)

    # each text with the centre that it shares most keys with
    most = (
        members.filter("id <> centre").groupBy(F.col("id").alias("a"), F.col("centre").alias("b"))
        .agg(F.count(F.lit(1)).alias("keys"))
        .groupBy("a").agg(F.max_by("b", F.struct("keys", "b")).alias("b"))
    )
    pairs, pairs_at = written(
        most.join(facts.withColumnRenamed("id", "a"), "a").join(other, "b").filter(near).select("a", "b")
    )
    links, links_at = _confirmed(texts, classes, pairs, words, percent)
    labels, labels_at = components(links)

    # keys that still hold several components, and the families that they make of their members
    part = members.select("key", "id").join(small(labels), "id", "left")
    part = part.withColumn("component", F.coalesce("component", "id"))
    mixed_keys = part.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("centre")
    ).filter("low <> high").select("key", "centre")
    # a member goes with the first of its centres, and each other centre of a member with that one: members of a group have
    # the same few centres, so these are about as many edges as members, not a member's number of keys times as many
    rest, rest_at = written(part.join(mixed_keys, "key").groupBy("id", "component").agg(
        F.min("centre").alias("first"), F.collect_set("centre").alias("centres")))
    edges = rest.select(F.col("id").alias("a"), F.col("first").alias("b")).union(
        rest.select(F.explode("centres").alias("a"), F.col("first").alias("b")))
    family, family_at = components(edges.filter("a <> b").distinct())
    undecided, undecided_at = written(
        rest.select("id", "component").join(family.select("id", F.col("component").alias("family")), "id"))
    more, more_at = _linked_in_families(texts, classes, undecided, words, percent)
    last_at = labels_at
    if not more.isEmpty():
        labels, last_at = components(links.unionByName(more))

    named = classes.select("n", "h1", "h2", "id", "unnamed", "doc", "t").join(labels, "id", "left").withColumn(
        "component", F.coalesce("component", "id"))
    first = named.groupBy("component").agg(F.min(F.struct("unnamed", "doc", "t")).alias("_f")).select("component", "_f.doc", "_f.t")
    final, _ = written(named.select("n", "h1", "h2", "component").join(first, "component"))
    forget(spark, classes_at, shared_at, likely_at, members_at, pairs_at, rest_at, undecided_at, links_at, more_at, family_at,
           labels_at, *([last_at] if last_at != labels_at else []))
    return Found(signed, final)


def near_duplicates(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5,
    percent: int = 80, signature: Signature = Signature(),
) -> DataFrame:
    """Per row of ``documents``: id, n_shingles, component_id (smallest id reachable over links), kept."""
    found = _components_of_texts(documents, doc_id, text, words, percent, signature)
    own = found.rows.select("doc", "n", "h1", "h2").join(
        found.classes.select("n", "h1", "h2", F.col("doc").alias("component_id")), ["n", "h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc"))
    return own.select(
        F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc") == component, component.isNull()).alias("kept"),
    )


def first_of_each(
    documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 5,
    percent: int = 80, signature: Signature = Signature(),
) -> DataFrame:
    """One row of ``documents`` of each component, with its own columns: of those with the smallest id (without id, if none has
    one) and among them the same text, any. Rows without words are all kept."""
    found = _components_of_texts(documents, doc_id, text, words, percent, signature)
    first = found.classes.select("n", "h1", "h2", F.col("doc").alias("first"), F.col("t").alias("first_t"))
    rows = found.rows.select("doc", "t", "n", "h1", "h2").filter("n > 0").join(first, ["n", "h1", "h2"])
    chosen = F.col("doc").eqNullSafe(F.col("first")) & (F.col("t") == F.col("first_t"))
    # (id, text) pairs of which not every row stays: copies, and chosen ones that occur more than once
    names = {c: fresh(documents, f"_{c}") for c in ("doc", "t", "again")}
    lists, _ = written(
        rows.groupBy("doc", "t", chosen.alias("_chosen")).agg(F.count(F.lit(1)).alias("_n")).filter("NOT _chosen OR _n > 1")
        .select(F.col("doc").alias(names["doc"]), F.col("t").alias(names["t"]), F.col("_chosen").alias(names["again"]))
    )
    few = small(lists)
    met = documents.join(
        few, col(doc_id).cast("bigint").eqNullSafe(F.col(names["doc"])) & (F.xxhash64(col(text)) == F.col(names["t"])), "left")
    plain = met.filter(F.col(names["again"]).isNull()).select(*[col(c) for c in documents.columns])
    once = met.filter(names["again"]).dropDuplicates([names["doc"], names["t"]]).select(*[col(c) for c in documents.columns])
    return plain.unionByName(once)
