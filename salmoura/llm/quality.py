"""Quality classifier: attention-based multiple-instance learning over the passages of a text.

A text is a bag of passages of ``PASSAGE`` words (the last may be shorter). Each passage is described by
how often one kind of byte follows another (lower, upper, digit, blank, line end, kinds of punctuation,
non-ASCII) and by how much its words repeat. A tanh layer encodes each passage; gated attention, learned from
labels of whole texts only, weighs the passages; the score is a logistic function of the weighted
representation. Attention lets a text be judged by the passages that tell, however few they are.

Learning uses a bounded sample: the ``sample`` labelled rows of smallest hash whose crc32(id) mod 4 is not 2. Only
texts enter a score. Training runs on the driver over the features of that sample, with a fixed seed.

Defined results: null and empty texts are one empty passage; several labels of an id count as 1 from a mean of one
half on, null labels are ignored; without any label every score is one half; with one class only, the scores tend to
it; very long texts are scored whole, all of their passages; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from salmoura.llm.common import batched, text_slices
from salmoura.llm.shingles import word_hashes
from salmoura.names import col

PASSAGE = 96
SAMPLE = 3_000
THRESHOLD = 0.7


def _kinds() -> np.ndarray:
    kind = np.full(256, 11, np.int64)  # other controls
    for i, members in enumerate((
        b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r",
        b".,;:", b"!?", b"'\"()-", b"*#$%&@^~+=", b"|<>[]{}/\\_`",
    )):
        kind[list(members)] = i
    kind[128:] = 10
    return kind


_KIND = _kinds()
KINDS = 12
WIDTH = KINDS * KINDS + 5


def passages(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (one a row), and the place of each text's first passage (one more at the end)."""
    encoded = [(t or "").encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b" ".join([*encoded, b""]), np.uint8)
    hashes, first_word = word_hashes(encoded)
    blank = np.isin(data, np.array([9, 10, 11, 12, 13, 32], np.uint8))
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    counts = np.diff(first_word)
    bags = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    rows = int(first[-1])
    # passage of each word, then of each byte: a byte belongs to the last word that began, blanks included
    owner = np.repeat(np.arange(len(texts)), counts)
    word_row = first[owner] + (np.arange(len(hashes)) - first_word[owner]) // PASSAGE
    text_at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in encoded])])[:-1]
    marks = np.zeros(len(data) + 1, np.int64)
    row_start = np.concatenate([[True], word_row[1:] != word_row[:-1]]) if len(word_row) else np.zeros(0, bool)
    begins = np.full(rows, -1, np.int64)
    begins[word_row[row_start]] = starts[row_start]
    begins[first[:-1]] = text_at  # a text's first passage begins with the text
    marks[begins] = 1
    byte_row = np.cumsum(marks[:-1]) - 1
    kind = _KIND[data]
    inside = np.ones(len(data), bool)
    inside[text_at + np.array([len(t) for t in encoded], np.int64)] = False  # nothing follows a text's end
    pair = byte_row[:-1] * (KINDS * KINDS) + kind[:-1] * KINDS + kind[1:]
    follows = np.bincount(pair[inside[:-1]], minlength=rows * KINDS * KINDS).reshape(rows, -1).astype(np.float32)
    sizes = np.maximum(1.0, follows.sum(axis=1, keepdims=True))
    words = np.bincount(word_row, minlength=rows).astype(np.float32)
    some = np.maximum(1.0, words)
    again = np.zeros(len(hashes), np.float32)
    if len(hashes):
        again[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
        order = np.lexsort((hashes, word_row))
        new = np.ones(len(order), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (word_row[order][1:] != word_row[order][:-1])
        distinct = np.bincount(word_row[order][new], minlength=rows)
    else:
        distinct = np.zeros(rows)
    repeated = np.bincount(word_row, weights=again, minlength=rows)
    rest = np.stack([
        repeated / some, distinct / some, np.log1p(words), sizes[:, 0] / some / 10, (words > 0).astype(np.float32),
    ], axis=1)
    return np.concatenate([np.sqrt(follows / sizes), rest], axis=1).astype(np.float32), first


@dataclass(frozen=True)
class Model:
    """Weights of the encoder, the gated attention and the output; ``mean`` and ``scale`` of the features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return _forward(self.weights, x, first)["p"]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    at = first[:-1]
    sizes = np.diff(first)
    h = np.tanh(x @ w["W"] + w["b"])
    tanh = np.tanh(h @ w["V"])
    gate = 1 / (1 + np.exp(-(h @ w["U"])))
    logit = (tanh * gate) @ w["w"]
    top = np.repeat(np.maximum.reduceat(logit, at), sizes)
    e = np.exp(logit - top)
    a = e / np.repeat(np.add.reduceat(e, at), sizes)
    z = np.add.reduceat(a[:, None] * h, at, axis=0)
    out = np.clip(z @ w["c"] + w["d"], -30, 30)
    return {"h": h, "tanh": tanh, "gate": gate, "a": a, "z": z, "p": 1 / (1 + np.exp(-out))}


def _gradient(w, x, first, y) -> dict[str, np.ndarray]:
    f = _forward(w, x, first)
    sizes = np.diff(first)
    d_out = (f["p"] - y) / len(y)
    d_z = np.repeat(d_out[:, None] * w["c"], sizes, axis=0)
    d_a = (d_z * f["h"]).sum(axis=1)
    mean = np.repeat(np.add.reduceat(f["a"] * d_a, first[:-1]), sizes)
    d_logit = f["a"] * (d_a - mean)
    mixed = d_logit[:, None] * w["w"]
    d_tanh = mixed * f["gate"] * (1 - f["tanh"] ** 2)
    d_gate = mixed * f["tanh"] * f["gate"] * (1 - f["gate"])
    d_h = d_z * f["a"][:, None] + d_tanh @ w["V"].T + d_gate @ w["U"].T
    d_x = d_h * (1 - f["h"] ** 2)
    return {
        "W": x.T @ d_x, "b": d_x.sum(axis=0), "V": f["h"].T @ d_tanh, "U": f["h"].T @ d_gate,
        "w": (f["tanh"] * f["gate"]).T @ d_logit, "c": f["z"].T @ d_out, "d": d_out.sum(keepdims=True),
    }


def train(
    features: np.ndarray, first: np.ndarray, labels: np.ndarray, *, hidden: int = 16, attention: int = 8,
    epochs: int = 25, batch: int = 64, rate: float = 0.005, decay: float = 1e-4, seed: int = 7,
) -> Model:
    """Fit by Adam on bags of passages."""
    rng = np.random.default_rng(seed)
    mean = features.mean(axis=0)
    scale = np.maximum(features.std(axis=0), 0.02)
    x = (features - mean) / scale
    w = {
        "W": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, hidden)), "b": np.zeros(hidden),
        "V": rng.normal(0, 0.3, (hidden, attention)), "U": rng.normal(0, 0.3, (hidden, attention)),
        "w": rng.normal(0, 0.3, attention), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1),
    }
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(u) for k, u in w.items()}
    step, sizes = 0, np.diff(first)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for start in range(0, len(order), batch):
            bags = order[start : start + batch]
            ends = np.concatenate([[0], np.cumsum(sizes[bags])])
            rows = np.repeat(first[bags] - ends[:-1], sizes[bags]) + np.arange(ends[-1])
            step += 1
            for k, g in _gradient(w, x[rows], ends, labels[bags]).items():
                g = g + decay * w[k] * (w[k].ndim > 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, {k: u.astype(np.float32) for k, u in w.items()})


def held_out(doc_id: str = "doc_id"):
    """Rows that no label may be learned from."""
    return F.coalesce(F.pmod(F.crc32(col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, 1):
        features, first = passages(batch.column(1).to_pylist())
        rows = [features[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["label", "rows"])


def learn(
    documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", sample: int = SAMPLE,
) -> Model | None:
    """Model fitted on at most ``sample`` labelled rows outside the held-out quarter; None without any."""
    known = (
        labels.select(col(doc_id).cast("bigint").alias("id"), col(label).cast("double").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id"))
        .groupBy("id").agg((F.avg("y") >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    chosen = documents.select(col(doc_id).cast("bigint").alias("id"), col(text).alias("text")).join(
        F.broadcast(known), "id"  # at most ``sample`` rows
    )
    found = batched(chosen.dropDuplicates(["id"]).select("label", "text")).mapInArrow(
        _featured, "label double, rows binary"
    ).collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["label"], bytes(r["rows"])))
    bags = [np.frombuffer(r["rows"], np.float32).reshape(-1, WIDTH) for r in found]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return train(np.concatenate(bags), first, np.array([r["label"] for r in found]))


def _scorer(model: Model | None, text_at: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_at):
            if model is None:
                scores = np.full(batch.num_rows, 0.5)
            elif batch.num_rows:
                scores = model.scores(*passages(batch.column(text_at).to_pylist()))
            else:
                scores = np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores.astype(np.float64))],
                names=[*batch.schema.names, "__score"],
            )

    return score


def scored(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``documents`` under the names _0, _1, ... with their score as the last column, ``__score``."""
    plain = documents.select(*[col(c).alias(f"_{i}") for i, c in enumerate(documents.columns)])
    schema = StructType([*plain.schema.fields, StructField("__score", DoubleType())])
    return batched(plain).mapInArrow(_scorer(model, documents.columns.index(text)), schema)


def classified(documents: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Per row: id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from ``threshold`` on)."""
    doc_id, text = options.get("doc_id", "doc_id"), options.get("text", "text")
    model = learn(documents, labels, **options)
    found = scored(documents.select(col(doc_id), col(text)), model, text)
    return found.select(
        F.col("_0").alias(doc_id), held_out("_0").alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(documents: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``documents`` that the classifier accepts, with their own columns; all where nothing is labelled."""
    model = learn(documents, labels, **options)
    if model is None:
        return documents
    found = scored(documents, model, options.get("text", "text")).filter(F.col("__score") >= threshold)
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(documents.columns)])
