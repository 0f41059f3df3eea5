"""BPE encoding with a backtracking encoder, decoding with an offset table.

A word is covered from the left with the longest token that the Aho-Corasick automaton found at each
place. A token may follow another only if encoding both together would give just these two; that is read
from the merge table and kept in a table of compatible pairs. Where no token fits, the last one is taken
back and replaced by its longest prefix token. The result equals applying the merges in rank order, and
each place is visited a bounded number of times.

Decoding gathers the bytes of each id from one buffer through a table of offsets. As the vocabulary file
names no decoder, tokens are joined by single blanks, in the file's own byte letters.

Defined results: null text counts as empty and gives no ids; special tokens written in a text are read as
such, as the tokenizers library does; very long texts are encoded whole, word by word; repeated rows give
repeated results.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from salmoura.llm.common import batched, slices
from salmoura.names import col

WORDS_KEPT = 150_000  # a worker remembers this many new words and as many older ones; no effect on results
PAIRS_KEPT = 1_000_000


_SEPARATORS = regex.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters, spare = [], 0x100
    for b in range(256):
        letters.append(chr(b if b in plain else spare))
        spare += b not in plain
    return letters


class Tokenizer:
    """Tables of a vocabulary file (BPE model with word ends, lower case, white space dropped)."""

    END = 0x10000  # added to the letter that ends a word

    def __init__(self, file: str):
        spec = json.loads(file)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_at = regex.compile("|".join(
            regex.escape(s) for s in sorted(self.special, key=len, reverse=True)
        )) if self.special else None

        letters = byte_letters()
        self.letter = dict(enumerate(letters))
        # every token as a text in which the last letter of a word is shifted by END
        shape: dict[str, str] = {}
        for letter in letters:
            shape[letter] = letter
            shape[letter + end] = chr(ord(letter) + self.END)
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        rank_of: dict[str, int] = {}
        order: list[str] = sorted((t for t in shape if t in vocabulary), key=vocabulary.__getitem__)
        for rank, token in enumerate(order):
            rank_of[token] = rank
        for left, right in model["merges"]:
            whole = left.removesuffix(end) + right
            rank = rank_of.setdefault(whole, len(rank_of))
            shape.setdefault(whole, shape[left] + shape[right])
            pair = (rank_of[left], rank_of[right])
            self.merged.setdefault(pair, rank)
            self.halves.setdefault(rank, pair)
        self.id_of = [0] * len(rank_of)
        self.size = [0] * len(rank_of)
        self.automaton = ahocorasick.Automaton()
        by_shape: dict[str, int] = {}
        for token, rank in rank_of.items():
            self.id_of[rank] = vocabulary[token]
            self.size[rank] = len(shape[token])
            by_shape[shape[token]] = rank
            self.automaton.add_word(shape[token], (len(shape[token]), rank))
        self.automaton.make_automaton()
        self.shorter: list[int] = [-1] * len(rank_of)  # longest token that begins this one
        for text, rank in by_shape.items():
            for n in range(len(text) - 1, 0, -1):
                prefix = by_shape.get(text[:n])
                if prefix is not None:
                    self.shorter[rank] = prefix
                    break
        self.compatible: dict[int, bool] = {}  # by left * tokens + right
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.older_chunks: dict[str, bytes] = {}

        names = {i: t for t, i in vocabulary.items()} | {i: t for t, i in self.special.items()}
        spelled = [names.get(i, "").encode() + b" " for i in range(max(names) + 1)]
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(spelled), np.uint8)

    def _fits(self, left: int, right: int) -> bool:
        """Would the merges leave these neighbours apart, and each of them whole?"""
        a, b, limit, fits = left, right, 1 << 62, True
        while True:
            if self.merged.get((a, b), limit) < limit:
                fits = False
                break
            # undo the later merge of the two; what it joined may not have joined earlier
            if a > b:
                if a not in self.halves:
                    break
                limit, a = a, self.halves[a][1]
            else:
                if b not in self.halves:
                    if a not in self.halves:
                        break
                    limit, a = a, self.halves[a][1]
                else:
                    limit, b = b + 1, self.halves[b][0]
        if len(self.compatible) >= PAIRS_KEPT:
            self.compatible.clear()
        self.compatible[left * len(self.size) + right] = fits
        return fits

    def ranks(self, word: str) -> list[int]:
        """Tokens of one word given in byte letters, its last letter shifted."""
        size, shorter, compatible, count = self.size, self.shorter, self.compatible, len(self.size)
        length = len(word)
        longest = [-1] * length
        for end, (width, rank) in self.automaton.iter(word):
            longest[end - width + 1] = rank  # a later end is a longer token
        closed: set[int] = set()  # places at which no token may end
        out: list[int] = []
        place, token, last = 0, longest[0], -1
        while place < length:
            while token >= 0:
                end = place + size[token]
                if end not in closed:
                    if last < 0:
                        break
                    fits = compatible.get(last * count + token)
                    if fits if fits is not None else self._fits(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                place, last = end, token
                token = longest[place] if place < length else -1
            else:  # nothing fits here
                closed.add(place)
                token = shorter[out.pop()]
                place -= size[last]
                last = out[-1] if out else -1
        return out

    def word(self, piece: str) -> bytes:
        """Ids of one piece of text, as little-endian 32-bit numbers."""
        known = self.words.get(piece)
        if known is None:
            known = self.older.get(piece)
            if known is None:
                word = piece.encode("utf-8", "replace").decode("latin-1").translate(self.letter)
                ranks = self.ranks(word[:-1] + chr(ord(word[-1]) + self.END))
                known = struct.pack(f"<{len(ranks)}I", *map(self.id_of.__getitem__, ranks))
            if len(self.words) >= WORDS_KEPT:
                self.older, self.words = self.words, {}
            self.words[piece] = known
        return known

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letters are lowered one by one
        text = text.lower()
        if _SEPARATORS.search(text):  # Python parts words there, the pattern does not
            return b"".join([self.words.get(p) or self.word(p) for p in self.pieces.findall(text)])
        chunks = self.chunks
        return b"".join([chunks.get(c) or self.chunk(c) for c in text.split()])

    def chunk(self, chunk: str) -> bytes:
        """Ids of what stands between white space; pieces never reach over it."""
        known = self.older_chunks.get(chunk)
        if known is None:
            words = self.words
            known = b"".join([words.get(p) or self.word(p) for p in self.pieces.findall(chunk)])
        if len(self.chunks) >= WORDS_KEPT:
            self.older_chunks, self.chunks = self.chunks, {}
        self.chunks[chunk] = known
        return known

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, as little-endian 32-bit numbers."""
        if not text:
            return b""
        if self.special_at is None or not self.special_at.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> bytes:
        """Text of ids in UTF-8: slices of one buffer, found through the offsets."""
        number = np.frombuffer(ids, "<u4")
        if not len(number):
            return b""
        starts = self.offsets[number]
        sizes = self.offsets[number + 1] - starts
        ends = np.cumsum(sizes)
        where = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.buffer[where].tobytes()[:-1]


@cache
def _tokenizer(digest: str, shared) -> Tokenizer:
    return Tokenizer(shared.value)


class _Shared:
    """A broadcast text that a cache finds again by its digest."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    value = property(lambda self: self.broadcast.value)
    __hash__ = lambda self: 0
    __eq__ = lambda self, other: isinstance(other, _Shared)


def encoded(
    documents: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Per row of ``documents``: id, ids (if asked for), n_tokens and digests of the ids and of the decoded text.

    ``vocabulary`` is the path of the file on the driver; its few megabytes are broadcast.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = file.read()
    shared = _Shared(documents.sparkSession.sparkContext.broadcast(spec))
    digest = hashlib.sha256(spec.encode()).hexdigest()
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"`{doc_id}` {kind}, " + "ids array<int>, " * with_ids + (
        "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(digest, shared)
        for batch in slices(batches):
            ids = [tokenizer.encode(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0)]
            if with_ids:
                ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
                numbers = np.frombuffer(b"".join(ids), "<i4")
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers)))
            columns += [
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                pa.array([hashlib.sha256(tokenizer.decode(i)).hexdigest() for i in ids]),
            ]
            names = [doc_id, *["ids"] * with_ids, "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return batched(documents.select(col(doc_id), col(text))).mapInArrow(encode, schema)
