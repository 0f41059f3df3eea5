"""Web archives as seekable Zstandard bundles.

WARC records are grouped into frames that are compressed on their own; a bundle ends with its index, which maps each
record identifier to a frame and an offset inside it, and with the seek table of the seekable Zstandard format, which
gives the sizes of all frames. Both are skippable frames, so a bundle is also an ordinary .warc.zst file. One record is
read by fetching the bundle's tail and one frame.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the smallest page id is a response, the others
are revisits that refer to it and hold no payload; their headers keep the payload's length and digest.

Bundles are written by the tasks to the shared folder, each attempt under a name of its own; the manifest that Spark
commits names the bundles that count, so a lost executor leaves at most a file nobody reads.

A record's identifier is made of page id and payload digest; rows that repeat both in one bundle get a number besides, so
every record of a bundle is found by an identifier of its own.

Defined results: null html is an empty payload; rows repeating both id and payload are one record written again; a
row without id never is what others refer to; missing urls are left empty; an empty table makes no bundle.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from salmoura.llm.common import batched, forget, slices, small, written
from salmoura.names import col
from salmoura.session import shared_folder

LEAST = 100
FRAME_BYTES = 256 << 10   # of records, before compression
BUNDLE_BYTES = 64 << 20   # after compression; a bundle is closed at the first frame beyond
LEVEL = 3
MOST_TASKS = 100_000      # that read the bundles of a manifest

# fixed values of the seekable format
_SKIPPABLE = 0x184D2A5E
_INDEX = 0x184D2A50
_SEEKABLE = 0x8F92EAB1
_FOOTER = struct.Struct("<IBI")
_ENTRY = struct.Struct("<II")

_ID = "urn:page:"


def identifier(page_id: int | None, digest: str) -> str:
    """Of the record of a page and a payload, so that rows of one id and several payloads are told apart."""
    return f"{_ID}{'' if page_id is None else page_id}.{digest[:32]}"


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
    again: str | None = None, date: str = "1970-01-01T00:00:00Z",
) -> bytes:
    """One WARC record: a response, or a revisit of ``refers_to``; ``again`` is the identifier of a repeated record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{again or identifier(page_id, digest)}>",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', '', url or '')}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [
            f"WARC-Refers-To: <{identifier(refers_to, digest)}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    block = http if revisit else http + payload
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``: headers of the record and of HTTP (names in lower case), payload, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    headers = _headers(data[at:end])
    begin = end + 4
    stop = begin + int(headers["content-length"])
    http_end = data.index(b"\r\n\r\n", begin, stop)
    headers |= {f"http-{k}": v for k, v in _headers(data[begin:http_end]).items()}
    return headers, data[http_end + 4 : stop], stop + 4


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, value in pairs}


class Bundle:
    """Writes records to frames, and at the end the index and the seek table."""

    def __init__(self, stream):
        self.stream, self.compressor = stream, zstandard.ZstdCompressor(level=LEVEL)
        self.buffer = bytearray()
        self.frames: list[tuple[int, int]] = []  # compressed and plain size
        self.index: dict[str, tuple[int, int]] = {}
        self.repeated: dict[str, int] = {}
        self.size = 0

    def add(self, identifier: str, data: bytes) -> None:
        """Add a record. Its identifier must be new in this bundle, see :meth:`unused`."""
        if identifier in self.index:
            raise ValueError(f"{identifier} is in this bundle already")
        self.index[identifier] = (len(self.frames), len(self.buffer))
        self.buffer += data
        if len(self.buffer) >= FRAME_BYTES:
            self._end_frame()

    def unused(self, identifier: str) -> str:
        """``identifier``, or with the number of its repetition where a record has it already."""
        if identifier not in self.index:
            return identifier
        self.repeated[identifier] = self.repeated.get(identifier, 1) + 1
        return f"{identifier}~{self.repeated[identifier]}"

    def _end_frame(self) -> None:
        if self.buffer:
            frame = self.compressor.compress(bytes(self.buffer))
            self.stream.write(frame)
            self.frames.append((len(frame), len(self.buffer)))
            self.size += len(frame)
            self.buffer.clear()

    def close(self) -> None:
        self._end_frame()
        index = self.compressor.compress(json.dumps(self.index).encode())
        self.stream.write(struct.pack("<II", _INDEX, len(index)) + index)
        entries = [*self.frames, (len(index) + 8, 0)]
        table = b"".join(_ENTRY.pack(*e) for e in entries) + _FOOTER.pack(len(entries), 0, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)
        self.stream.close()


class Reader:
    """Reads a bundle frame by frame, or one record by its identifier."""

    def __init__(self, path: str):
        system, at = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(at)
        end = self.file.size()
        count, _, magic = _FOOTER.unpack(self._at(end - _FOOTER.size, _FOOTER.size))
        if magic != _SEEKABLE:
            raise ValueError(f"no seek table at the end of {path}")
        table = self._at(end - _FOOTER.size - count * _ENTRY.size, count * _ENTRY.size)
        self.sizes = list(_ENTRY.iter_unpack(table))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.decompressor = zstandard.ZstdDecompressor()

    def _at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, number: int) -> bytes:
        packed, plain = self.sizes[number]
        return self.decompressor.decompress(self._at(self.starts[number], packed), max_output_size=plain)

    def frames(self) -> Iterator[bytes]:
        for number in range(len(self.sizes) - 1):
            yield self.frame(number)

    @cached_property
    def index(self) -> dict[str, tuple[int, int]]:
        packed, _ = self.sizes[-1]
        data = self._at(self.starts[-2], packed)[8:]
        return json.loads(self.decompressor.decompress(data))

    def record(self, identifier: str) -> tuple[dict[str, str], bytes]:
        number, offset = self.index[identifier]
        headers, payload, _ = parse(self.frame(number), offset)
        return headers, payload

    def close(self) -> None:
        self.file.close()


def _writer(folder: str, bundle_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = fs.FileSystem.from_uri(folder)
        system.create_dir(at, recursive=True)
        bundle, name, made = None, "", []

        def close() -> None:
            bundle.close()
            made.append((f"{folder}/{name}", len(bundle.index), len(bundle.frames)))

        for batch in slices(batches, 64):
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(system.open_output_stream(f"{at}/{name}", compression=None))
                payload = (html or "").encode("utf-8", "replace")
                own = bundle.unused(identifier(page_id, digest))
                bundle.add(own, record(page_id, url, payload, digest, refers_to, own))
                if bundle.size >= bundle_bytes:
                    close()
                    bundle = None
        if bundle is not None:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()),
             pa.array([m[2] for m in made], pa.int64())], names=["bundle", "records", "frames"],
        )

    return write


def archive(
    pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html",
    bundle_bytes: int = BUNDLE_BYTES,
) -> DataFrame:
    """Write all pages as bundles under ``folder``; the manifest: bundle, records, frames.

    ``folder`` must be one that every executor and the driver reach under the same address.
    """
    body = F.coalesce(col(html).cast("string"), F.lit(""))
    keyed = pages.select(
        col(page_id).cast("bigint").alias("id"), col(url).cast("string").alias("url"), body.alias("html"),
        F.sha2(body, 256).alias("digest"),
    )
    facts, facts_at = written(keyed.filter(F.octet_length("html") >= LEAST).select("id", "digest"))
    firsts, firsts_at = written(
        facts.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first IS NOT NULL").drop("n")
    )
    revisits, revisits_at = written(
        facts.join(small(firsts), "digest").filter(~F.col("id").eqNullSafe(F.col("first")))
        .select(F.col("id").alias("of"), F.col("digest").alias("same"), "first").distinct()
    )
    joined = keyed.join(
        small(revisits), F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left"
    ).select("id", "url", "html", "digest", "first")
    manifest, _ = written(batched(joined).mapInArrow(
        _writer(folder, bundle_bytes), "bundle string, records bigint, frames bigint"
    ))
    forget(pages.sparkSession, facts_at, firsts_at, revisits_at)
    return manifest


def _reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            reader = Reader(path)
            for frame in reader.frames():
                rows, at = [], 0
                while at < len(frame):
                    headers, payload, at = parse(frame, at)
                    digest = headers["warc-payload-digest"].removeprefix("sha256:")
                    kind = headers["warc-type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {headers['warc-record-id']} in {path} differs from its digest")
                    own, other = (
                        headers.get(h, "").strip("<>").removeprefix(_ID).split(".")[0] for h in ("warc-record-id", "warc-refers-to")
                    )
                    rows.append((
                        int(own) if own else None, headers["warc-target-uri"], int(headers["http-content-length"]),
                        digest, kind, int(other) if other else None, payload if kind == "response" else None,
                    ))
                columns = zip(*rows)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            reader.close()


def records(manifest: DataFrame) -> DataFrame:
    """All records of the bundles, a task a bundle as far as that goes: id, url, length and digest of the payload, type, what it refers to, and the payload
    (null for revisits). Payloads are checked against their digests."""
    # with a number of tasks, as adaptive execution would put these few bytes into one
    tasks = max(1, min(manifest.count(), MOST_TASKS))
    return manifest.select("bundle").repartition(tasks).mapInArrow(
        _reading, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint, payload binary",
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archives back."""
    return records(archive(pages, shared_folder(spark))).drop("payload", "url")
