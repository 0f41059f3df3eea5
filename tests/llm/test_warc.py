import hashlib
import io

import pytest
import zstandard

from salmoura.llm import warc
from salmoura.session import shared_folder

BIG = "<p>" + "payload é " * 30 + "</p>"
ROWS = [
    (4, "http://a/", BIG), (2, "http://b/", BIG), (9, None, BIG), (None, "http://c/", BIG), (9, None, BIG),
    (1, "http://d/\r\nX: y", "small"), (3, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1" * 20),
    (8, "u", "x" * 300_000), (None, None, None),
]


def pages(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.selectExpr("*", "'x' AS id", "1 AS digest", "2 AS `first`")


def expected(rows):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == payload and j is not None]
        first = min(same, default=None)
        revisit = len(payload) >= 100 and first is not None and i != first
        digest = hashlib.sha256(payload).hexdigest()
        out.append((i, len(payload), digest, "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    found = warc.round_trip(spark, pages(spark))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.collect()), key=str) == expected(ROWS)
    assert warc.round_trip(spark, pages(spark).limit(0)).count() == 0


def test_many_bundles_and_payloads(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}" + "text " * (i % 700)) for i in range(1500)]
    manifest = warc.archive(pages(spark, rows).repartition(3), shared_folder(spark), bundle_bytes=2_000)
    listed = manifest.collect()
    assert len(listed) > 3 and sum(r["records"] for r in listed) == 1500
    found = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.records(manifest).collect()}
    assert found == {i: html for i, _, html in rows}


def test_one_record_by_its_identifier_and_ordinary_reading(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    path = str(tmp_path / "one.warc.zst")
    bundle = warc.Bundle(open(path, "wb"))
    made = {}
    for i in range(40):
        payload = f"page {i} ".encode() * (i + 1)
        made[f"urn:page:{i}"] = payload
        bundle.add(f"urn:page:{i}", warc.record(i, "u", payload, hashlib.sha256(payload).hexdigest(), None))
    bundle.close()
    assert len(bundle.frames) > 10
    reader = warc.Reader(path)
    assert {i: reader.record(i)[1] for i in made} == made
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(open(path, "rb").read()), read_across_frames=True).read()
    assert whole == b"".join(reader.frames())
    with pytest.raises(KeyError):
        reader.record("urn:page:99")
    broken = tmp_path / "broken.warc.zst"
    broken.write_bytes(open(path, "rb").read()[:-3])
    with pytest.raises(ValueError, match="no seek table"):
        warc.Reader(str(broken))


def test_rows_of_one_id_and_without_id_are_all_found(spark):
    """Two payloads of one id, whole repeated rows, rows without id: the index has an entry of its own for each."""
    rows = [(7, "u", "a" * 200), (7, "u", "b" * 200), (7, "u", "b" * 200), (None, "u", "c"), (None, "u", "d"), (None, "u", "d")]
    listed = warc.archive(pages(spark, rows).coalesce(1), shared_folder(spark)).collect()
    assert sum(r["records"] for r in listed) == len(rows)
    got = []
    for r in listed:
        reader = warc.Reader(r["bundle"])
        assert all(reader.record(i)[0]["warc-record-id"] == f"<{i}>" for i in reader.index)
        got += [reader.record(i)[1].decode() for i in reader.index]
    assert sorted(got) == sorted(html for _, _, html in rows)


def test_bundles_are_read_by_as_many_tasks(spark):
    rows = [(i, "u", f"<p>{i}" + "text " * 300) for i in range(400)]
    manifest = warc.archive(pages(spark, rows).repartition(8), shared_folder(spark), bundle_bytes=1_000)
    assert manifest.count() >= 8
    assert warc.records(manifest).rdd.getNumPartitions() == manifest.count()
