import base64
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from glossa.llm import warc as W

SCHEMA = "page_id long, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def rows():
    rng = random.Random(1)
    out = [(i, f"https://h/{i}", rng.choice(["same", "é" * 50, None, "", f"own {i}", "x" * 70_000])) for i in range(80)]
    return out + [(None, None, "same"), (None, "u", "only here"), (500, "a b\r\nInjected: x", "own 500"), (7, "again", out[7][2]), (8, "again", "new 8")]


def brute(data, min_bytes=0):
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in data:
        h = h or ""
        f = first.get(h)
        again = len(h.encode()) >= min_bytes and f is not None and f != i
        out.append((str(i), len(h.encode()), sha(h), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_bytes", [0, 60])
def test_round_trip(spark, tmp_path, min_bytes, monkeypatch):
    data = rows()
    pages = spark.createDataFrame(data, SCHEMA).repartition(3).withColumns({c: F.lit(1) for c in ("k", "n", "first", "payload")})
    path = f"file:{tmp_path}/w"
    W.write_pages(pages, path, min_bytes)
    got = W.read_pages(spark, path).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(data, min_bytes)
    bodies = sorted((str(r.page_id), bytes(r.payload).decode()) for r in got if r.record_type == "response")
    kept = [(str(i), h or "") for (i, _, h), b in zip(data, data) if True]
    assert all(b in kept for b in bodies)
    urls = {r.page_id: r.url for r in got}
    assert urls[500] == "a b%0D%0AInjected: x" and urls[3] == "https://h/3"


def test_members_are_gzip_and_skippable(tmp_path):
    record = {"record_id": "urn:page:1", "record_type": "response", "target_uri": "u", "refers_to": None,
              "payload_sha1": hashlib.sha1(b"abc").digest(), "payload_bytes": 3, "payload": b"abc"}
    raw = W.record_bytes(record, "2020-01-01T00:00:00Z")
    again = W.record_bytes(record | {"record_id": "urn:page:2", "record_type": "revisit", "refers_to": "urn:page:1", "payload": None}, "2020-01-01T00:00:00Z")
    both = W.member(raw) + W.member(again)
    assert gzip.decompress(both) == raw + again
    for name, body in (("sized.warc.gz", both), ("plain.warc.gz", gzip.compress(raw) + gzip.compress(again)), ("bare.warc", raw + again),
                       ("info.warc", b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\nX: a\r\n b\r\n\r\nhello\r\n\r\n" + raw + again)):
        (tmp_path / name).write_bytes(body)
        found = [r for r in W.read_records(str(tmp_path / name)) if r["record_type"] != "warcinfo"]
        assert [(r["record_id"], r["record_type"], r["payload"], r["payload_bytes"], r["refers_to"]) for r in found] == [
            ("urn:page:1", "response", b"abc", 3, None), ("urn:page:2", "revisit", None, 3, "urn:page:1")]
        assert [r["record_id"] for r in W.read_records(str(tmp_path / name), wanted=lambda r: r["record_type"] == "revisit", need_payload=False)] == ["urn:page:2"]


def test_damaged_payload_is_found(tmp_path):
    record = {"record_id": "urn:page:1", "record_type": "response", "target_uri": "u", "refers_to": None,
              "payload_sha1": hashlib.sha1(b"other").digest(), "payload_bytes": 3, "payload": b"abc"}
    (tmp_path / "x.warc").write_bytes(W.record_bytes(record, "d"))
    with pytest.raises(ValueError):
        list(W.read_records(str(tmp_path / "x.warc")))


def test_unwanted_payloads_are_not_inflated(tmp_path, monkeypatch):
    big = {"record_id": "urn:page:1", "record_type": "response", "target_uri": "u", "refers_to": None,
           "payload_sha1": b"\0" * 20, "payload_bytes": 5_000_000, "payload": random.Random(0).randbytes(5_000_000)}
    (tmp_path / "x.warc.gz").write_bytes(W.member(W.record_bytes(big, "d")) * 3)
    made = []
    real = zlib.decompressobj

    class Counting:
        def __init__(self, bits):
            self.inner = real(bits)

        def decompress(self, data):
            made.append(len(data))
            return self.inner.decompress(data)

        @property
        def eof(self):
            return self.inner.eof

    monkeypatch.setattr(W.zlib, "decompressobj", Counting)
    assert len(list(W.read_records(str(tmp_path / "x.warc.gz"), need_payload=False))) == 3 and sum(made) < 50_000


def test_partitions_and_pushdown(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/w"
    W.write_pages(spark.createDataFrame(rows(), SCHEMA), path)
    reader = W.WarcReader(path, W.WarcDataSource({"path": path}).schema() and __import__("pyspark.sql.types", fromlist=["x"])._parse_datatype_string(W.SCHEMA))
    left = list(reader.pushFilters([W.EqualTo(("record_type",), "revisit"), W.In(("refers_to",), ("urn:page:1",)), W.EqualTo(("payload_bytes",), 3)]))
    assert [f.attribute for f in left] == [("payload_bytes",)] and len(reader.tests) == 2
    df = spark.read.format("warc").load(path)
    assert df.filter("record_type = 'revisit'").count() == sum(r[3] == "revisit" for r in brute(rows()))
    assert df.filter("target_uri = 'https://h/3'").select("record_id").first()[0] == "urn:page:3"
    assert df.filter("refers_to IS NOT NULL AND record_id IN ('urn:page:1')").count() <= 1
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(b"a file that no commit names")
    assert spark.read.format("warc").load(path).count() == len(rows())


def test_empty_table(spark, tmp_path):
    W.write_pages(spark.createDataFrame([], SCHEMA), f"{tmp_path}/none")
    assert W.read_pages(spark, f"{tmp_path}/none").collect() == []


def test_splits_between_records(tmp_path, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(W, "SPLIT_BYTES", 500)
    monkeypatch.setattr(W, "FILE_BYTES", 3000)
    data = [{"record_id": f"urn:page:{i}", "record_type": "response", "target_uri": None, "refers_to": None, "payload_sha1": hashlib.sha1(str(i).encode()).digest(),
             "payload_bytes": len(str(i)), "payload": str(i).encode()} for i in range(40)]
    writer = W.WarcWriter(str(tmp_path), "d", False)
    done = writer.write(iter([pa.RecordBatch.from_pylist(data)]))
    writer.commit([done])
    reader = W.WarcReader(str(tmp_path), __import__("pyspark.sql.types", fromlist=["x"])._parse_datatype_string(W.SCHEMA))
    parts = reader.partitions()
    assert len(done.files) > 1 and len(parts) > len(done.files)
    got = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted(r["record_id"] for r in got) == sorted(d["record_id"] for d in data)
    writer.abort([done])
    assert not list(tmp_path.glob("part-*"))
