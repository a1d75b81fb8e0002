import hashlib
import io
import struct

import pytest
import zstandard as zstd

from quarry.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first int, salt string"


def brute(rows, least=100):
    payloads = [(p, (h or "").encode()) for p, _, h in rows]
    firsts = {}
    for p, b in payloads:
        if len(b) >= least and p is not None:
            firsts[b] = min(p, firsts.get(b, p))
    n = {}
    for _, b in payloads:
        n[b] = n.get(b, 0) + 1
    for p, b in payloads:
        first = firsts.get(b)
        again = n[b] > 1 and first is not None and p != first
        yield str(p), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(first) if again else "None"


@pytest.fixture(scope="module")
def rows():
    big = "<p>ü" + "long page " * 30
    got = [(i, f"http://e.org/{i}", f"<html>{i} " + "text " * (i % 50)) for i in range(80)]
    got += [(100 + i, "http://copy", big) for i in range(50)] + [(90, None, big), (95, "http://a\r\nb é", "short"), (96, "", "short"), (97, "u", None), (98, "u", "")]
    return got + [(90, "again", big), (None, "n", big), (None, "m", None), (99, "v", "z" * 3_000_000)]


def test_round_trip(spark, rows):
    pages = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    got = warc.archive_round_trip(pages, with_payload=True).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(brute(rows))
    assert all((r.payload is None) if r.record_type == "revisit" else hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got)


def test_small_archives_and_empty(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.scratch(spark, "t")
    manifest = warc.write_archives(warc.plan_records(pages), folder, b"", archive_bytes=2000)
    assert manifest.count() > 3 and manifest.agg({"records": "sum"}).first()[0] == len(rows)
    assert warc.read_archives(manifest, False).count() == len(rows)
    assert warc.archive_round_trip(pages.limit(0)).collect() == []


def archive(*records, dictionary=b"", packed=True):
    d = zstd.ZstdCompressionDict(dictionary) if dictionary else None
    body = zstd.ZstdCompressor().compress(dictionary) if packed else dictionary
    head = struct.pack("<II", warc.DICT_MAGIC, len(body)) + body if dictionary else b""
    return io.BytesIO(head + b"".join(zstd.ZstdCompressor(dict_data=d).compress(r) for r in records))


@pytest.mark.parametrize("packed", [True, False])
def test_frames_with_dictionary(packed):
    dictionary = zstd.train_dictionary(2000, [b"<html><body>page number %d of many </body>" % i * 3 for i in range(200)]).as_bytes()
    records = [warc.record_bytes(i, "http://u", b"<html><body>page number" * i, hashlib.sha256(b"<html><body>page number" * i).hexdigest(), None, "2024-01-01T00:00:00Z") for i in range(50)]
    assert list(warc.frames(archive(*records, dictionary=dictionary, packed=packed))) == records
    whole = archive(*records, dictionary=dictionary, packed=packed).getvalue()
    with pytest.raises((ValueError, zstd.ZstdError)):
        list(warc.frames(io.BytesIO(whole[:-5])))


def test_damaged_records():
    good = warc.record_bytes(1, "http://u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(good)["payload"] == b"payload"
    for bad in (good.replace(b"payload\r", b"payloax\r"), good[:-1], good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Type: response\r\n", b""),
                good.replace(b"Content-Length: 7", b"Content-Length: 8"), good.replace(b"WARC-Date:", b"WARC-Date"), good + b"x"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_files_have_a_frame_per_record(spark, rows):
    """Read as bytes: a skippable frame first, then as many frames as the manifest has records."""
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    samples = [b"<html>%d text text text" % i * 20 for i in range(300)]
    dictionary = zstd.train_dictionary(2000, samples).as_bytes()
    manifest = warc.write_archives(warc.plan_records(pages), warc.scratch(spark, "t"), dictionary).collect()
    for r in manifest:
        data = open(r.archive.removeprefix("file://"), "rb").read()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == warc.DICT_MAGIC and len(data) == r.bytes
        at, n = 8 + size, 0
        known = zstd.ZstdCompressionDict(zstd.ZstdDecompressor().decompress(data[8:at]))
        while at < len(data):
            assert data[at : at + 4] == struct.pack("<I", warc.ZSTD_MAGIC)
            frame = zstd.ZstdDecompressor(dict_data=known).decompressobj()
            assert frame.decompress(data[at:]).startswith(b"WARC/1.1\r\n")
            at, n = len(data) - len(frame.unused_data), n + 1
        assert n == r.records


def test_payloads_beyond_the_broadcast_table(spark, rows, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 1)
    rows = rows + [(200 + i, "http://two", "<b>second" + "payload " * 30) for i in range(5)] + [(300 + i, "u", "<b>third" + "payload " * 30) for i in range(3)]
    got = warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), len(r.payload), r.digest, r.record_type, str(r.refers_to)) for r in got) == sorted(brute(rows))
