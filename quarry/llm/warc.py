"""WARC archives in Zstandard: one frame per record, a shared dictionary up front.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself a Zstandard frame or raw; after it every record is a frame
of its own. The writer leaves out payloads that an earlier page has (revisit
records); the reader streams frame by frame, so it holds one record at a time,
and checks each record: version line, mandatory headers, block length, closing
line ends, HTTP length and payload digest.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hashed_sample, scratch, stage

# Fixed by the format.
DICT_MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

HOT = 1000
MIN_PAYLOAD = 100
_CHUNK = 256 << 10


def plan_records(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``page_id, url, payload, digest, record_type, refers_to`` for every page.

    Among records with equal payloads of at least ``min_payload`` bytes the
    smallest page_id is the response, the others revisit it (rows repeated with
    that smallest id are responses too, since none can revisit itself; a null
    page_id is never the smallest unless all are null, and then all are
    responses). Null html is an empty payload. Payloads are counted before the
    shuffle: the ``HOT`` most shared ones are looked up from a broadcast table of
    as many rows and their pages are spread over all tasks, so no other payload
    than those of at most 1/``HOT`` of the pages is a join key.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= min_payload)
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = stage(firsts, "payloads")
    hot = firsts.orderBy(F.desc("n"), "digest").limit(HOT)
    cold = firsts.join(F.broadcast(hot.select("digest")), "digest", "left_anti").select(F.col("digest").alias("key"), F.col("first").alias("cold"))
    rows = rows.join(F.broadcast(hot.select("digest", F.col("first").alias("hot"))), "digest", "left")
    # what the broadcast table has answered needs no partner: it gets a key of its own
    rows = rows.withColumn("key", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.xxhash64("page_id", "url").cast("string")))
    joined = rows.join(cold, "key", "left").withColumn("first", F.coalesce("hot", "cold"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("first")).alias("refers_to"))


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit's block is the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {quote(url or 'about:blank', safe=''.join(map(chr, range(33, 127))))}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_uri(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(records: DataFrame, samples: int = 400, sample_bytes: int = 8192, size: int = 32768) -> bytes:
    """A dictionary from at most ``samples`` payload heads chosen by hash; empty if there is too little to learn from."""
    got = records.select("digest", F.substring("payload", 1, sample_bytes).alias("p")).where("octet_length(p) >= 64")
    got = [bytes(r["p"]) for r in hashed_sample(got, ["digest"], samples).select("p").collect()]
    try:
        return zstd.train_dictionary(size, got).as_bytes() if len(got) >= 16 else b""
    except zstd.ZstdError:
        return b""


def write_archives(records: DataFrame, folder: str, dictionary: bytes = b"", date: str = "2024-01-01T00:00:00Z",
                   archive_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Write ``folder``/*.warc.zst and return the manifest ``archive, records, bytes``.

    Every attempt of a task writes files of its own name and only those that a
    committed task reports are in the manifest, so a lost executor leaves at
    most files that nobody reads. ``folder`` is a URI that all executors share.
    """
    skip = b""
    if dictionary:
        body = zstd.ZstdCompressor(level=9).compress(dictionary)
        skip = struct.pack("<II", DICT_MAGIC, len(body)) + body

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        pack = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        out, name, n, size = None, "", 0, 0
        for b in batches:
            for page_id, url, payload, digest, refers in zip(b["page_id"].array, b["url"].array, b["payload"].array, b["digest"].array, b["refers_to"].array):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out, n, size = fs.open_output_stream(f"{base}/{name}", compression=None), 0, len(skip)
                    out.write(skip)
                frame = pack.compress(record_bytes(None if pd.isna(page_id) else int(page_id), None if pd.isna(url) else url, bytes(payload), digest,
                                                   None if pd.isna(refers) else int(refers), date))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= archive_bytes:
                    out.close()
                    yield pd.DataFrame({"archive": [f"{folder}/{name}"], "records": [n], "bytes": [size]})
                    out = None
        if out is not None:
            out.close()
            yield pd.DataFrame({"archive": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

    # nullable ids travel as strings: a pandas float column would round large ones
    sent = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"))
    return stage(sent.mapInPandas(write, "archive string, records long, bytes long"), "manifest")


def frames(stream: io.RawIOBase) -> Iterator[bytes]:
    """The decoded frames of an archive, using the dictionary of its leading skippable frame."""
    head = stream.read(8)
    if not head:
        return
    if len(head) < 8:
        raise ValueError("archive is cut short")
    magic, size = struct.unpack("<II", head)
    dictionary = None
    if magic == DICT_MAGIC:
        body = stream.read(size)
        if len(body) != size:
            raise ValueError("dictionary frame is cut short")
        if body[:4] == struct.pack("<I", ZSTD_MAGIC):
            body = zstd.ZstdDecompressor().decompressobj().decompress(body)
        dictionary, head = zstd.ZstdCompressionDict(body), b""
    unpack = zstd.ZstdDecompressor(dict_data=dictionary)
    left = head
    while True:
        left = left or stream.read(_CHUNK)
        if not left:
            return
        frame, parts = unpack.decompressobj(), []
        while not frame.eof:
            if not left:
                left = stream.read(_CHUNK)
                if not left:
                    raise ValueError("frame is cut short")
            parts.append(frame.decompress(left))
            left = b""
        left = frame.unused_data
        yield b"".join(parts)


def parse_record(data: bytes) -> dict:
    """Fields of one record; ValueError if a header, length or digest is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"header {name} is missing")
    if not fields["content-length"].isdigit() or int(fields["content-length"]) != len(rest) - 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("block length is not the declared one")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    if not found or not http.startswith(b"HTTP/1.") or not length:
        raise ValueError("no HTTP header")
    n, digest = int(length[1]), fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if fields["warc-type"] == "response":
        if n != len(payload) or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("payload does not match its length or digest")
    elif fields["warc-type"] != "revisit" or payload or not re.fullmatch("[0-9a-f]{64}", digest) or "warc-refers-to" not in fields:
        raise ValueError("not a response or revisit")

    def page(uri: str | None) -> str | None:
        found = re.fullmatch(r"<urn:page:(-?\d+|null)>", uri or "")
        if uri and not found:
            raise ValueError(f"bad record id {uri[:80]!r}")
        return found[1] if found and found[1] != "null" else None

    return {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": n, "payload_digest": digest,
            "record_type": fields["warc-type"], "refers_to": page(fields.get("warc-refers-to")), "payload": payload if fields["warc-type"] == "response" else None}


def read_archives(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``manifest``; a damaged archive fails the job.

    ``payload`` is null for revisits (and for all without ``with_payload``).
    Archives are dealt out evenly, one at a time per task, and streamed. A
    manifest count that an archive does not hold is an error too.
    """
    columns = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for archive, expected in zip(b["archive"], b["records"]):
                fs, path = pafs.FileSystem.from_uri(archive)
                rows, size, n = [], 0, 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for data in frames(stream):
                        try:
                            row = parse_record(data)
                        except ValueError as e:
                            raise ValueError(f"{archive}, record {n}: {e}") from e
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        n, size = n + 1, size + (len(data) if with_payload else 200)
                        if size > 8 << 20:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, size = [], 0
                if n != expected:
                    raise ValueError(f"{archive}: {n} records, the manifest has {expected}")
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    n = max(1, manifest.count())
    found = manifest.repartition(n).mapInPandas(read, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return found.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def archive_round_trip(pages: DataFrame, min_payload: int = MIN_PAYLOAD, with_payload: bool = False) -> DataFrame:
    """Write every page as a record and read the archives back."""
    records = plan_records(pages, min_payload)
    folder = scratch(pages.sparkSession, "warc")
    sample = pages.select(F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    return read_archives(write_archives(records, folder, train_dictionary(sample)), with_payload)
