"""Packing: best-fit decreasing over a histogram of piece lengths.

Every document becomes token ids plus an end id and is cut into full windows
and one remainder. Best-fit decreasing puts each piece, longest first, into
the open window with the least room that still holds it; a segment tree
indexed by remaining capacity finds that window. Pieces of one length are
interchangeable and so are windows of one remaining capacity, so the plan is
made on the histogram: at most ``capacity`` counts on the driver, whatever the
size of the corpus, give the same packing as placing pieces one by one. Spark
then ranks the pieces of each length and looks up each rank in the plan.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import stage

CAPACITY = 4096
END_ID = 2
CACHE_WORDS = 600_000
RANK_ROWS = 2_000
_KEEP: dict = {}  # tokenizers and their words, one per Python worker


def _id_bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_level() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Word -> id bytes; a word not met before is encoded by the tokenizer.

    Words of ASCII characters (without ``'`` and ``<``, which start contractions
    and special tokens) and Latin-1 letters are split here, as the tokenizer's
    own pattern does: runs of letters, single digits, runs of others; its BPE model
    then merges each part, and parts are kept as words of their own. All other
    words take the tokenizer's whole path.
    """

    plain = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
    parts = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.alphabet = _byte_level()

    def shrink(self) -> None:
        """Forget long words, which seldom come back; all if that is not enough."""
        short = {w: ids for w, ids in self.items() if len(w) <= 8}
        self.clear()
        if len(short) <= CACHE_WORDS // 2:
            self.update(short)

    def whole(self, text: str) -> bytes:
        return _id_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def part(self, p: str) -> bytes:
        found = self.get(p)
        if found is None:
            mapped = p if p.isascii() else "".join(map(self.alphabet.__getitem__, p.encode()))
            found = self[p] = _id_bytes([t.id for t in self.merge(mapped)])
        return found

    def __missing__(self, word: str) -> bytes:
        found = b"".join(map(self.part, self.parts.findall(word.lower()))) if self.plain.fullmatch(word) else self.whole(word)
        self[word] = found
        return found


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never joins across it, so a text's ids
    are those of its words in order, and a word met before costs one lookup.
    Texts with the separators U+001C to U+001F, which Python but not the
    tokenizer takes for white space, are encoded whole.
    """
    if path not in _KEEP:
        _KEEP[path] = WordIds(path)
    cache, out = _KEEP[path], []
    for t in texts:
        if len(cache) > CACHE_WORDS:
            cache.shrink()
        out.append(cache.whole(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else b"".join(map(cache.__getitem__, t.split())))
    return out


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, doc_tokens, ids``: full windows and one remainder per document.

    ``ids`` is binary. Null texts are empty; every document has at least its end
    id, hence a piece. Documents are read in slices of about 4 million
    characters, so memory follows the longest document, not the batch.
    """
    end = _id_bytes([end_id])
    width = 4 * capacity

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(ids: list, texts: list) -> pd.DataFrame:
            rows = []
            for doc_id, found in zip(ids, encode(texts, tokenizer)):
                found += end
                n = len(found) // 4
                rows += [(doc_id, at // 4, min(width, len(found) - at) // 4, n, found[at : at + width]) for at in range(0, len(found), width)]
            got = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])
            return got.astype({"doc_id": "Int64"})

        for b in batches:
            ids, texts, size = [], [], 0
            for doc_id, text in zip(b["doc_id"].array, b["text"].array):
                text = "" if text is None or text is pd.NA else text
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                texts.append(text)
                size += len(text)
                if size > 4_000_000:
                    yield out(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield out(ids, texts)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


class CapacityTree:
    """Segment tree over remaining capacities 0..top; a leaf is set while windows of it are open."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.live = bytearray(2 * self.size)

    def put(self, capacity: int, on: bool) -> None:
        at = self.size + capacity
        self.live[at] = on
        while at > 1:
            at //= 2
            self.live[at] = self.live[2 * at] | self.live[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The least open capacity of at least ``need``."""
        at = self.size + need
        if self.live[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.live[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.live[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing of ``lengths`` (length -> count).

    Returns runs ``(length, rank, count, sequence, each, offset)``: pieces of
    this length with ranks from ``rank`` on go ``each`` at a time to the
    sequences from ``sequence`` on, from ``offset`` on. A window that takes a
    piece and still holds another is the tightest for that one too, so windows
    are filled in whole runs.
    """
    tree, open_runs, runs, n_sequences = CapacityTree(capacity), {}, [], 0

    def leave(room: int, sequence: int, count: int) -> None:
        if room and count:
            open_runs.setdefault(room, []).append((sequence, count))
            tree.put(room, True)

    for length in sorted(lengths, reverse=True):
        rank, left = 0, lengths[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, sequence, windows = capacity, n_sequences, -(-left // (capacity // length))
                n_sequences += windows
            else:
                sequence, windows = open_runs[room].pop()
                if not open_runs[room]:
                    tree.put(room, False)
            each = room // length
            full = min(windows, left // each)
            if full:
                runs.append((length, rank, full * each, sequence, each, capacity - room))
                leave(room - each * length, sequence, full)
                rank, left = rank + full * each, left - full * each
            if full < windows and left:
                # fewer than a window's worth: the last window of this run stays wider
                runs.append((length, rank, left, sequence + full, left, capacity - room))
                leave(room - left * length, sequence + full, 1)
                full, rank, left = full + 1, rank + left, 0
            leave(room, sequence + full, windows - full)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with ``doc_id, start, length``.

    Repeated rows are separate pieces. Ranks come from counts per (length,
    salt), with as many salts for a length as keep a group near ``RANK_ROWS``
    rows, so a length that many documents share is no single task. The plan has a few
    rows per length (at most ``capacity`` lengths), a bound that does not grow
    with the corpus, and is broadcast. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    lengths = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    runs = best_fit(lengths, capacity)
    salts = spark.createDataFrame([(n, -(-c // RANK_ROWS)) for n, c in lengths.items()], "length long, __salts long")
    rows = pieces.join(F.broadcast(salts), "length")  # at most ``capacity`` rows
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start"), "__salts")).drop("__salts")
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("length", "__salt").count().select("length", "__salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("length", "__salt").orderBy("doc_id", "start", *[c for c in pieces.columns if c not in ("doc_id", "start", "length")])
    rows = rows.withColumn("__rank", F.row_number().over(inside).cast("long") - 1).join(bases, ["length", "__salt"])
    rows = rows.withColumn("__rank", F.col("__rank") + F.col("__base"))
    plan = spark.createDataFrame(runs, "length long, first long, n long, sequence long, each long, at long").withColumnsRenamed(
        {c: f"__{c}" for c in ("first", "n", "sequence", "each", "at")})
    inside_run = (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__n"))
    rows = rows.withColumnRenamed("length", "__length").join(F.broadcast(plan), (F.col("__length") == F.col("length")) & inside_run)
    nth = F.col("__rank") - F.col("__first")
    return (rows.withColumn("sequence_id", F.col("__sequence") + F.floor(nth / F.col("__each")).cast("long"))
            .withColumn("offset", F.col("__at") + nth % F.col("__each") * F.col("length"))
            .select(*pieces.columns, "sequence_id", "offset"))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """``sequence_id, tokens, ids``: whole sequences from packed pieces with ``ids``.

    Ids are padded to ``capacity`` unless their number is a power of two. At most ``capacity`` ids meet in a row.
    """
    pad = _id_bytes([pad_id]).hex()
    got = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("p"), F.sum("length").alias("tokens"))
    body = F.array_join(F.transform("p", lambda x: x["ids"]), "")
    even = F.col("tokens").bitwiseAND(F.col("tokens") - 1) == 0
    return got.select("sequence_id", "tokens", F.unhex(F.when(even, body).otherwise(F.rpad(body, 8 * capacity, pad))).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """(pieces with ids, written once; their places without ids)."""
    pieces = stage(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    places = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pieces, pack(places, capacity)
