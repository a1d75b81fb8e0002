"""SimHash near-duplicates through Golay-code fuzzy hashing.

Fingerprints are 64 bits, cut into three segments of 22, 21 and 21 bits. A
segment, padded to 23 bits, is a word of the perfect binary Golay code
[23, 12, 7]: decoding gives its nearest codeword, and with the codewords at
distance 4 there are one to six codeword indices. Two words at distance 2 or
less always share an index: the word between them lies within 3 of some
codeword, which then lies within 4 of both.

Pigeonhole over at most 4 differing bits:

* some segment has none: of the other two, one has at most 2. Key: the exact
  segment with a codeword index of that other (6 ordered pairs);
* no segment has none: then the counts are (2,1,1) or (1,1,1) in some order.
  Key: a codeword index of the segment with most, and of either other segment
  one half that is exact (3 x 2 x 2 choices).

That makes about 96 keys of 33 or 34 bits per distinct fingerprint. Equal keys
meet in one bucket, where distances are checked and only a spanning forest of
the links leaves. Buckets over ``BUCKET`` fingerprints are cut into blocks and
compared block pair by block pair in a second pass, so none is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage
from quarry.llm.components import components

SEED = 42
SHINGLE = 4
MAX_BITS = 4
BUCKET = 4096
GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEGMENTS = [(0, 22), (22, 21), (43, 21)]  # first bit, bits


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a text: bit i is set if over half of the shingle hashes have it set.

    Words are split at ASCII white space after lower-casing A-Z; a text of
    fewer words than ``shingle`` is one shingle, one without words has
    fingerprint 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, both times
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(joined, SEED)], np.uint64)
    else:
        stops = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = [0, *(stops[: -shingle] + 1).tolist()]
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops[shingle - 1 :].tolist())), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 32768):
        part = hashes[at : at + 32768].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (bigint, the 64 bits as a signed number) of whole texts; null texts have no words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint_of(t or "", shingle) for t in b["text"]], np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fps})

    # ids travel as strings where they may be null: pandas would make them floats
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def _remainders(bits: int) -> np.ndarray:
    """Remainder modulo the generator of every word of ``bits`` bits."""
    out = np.arange(1 << bits, dtype=np.int64)
    for at in range(bits - 1, 10, -1):
        out = np.where(out >> at & 1, out ^ (GENERATOR << (at - 11)), out)
    return out


class Golay:
    """Indices of the codewords within distance 4, for arrays of 23-bit words."""

    def __init__(self):
        self.low = _remainders(12)
        high = np.arange(1 << 11, dtype=np.int64) << 12
        for at in range(22, 10, -1):
            high = np.where(high >> at & 1, high ^ (GENERATOR << (at - 11)), high)
        self.high = high
        # per syndrome: the pattern of weight 3 or less, then the five of weight 4 where it has weight 3
        self.patterns = np.full((2048, 6), -1, np.int64)
        filled = np.zeros(2048, np.int64)
        for weight in range(5):
            for places in combinations(range(23), weight):
                word = sum(1 << p for p in places)
                s = int(self.syndrome(np.array([word]))[0])
                if weight < 4 or bin(int(self.patterns[s, 0])).count("1") == 3:
                    self.patterns[s, filled[s]] = word
                    filled[s] += 1

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]

    def indices(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) indices of 12 bits, -1 where there are fewer."""
        patterns = self.patterns[self.syndrome(words)]
        return np.where(patterns >= 0, (words[:, None] ^ patterns) >> 11, -1)


_TABLES: list[Golay] = []


def golay() -> Golay:
    if not _TABLES:
        _TABLES.append(Golay())
    return _TABLES[0]


def keys_of(fps: np.ndarray) -> np.ndarray:
    """(n, 108) keys of fingerprints (uint64), -1 where a segment has fewer codewords."""
    code, words = golay(), [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [code.indices(w) for w in words]
    halves = [(w & 0x3FF, w >> 10) for w in words]
    out, family = [], 0
    for x in range(3):
        for y in range(3):
            if x != y:
                key = (family << 36) | (words[x][:, None] << 12) | near[y]
                out.append(np.where(near[y] >= 0, key, -1))
                family += 1
    for x in range(3):
        y, z = (i for i in range(3) if i != x)
        for p in range(2):
            for q in range(2):
                exact = (halves[y][p] << 12) | halves[z][q]
                key = (family << 36) | (exact[:, None] << 12) | near[x]
                out.append(np.where(near[x] >= 0, key, -1))
                family += 1
    return np.concatenate(out, axis=1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def forest(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[np.ndarray]:
    """Components of two or more among the fingerprints of one bucket.

    Breadth first: each member meets those not yet reached once, so a dense
    group takes few passes and no list of pairs is made.
    """
    rest, found = np.unique(fps), []
    while len(rest) > 1:
        member, queue, rest = [rest[0]], [rest[0]], rest[1:]
        while queue and len(rest):
            hit = _apart(rest, queue.pop()) <= max_bits
            if hit.any():
                new = rest[hit]
                rest = rest[~hit]
                member.extend(new)
                queue.extend(new)
        if len(member) > 1:
            found.append(np.array(member, np.uint64))
    return found


def _bucket_links(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets (rows sorted by key): pairs in small ones, stars of components in larger ones."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    left, right = [], []
    small = np.repeat(sizes <= 16, sizes)
    for d in range(1, 16):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        if not len(i):
            break
        i = i[_apart(fps[i], fps[i + d]) <= max_bits]
        left.append(fps[i])
        right.append(fps[i + d])
    for s, n in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
        for member in forest(fps[s : s + n], max_bits):
            left.append(member[1:])
            right.append(np.full(len(member) - 1, member[0]))
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def link(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp`` (distinct) -> links ``a, b`` whose transitive closure holds exactly the pairs within ``max_bits`` (at most 4).

    Rows go to buckets by key and are streamed in key order; a bucket that
    outgrows ``BUCKET`` rows passes through unread for the second pass.
    """
    if max_bits > MAX_BITS:
        raise ValueError("the keys cover at most 4 differing bits")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 10_000):
                fps = b["fp"].to_numpy(np.int64)[at : at + 10_000]
                keys = keys_of(fps.astype(np.uint64))
                row, col = np.nonzero(keys >= 0)
                yield pd.DataFrame({"key": keys[row, col], "fp": fps[row]})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, fps, over = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def linked(k: np.ndarray, f: np.ndarray) -> pd.DataFrame:
            a, b = _bucket_links(k, f, max_bits)
            return pd.DataFrame({"a": a.astype(np.int64), "b": b.astype(np.int64), "over": False}).drop_duplicates()

        def passed(k: np.ndarray, f: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"a": k, "b": f.astype(np.int64), "over": True})

        for b in batches:
            k, f = b["key"].to_numpy(np.int64), b["fp"].to_numpy(np.int64).astype(np.uint64)
            if over is not None:  # the rest of a bucket that is passed through
                n = int(np.searchsorted(k, over, side="right"))
                if n:
                    yield passed(k[:n], f[:n])
                k, f, over = k[n:], f[n:], None if n < len(b) else over
            if not len(k):
                continue
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            last = int(np.searchsorted(keys, keys[-1]))
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            big = np.repeat(sizes > BUCKET, sizes)
            whole = ~big
            whole[last:] = False
            if big.any():
                yield passed(keys[big], fps[big])
            if whole.any():
                yield linked(keys[whole], fps[whole])
            if big[-1]:
                over, last = keys[-1], len(keys)
            keys, fps = keys[last:], fps[last:]
        if len(keys):
            yield linked(keys, fps)

    # a named number of tasks: adaptive execution would size them by 8-byte rows that grow a hundredfold
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = distinct.select("fp").repartition(parts, "fp").mapInPandas(emit, "key long, fp long")
    met = stage(keyed.repartition("key").sortWithinPartitions("key").mapInPandas(meet, "a long, b long, over boolean"), "links")
    links = met.where("not over").select("a", "b")
    large = met.where("over").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    if large.isEmpty():
        return links
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("n"))
    rows = large.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")

    def compare(b: pd.DataFrame) -> pd.DataFrame:
        stars = [(m[1:], np.full(len(m) - 1, m[0])) for m in forest(b["fp"].to_numpy(np.int64).astype(np.uint64), max_bits)]
        a, r = (np.concatenate(x) for x in zip(*stars)) if stars else (np.empty(0, np.uint64),) * 2
        return pd.DataFrame({"a": a.astype(np.int64), "b": r.astype(np.int64)})

    return links.union(rows.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    component_id is the smallest doc_id that links of at most ``max_bits``
    bits reach, the row itself included (null only where all reached ids are
    null). Equal fingerprints are one node, so copies make no links. Extra
    columns are ignored, repeated rows are kept, an empty table gives no rows.
    """
    marked = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(link(marked.select("fp").distinct(), max_bits)).withColumnRenamed("node", "fp")
    # only linked fingerprints need their component's lowest id; both sides are staged, so that a
    # component with very many fingerprints is a skewed join, which adaptive execution splits
    linked = stage(nodes.join(roots, "fp"), "linked")
    lowest = stage(linked.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    low = linked.join(lowest, "root").select("fp", "component_id")
    named = stage(nodes.join(low, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "components")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
