"""Benchmark decontamination with a positional inverted index.

The index stores every token of every document. It is a table of segments: a
segment covers some whole documents (about ``SEGMENT_TOKENS`` tokens) and holds
their ids and first positions, its sorted vocabulary, and one posting list of
positions per term. Positions run through the segment, with one free position
between documents, so a phrase never crosses from one document to the next.

A test phrase is looked up inside each segment on its own: its terms are
ordered by the length of their lists in that segment, the rarest list, shifted
by the term's offset, gives the candidate starts, and the list of each further
term, shifted by its offset, is intersected with them. All phrases of a block
whose rarest word (among the items) the segment has take each step together, in
numpy. Segments need no shuffle, and test items come in blocks of bounded size.

A segment is a row of some 300 KB, its lists packed, and a task opens one at a time;
row groups are small. So memory follows neither the file nor the task that reads it.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import stage

WINDOW = 10
STRETCH = 2
SEGMENT_TOKENS = 1 << 17
GROUP_BYTES = 8 << 20  # of the index that a writer or reader holds at a time
BLOCK_BYTES = 16 << 20

# Word characters: 0-9, a-z (A-Z fold to them) and everything beyond ASCII.
_FOLD = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
    for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text (UTF-8); null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


INDEX_SCHEMA = "doc_ids array<string>, doc_rows binary, doc_starts binary, doc_words binary, terms binary, list_starts binary, positions binary"
_INDEX = pa.schema([("doc_ids", pa.list_(pa.string())), *((c, pa.binary()) for c in ("doc_rows", "doc_starts", "doc_words", "terms", "list_starts", "positions"))])


def _packed(data: bytes) -> bytes:
    return zstd.ZstdCompressor(level=1).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstd.ZstdDecompressor().decompress(data)


def _segment(ids: list, rows: list[int], texts: list[list[bytes]]) -> dict:
    numbers: defaultdict = defaultdict(itertools.count().__next__)
    counts = np.array([len(w) for w in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts + 1)[:-1]]).astype(np.int64)
    term = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(texts)), np.int32, int(counts.sum()))
    position = np.arange(len(term), dtype=np.int64) + np.repeat(np.arange(len(texts)), counts)
    terms = sorted(numbers)  # bytes order
    place = np.empty(len(terms), np.int32)
    place[np.fromiter((numbers[t] for t in terms), np.int64, len(terms))] = np.arange(len(terms))
    term = place[term]
    order = np.argsort(term, kind="stable")
    lists = np.searchsorted(term[order], np.arange(len(terms) + 1))
    return {"doc_ids": ids, "doc_rows": np.array(rows, "<i8").tobytes(), "doc_starts": starts.astype("<i8").tobytes(), "doc_words": counts.astype("<i8").tobytes(), "terms": _packed(b" ".join(terms)),
            "list_starts": _packed(lists.astype("<i8").tobytes()), "positions": _packed(position[order].astype("<i4").tobytes())}


def build_index(docs: DataFrame, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """The index of ``doc_id, text``, written once to the shared folder.

    Each row gets a number of its own, so rows that share an id, or have none,
    stay apart; the numbers hold because they are written with the index.
    Documents stay whole: a segment ends with the document that takes it past
    ``segment_tokens``, so memory follows that bound plus the longest document.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, numbers, texts, size = [], [], [], 0
        for b in batches:
            for doc_id, number, text in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text")):
                ids.append(doc_id)
                numbers.append(number)
                texts.append(words_of(text.as_py()))
                size += len(texts[-1]) + 1
                if size >= segment_tokens:
                    yield pa.RecordBatch.from_pylist([_segment(ids, numbers, texts)], schema=_INDEX)
                    ids, numbers, texts, size = [], [], [], 0
        if ids:
            yield pa.RecordBatch.from_pylist([_segment(ids, numbers, texts)], schema=_INDEX)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return stage(rows.mapInArrow(build, INDEX_SCHEMA), "index", dictionary=False, group_bytes=GROUP_BYTES)


class Segment:
    """One segment, opened for lookups."""

    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.rows = np.frombuffer(row["doc_rows"], "<i8")
        self.starts = np.frombuffer(row["doc_starts"], "<i8")
        self.counts = np.frombuffer(row["doc_words"], "<i8")
        self.lists = np.frombuffer(_unpacked(row["list_starts"]), "<i8")
        self.positions = np.frombuffer(_unpacked(row["positions"]), "<i4").astype(np.int64)
        terms = _unpacked(row["terms"])
        self.terms = {t: i for i, t in enumerate(terms.split(b" "))} if terms else {}
        # (term, position) in one sorted array: a list is a slice, membership a binary search
        self.keys = (np.repeat(np.arange(len(self.terms), dtype=np.int64), np.diff(self.lists)) << 32) | self.positions

    def numbers(self, vocabulary: list[bytes]) -> np.ndarray:
        """Term numbers of this segment, -1 for terms that it lacks."""
        return np.array([self.terms.get(t, -1) for t in vocabulary], np.int64)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = (term << 32) | position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (position >= 0)

    def phrases(self, terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact occurrences of phrases: (phrase, start).

        ``terms`` is (n, longest) with the segment's term numbers, ``sizes`` the
        phrase lengths; a phrase with a term that the segment lacks has none.
        """
        live = np.arange(terms.shape[1])[None, :] < sizes[:, None]
        known = np.flatnonzero(~((terms < 0) & live).any(axis=1) & (sizes > 0))
        if not len(known) or not len(self.keys):
            return known[:0], known[:0]
        terms, sizes = terms[known], sizes[known]
        length = np.where(live[known], np.diff(self.lists)[np.maximum(terms, 0)], np.iinfo(np.int64).max)
        rare_first = np.argsort(length, axis=1, kind="stable")
        first = rare_first[:, 0]
        rows = np.arange(len(terms))
        rarest = terms[rows, first]
        n = np.diff(self.lists)[rarest]
        phrase = np.repeat(rows, n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        start = self.positions[np.repeat(self.lists[rarest], n) + inside] - first[phrase]
        keep = start >= 0
        phrase, start = phrase[keep], start[keep]
        for step in range(1, terms.shape[1]):
            if not len(phrase):
                break
            offset = rare_first[phrase, step]
            keep = (offset >= sizes[phrase]) | self.has(terms[phrase, offset], start + offset)
            phrase, start = phrase[keep], start[keep]
        return known[phrase], start

    def near(self, terms: list[int], slop: int) -> np.ndarray:
        """Positions of the rarest term around which each other term occurs within ``slop`` positions, in the same document."""
        if not terms or min(terms) < 0:
            return np.empty(0, np.int64)
        lists = sorted((self.positions[self.lists[t] : self.lists[t + 1]] for t in set(terms)), key=len)
        at = lists[0]
        doc = np.searchsorted(self.starts, at, side="right") - 1
        low, high = np.maximum(at - slop, self.starts[doc]), np.minimum(at + slop, self.starts[doc] + self.counts[doc] - 1)
        for other in lists[1:]:
            keep = np.searchsorted(other, low) < np.searchsorted(other, high, side="right")
            at, low, high = at[keep], low[keep], high[keep]
        return at


    def gathered(self, terms: np.ndarray, width: int) -> list[int]:
        """Documents with a stretch of ``width`` words that holds all ``terms``.

        Starts from the places that ``near`` leaves; for each, the starts of a
        stretch that holds the place are narrowed term by term.
        """
        terms = np.unique(terms)
        found: list[int] = []
        for p in self.near(terms.tolist(), width - 1).tolist():
            doc = int(np.searchsorted(self.starts, p, side="right") - 1)
            if found and found[-1] == doc:
                continue
            low, high = max(p - width + 1, int(self.starts[doc])), min(p + width - 1, int(self.starts[doc] + self.counts[doc]) - 1)
            starts = np.ones(width, bool)  # of the stretches from p - width + 1 to p
            for t in terms:
                places = self.positions[self.lists[t] : self.lists[t + 1]]
                places = places[np.searchsorted(places, low) : np.searchsorted(places, high, side="right")] - (p - width + 1)
                edges = np.zeros(2 * width + 1, np.int64)
                np.add.at(edges, np.maximum(places - width + 1, 0), 1)
                np.add.at(edges, places + 1, -1)
                starts &= np.cumsum(edges)[:width] > 0
            if starts.any():
                found.append(doc)
        return found


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Segment]:
    """The segments of an index, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield Segment({c: b.column(c)[i].as_py() for c in b.schema.names})


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The test items (item_id as string, words) in blocks of about ``block_bytes`` of text, by hash of the row.

    Items without words have no windows and are left out; null ids stay null.
    """
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for i in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i)
        found = [(r["item_id"], w) for r in part.orderBy("item_id", "text").toLocalIterator() if (w := words_of(r["text"]))]
        if found:
            yield found


def _windows(items: list[tuple[str, list[bytes]]], window: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Vocabulary, distinct windows (term indices, padded with 0), their lengths and, per (window, item) pair, both."""
    numbers: defaultdict = defaultdict(itertools.count().__next__)
    owners: dict[tuple, set[int]] = {}
    for i, (_, words) in enumerate(items):
        t = [numbers[w] for w in words]
        for at in range(max(1, len(t) - window + 1)):
            owners.setdefault(tuple(t[at : at + window]), set()).add(i)
    terms = np.zeros((len(owners), window), np.int64)
    sizes = np.array([len(w) for w in owners], np.int64)
    for i, w in enumerate(owners):
        terms[i, : len(w)] = w
    pairs = np.array([(i, o) for i, own in enumerate(owners.values()) for o in sorted(own)], np.int64)
    return list(numbers), terms, sizes, pairs


def _by_rarest(terms: np.ndarray, sizes: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows in order of their rarest word (by windows that hold it), and where each word's windows begin."""
    live = np.arange(terms.shape[1])[None, :] < sizes[:, None]
    often = np.bincount(terms[live], minlength=vocabulary)
    rarest = terms[np.arange(len(terms)), np.where(live, often[terms], np.iinfo(np.int64).max).argmin(axis=1)]
    order = np.argsort(rarest, kind="stable")
    return order, np.searchsorted(rarest[order], np.arange(vocabulary + 1))


def _with_first(items: list[tuple[str | None, list[bytes]]]) -> dict[bytes, list[tuple[str | None, list[bytes]]]]:
    """The items by their rarest word (by items that hold it)."""
    often: defaultdict = defaultdict(int)
    for _, words in items:
        for w in set(words):
            often[w] += 1
    found: defaultdict = defaultdict(list)
    for item in items:
        found[min(item[1], key=lambda w: (often[w], w))].append(item)
    return dict(found)


def matches(index: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact matches ``row, doc_id, item_id, start, stop`` (row number, word positions, stop exclusive).

    A window is ``window`` consecutive words of an item (all of a shorter
    item). Overlapping occurrences of one item's windows are merged into one
    span. One pass over the index per block of items.
    """
    got = None
    for block in item_blocks(items, block_bytes):
        vocabulary, terms, sizes, pairs = _windows(block, window)
        names = [name for name, _ in block]
        known = {w: i for i, w in enumerate(vocabulary)}
        shared = index.sparkSession.sparkContext.broadcast((known, terms, sizes, pairs, names, *_by_rarest(terms, sizes, len(known))))  # at most block_bytes of text

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, terms, sizes, pairs, names, by_rarest, begin = shared.value
            first = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))
            for seg in _opened(batches):
                at = {known[t]: i for t, i in seg.terms.items() if t in known}
                number = np.full(len(known), -1, np.int64)
                number[list(at)] = list(at.values())
                met = np.flatnonzero(number >= 0)
                n = begin[met + 1] - begin[met]
                window = by_rarest[np.repeat(begin[met], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
                found, start = seg.phrases(number[terms[window]], sizes[window])
                if not len(found):
                    continue
                found = window[found]
                n = (first[1:] - first[:-1])[found]
                item = pairs[np.repeat(first[found], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n), 1]
                start, stop = np.repeat(start, n), np.repeat(start + sizes[found], n)
                doc = np.searchsorted(seg.starts, start, side="right") - 1
                order = np.lexsort((start, item, doc))
                doc, item, start, stop = doc[order], item[order], start[order], stop[order]
                # windows of one item have one length, so sorted starts have sorted stops
                fresh = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > stop[:-1])]
                head = np.flatnonzero(fresh)
                tail = np.r_[head[1:], len(doc)] - 1
                base = seg.starts[doc[head]]
                yield pa.RecordBatch.from_arrays([pa.array(seg.rows[doc[head]], pa.int64()), pa.array([seg.ids[d] for d in doc[head]], pa.string()), pa.array([names[i] for i in item[head]], pa.string()),
                                                  pa.array(start[head] - base, pa.int64()), pa.array(stop[tail] - base, pa.int64())], ["row", "doc_id", "item_id", "start", "stop"])

        part = index.mapInArrow(search, "row long, doc_id string, item_id string, start long, stop long")
        got = part if got is None else got.union(part)
    if got is None:
        return index.sparkSession.createDataFrame([], "row long, doc_id long, item_id string, start long, stop long")
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))


def proximity(index: DataFrame, items: DataFrame, slop: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, position``: places of an item's rarest term with all its other terms within ``slop`` words."""
    got = None
    for block in item_blocks(items, block_bytes):
        shared = index.sparkSession.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for seg in _opened(batches):
                rows = []
                for name, words in shared.value:
                    at = seg.near([int(x) for x in seg.numbers(words)], slop)
                    doc = np.searchsorted(seg.starts, at, side="right") - 1
                    rows += [{"doc_id": seg.ids[d], "item_id": name, "position": int(p - seg.starts[d])} for d, p in zip(doc, at)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.string()), ("item_id", pa.string()), ("position", pa.int64())]))

        part = index.mapInArrow(search, "doc_id string, item_id string, position long")
        got = part if got is None else got.union(part)
    if got is None:
        return index.sparkSession.createDataFrame([], "doc_id long, item_id string, position long")
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))


def gathered(index: DataFrame, items: DataFrame, stretch: int = STRETCH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Proximity matches ``row, doc_id, item_id``: all words of the item stand, in any order, inside some
    stretch of the document that is ``stretch`` times as long as the item."""
    got = None
    for block in item_blocks(items, block_bytes):
        shared = index.sparkSession.sparkContext.broadcast(_with_first(block))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for seg in _opened(batches):
                rows = []
                for first in seg.terms.keys() & shared.value.keys():
                    for name, words in shared.value[first]:
                        rows += [{"row": int(seg.rows[d]), "doc_id": seg.ids[d], "item_id": name} for d in seg.gathered(seg.numbers(words), stretch * len(words))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("row", pa.int64()), ("doc_id", pa.string()), ("item_id", pa.string())]))

        part = index.mapInArrow(search, "row long, doc_id string, item_id string")
        got = part if got is None else got.union(part)
    if got is None:
        return index.sparkSession.createDataFrame([], "row long, doc_id long, item_id string")
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))


def document_words(index: DataFrame) -> DataFrame:
    """``row, doc_id, n_words`` of every indexed document."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                yield pd.DataFrame({"row": np.frombuffer(row.doc_rows, "<i8"), "doc_id": list(row.doc_ids), "n_words": np.frombuffer(row.doc_words, "<i8")})

    return index.select("doc_ids", "doc_rows", "doc_words").mapInPandas(count, "row long, doc_id string, n_words long").withColumn("doc_id", F.col("doc_id").cast("long"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, stretch: int | None = None) -> DataFrame:
    """Per document: ``n_words, n_hit, n_items, items_sha256, contaminated``, with ``stretch`` also ``n_near``.

    A word is hit if it lies in an occurrence of any window; ``n_near`` counts
    the items whose words are all gathered in one place (``gathered``). Null
    texts have no words; an item without words has no window; all items with
    null ids count as one item, whose id is not in the hash; an empty table of
    items leaves every document clean. Rows that share a doc_id, or have none,
    are each reported with their own spans; extra columns are ignored.
    """
    index = build_index(docs)
    spans = stage(matches(index, items, window).distinct(), "matches")
    # union of spans per document: a span adds what lies beyond all earlier stops
    by_start = Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    flat = spans.select("row", "start", "stop").distinct()
    new = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(by_start), F.lit(0))))
    hits = flat.withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"))
    names = spans.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("long")).alias("unnamed"))
    rows = document_words(index).join(hits.join(names, "row"), "row", "left")
    items_text = F.coalesce(F.array_join("items", ","), F.lit(""))
    n_items = F.when(F.col("items").isNull(), 0).otherwise(F.size("items") + F.col("unnamed")).cast("long")
    more = []
    if stretch is not None:
        near = gathered(index, items, stretch).groupBy("row").agg((F.count_distinct("item_id") + F.max(F.col("item_id").isNull().cast("long"))).alias("n_near"))
        rows, more = rows.join(near, "row", "left"), [F.coalesce("n_near", F.lit(0)).alias("n_near")]
    return rows.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), n_items.alias("n_items"), F.sha2(items_text, 256).alias("items_sha256"),
                       F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"), *more)
