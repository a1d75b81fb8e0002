"""Hard-negative mining with an STR-packed R-tree over integer vectors.

The rows are packed by sort-tile-recursive: quantiles of the coordinate that
varies most cut slabs, quantiles of the second coordinate cut each slab, and
inside a tile rows are sorted by the third. The sort runs over the whole table
in ranges of even size (ties are ordered by row number, so equal vectors split
like any others); each range is a shard, its consecutive rows are leaves, and
its leaves' bounding boxes form a tree.

For an anchor ``a`` and a box ``[lo, hi]`` each coordinate's product lies in the
interval between ``a_i * lo_i`` and ``a_i * hi_i``; the sums of the interval ends
bound every inner product in the box. A search takes boxes from a queue, best
upper bound first. It skips a box that has no row of the wanted kind of label,
lies outside the score window, or whose upper bound is strictly below the
k-th score so far; a box that ties with the k-th is opened, since a smaller id
may be inside.

Anchors meet each shard in blocks: shard rows come first in one sorted stream,
then the anchors in Arrow batches, so a task holds one shard and one batch. Each shard
returns its own first k per search, and a window of those gives the first k of
all. Every row is searched; nothing is capped.

Defined results. Rows with a null label, a null vector, a null or non-finite
component, or one of 2**19 or more in size (its scores may not fit a bigint)
take no part. Shorter vectors count as padded with zeros. Each repeated row is a
row of its own. Null ids take part, come after all others in ties, and are no
anchors. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import stage

LEAF = 128
FANOUT = 8
SHARD = 8192
SCALE = 256
LARGEST = float(1 << 19)
EXACT = float(1 << 53)
NO_ID = np.iinfo(np.int64).max

_ROW = "row long, id long, none boolean, label int"


# ---- one shard -------------------------------------------------------------


class Tree:
    """Bounding boxes over the rows of one shard, which come in packed order."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, none: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.none, self.labels, self.vectors = rows, ids, none, labels, vectors
        self.exact = float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
        self.floats = vectors.astype(np.float64)
        cuts = np.arange(0, len(rows), LEAF)
        self.slices = [slice(c, c + LEAF) for c in cuts.tolist()]
        lo, hi = np.minimum.reduceat(vectors, cuts).astype(float), np.maximum.reduceat(vectors, cuts).astype(float)
        held = [frozenset(labels[s].tolist()) for s in self.slices]
        children: list[list[int]] = [[] for _ in cuts]
        level = list(range(len(cuts)))
        los, his = [lo], [hi]
        while len(level) > 1:
            groups = [level[i : i + FANOUT] for i in range(0, len(level), FANOUT)]
            firsts = np.arange(0, len(level), FANOUT)
            los.append(np.minimum.reduceat(los[-1], firsts))
            his.append(np.maximum.reduceat(his[-1], firsts))
            level = list(range(len(children), len(children) + len(groups)))
            children += groups
            held += [frozenset().union(*(held[c] for c in g)) for g in groups]
        self.lo, self.hi, self.children, self.held, self.root = np.concatenate(los), np.concatenate(his), children, held, level[0]

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product that each box allows."""
        a, b = self.lo * anchor, self.hi * anchor
        low, high = np.minimum(a, b).sum(axis=1), np.maximum(a, b).sum(axis=1)
        if max(np.abs(low).max(), np.abs(high).max()) >= EXACT:  # sums of doubles are rounded from here on
            slack = 1e-9 * np.maximum(np.abs(low), np.abs(high))
            return low - slack, high + slack
        return low, high

    def scores(self, leaf: int, anchor: np.ndarray) -> np.ndarray:
        if self.exact * float(np.abs(anchor).max(initial=0)) < EXACT:
            return (self.floats[self.slices[leaf]] @ anchor.astype(np.float64)).astype(np.int64)
        return self.vectors[self.slices[leaf]] @ anchor

    def search(self, anchor: np.ndarray, me: int, label: int, same: bool, windows: list[tuple[int, int]], k: int) -> list[list[tuple]]:
        """Per score window (least, greatest) its first ``k`` rows of the anchor's label, or of others: (-score, none, id, row)."""
        low, high = self.bounds(anchor)
        opened: dict[int, list[np.ndarray]] = {}
        return [self._window(anchor, me, label, same, w, k, low, high, opened) for w in windows]

    def _wanted(self, box: int, label: int, same: bool) -> bool:
        return label in self.held[box] if same else bool(self.held[box] - {label})

    def _window(self, anchor, me, label, same, window, k, low, high, opened) -> list[tuple]:
        least, most = window
        best: list[tuple] = []
        queue = [(-high[self.root], self.root)]
        while queue:
            upper, box = heapq.heappop(queue)
            if len(best) == k and -upper < -best[-1][0]:
                break  # all boxes left are strictly below the k-th
            if self.children[box]:
                for c in self.children[box]:
                    # what is above the window cannot be an answer: its bound counts as the window's end
                    if high[c] >= least and low[c] <= most and self._wanted(c, label, same):
                        heapq.heappush(queue, (-min(high[c], most), c))
                continue
            if box not in opened:
                s = self.slices[box]
                keep = ((self.labels[s] == label) == same) & (self.rows[s] != me)
                opened[box] = [x[keep] for x in (self.scores(box, anchor), self.none[s], self.ids[s], self.rows[s])]
            score, none, ids, rows = opened[box]
            fit = (score >= max(least, -best[-1][0] if len(best) == k else least)) & (score <= most)
            if fit.any():
                best = heapq.nsmallest(k, best + list(zip((-score[fit]).tolist(), none[fit].tolist(), ids[fit].tolist(), rows[fit].tolist())))
        return best


# ---- tables ----------------------------------------------------------------


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """``row, id, none, label, v``: the rows that take part, staged so that row numbers hold."""
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LARGEST))
    rows = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(0)).cast("long").alias("id"), F.col("vec_id").isNull().alias("none"), label.cast("int").alias("label"), scaled.alias("v"))
    return stage(rows, "vectors")


def packed(vectors: DataFrame, shard_rows: int = SHARD, leaf: int = LEAF) -> DataFrame:
    """The rows in STR order with their ``shard`` and place in it (``at``), staged."""
    n, width = vectors.agg(F.count("*"), F.greatest(F.max(F.size("v")), F.lit(1))).first()
    width = width or 1
    spread = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("s")).orderBy(F.desc("s"), "i").limit(3).collect()
    dims = [r["i"] for r in spread]
    dims += [0] * (3 - len(dims))
    x, y, z = (F.coalesce(F.get("v", F.lit(d)), F.lit(0)).alias(c) for d, c in zip(dims, "xyz"))
    slabs = max(1, round((n / leaf) ** (1 / 3)))
    shares = [i / slabs for i in range(1, slabs)]
    rows = vectors.select("*", x, y, z)
    if shares:
        def below(cuts: F.Column, c: str) -> F.Column:
            return F.size(F.filter(cuts, lambda q: q < F.col(c)))

        first = rows.agg(F.percentile_approx("x", shares, 10_000)).first()[0]
        rows = rows.withColumn("slab", below(F.array(*[F.lit(c) for c in first]), "x"))
        second = rows.groupBy("slab").agg(F.percentile_approx("y", shares, 10_000).alias("cuts"))  # slabs ** 2 numbers: (rows / leaf) ** (2 / 3)
        rows = rows.join(F.broadcast(second) if slabs <= 1000 else second, "slab").withColumn("tile", F.col("slab") * slabs + below(F.col("cuts"), "y"))
    else:
        rows = rows.withColumn("tile", F.lit(0))
    shards = max(1, -(-n // shard_rows))
    rows = rows.select("row", "id", "none", "label", "v", "tile", "z").repartitionByRange(shards, "tile", "z", "row").sortWithinPartitions("tile", "z", "row")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at = TaskContext.get().partitionId(), 0
        for b in batches:
            places = np.arange(at, at + b.num_rows)
            at += b.num_rows
            flat = b.column(4).flatten().to_numpy(zero_copy_only=False)
            held = np.zeros((b.num_rows, width), "<i8")
            sizes = np.diff(b.column(4).offsets.to_numpy())
            held[np.repeat(np.arange(b.num_rows), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array([r.tobytes() for r in held], pa.binary()), pa.array(np.full(b.num_rows, shard), pa.int64()), pa.array(places, pa.int64())],
                                             names=["row", "id", "none", "label", "v", "shard", "at"])

    return stage(rows.mapInArrow(number, f"{_ROW}, v binary, shard long, at long"), "packed")


_FOUND = "anchor long, window long, score long, none boolean, id long, row long"


def searched(rows: DataFrame, anchors: DataFrame, same: bool, k: int) -> DataFrame:
    """First ``k`` rows per anchor and window, by score (high first), null ids last, id, row.

    ``rows``: from ``packed``. ``anchors``: ``row, label, v, windows`` (array of
    struct ``w, least, most``). Gives ``anchor, window, score, none, id, row, rank``.
    """
    shards = rows.agg(F.max("shard")).first()[0]
    if shards is None:
        return rows.sparkSession.createDataFrame([], _FOUND + ", rank int")
    none = F.lit(None)
    data = rows.select("shard", F.lit(0).alias("tag"), "at", "row", "id", "none", "label", "v", none.cast("array<struct<w:long,least:long,most:long>>").alias("windows"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards).cast("long"))).alias("shard"), F.lit(1).alias("tag"), F.col("row").alias("at"), "row", F.lit(0).cast("long").alias("id"), F.lit(False).alias("none"), "label", "v", "windows")
    stream = data.unionByName(asked).repartitionByRange(shards + 1, "shard").sortWithinPartitions("shard", "tag", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("window", pa.int64()), ("score", pa.int64()), ("none", pa.bool_()), ("id", pa.int64()), ("row", pa.int64())])
        now, held, tree = None, [], None
        for b in batches:
            out = []
            shard, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
            starts = np.flatnonzero(np.r_[True, (np.diff(shard) != 0) | (np.diff(tag) != 0)]).tolist()
            for lo, hi in zip(starts, [*starts[1:], b.num_rows]):
                part = b.slice(lo, hi - lo)
                if shard[lo] != now:
                    now, held, tree = shard[lo], [], None
                if tag[lo] == 0:
                    held.append(part)
                    continue
                if tree is None:
                    if not held:
                        continue
                    t = pa.Table.from_batches(held)
                    vectors = np.frombuffer(b"".join(t.column(7).to_pylist()), "<i8").reshape(t.num_rows, -1)
                    tree = Tree(*(t.column(i).to_numpy() for i in (3, 4)), t.column(5).to_numpy(zero_copy_only=False).astype(bool), t.column(6).to_numpy(), vectors)
                    held = []
                for me, label, v, windows in zip(*(part.column(i).to_pylist() for i in (3, 6, 7, 8))):
                    found = tree.search(np.frombuffer(v, "<i8"), me, label, same, [(w["least"], w["most"]) for w in windows], k)
                    out += [(me, w["w"], -score, no, i, r) for w, rows_ in zip(windows, found) for score, no, i, r in rows_]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [()] * 6, schema)], schema=schema)

    found = stream.mapInArrow(run, _FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "none", "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose ``vec_id`` is divisible by ``every``. For each of
    an anchor's first ``positives`` rows of its label: the first ``negatives``
    rows of other labels whose score is from ``least`` to ``most`` per cent of
    the positive's.
    """
    rows = packed(integer_vectors(embeddings))
    anchors = rows.where(~F.col("none") & (F.col("id") % every == 0)).select("row", F.col("id").alias("anchor_id"), "label", "v")
    bound = 2**62
    everything = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(-bound).cast("long").alias("least"), F.lit(bound).cast("long").alias("most")))
    near = stage(searched(rows, anchors.withColumn("windows", everything), True, positives), "positives")
    # a negative score of the positive leaves an empty window; the ends round inward
    window = F.struct(F.col("rank").cast("long").alias("w"), F.expr(f"cast(ceil(cast(score as decimal(25,0)) * {least} / 100) as bigint)").alias("least"),
                      F.expr(f"cast(floor(cast(score as decimal(25,0)) * {most} / 100) as bigint)").alias("most"))
    windows = near.where("score >= 0").groupBy(F.col("anchor").alias("row")).agg(F.collect_list(window).alias("windows"))  # at most ``positives`` of them
    far = searched(rows, anchors.join(windows, "row"), False, negatives)
    named = near.select("anchor", F.col("rank").cast("long").alias("window"), F.expr("if(none, null, id)").alias("positive_id"), F.col("score").alias("positive_score"))
    found = far.join(named, ["anchor", "window"]).join(anchors.select(F.col("row").alias("anchor"), "anchor_id"), "anchor")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.expr("if(none, null, id)").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
