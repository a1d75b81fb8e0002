"""Vector top-k retrieval (L1) and per-source top-k (L2), exact, by cosine.

On unit vectors the cosine is ``1 - d * d / 2`` of the Euclidean distance, so the
triangle inequality bounds it: a block of rows whose distances to a pivot lie in
``[lo, hi]`` is at least ``max(lo - d, d - hi)`` away from a query at distance ``d``
from that pivot. Rows are grouped by their nearest pivot into blocks of at most
``TILE`` rows; a block whose bound is below a query's k-th score so far, or below
the threshold, is not multiplied for that query. Scores are computed in tiles of
at most ``TILE`` x ``TILE``, whatever the number of queries. Pivots only steer the
search: any choice gives the same result.

Equal scores are ordered by ``vec_id``. Of equal vectors in one batch only the
``k`` smallest ids (per source) are scored, and the scores that decide are summed
in one fixed order, so that equal vectors tie exactly and no tie makes more than
``k`` rows per query and task.

Queries below the broadcast limit are on every task. Otherwise the corpus is cut
into shards (rows of one nearest pivot, by number where that are many) and each
query goes to shards: first to the one with the best bound, then, with the k-th
score known, to those whose bound reaches it. Only queries are replicated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import BROADCAST_LIMIT_BYTES, cut_lineage

TILE = 1024
PIVOTS = 32
PIVOT_SAMPLE = 1024
SHARD_ROWS = 1 << 16
STATE = 1 << 22  # kept scores of a task
SLACK = 1e-9  # rounding of a tile product and of the bounds
CAND_SCHEMA = "query_id bigint, vec_id bigint, source int, score double"


def _matrix(vectors) -> np.ndarray:
    """Unit rows (zero vectors stay zero)."""
    m = np.stack([np.asarray(x, dtype=np.float64) for x in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    n[n == 0] = 1.0
    return m / n


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` rows of a sample of unit vectors, each the farthest from those before."""
    if not len(sample):
        return sample
    chosen, far = [0], np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    own, other = (rows * rows).sum(axis=1), (pivots * pivots).sum(axis=1)
    return np.sqrt(np.maximum(own[:, None] + other[None, :] - 2 * (rows @ pivots.T), 0))


def _reach(near: np.ndarray, low: np.ndarray, high: np.ndarray, unit: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """(queries, blocks): the greatest cosine that each block allows. ``blank`` blocks hold zero vectors, others unit ones."""
    gap = np.zeros((len(near), len(low)))
    for p in range(near.shape[1]):
        d = near[:, p, None]
        np.maximum(gap, np.maximum(low[None, :, p] - d, d - high[None, :, p]), out=gap)
    reach = 1 - np.maximum(gap - SLACK, 0) ** 2 / 2
    reach[:, blank] = 0.0
    reach[~unit] = 0.0
    return reach


class Best:
    """The k best (score, vec_id) of every query so far."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        some = np.unique(query)
        q = np.concatenate([np.repeat(some, self.k), query])
        s = np.concatenate([self.score[some].ravel(), score])
        i = np.concatenate([self.ids[some].ravel(), ids])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.score[q[keep], place[keep]], self.ids[q[keep], place[keep]] = s[keep], i[keep]


class Search:
    """Top k of a fixed set of queries over batches of rows."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int, threshold: float, per_source: bool):
        self.q_ids, self.q, self.pivots, self.k, self.threshold, self.per_source = q_ids, q, pivots, k, threshold, per_source
        self.near, self.unit = _distances(q, pivots), (q * q).sum(axis=1) > 0.5
        self.best: dict[int, Best] = {}
        self.multiplied = self.skipped = 0

    def batch(self, ids: np.ndarray, src: np.ndarray, rows: np.ndarray) -> Iterator[pd.DataFrame]:
        """Take in a batch of unit rows; gives back what no longer fits into the state."""
        for s in np.unique(src) if self.per_source else [0]:
            part = np.flatnonzero(src == s) if self.per_source else np.arange(len(ids))
            if s not in self.best and (len(self.best) + 1) * len(self.q) * self.k > STATE and self.best:
                yield from self.found()
                self.best = {}
            best = self.best.setdefault(int(s), Best(len(self.q), self.k))
            self._scan(best, ids[part], rows[part])

    def _scan(self, best: Best, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.lexsort((ids, *rows.T[::-1]))
        ids, rows = ids[order], rows[order]
        fresh = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]
        first = np.flatnonzero(fresh)
        again = np.arange(len(ids)) - first[np.cumsum(fresh) - 1] < self.k
        ids, rows = ids[again], rows[again]
        away = _distances(rows, self.pivots)
        blank = (rows * rows).sum(axis=1) < 0.5
        group = np.where(blank, away.shape[1], away.argmin(axis=1))
        order = np.argsort(group, kind="stable")
        ids, rows, away, group = ids[order], rows[order], away[order], group[order]
        edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]).tolist()
        cuts = [c for a, b in zip(edges, edges[1:]) for c in range(a, b, TILE)]
        low, high = np.minimum.reduceat(away, cuts), np.maximum.reduceat(away, cuts)
        blocks = list(zip(cuts, [*cuts[1:], len(ids)]))
        for at in range(0, len(self.q), TILE):
            tile = slice(at, at + TILE)
            reach = _reach(self.near[tile], low, high, self.unit[tile], group[cuts] == away.shape[1])
            for b in np.argsort(-reach.max(axis=0)).tolist():
                least = np.maximum(best.score[tile, -1], self.threshold) - SLACK
                want = np.flatnonzero(reach[:, b] >= least)
                self.skipped += len(reach) - len(want)
                if len(want):
                    self.multiplied += len(want)
                    self._multiply(best, want + at, least[want], ids[slice(*blocks[b])], rows[slice(*blocks[b])])

    def _multiply(self, best: Best, query: np.ndarray, least: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        scores = self.q[query] @ rows.T
        if len(ids) > self.k:
            least = np.maximum(least, np.partition(scores, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - SLACK)
        qi, ci = np.nonzero(scores >= least[:, None])
        for part in range(0, len(qi), TILE * 16):
            a, c = query[qi[part : part + TILE * 16]], ci[part : part + TILE * 16]
            exact = (self.q[a] * rows[c]).sum(axis=1)  # one order of summation: equal vectors have equal scores
            keep = exact >= self.threshold
            if keep.any():
                best.add(a[keep], exact[keep], ids[c[keep]])

    def found(self) -> Iterator[pd.DataFrame]:
        for s, best in self.best.items():
            qi, place = np.nonzero(best.score > -np.inf)
            if len(qi):
                yield pd.DataFrame({"query_id": self.q_ids[qi], "vec_id": best.ids[qi, place], "source": s, "score": best.score[qi, place]})


def _sources(found: DataFrame, corpus: DataFrame, per_source: bool) -> DataFrame:
    """Without ``per_source`` the search does not carry sources: they are looked up for the answers."""
    if per_source:
        return found
    return found.drop("source").join(corpus.select("vec_id", "source"), "vec_id")


def retrieve_top_k(queries: DataFrame, corpus: DataFrame, k: int = 5, threshold: float = 0.0, per_source: bool = False,
                   broadcast_bytes: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """L1 / L2: ``queries(query_id, embedding)`` x ``corpus(vec_id, embedding, source)``, ids unique.

    Returns ``query_id, rank, vec_id, source, score`` with ``score >= threshold``;
    ``per_source`` ranks within each (query, source). Rows without an embedding
    take no part.
    """
    queries = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    corpus = corpus.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("source").cast("int").alias("source")).where("embedding is not null")
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    sample = [r["embedding"] for r in corpus.select("embedding").limit(PIVOT_SAMPLE).collect()]
    pivots = choose_pivots(_matrix(sample)) if sample else np.empty((0, 1))
    if not n or not len(pivots):
        return corpus.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, source int, score double")
    if n * width * 8 <= broadcast_bytes:
        found = _on_every_task(queries, corpus, pivots, k, threshold, per_source)
    else:
        found = _by_shards(queries, corpus, pivots, k, threshold, per_source, broadcast_bytes)
    keys = ["query_id", "source"] if per_source else ["query_id"]
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return _sources(ranked, corpus, per_source).select("query_id", "rank", "vec_id", "source", "score")


def _on_every_task(queries: DataFrame, corpus: DataFrame, pivots: np.ndarray, k: int, threshold: float, per_source: bool) -> DataFrame:
    rows = queries.collect()  # measured before
    shared = corpus.sparkSession.sparkContext.broadcast((np.array([r["query_id"] for r in rows], np.int64), _matrix([r["embedding"] for r in rows]), pivots))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Search(*shared.value, k, threshold, per_source)
        for b in batches:
            if len(b):
                yield from search.batch(b["vec_id"].to_numpy(np.int64), b["source"].fillna(0).to_numpy(np.int64), _matrix(b["embedding"]))
        yield from search.found()

    return corpus.mapInPandas(score, CAND_SCHEMA)


def _by_shards(queries: DataFrame, corpus: DataFrame, pivots: np.ndarray, k: int, threshold: float, per_source: bool, broadcast_bytes: int) -> DataFrame:
    spark = corpus.sparkSession
    width = pivots.shape[0]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                rows = _matrix(b["embedding"])
                away = _distances(rows, pivots)
                blank = (rows * rows).sum(axis=1) < 0.5
                yield pd.DataFrame({"vec_id": b["vec_id"], "source": b["source"], "unit": [r.tobytes() for r in rows], "pivot": np.where(blank, width, away.argmin(axis=1)), "away": list(away)})

    placed = cut_lineage(corpus.mapInPandas(place, "vec_id bigint, source int, unit binary, pivot int, away array<double>"))
    counts = placed.groupBy("pivot").agg(F.count("*").alias("n")).select("pivot", (F.floor(F.col("n") / SHARD_ROWS) + 1).alias("subs"))  # a row per pivot
    placed = placed.join(F.broadcast(counts), "pivot").withColumn("shard", F.concat_ws("-", "pivot", F.pmod(F.xxhash64("vec_id"), F.col("subs"))))
    spans = placed.groupBy("shard", "pivot").agg(*[f(F.col("away")[p]).alias(f"{name}{p}") for p in range(width) for f, name in ((F.min, "lo"), (F.max, "hi"))]).collect()
    # rows of the corpus / SHARD_ROWS, 16 bytes per pivot each: 8 MB for a billion rows
    if len(spans) * width * 16 > broadcast_bytes + (1 << 20):
        raise ValueError("the table of shards is over the broadcast limit; raise SHARD_ROWS")
    shards = [r["shard"] for r in spans]
    low, high = (np.array([[r[f"{name}{p}"] for p in range(width)] for r in spans]) for name in ("lo", "hi"))
    table = spark.sparkContext.broadcast((shards, low, high, np.array([r["pivot"] == width for r in spans]), pivots))

    def route(first: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            shards, low, high, blank, pivots = table.value
            for b in batches:
                for at in range(0, len(b), TILE):
                    part = b.iloc[at : at + TILE]
                    q = _matrix(part["embedding"])
                    reach = _reach(_distances(q, pivots), low, high, (q * q).sum(axis=1) > 0.5, blank)
                    home = reach.argmax(axis=1)
                    if first:
                        qi, si = np.arange(len(part)), home
                    else:
                        wanted = reach >= np.maximum(part["kth"].to_numpy(float), threshold)[:, None] - SLACK
                        wanted[np.arange(len(part)), home] = False
                        qi, si = np.nonzero(wanted)
                    yield pd.DataFrame({"shard": [shards[s] for s in si], "query_id": part["query_id"].to_numpy()[qi], "unit": [q[i].tobytes() for i in qi]})

        return run

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, block = None, [], None
        for b in batches:
            for (shard, tag), part in b.groupby(["shard", "tag"], sort=False):
                if shard != now:
                    now, held, block = shard, [], None
                if tag == 0:
                    held.append(part)
                elif held or block:
                    if block is None:
                        t = pd.concat(held)
                        block, held = (t["id"].to_numpy(np.int64), t["source"].fillna(0).to_numpy(np.int64), np.frombuffer(b"".join(t["unit"])).reshape(len(t), -1)), []
                    search = Search(part["id"].to_numpy(np.int64), np.frombuffer(b"".join(part["unit"])).reshape(len(part), -1), table.value[4], k, threshold, per_source)
                    yield from search.batch(*block)
                    yield from search.found()

    def met(asked: DataFrame) -> DataFrame:
        both = placed.select("shard", F.lit(0).alias("tag"), F.col("vec_id").alias("id"), "source", "unit").unionByName(
            asked.select("shard", F.lit(1).alias("tag"), F.col("query_id").alias("id"), F.lit(None).cast("int").alias("source"), "unit"))
        return both.repartition(max(1, len(shards)), "shard").sortWithinPartitions("shard", "tag", "id").mapInPandas(visit, CAND_SCHEMA)

    sent = "shard string, query_id bigint, unit binary"
    near = cut_lineage(met(queries.mapInPandas(route(True), sent)))
    # per source any shard may hold a source that the home shard lacks: only the threshold prunes there
    known = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth")) if not per_source else near.select("query_id", F.lit(None).cast("double").alias("kth")).limit(0)
    rest = queries.join(known, "query_id", "left").select("query_id", "embedding", F.coalesce("kth", F.lit(-2.0)).alias("kth"))
    return near.unionByName(met(rest.mapInPandas(route(False), sent)))


def with_content(results: DataFrame, store: DataFrame) -> DataFrame:
    """``query_id, results``: one row per query, best first, each result with the content and metadata of its row.

    ``store(vec_id, content, metadata)``; an id that it lacks has null content.
    At most ``k`` results (per source) meet in a row.
    """
    rows = results.join(store.select("vec_id", "content", "metadata"), "vec_id", "left")
    one = F.struct("rank", "source", "vec_id", "content", "score", "metadata")

    def order(a: Column, b: Column) -> Column:  # a map among the metadata has no order
        below = (a["rank"] < b["rank"]) | ((a["rank"] == b["rank"]) & (a["source"] < b["source"]))
        return F.when(below, -1).when((a["rank"] == b["rank"]) & a["source"].eqNullSafe(b["source"]), 0).otherwise(1)

    return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(one), order).alias("results"))
