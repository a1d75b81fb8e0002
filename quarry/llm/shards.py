"""Sharding by histogram sort: equal bytes per shard, one exchange.

Rows are ordered by ``doc_id``, a hash of the text and a row number, so that an
id with many rows, or many equal rows, can be cut. The driver keeps, for every wanted boundary, an
interval of keys that must hold it, and probes all intervals at once: one job
counts the exact bytes and rows below each probe key across all partitions,
which shrinks every interval by the number of probes. Probing ends when each
boundary is within ``tolerance`` of its target or its interval holds one row. Then
the rows move once, each to the key range it belongs to.

Shards are contiguous key ranges. Each shard is cut into several ranges (by
the same boundaries) so that no task has to hold a whole shard; a row's slot is
the number of shard rows before its range, known from the probes, plus its
place inside the range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarry.llm.common import order_key, stage

PROBES = 64


PARTS = ["key", "hash", "row"]
HALF, WORD = 1 << 63, (1 << 64) - 1


def _joined(parts: tuple[int, int, int]) -> int:
    """The three signed numbers as one unsigned number of 192 bits, in the same order."""
    return (parts[0] + HALF) << 128 | (parts[1] + HALF) << 64 | (parts[2] + HALF)


def _position(keys: list[int]):
    """Arrow UDF: how many of the sorted ``keys`` (joined) lie at or below each row's ``PARTS``."""
    first = np.array([(k >> 128) - HALF for k in keys], np.int64)
    whole = np.array([[k >> 128, k >> 64 & WORD, k & WORD] for k in keys], np.uint64).reshape(-1, 3)

    def fixed(parts: np.ndarray) -> np.ndarray:
        """Rows as strings of 24 bytes, which compare like the numbers."""
        return np.ascontiguousarray(parts.astype(">u8")).view("S24").ravel()

    marks = fixed(whole)

    @F.pandas_udf(T.IntegerType())
    def place(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for b in batches:
            parts = [x.to_numpy(np.int64) for x in b]
            at = np.searchsorted(first, parts[0], side="right")
            close = np.flatnonzero(np.searchsorted(first, parts[0], side="left") < at)  # the first number alone does not tell
            if len(close):
                unsigned = np.stack([x[close].view(np.uint64) ^ np.uint64(HALF) for x in parts], 1)
                at[close] = np.searchsorted(marks, fixed(unsigned), side="right")
            yield pd.Series(at.astype(np.int32))

    return place


def splitters(sizes: DataFrame, parts: int, tolerance: float) -> tuple[list[int], list[int], list[int]]:
    """Boundary keys for ``parts`` ranges of near equal bytes.

    ``sizes`` has ``PARTS`` (bigint, no nulls) and ``size``. Returns the
    ``parts - 1`` first keys (joined) of ranges 1.., the exact bytes below and
    rows below each. Of the candidate keys the one whose byte count is closest to
    the target is taken. The driver holds ``PROBES`` counts per boundary.
    """
    ends = F.struct(*PARTS)
    top = sizes.agg(F.min(ends), F.max(ends), F.sum("size"), F.count("*")).first()
    lo0, hi0, total, rows = _joined(top[0]), _joined(top[1]), int(top[2]), int(top[3])
    goals = [total * (j + 1) / parts for j in range(parts - 1)]
    allowed = tolerance * total / parts
    # invariant: bytes below lo <= goal <= bytes below hi
    lo, hi = [(lo0, 0, 0)] * len(goals), [(hi0 + 1, total, rows)] * len(goals)
    while True:
        probes: set[int] = set()
        for j, goal in enumerate(goals):
            close = min(goal - lo[j][1], hi[j][1] - goal) <= allowed
            if not close and hi[j][2] - lo[j][2] > 1:
                span = hi[j][0] - lo[j][0]
                probes.update(lo[j][0] + span * i // PROBES for i in range(1, PROBES))
                probes.discard(lo[j][0])
        if not probes:
            break
        keys = sorted(probes)
        counted = sizes.groupBy(_position(keys)(*PARTS).alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        by_cell = {r["cell"]: (int(r["size"]), int(r["n"])) for r in counted}
        known, below, count = [], 0, 0
        for i, key in enumerate(keys):  # rows in cell i lie below key i
            size, n = by_cell.get(i, (0, 0))
            below, count = below + size, count + n
            known.append((key, below, count))
        for j, goal in enumerate(goals):
            for mark in known:
                if mark[1] <= goal and mark[0] > lo[j][0]:
                    lo[j] = mark
                if mark[1] >= goal and mark[0] < hi[j][0]:
                    hi[j] = mark
                    break
    best = [a if goal - a[1] <= b[1] - goal else b for a, b, goal in zip(lo, hi, goals)]
    return [b[0] for b in best], [b[1] for b in best], [b[2] for b in best]


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.0005, range_bytes: int = 64 << 20) -> DataFrame:
    """All rows of ``docs`` plus ``size, shard, slot``.

    Size is the UTF-8 length of the text plus 1 (null text: 1). Slots run
    without gaps from 0 in each shard, by ``doc_id`` (nulls first) and then by
    a hash of the text. Rows of one ``doc_id``, equal ones too, are cut like
    any others; their order is fixed by one copy on disk that numbers the
    rows. An empty table gives no rows; columns named ``size``, ``shard`` or
    ``slot`` are replaced.
    """
    docs = docs.drop("size", "shard", "slot").withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    keyed = docs.withColumn("__key", order_key("doc_id")).withColumn("__hash", F.xxhash64("text"))
    docs = stage(keyed.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    sizes = stage(docs.select(*(F.col(f"__{p}").alias(p) for p in PARTS), "size"), "sizes")
    total = sizes.agg(F.sum("size")).first()[0]
    if not total:
        return docs.drop("__key", "__hash", "__row").withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    per_shard = max(1, -(-int(total) // (shards * range_bytes)))
    keys, _, before = splitters(sizes, shards * per_shard, tolerance)
    first_rows = [0, *before]  # rows of the whole table before each range
    base = [first_rows[r] - first_rows[r // per_shard * per_shard] for r in range(shards * per_shard)]
    marks = F.array(*[F.lit(x).cast("long") for x in base])
    docs = docs.withColumn("__range", _position(keys)("__key", "__hash", "__row"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy("__key", "__hash", "__row")).cast("long") - 1
    placed = docs.withColumn("slot", place + F.element_at(marks, F.col("__range") + 1))
    return placed.withColumn("shard", F.floor(F.col("__range") / per_shard).cast("int")).drop("__key", "__hash", "__row", "__range")
