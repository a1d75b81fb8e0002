"""Join-node reducers over branch outputs ``(join_id, seq, v)``.

All built-in reducers are partial aggregates (``max_by``/``min_by``/``sum``
combine map-side), so one join with a third of all branches is reduced in
every task before the shuffle. ``collect_list`` (A1) is the only reducer
whose output grows with the group, as the feature requires.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DoubleType, StructField, StructType

_CUSTOM: dict[str, tuple[Callable, DataType]] = {}


def reduce_list_append(b: DataFrame) -> DataFrame:
    """A1: outputs in branch order (nulls kept)."""
    return b.groupBy("join_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "v"))), lambda x: x["v"]).alias("values"))


def reduce_dict_merge(entries: DataFrame) -> DataFrame:
    """A2: ``(join_id, seq, key, value)`` map entries; a later branch wins per key."""
    return entries.groupBy("join_id", "key").agg(F.max_by("value", "seq").alias("value"))


def merged_dicts(merged: DataFrame) -> DataFrame:
    """A2: ``reduce_dict_merge`` rows -> one map per join (the feature's result; as large as its keys)."""
    entries = F.array_sort(F.collect_list(F.struct("key", "value")))
    return merged.groupBy("join_id").agg(F.map_from_entries(entries).alias("merged"))


def reduce_sum(b: DataFrame, initial: float = 0.0) -> DataFrame:
    """A3: sum of numeric outputs plus the initial value."""
    return b.groupBy("join_id").agg((F.coalesce(F.sum("v"), F.lit(0.0)) + F.lit(initial)).alias("total"))


def reduce_first(b: DataFrame) -> DataFrame:
    """A4: first non-null output by branch order."""
    return b.groupBy("join_id").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("seq"))).alias("first_v"))


def reduce_last(b: DataFrame) -> DataFrame:
    """A5: last output by branch order (a null last output stays null)."""
    return b.groupBy("join_id").agg(F.max_by("v", "seq").alias("last_v"))


def reduce_null(b: DataFrame) -> DataFrame:
    """Discard outputs; one null row per join."""
    return b.groupBy("join_id").agg(F.lit(None).cast("double").alias("result"))


def register_reducer(name: str, fn: Callable[[pd.Series], float], return_type: DataType | None = None) -> None:
    """Register a CUSTOM reducer: ``fn(values: pd.Series) -> scalar`` over the outputs of one join."""
    _CUSTOM[name] = fn, return_type or DoubleType()


def _starts(ids: pa.Array) -> np.ndarray:
    """Places where a new value begins in an ordered column; nulls are one value, and so are NaNs."""
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    new = pc.fill_null(pc.not_equal(a, b), pc.xor(a.is_null(), b.is_null()))
    if pa.types.is_floating(ids.type):
        new = pc.and_not(new, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    return np.r_[0, np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1]


def reduce_custom(b: DataFrame, name: str) -> DataFrame:
    """Apply a registered custom reducer per join, one call per group.

    Rows come sorted by join and a task cuts whole Arrow batches into groups;
    only the group that a batch leaves open is carried on.
    """
    fn, kind = _CUSTOM[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: pa.Array, v: pa.Array, first: np.ndarray) -> pa.RecordBatch:
            ends = [*first[1:].tolist(), len(ids)]
            if pa.types.is_floating(v.type):
                values = v.to_numpy(zero_copy_only=False)  # nulls become NaN, as in a group of its own
                results = [fn(pd.Series(values[s:e])) for s, e in zip(first.tolist(), ends)]
            else:
                results = [fn(v.slice(s, e - s).to_pandas()) for s, e in zip(first.tolist(), ends)]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.Array.from_pandas(results, type=to_arrow_type(kind))], ["join_id", "result"])

        def joined(parts: list[pa.Array]) -> pa.Array:
            return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

        held: list[pa.RecordBatch] = []  # the open group
        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                edge = _starts(pa.concat_arrays([held[-1].column(0).slice(held[-1].num_rows - 1), batch.column(0)]))
                end = int(edge[1]) - 1 if len(edge) > 1 else batch.num_rows
                if end:
                    held.append(batch.slice(0, end))
                if end == batch.num_rows:
                    continue
                yield out(*(joined([h.column(i) for h in held]) for i in (0, 1)), np.array([0]))
                batch = batch.slice(end)
            first = _starts(batch.column(0))
            if len(first) > 1:
                yield out(batch.column(0).slice(0, int(first[-1])), batch.column(1).slice(0, int(first[-1])), first[:-1])
            held = [batch.slice(int(first[-1]))]
        if held:
            yield out(*(joined([h.column(i) for h in held]) for i in (0, 1)), np.array([0]))

    rows = b.select("join_id", "v").repartition("join_id").sortWithinPartitions("join_id")
    return rows.mapInArrow(run, StructType([StructField("join_id", b.schema["join_id"].dataType), StructField("result", kind)]))


def _median(v: pd.Series) -> float:
    a = v.to_numpy()
    a = np.sort(a[a == a])
    n = len(a)
    if not n:
        return None
    return float(a[n // 2]) if n % 2 else float((a[n // 2 - 1] + a[n // 2]) / 2)


register_reducer("median", _median)
