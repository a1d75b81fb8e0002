"""Custom reducers: every group whole, whatever the batches, at little cost a group."""

import statistics
import time

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.operators import reducers


def test_groups_are_whole_over_batches(spark):
    rows = [(j if j else None, s, None if (j + s) % 4 == 0 else float((j * 7 + s * 3) % 11)) for j in range(60) for s in range(1 + j * 7 % 40)] + [(99, 0, None)]
    df = spark.createDataFrame(rows, "join_id long, seq int, v double")
    want = {}
    for j, _, v in rows:
        want.setdefault(j, []).extend([] if v is None else [v])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = reducers.reduce_custom(df, "median").collect()
        reducers.register_reducer("sizes", lambda v: f"{v.dtype} {len(v)} {v.notna().sum()}", StringType())
        texts = reducers.reduce_custom(df.select("join_id", F.col("v").cast("string").alias("v")), "sizes").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want) and {r.join_id: r.result for r in got} == {j: statistics.median(v) if v else None for j, v in want.items()}
    assert len(texts) == len(want) and all(r.result.split()[2] == str(len(want[r.join_id])) for r in texts)


def test_many_small_groups(spark):
    df = spark.range(120_000).select((F.col("id") / 3).cast("long").alias("join_id"), F.lit(0).alias("seq"), F.col("id").cast("double").alias("v"))
    reducers.register_reducer("most", lambda v: float(v.max()) if isinstance(v, pd.Series) else None)
    started = time.time()
    assert reducers.reduce_custom(df, "most").agg(F.sum("result")).first()[0] == sum(range(2, 120_000, 3))
    assert time.time() - started < 12
