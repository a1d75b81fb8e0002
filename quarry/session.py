"""Session construction and shared run-time settings."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Above this many measured bytes a side is not collected for a broadcast.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024

# Rows of a shuffled input that one task sorts; memory of a task then does not grow with the input.
ROWS_PER_TASK = 250_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Partitions for a shuffle of ``rows`` input rows, one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))


def spread(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to that many tasks; None leaves the number to the session."""
    return df if tasks is None else df.repartition(tasks, *keys)


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "quarry") -> SparkSession:
    """Local session for tests and the bench; on a cluster use the given one."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a
    local master gets a fresh scratch folder; on a cluster that is an error,
    since executors would write to disks of their own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="quarry-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder as compressed columns, for wide rows that are read several times."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """``stage`` and the row count, in one job."""
    seen = Observation()
    staged = stage(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return staged, seen.get["n"]


def cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut_lineage`` and the row count, in one job."""
    seen = Observation()
    cut = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return cut, seen.get["n"]
