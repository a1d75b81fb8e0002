"""Structured Streaming twin of the run-event parsing.

The stream reads JSON records ``(run_id, seq, ts, line)`` from a folder and
applies exactly the batch Column code (F11 parse + P6 flags). Scratch and
checkpoint folders live under the session's shared ``spark.checkpoint.dir``
so a restarted driver or lost executor resumes from the checkpoint.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import runs
from quarry.session import ensure_checkpoint_dir

# JSON would otherwise keep milliseconds only.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
LINE_SCHEMA = "run_id string, seq bigint, ts timestamp, line string"


def scratch_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quarry-{name}-{uuid.uuid4().hex[:12]}"


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """Unbounded event lines -> parsed, classified events (streaming DataFrame)."""
    raw = spark.readStream.schema(LINE_SCHEMA).option("timestampFormat", TIME_FORMAT).json(path)
    return runs.event_flags(runs.parse_event_lines(raw))


def run_to_table(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Run a streaming DataFrame with ``availableNow`` into a parquet folder and read it back.

    With ``folder`` its output and checkpoint are kept there, and a later run goes on from them.
    """
    spark = df.sparkSession
    folder = folder or scratch_dir(spark, name)
    out, ckpt = f"{folder}/out", f"{folder}/ckpt"
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def stage_lines(lines: DataFrame) -> str:
    """Write ``(run_id, seq, ts, line)`` rows as JSON files for a file stream source."""
    spark = lines.sparkSession
    path = scratch_dir(spark, "lines")
    lines.select("run_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "line") \
        .write.mode("overwrite").option("timestampFormat", TIME_FORMAT).json(path)
    return path
