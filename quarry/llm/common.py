"""Shared helpers: driver tables, the cluster's scratch folder, staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy scan of one driver table; Spark opens the path, whatever its scheme."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is made only where the setting is unset and the
    master is local (tests); on a cluster an unset folder is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='quarry-llm-')}"
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder."""
    return f"{scratch_root(spark)}/llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, dictionary: bool = True, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with committed files: a lost executor costs the tasks it
    ran, never the rows that are already written. Without ``dictionary`` the
    writer keeps no values in memory to look for repeats. ``group_bytes``: about what
    a writer gathers, and a reader takes, at a time, for tables of few, large rows.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(dictionary).lower())
    if group_bytes is not None:
        writer = writer.option("parquet.block.size", str(group_bytes)).option("parquet.page.size.row.check.min", "1").option("parquet.page.size.row.check.max", "16")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(c: str | Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only (``lower`` would fold other scripts too)."""
    return F.translate(c, UPPER, LOWER)


def order_key(c: str) -> Column:
    """A total order on a nullable bigint: nulls sort first."""
    return F.coalesce(F.col(c), F.lit(-(2**63)))


def hashed_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of ``df``, those whose keys hash lowest.

    Rows are thinned by hash to about four times as many before they are
    ordered, so what tasks send on does not grow with their number. Where few
    distinct keys repeat often, the sample may be smaller.
    """
    total, h = df.count(), F.pmod(F.xxhash64(*keys), F.lit(1 << 40))
    if total > 4 * most:
        df = df.where(h < F.lit((1 << 40) * 4 * most // total))
    return df.orderBy(h, *keys).limit(most)
