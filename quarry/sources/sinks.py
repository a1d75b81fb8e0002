"""Sinks: event NDJSON (K1), run records (K2), node outputs (K3), id maps (K4)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.checks import path_confined
from quarry.operators.resolve import render_template
from quarry.session import cut_lineage


def write_ndjson(df: DataFrame, json_col: str, path: str) -> None:
    """K1 / K2: one compact JSON object per line."""
    df.select(F.col(json_col).alias("value")).write.mode("overwrite").text(path)


def node_output_paths(outputs: DataFrame, template: str = "{node_id}/output.json") -> DataFrame:
    """K3: render the relative path per node output and check it stays confined."""
    parts = template.split("{node_id}")
    path = F.concat(*[x for i, p in enumerate(parts)
                      for x in ([F.lit(p)] + ([F.col("node_id")] if i < len(parts) - 1 else []))])
    return outputs.withColumn("path", path).withColumn("path_ok", path_confined(F.col("path")))


def templated_output_paths(outputs: DataFrame, templates: DataFrame, values: DataFrame) -> DataFrame:
    """K3 with a path template per (run, node): references are rendered (F14), then the path is checked.

    ``templates(run_id, node_id, template)``, ``values(run_id, slug, field,
    value)``. A template with a missing value gives a null path, which is not ok.
    """
    texts = templates.select(F.col("run_id").alias("workflow_id"), F.col("node_id").alias("node"), "template")
    rendered = render_template(texts, values.withColumnRenamed("run_id", "workflow_id"))
    paths = rendered.select(F.col("workflow_id").alias("run_id"), F.col("node").alias("node_id"), F.col("rendered").alias("path"))
    return outputs.join(paths, ["run_id", "node_id"], "left").withColumn("path_ok", F.coalesce(path_confined(F.col("path")), F.lit(False)))


BUCKETS = 64


def save_node_outputs(outputs: DataFrame, root: str) -> None:
    """K3: additive write of the confined outputs; runs share ``BUCKETS`` folders, whatever their number."""
    (node_output_paths(outputs).where("path_ok").drop("path_ok").withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)))
     .write.mode("append").partitionBy("bucket").json(root))


def id_map_rows(diff: DataFrame) -> DataFrame:
    """K4: whole-map rows per workflow: kept ids and fresh ids for added keys."""
    fresh = F.md5(F.concat_ws("|", F.lit("new"), F.col("workflow_id").cast("string"), F.col("key")))
    new_id = F.concat_ws("-", F.substring(fresh, 1, 8), F.substring(fresh, 9, 4), F.substring(fresh, 13, 4),
                         F.substring(fresh, 17, 4), F.substring(fresh, 21, 12))
    return diff.where(F.col("change") != "removed").select(
        "workflow_id", F.lit("node").alias("kind"), "key", F.coalesce(F.col("id"), new_id).alias("id"))


def save_id_map(rows: DataFrame, path: str, version: int = 1) -> None:
    """K4: replace each written workflow's whole map; schema version must be 1.

    Workflows share ``BUCKETS`` folders. Maps of other workflows in a touched
    folder are carried over, staged first since they are read from where the
    new files go. The overwrite mode is set for this write alone.
    """
    if version != 1:
        raise ValueError(f"unsupported id map version {version}; expected 1")
    spark, cols = rows.sparkSession, ["workflow_id", "kind", "key", "id", "version", "bucket"]
    new = rows.withColumn("version", F.lit(version)).withColumn("bucket", F.pmod(F.xxhash64("workflow_id"), F.lit(BUCKETS)).cast("int")).select(cols)
    try:
        old = spark.read.schema(new.schema).parquet(path).select(cols)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        kept = old.join(new.select("bucket").distinct(), "bucket", "left_semi").join(new.select("workflow_id").distinct(), "workflow_id", "left_anti")
        new = cut_lineage(new.unionByName(kept.select(cols)))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_id_map(spark: SparkSession, path: str) -> DataFrame:
    """The stored ``(workflow_id, kind, key, id)`` rows."""
    return spark.read.parquet(path).select("workflow_id", "kind", "key", "id")
