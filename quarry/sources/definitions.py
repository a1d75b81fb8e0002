"""Workflow definitions as nested records <-> flat tables.

``scan_definitions`` reads JSON definition files (one object per file) with
``try_parse_json`` so a bad file becomes a reject row instead of a failed
job. ``composite_records`` / ``explode_composite_nodes`` convert between the
nested composite form and the flat ``nodes`` table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPOSITE_SCHEMA = ("workflow_id bigint, workflow struct<entry:string, exit:string>, "
                    "nodes array<struct<pos:int, slug:string, type:string>>, "
                    "edges array<struct<src:string, dst:string, type:string>>")


def split_definitions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``raw(file, value)`` -> (accepted ``file, value``, rejects ``file, reason``): a definition is one JSON object."""
    # what parses is an object if it begins with a brace
    brace = F.startswith(F.ltrim(F.col("value"), F.lit(" \t\r\n")), F.lit("{"))
    kind = F.when(F.try_parse_json("value").isNull(), "invalid JSON").when(~brace, "not an object")
    marked = raw.withColumn("reason", kind)
    return marked.where("reason is null").select("file", "value"), marked.where("reason is not null").select("file", "reason")


def scan_definitions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Definition files, one JSON object each -> (accepted rows, reject rows with the reason)."""
    return split_definitions(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def composite_records(workflows: DataFrame, nodes: DataFrame, edges: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Nested composite JSON per workflow (one workflow's nodes/edges form one bounded record)."""
    n = nodes.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("pos", "slug", "type"))).alias("nodes"))
    e = edges.groupBy("workflow_id").agg(F.collect_list(F.struct("src", "dst", "type")).alias("edges"))
    rec = (workflows.join(n, "workflow_id", "left").join(e, "workflow_id", "left")
           .select("workflow_id", F.struct("entry", "exit").alias("workflow"), "nodes", "edges"))
    return rec.select(*(keep or []), F.to_json(F.struct("workflow_id", "workflow", "nodes", "edges")).alias("json"))


def explode_composite_nodes(composite_json: DataFrame) -> DataFrame:
    """Composite JSON -> ``(workflow_id, node_pos, slug, type)``."""
    c = composite_json.select(F.from_json("json", COMPOSITE_SCHEMA).alias("c")).select("c.*")
    x = c.select("workflow_id", F.posexplode_outer("nodes").alias("node_pos", "n"))
    return x.where(F.col("n").isNotNull()).select("workflow_id", F.col("node_pos").cast("int").alias("node_pos"),
                                                  F.col("n.slug").alias("slug"), F.col("n.type").alias("type"))


def explode_composite_edges(composite_json: DataFrame) -> DataFrame:
    """Composite JSON -> ``(workflow_id, src, dst, type)``."""
    c = composite_json.select(F.from_json("json", COMPOSITE_SCHEMA).alias("c")).select("c.*")
    return c.select("workflow_id", F.explode("edges").alias("e")).select("workflow_id", "e.src", "e.dst", "e.type")
