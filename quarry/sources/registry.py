"""Node-type registry: JSON snapshot -> exploded dimension tables.

``read_registry`` reads a registry export (``{all_node_types: [...]}``) with
``spark.read.json``; ``sample_registry`` gives a small literal snapshot used
by tests and the registered queries. All registry tables are tiny (one row
per node type / field / output path) and broadcast.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Sample snapshot (test dimension data, shaped like a registry export).
SAMPLE = {
    "schema_definitions": {"Count": {"type": "integer", "minimum": 1}},
    "all_node_types": [
        {"type": "LLM_CALL", "status": "active",
         "output_variables": [{"path": "output.text"}, {"path": "output.response"}],
         "fields": [{"name": n} for n in ["name", "description", "model", "template",
                                          "system_prompt", "temperature", "maxTokens", "stream"]],
         "config_json_schema": {"type": "object", "required": ["model_name", "system_prompt", "owner"],
                                "properties": {"temperature": {"type": "number", "minimum": 0, "maximum": 2},
                                               "max_tokens": {"type": "integer", "exclusiveMinimum": 0},
                                               "model_name": {"type": "string", "minLength": 1},
                                               "meta": {"type": "object", "additionalProperties": {"type": "integer"}}}}},
        {"type": "RETRIEVE", "status": "active",
         "output_variables": [{"path": "output.results"}, {"path": "output.files"}, {"path": "output.text"}],
         "fields": [{"name": n} for n in ["knowledgeBaseId", "topK", "searchQuery", "scoreThreshold",
                                          "includeMetadata", "enableReranking"]],
         "config_json_schema": {"type": "object", "required": ["query"],
                                "properties": {"top_k_results": {"type": "integer", "minimum": 1},
                                               "meta": {"type": "object", "additionalProperties": False, "properties": {"a": {"$ref": "#/$defs/Count"}}},
                                               "extractionPrompt": {"type": ["integer", "null"]},
                                               "agent_name": {"type": ["string", "null"]}}}},
        {"type": "RAG_AGENT", "status": "inactive",
         "output_variables": [{"path": "output.text"}],
         "fields": [{"name": n} for n in ["agentId", "knowledgeBaseIds", "topK"]],
         "config_json_schema": {"type": "object",
                                "properties": {"top_k_results": {"$ref": "#/$defs/Count"},
                                               "zz_note": {"anyOf": [{"type": "number"}, {"type": "null"}]}}}},
        {"type": "PLAIN_TXT_INPUT", "status": "active",
         "output_variables": [{"path": "output.text"}],
         "fields": [{"name": n} for n in ["placeholder", "metadata"]],
         "config_json_schema": {"type": "object"}},
        {"type": "STRUCTURED_OUTPUT", "status": "active",
         "output_variables": [{"path": "output.data"}],
         "fields": [{"name": n} for n in ["schema", "model", "primaryInput"]],
         "config_json_schema": {"type": "object", "required": ["model_name"],
                                "properties": {"knowledge_base_names": {"type": "array", "items": {"type": "integer"}}}}},
    ]
}


def registry_frame(spark: SparkSession, snapshot: dict | None = None) -> DataFrame:
    """One row per node type from a registry dict (driver-side: a bounded, small document)."""
    snap = snapshot or SAMPLE
    rows = [(t["type"], t.get("status", "active"),
             [v.get("path") for v in t.get("output_variables", []) if v.get("path")],
             [f.get("name") for f in t.get("fields", []) if f.get("name")],
             json.dumps(t.get("config_json_schema") or {}))
            for t in snap["all_node_types"]]
    return spark.createDataFrame(rows, "type string, status string, outputs array<string>, "
                                       "fields array<string>, config_schema string")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry export file(s) -> the same one-row-per-type frame."""
    raw = spark.read.option("multiLine", "true").json(path)
    t = raw.select(F.explode("all_node_types").alias("t")).select("t.*")
    return t.select(
        "type", F.coalesce(F.col("status"), F.lit("active")).alias("status"),
        F.expr("filter(transform(output_variables, v -> v.path), p -> p is not null)").alias("outputs"),
        F.expr("filter(transform(fields, f -> f.name), p -> p is not null)").alias("fields"),
        F.to_json("config_json_schema").alias("config_schema"))
