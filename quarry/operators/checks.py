"""Definition checks over ``nodes(workflow_id, slug, type, config JSON)`` tables.

F12 reference extraction, J5-J8 checks, P9/P10 field rules, F23 config
rules, A14 report, A15 tally (F24 is in ``contract``). Only the fixed rule tables
are broadcast by hint; registry tables come from the caller, and Spark picks
their join by size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry import dims
from quarry.functions.text import strip_ws

# Control characters never stand in a JSON text as such, so these two can hold the place of an escape.
_BACKSLASH, _QUOTE = "\x01", "\x02"


def _without_keys(config_json: Column) -> Column:
    """A JSON document's text without its object keys; null if it is not valid.

    One linear pass takes every string whole, so that it keeps in step, and
    leaves out those that a colon follows. Escapes stand as single control
    characters, which a reference cannot hold.
    """
    valid = F.when(F.try_parse_json(config_json).isNotNull(), config_json)
    plain = F.replace(F.replace(valid, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    return F.regexp_replace(plain, r'("[^"]*+"(?![ \t\r\n]*+:))|"[^"]*+"', "$1")


def extract_variable_refs(df: DataFrame, config_col: str = "config") -> DataFrame:
    """one row per ``{{slug.path}}`` in string leaves: adds ``ref_no, slug, path``."""
    df = df.where(F.col(config_col).contains("{{"))  # before any parsing
    # outside its strings a JSON text has no name in braces, so without its keys only string values can match
    matches = F.regexp_extract_all(_without_keys(F.col(config_col)), F.lit(dims.VAR_REF_PATTERN), F.lit(0))
    # an inner explode would have Spark filter by the same matches first, and so make them twice
    x = df.select("*", F.posexplode_outer(matches).alias("ref_no", "raw")).where("raw is not null")
    return (x.withColumn("slug", F.regexp_extract("raw", dims.VAR_REF_PATTERN, 1))
            .withColumn("path", F.regexp_extract("raw", dims.VAR_REF_PATTERN, 2))
            .drop("raw"))


def invalid_variable_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Refs whose slug is not a node of the same workflow; first per (node, slug)."""
    keys = nodes.select("workflow_id", F.col("slug").alias("ref_slug")).distinct()
    bad = (refs.select("workflow_id", "node", "ref_no", F.col("slug").alias("ref_slug"), "path")
           .join(keys, ["workflow_id", "ref_slug"], "left_anti"))
    first = (bad.groupBy("workflow_id", "node", "ref_slug")
             .agg(F.min_by("path", "ref_no").alias("path")))
    return first.select("workflow_id", "node", F.col("ref_slug").alias("invalid_slug"),
                        F.concat(F.lit("{{"), F.col("ref_slug"), F.lit("."), F.col("path"), F.lit("}}"))
                        .alias("reference"))


def output_path_check(refs: DataFrame, nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """Refs to known nodes whose path is not a registered output of that node's type."""
    target = nodes.select("workflow_id", F.col("slug").alias("ref_slug"),
                          F.upper("type").alias("referenced_type"))
    outs = registry.where(F.size("outputs") > 0).select(F.col("type").alias("referenced_type"), "outputs")
    r = (refs.select("workflow_id", "node", F.col("slug").alias("ref_slug"), "path")
         .join(target, ["workflow_id", "ref_slug"])
         .where(~F.col("referenced_type").isin(dims.OUTPUT_CHECK_EXEMPT_TYPES))
         .join(outs, "referenced_type"))
    return (r.where(~F.array_contains("outputs", F.col("path")))
            .select("workflow_id", "node", F.col("ref_slug").alias("referenced_node"), "referenced_type",
                    "path", F.array_join(F.array_sort("outputs"), ", ").alias("valid_paths")))


def type_status_check(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """Unsupported types -> FAIL, registry status ``inactive`` -> WARN."""
    unsupported = nodes.where(F.col("type").isin(dims.UNSUPPORTED_NODE_TYPES)).select(
        "workflow_id", "slug", F.col("type").alias("node_type"), F.lit("FAIL").alias("status"))
    st = registry.select(F.col("type").alias("utype"), "status")
    inactive = (nodes.withColumn("utype", F.upper("type")).join(st, "utype")
                .where(F.col("status") == "inactive")
                .select("workflow_id", "slug", F.col("utype").alias("node_type"), F.lit("WARN").alias("status")))
    return unsupported.unionByName(inactive)


def model_fields(spark) -> DataFrame:
    rows = [(t, f) for t, fs in dims.MODEL_FIELDS.items() for f in fs]
    return spark.createDataFrame(rows, "type string, field string")


def field_drift(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """Per workflow and used, active, registered type: model-only / registry-only fields."""
    spark = nodes.sparkSession
    mf = model_fields(spark)
    active = registry.where(F.col("status") != "inactive").where(F.size("fields") > 0)
    rf = (active.select(F.col("type").alias("utype"), F.explode("fields").alias("field"))
          .where(~F.col("field").isin(dims.FIELD_DRIFT_IGNORED)))
    m = mf.select(F.upper("type").alias("utype"), "field", F.lit(1).alias("in_model"))
    joined = (m.join(active.select(F.col("type").alias("utype")), "utype", "left_semi")
              .join(rf.withColumn("in_reg", F.lit(1)), ["utype", "field"], "full_outer")
              .join(active.select(F.col("type").alias("utype")), "utype", "left_semi"))
    drift = (joined.groupBy("utype")
             .agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("in_reg").isNull(), F.col("field")))), ", ")
                  .alias("cli_only"),
                  F.array_join(F.array_sort(F.collect_list(F.when(F.col("in_model").isNull(), F.col("field")))), ", ")
                  .alias("registry_only"))
             .where((F.col("cli_only") != "") | (F.col("registry_only") != "")))
    used = nodes.select("workflow_id", F.upper("type").alias("utype")).distinct()
    return used.join(drift, "utype").select(
        "workflow_id", F.col("utype").alias("node_type"), "cli_only", "registry_only")


def path_confined(p: Column) -> Column:
    """Non-blank, not absolute, no ``..`` segment."""
    return (strip_ws(p) != "") & ~F.startswith(p, F.lit("/")) & ~F.array_contains(F.split(p, "/"), "..")


def removed_fields(nodes: DataFrame, config_col: str = "config") -> DataFrame:
    """P10: retired config keys present on a node of the type that retired them."""
    spark = nodes.sparkSession
    rules = F.broadcast(spark.createDataFrame(dims.REMOVED_FIELDS, "type string, field string, message string"))
    known = nodes.join(rules.select("type").distinct(), "type", "left_semi")  # other configs are not read
    keys = known.select("workflow_id", "slug", "type",
                        F.explode_outer(F.json_object_keys(F.col(config_col))).alias("field"))
    return keys.join(rules, ["type", "field"]).select("workflow_id", "slug", "type", "field", "message")


def _num(cfg: Column, key: str) -> Column:
    return F.get_json_object(cfg, f"$.{key}").cast("double")


def _present(cfg: Column, key: str) -> Column:
    return F.coalesce(~F.get_json_object(cfg, f"$.{key}").isin("", "[]"), F.lit(False))


def config_rules(nodes: DataFrame, config_col: str = "config") -> DataFrame:
    """per-type range / required-reference rules -> one row per violation.

    A config is read only for the keys that the rules of its node's type name.
    """
    cfg, t = F.col(config_col), F.col("type")
    temperature = (~_num(cfg, "temperature").between(0, 2), "temperature must be between 0 and 2")
    max_tokens = (_num(cfg, "maxTokens") <= 0, "maxTokens must be greater than 0")
    top_k = (_num(cfg, "topK") <= 0, "topK must be greater than 0")
    iterations = _num(cfg, "max_iterations")
    rules = {
        "agent": [temperature, max_tokens, ((iterations <= 0) | (iterations > 100), "max_iterations must be between 1 and 100")],
        "llm_call": [temperature, max_tokens],
        "human_review": [(_num(cfg, "timeoutMinutes") <= 0, "timeoutMinutes must be greater than 0")],
        "file_upload": [(_num(cfg, "maxFileSize") <= 0, "maxFileSize must be greater than 0")],
        "rag_agent": [top_k,
                      (~_present(cfg, "agentId") & ~_present(cfg, "agent_name"), "RAG_AGENT config requires either agentId (UUID) or agent_name"),
                      (~_present(cfg, "knowledgeBaseIds") & ~_present(cfg, "knowledge_base_names"),
                       "RAG_AGENT config requires either knowledgeBaseIds (UUIDs) or knowledge_base_names")],
        "retrieve": [top_k, (~_num(cfg, "scoreThreshold").between(0, 1), "scoreThreshold must be between 0 and 1"),
                     (~_present(cfg, "knowledgeBaseId") & ~_present(cfg, "knowledge_base_name") & ~_present(cfg, "knowledge_base_names"),
                      "RETRIEVE config requires knowledgeBaseId, knowledge_base_name, or knowledge_base_names")],
    }
    found = F.array().cast("array<string>")
    for name, checks in rules.items():
        found = F.when(t == name, F.array(*[F.when(broken, F.lit(m)) for broken, m in checks])).otherwise(found)
    general = [(~t.isin(dims.NODE_TYPES), "unknown node type")]
    if "execution_mode" in nodes.columns:
        general.append((~F.col("execution_mode").isin(dims.EXECUTION_MODES), "unknown execution_mode"))
    every = F.array_compact(F.concat(F.array(*[F.when(broken, F.lit(m)) for broken, m in general]), found))
    return nodes.select("workflow_id", "slug", "type", F.explode_outer(every).alias("violation")).where("violation is not null")


def check_report(workflows: DataFrame, nodes: DataFrame, edges: DataFrame,
                 registry: DataFrame | None, schema_fail: DataFrame, unreachable: DataFrame,
                 cyclic: DataFrame, invalid_refs: DataFrame, unsupported: DataFrame,
                 bad_paths: DataFrame | None, inactive: DataFrame | None,
                 drift: DataFrame | None, syntax_fail: DataFrame | None = None) -> DataFrame:
    """13 check rows per workflow in fixed order; a syntax or schema failure stops the rest.

    Each input is a violation table with a ``workflow_id`` column; the
    report flags workflows present in it. Without a registry the three
    registry checks are SKIP.
    """
    parts = [(syntax_fail, "f_syntax"), (schema_fail, "f_schema"), (unreachable, "f_reach"), (cyclic, "f_cycle"), (invalid_refs, "f_refs"),
             (unsupported, "f_unsup"), (bad_paths, "f_paths"), (inactive, "f_inactive"), (drift, "f_drift")]
    # all findings in one table and one aggregation; every workflow is in it once without a finding
    rows = [df.select("workflow_id", F.lit(name).alias("found")) for df, name in parts if df is not None]
    every = reduce(DataFrame.union, [workflows.select("workflow_id", F.lit(None).cast("string").alias("found"), F.lit(True).alias("own")), *[r.withColumn("own", F.lit(False)) for r in rows]])
    flags = every.groupBy("workflow_id").agg(F.max("own").alias("own"), *[F.max(F.when(F.col("found") == name, True)).alias(name) for _, name in parts]).where("own")
    has_reg = registry is not None

    def st(fail_col, bad="FAIL", registry_check=False):
        if registry_check and not has_reg:
            return F.lit("SKIP")
        return F.when(F.col(fail_col).isNotNull(), F.lit(bad)).otherwise(F.lit("PASS"))

    statuses = [st("f_syntax"), st("f_schema"), st("f_reach"), st("f_cycle"), st("f_refs"), st("f_unsup"),
                st("f_paths", registry_check=True), st("f_inactive", "WARN", registry_check=True),
                st("f_drift", "WARN", registry_check=True)] + [F.lit("PASS")] * 4
    rows = F.array(*[F.struct(F.lit(i + 1).alias("check_no"), F.lit(n).alias("check_name"), s.alias("status"))
                     for i, (n, s) in enumerate(zip(dims.CHECK_NAMES, statuses))])
    last = F.when(F.col("f_syntax").isNotNull(), 1).when(F.col("f_schema").isNotNull(), 2).otherwise(len(dims.CHECK_NAMES))
    out = flags.select("workflow_id", last.alias("last"), F.explode(rows).alias("r"))
    return (out.where(F.col("r.check_no") <= F.col("last"))
            .select("workflow_id", F.col("r.check_no").alias("check_no"),
                    F.col("r.check_name").alias("check_name"), F.col("r.status").alias("status")))


def check_tally(report: DataFrame) -> DataFrame:
    """Counts per status and the overall verdict per workflow."""
    agg = report.groupBy("workflow_id").agg(
        F.count_if(F.col("status") == "PASS").alias("n_pass"),
        F.count_if(F.col("status") == "FAIL").alias("n_fail"),
        F.count_if(F.col("status") == "WARN").alias("n_warn"),
        F.count_if(F.col("status") == "SKIP").alias("n_skip"))
    verdict = (F.when(F.col("n_fail") > 0, "failed").when(F.col("n_warn") > 0, "passed with warnings")
               .when(F.col("n_skip") > 0, "passed with skips").otherwise("passed"))
    return agg.withColumn("verdict", verdict)


__all__ = ["extract_variable_refs", "invalid_variable_refs", "output_path_check", "type_status_check",
           "field_drift", "path_confined", "removed_fields", "config_rules",
           "check_report", "check_tally"]
