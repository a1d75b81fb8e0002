"""Checks before a submission or a fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import dims


def submission_preflight(submissions: DataFrame, runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The first rule that each submission breaks (``verdict`` is ``ok`` if none).

    ``submissions(sub_id, kind, run_id, node_id, approve, reject, revise,
    comment)`` with kind ``review`` or ``input``; ``runs(run_id, workflow_id,
    status, execution_status, current_node_id, waiting_input_node_id,
    review_node_id)``; ``nodes(workflow_id, node_id, type)``.
    """
    j = submissions.join(runs, "run_id", "left").join(nodes, ["workflow_id", "node_id"], "left")
    review = F.col("kind") == "review"
    flags = sum(F.coalesce(F.col(c), F.lit(False)).cast("int") for c in ("approve", "reject", "revise"))
    no_comment = ~F.coalesce(F.col("approve"), F.lit(False)) & (F.coalesce("comment", F.lit("")) == "")
    set_ = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    ended = F.upper("status").isin(dims.ENDED_STATUSES)
    unknown = F.col("type").isNull()
    awaited = F.when(set_("waiting_input_node_id"), F.col("waiting_input_node_id")).when(
        F.upper("execution_status") == "WAITING_FOR_INPUT", F.col("current_node_id"))
    rules = [
        (review & (flags != 1), "one decision needed"),
        (review & no_comment, "comment needed"),
        (F.col("status").isNull(), "run not found"),
        (~review & unknown, "node not found"),
        (ended, "run has ended"),
        (review & set_("waiting_input_node_id"), "paused for input"),
        (review & unknown, "node not found"),
        (review & (F.upper("type") != "HUMAN_REVIEW"), "not a review node"),
        (review & ~F.coalesce(F.col("review_node_id") == F.col("node_id"), F.lit(False)), "not paused for this review"),
        (~review & set_("review_node_id"), "paused for review"),
        (~review & ~F.coalesce(awaited == F.col("node_id"), F.lit(False)), "not waiting for this input"),
    ]
    verdict = F.coalesce(*[F.when(c, F.lit(m)) for c, m in rules], F.lit("ok"))
    return j.select("sub_id", verdict.alias("verdict"))


def registry_freshness(requests: DataFrame, caches: DataFrame, fetched: DataFrame, ttl_hours: int = dims.REGISTRY_TTL_HOURS) -> DataFrame:
    """per request the registry to use: fresh cache, else a new fetch, else the stale cache, else none.

    ``requests(key, host, now)``, ``caches(key, host, fetched_at, registry)`` and
    ``fetched(key, registry)`` (no row: the fetch failed) have one row per key.
    A null host asks for nothing. A cache is stale past ``ttl_hours`` or if it
    came from another host (trailing slashes aside).
    """
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    c = caches.select("key", F.col("host").alias("_host"), "fetched_at", F.col("registry").alias("_cached"))
    j = requests.join(c, "key", "left").join(fetched.withColumnRenamed("registry", "_new"), "key", "left")
    age = F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))
    fresh = F.col("_cached").isNotNull() & (age <= ttl_hours * 3_600_000_000) & (bare("_host") == bare("host"))
    source = (F.when(F.col("host").isNull(), "none").when(fresh, "cache").when(F.col("_new").isNotNull(), "fetch")
              .when(F.col("_cached").isNotNull(), "stale").otherwise("none"))
    registry = F.when(source == "fetch", F.col("_new")).when(source.isin("cache", "stale"), F.col("_cached"))
    return j.select("key", source.alias("source"), registry.alias("registry"), (source == "stale").alias("is_stale"))
