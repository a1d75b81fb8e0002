"""Run-event analytics (batch): parse, classify, truncate, fold, status.

Event order is ``seq`` (arrival order does not survive a shuffle). A line is
parsed once, into typed columns (``typed_events``); callers that use the
events more than once stage them. Per-run reductions use ``groupBy``
aggregates (``max_by``/``min_by``/``count_if``), which Spark combines
map-side. Truncation (W3) joins the events with one "first stop" row per run.
Where an event needs its predecessors (W4-W6), a run is cut into ``seq``
buckets: a window runs inside a bucket, and what earlier buckets contribute
comes from one aggregated row per bucket. A run holding a third of all
events is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry import dims
from quarry.functions.text import strip_ws

STEP_STATUS = {"STEP_STARTED": "started", "STEP_FINISHED": "finished", "STEP_ERROR": "error"}


# ------------------------------------------------------------------ F11 / P6
def parse_event_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """keep ``data:`` lines whose body is a JSON object; add ``event_type, data``.

    ``data`` is a VARIANT; ``event_type`` defaults to ``UNKNOWN``.
    """
    line = strip_ws(F.col(line_col))
    body = strip_ws(F.substring(line, 6, 1 << 30))
    v = F.try_parse_json(body)
    out = (lines.where(F.startswith(line, F.lit("data:")))
           .withColumn("data", v)
           .where(F.schema_of_variant(F.col("data")).startswith("OBJECT"))
           .withColumn("event_type", F.coalesce(F.try_variant_get("data", "$.type", "string"), F.lit("UNKNOWN"))))
    return out.drop(line_col)


def event_flags(events: DataFrame) -> DataFrame:
    """``category`` (lifecycle/step/state/text/tool/hitl/custom/unknown), ``is_terminal``, ``is_pausing``."""
    u = F.upper(F.col("event_type"))
    return (events.withColumn("etype", u)
            .withColumn("category", F.coalesce(F.element_at(dims.event_category_map(), u), F.lit("unknown")))
            .withColumn("is_terminal", u.isin(dims.TERMINAL_EVENTS))
            .withColumn("is_pausing", u.isin(dims.PAUSING_EVENTS)))


TEXT_FIELDS = ["node_id", "node_slug", "step_name", "step_type"]


def typed_events(events: DataFrame) -> DataFrame:
    """P6 flags and the event fields as plain columns; the VARIANT is dropped.

    ``delta`` and ``outputs`` stay JSON text and are only set on the state events that have them.
    """
    if "node_id" in events.columns:
        return events
    ev = events if "etype" in events.columns else event_flags(events)
    cols = {f: F.try_variant_get("data", f"$.{f}", "string") for f in TEXT_FIELDS}
    cols["duration_ms"] = F.try_variant_get("data", "$.duration_ms", "bigint")
    cols["delta"] = F.when(F.col("etype") == "STATE_DELTA", F.to_json(F.try_variant_get("data", "$.delta", "variant")))
    cols["outputs"] = F.when(F.col("etype") == "STATE_SNAPSHOT", F.to_json(F.try_variant_get("data", "$.snapshot.node_outputs", "variant")))
    return ev.withColumns(cols).drop("data")


BUCKET_SEQS = 10_000


def _bucketed(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("_bucket", F.floor(F.col(order) / BUCKET_SEQS))


# ------------------------------------------------------------------ W3
def truncate_run(events: DataFrame, until: str = "pause") -> DataFrame:
    """Keep each run's events up to and including its first stop event.

    ``until='pause'`` stops at terminal or pausing events (the reference
    closes its stream at a pause); ``until='terminal'`` keeps whole runs up
    to the terminal event.
    """
    ev = events if "is_terminal" in events.columns else event_flags(events)
    stop = F.col("is_terminal") | (F.col("is_pausing") if until == "pause" else F.lit(False))
    first_stop = (ev.where(stop).groupBy("run_id").agg(F.min("seq").alias("_stop_seq")))
    return (ev.join(first_stop, "run_id", "left")
            .where(F.col("_stop_seq").isNull() | (F.col("seq") <= F.col("_stop_seq")))
            .drop("_stop_seq"))


# ------------------------------------------------------------------ A12 / W5
def node_run_summary(events: DataFrame, until: str = "pause") -> DataFrame:
    """Per (run, node) latest step status, step type, display name and duration.

    STARTED resets the entry; FINISHED/ERROR without a STARTED creates it.
    Duration is the last finishing event's ``duration_ms``, else the time
    since that node's latest STARTED (W5), else null; null after a STARTED.
    """
    ev = truncate_run(typed_events(events), until)
    step = ev.where(F.col("etype").isin(list(STEP_STATUS)) & (F.col("node_id") != ""))
    display = F.coalesce(F.nullif(F.col("node_slug"), F.lit("")), F.nullif(F.col("step_name"), F.lit("")), F.col("node_id"))
    started = F.col("etype") == "STEP_STARTED"
    step = (step.withColumn("display", display)
            .withColumn("step_type", F.coalesce("step_type", F.lit("")))
            .withColumn("dur", F.col("duration_ms"))
            .withColumn("t_us", F.unix_micros(F.col("ts").cast("timestamp"))))
    agg = step.groupBy("run_id", "node_id").agg(
        F.max_by(F.struct("etype", "display", "dur", "t_us"), "seq").alias("last"),
        F.max_by(F.when(started, F.col("step_type")), F.when(started, F.col("seq"))).alias("st_started"),
        F.min_by("step_type", "seq").alias("st_first"),
        F.max_by(F.when(started, F.col("t_us")), F.when(started, F.col("seq"))).alias("t_started"),
        F.count_if(started).alias("n_started"))
    status = F.element_at(F.create_map(*[F.lit(x) for kv in STEP_STATUS.items() for x in kv]), F.col("last.etype"))
    fallback = F.floor((F.col("last.t_us") - F.col("t_started")) / 1000).cast("bigint")
    duration = F.when(F.col("last.etype") == "STEP_STARTED", F.lit(None).cast("bigint")) \
        .otherwise(F.coalesce(F.col("last.dur"), fallback))
    return agg.select(
        "run_id", "node_id", F.col("last.display").alias("display_name"),
        F.when(F.col("n_started") > 0, F.col("st_started")).otherwise(F.col("st_first")).alias("step_type"),
        status.alias("status"), duration.alias("duration_ms"))


def duration_fallback(events: DataFrame) -> DataFrame:
    """Per finishing step event, its duration or ms since the node's latest STARTED."""
    ev = typed_events(events)
    ev = (ev.where(F.col("etype").isin(list(STEP_STATUS)) & (F.col("node_id") != ""))
          .withColumn("t_us", F.unix_micros(F.col("ts").cast("timestamp"))))
    ev = _bucketed(ev.select("run_id", "node_id", "seq", "etype", "duration_ms", "t_us"), "seq")
    key, start = ["run_id", "node_id"], F.col("etype") == "STEP_STARTED"
    per = ev.groupBy(*key, "_bucket").agg(F.max_by(F.when(start, F.col("t_us")), F.when(start, F.col("seq"))).alias("_started"))
    earlier = Window.partitionBy(*key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*key, "_bucket", F.last("_started", ignorenulls=True).over(earlier).alias("_before"))
    inside = Window.partitionBy(*key, "_bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ev = ev.withColumn("_own", F.last(F.when(start, F.col("t_us")), ignorenulls=True).over(inside)).join(per, [*key, "_bucket"])
    since = F.floor((F.col("t_us") - F.coalesce("_own", "_before")) / 1000).cast("bigint")
    return ev.where(~start).select("run_id", "seq", "node_id", F.coalesce("duration_ms", since).alias("duration_ms"))


# ------------------------------------------------------------------ W4 / W6 / W7 / W8
def progress_step(events: DataFrame, until: str = "pause") -> DataFrame:
    """Running count of distinct nodes started so far, on every kept event."""
    ev = truncate_run(typed_events(events), until).select("run_id", "seq", "etype", "node_id")
    start = (F.col("etype") == "STEP_STARTED") & (F.col("node_id") != "")
    first = ev.where(start).groupBy("run_id", "node_id").agg(F.min("seq").alias("seq")).select("run_id", "seq", F.lit(1).alias("is_first"))
    flagged = _bucketed(ev.join(first.groupBy("run_id", "seq").agg(F.sum("is_first").alias("is_first")), ["run_id", "seq"], "left"), "seq")
    per = flagged.groupBy("run_id", "_bucket").agg(F.coalesce(F.sum("is_first"), F.lit(0)).alias("_n"))
    earlier = Window.partitionBy("run_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("run_id", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("run_id", "_bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce(F.sum("is_first").over(inside), F.lit(0))
    return flagged.withColumn("_own", step).join(per, ["run_id", "_bucket"]).select(
        "run_id", "seq", "etype", (F.col("_own") + F.col("_before")).alias("step"))


def node_transitions(polls: DataFrame) -> DataFrame:
    """Polls ``(run_id, poll_no, current_node)`` -> rows where the node is set and changed."""
    rows = _bucketed(polls.select("run_id", "poll_no", "current_node", F.coalesce("current_node", F.lit("")).alias("_cur")), "poll_no")
    per = rows.groupBy("run_id", "_bucket").agg(F.max_by("_cur", "poll_no").alias("_last"))
    per = per.select("run_id", "_bucket", F.lag("_last").over(Window.partitionBy("run_id").orderBy("_bucket")).alias("_before"))
    rows = rows.withColumn("_own", F.lag("_cur").over(Window.partitionBy("run_id", "_bucket").orderBy("poll_no"))).join(per, ["run_id", "_bucket"])
    previous = F.coalesce("_own", "_before", F.lit(""))
    return rows.where((F.col("_cur") != "") & (F.col("_cur") != previous)).select("run_id", "poll_no", "current_node")


def interrupted_runs(events: DataFrame) -> DataFrame:
    """Runs whose last event is neither terminal nor pausing; with that event's type."""
    ev = event_flags(events) if "etype" not in events.columns else events
    last = ev.groupBy("run_id").agg(F.max_by(F.struct("event_type", "is_terminal", "is_pausing"), "seq").alias("l"))
    return last.where(~F.col("l.is_terminal") & ~F.col("l.is_pausing")).select("run_id", F.col("l.event_type").alias("last_event_type"))


def overdue_runs(events: DataFrame, limit_s: int = dims.RUN_TIMEOUT_S) -> DataFrame:
    """Runs without a terminal event whose span of event times reaches the limit."""
    ev = event_flags(events) if "etype" not in events.columns else events
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    agg = ev.groupBy("run_id").agg(F.count_if("is_terminal").alias("n_term"),
                                   ((F.max(t) - F.min(t)) / 1_000_000).alias("elapsed_s"))
    return (agg.where((F.col("n_term") == 0) & (F.col("elapsed_s") >= limit_s))
            .select("run_id", F.floor("elapsed_s").cast("bigint").alias("elapsed_s")))


def latest_run(runs: DataFrame) -> DataFrame:
    """Most recent run per workspace (ties broken by the larger run id)."""
    return runs.groupBy("workspace_id").agg(
        F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"),
        F.max("started_at").alias("started_at"))


def run_context(last: DataFrame, asked: DataFrame) -> DataFrame:
    """``last(workspace_id, run_id)`` and ``asked(workspace_id, run_id or null)`` -> ``workspace_id, run_id, verdict, expected``.

    Without a run id the last run is meant; another id than that of the last run
    is a mismatch (``expected`` names the last run), as is any id where there is none.
    """
    j = asked.select("workspace_id", F.col("run_id").alias("want")).join(last.select("workspace_id", F.col("run_id").alias("have")), "workspace_id", "left")
    want, have = F.col("want"), F.col("have")
    verdict = (F.when(have.isNull() & want.isNull(), "no last run").when(have.isNull(), "run id without a last run")
               .when(want != have, "mismatch").otherwise("found"))
    return j.select("workspace_id", F.when(verdict == "found", have).alias("run_id"), verdict.alias("verdict"), F.when(verdict == "mismatch", have).alias("expected"))


# ------------------------------------------------------------------ P7 / P8 / A13
def effective_status(status: Column, exec_status: Column) -> Column:
    """A RUNNING run reports its state's waiting or terminal status instead."""
    s, e = F.upper(status), F.upper(F.coalesce(exec_status, F.lit("")))
    return F.when((s == "RUNNING") & e.isin(dims.HITL_STATUSES + dims.TERMINAL_STATUSES), e).otherwise(s)


def node_status(node_id: Column, history: Column, current: Column, overall: Column,
                outputs: Column, waiting_input: Column, review: Column) -> Column:
    """First match wins (input, review, running, output, history, pending)."""
    return (F.when(node_id == waiting_input, "WAITING_FOR_INPUT")
            .when(node_id == review, "WAITING_FOR_REVIEW")
            .when((node_id == current) & (F.upper(overall) == "RUNNING"), "RUNNING")
            .when(F.coalesce(F.map_contains_key(outputs, node_id), F.lit(False)), "COMPLETED")
            .when(F.coalesce(F.array_contains(history, node_id), F.lit(False)), "COMPLETED")
            .otherwise("PENDING"))


def run_progress(node_statuses: DataFrame) -> DataFrame:
    """Completed / total nodes per run."""
    return node_statuses.groupBy("run_id").agg(
        F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count("*").alias("total"))


# ------------------------------------------------------------------ T5 / K1 / K2
def node_outputs_latest(events: DataFrame) -> DataFrame:
    """T5: fold STATE_SNAPSHOT / STATE_DELTA ops on ``/node_outputs/<id>``: newest value per node.

    A snapshot resets the fold (its ``node_outputs`` entries count as ops at
    that event); ``remove`` deletes the node's value. ``~1`` and ``~0`` in a
    path stand for ``/`` and ``~``. Ops on deeper paths change a part of a
    value and leave the node's whole value as it is.
    """
    ev = typed_events(events)
    snaps = ev.where(F.col("etype") == "STATE_SNAPSHOT").select("run_id", "seq", "outputs")
    last_snap = snaps.groupBy("run_id").agg(F.max("seq").alias("_snap"), F.max_by("outputs", "seq").alias("outputs"))
    snap_ops = (last_snap.select("run_id", F.col("_snap").alias("seq"), F.explode(F.from_json("outputs", "map<string,string>")).alias("node_id", "value"))
                .select("run_id", "seq", F.lit(0).alias("op_pos"), "node_id", F.lit("add").alias("op"), "value"))
    path = F.split(F.col("d.path"), "/")
    deltas = (ev.where(F.col("etype") == "STATE_DELTA")
              .select("run_id", "seq", F.posexplode(F.from_json("delta", "array<struct<op:string,path:string,value:string>>")).alias("op_pos", "d"))
              .where(F.col("d.path").startswith("/node_outputs/") & (F.size(path) == 3))
              .select("run_id", "seq", "op_pos",
                      F.replace(F.replace(path.getItem(2), F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")).alias("node_id"),
                      F.col("d.op").alias("op"), F.col("d.value").alias("value")))
    ops = snap_ops.unionByName(deltas).join(last_snap.select("run_id", "_snap"), "run_id", "left") \
        .where(F.col("_snap").isNull() | (F.col("seq") >= F.col("_snap")))
    latest = ops.groupBy("run_id", "node_id").agg(
        F.max_by(F.struct("op", "value"), F.struct("seq", "op_pos")).alias("l"))
    return latest.where(F.col("l.op") != "remove").select("run_id", "node_id", F.col("l.value").alias("value"))


def events_to_ndjson(events: DataFrame) -> DataFrame:
    """K1: each decoded event as one compact JSON object (keys in canonical order)."""
    return events.select("run_id", "seq", F.to_json("data").alias("json"))


def run_result_json(runs: DataFrame, outputs: DataFrame) -> DataFrame:
    """K2: one compact JSON record per run from its state.

    ``runs(run_id, workflow_id, status, execution_status)`` gives the final
    status (P7); ``outputs(run_id, node_id, value)`` the node outputs (``{}`` if none).
    """
    outs = outputs.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("node_id", "value")))).alias("node_outputs"))
    rec = runs.join(outs, "run_id", "left").select(
        "run_id", "workflow_id", effective_status(F.col("status"), F.col("execution_status")).alias("final_status"),
        F.coalesce("node_outputs", F.create_map().cast("map<string,string>")).alias("node_outputs"))
    return rec.select("run_id", F.to_json(F.struct("run_id", "workflow_id", "final_status", "node_outputs"),
                                          {"ignoreNullFields": "false"}).alias("json"))


def scan_event_lines(spark, path: str) -> DataFrame:
    """S3: event text files -> ``(run_id, seq, line)``.

    One file per run; ``seq`` is ``monotonically_increasing_id`` which grows
    with file offset inside each file (partition index, then row index).
    """
    raw = spark.read.text(path)
    run = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1)
    return raw.select(run.alias("run_id"), F.monotonically_increasing_id().alias("seq"),
                      F.col("value").alias("line"))
