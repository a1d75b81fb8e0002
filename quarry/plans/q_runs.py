"""Registered run-event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry import dims
from quarry.functions import text as tf
from quarry.operators import runs
from quarry.plans.catalog import query
from quarry.plans.sqlgen import in_list
from quarry.session import cut_lineage
from quarry.sources import fixtures as fx
from quarry.sources.tables import table

STOP_SQL = f"etype IN {in_list(dims.TERMINAL_EVENTS + dims.PAUSING_EVENTS)}"
TRUNC_SQL = f"""SELECT e.* FROM v_events e LEFT JOIN (SELECT run_id, min(seq) AS stop_seq FROM v_events
  WHERE {STOP_SQL} GROUP BY run_id) s ON s.run_id = e.run_id
  WHERE s.stop_seq IS NULL OR e.seq <= s.stop_seq"""
CAT_PAIRS = [(n, c) for c, ns in [("lifecycle", dims.LIFECYCLE_EVENTS), ("step", dims.STEP_EVENTS),
                                  ("state", dims.STATE_EVENTS), ("text", dims.TEXT_EVENTS),
                                  ("tool", dims.TOOL_EVENTS), ("hitl", dims.HITL_EVENTS),
                                  ("custom", dims.CUSTOM_EVENTS)] for n in ns]
CAT_SQL = "CASE " + " ".join(f"WHEN etype = '{n}' THEN '{c}'" for n, c in CAT_PAIRS) + " ELSE 'unknown' END"


def _events(spark, sf):
    return runs.event_flags(runs.parse_event_lines(fx.event_lines(spark, sf)))


def _staged(spark, sf):
    """Events parsed once into typed columns and written, for queries that read them several times."""
    return cut_lineage(runs.typed_events(_events(spark, sf)))


@query("scan_event_lines", "SELECT run_id, seq, line FROM v_event_lines")
def scan_event_lines(spark, sf):
    """S3 over the stand-in line table (file sources use ``runs.scan_event_lines``)."""
    return fx.event_lines(spark, sf).select("run_id", "seq", "line")


@query("parse_event_line", """
SELECT run_id, seq, event_type, json_extract_string(body, '$.node_id') AS node_id,
  cast(json_extract(body, '$.duration_ms') AS BIGINT) AS duration_ms FROM v_events""")
def parse_event_line(spark, sf):
    e = runs.parse_event_lines(fx.event_lines(spark, sf))
    return e.select("run_id", "seq", "event_type",
                    F.try_variant_get("data", "$.node_id", "string").alias("node_id"),
                    F.try_variant_get("data", "$.duration_ms", "bigint").alias("duration_ms"))


@query("event_category", f"""
SELECT run_id, seq, etype, {CAT_SQL} AS category, etype IN {in_list(dims.TERMINAL_EVENTS)} AS is_terminal,
  etype IN {in_list(dims.PAUSING_EVENTS)} AS is_pausing FROM v_events""")
def event_category(spark, sf):
    return _events(spark, sf).select("run_id", "seq", "etype", "category", "is_terminal", "is_pausing")


@query("truncate_run", f"SELECT run_id, seq, event_type FROM ({TRUNC_SQL}) t")
def truncate_run(spark, sf):
    return runs.truncate_run(_staged(spark, sf)).select("run_id", "seq", "event_type")


A12_SQL = f"""WITH t AS ({TRUNC_SQL}),
s AS (SELECT run_id, seq, etype, coalesce(json_extract_string(body, '$.node_id'), '') AS node_id,
  coalesce(nullif(json_extract_string(body, '$.node_slug'), ''), nullif(json_extract_string(body, '$.step_name'), ''),
           json_extract_string(body, '$.node_id')) AS display,
  coalesce(json_extract_string(body, '$.step_type'), '') AS step_type,
  cast(json_extract(body, '$.duration_ms') AS BIGINT) AS dur, epoch_us(ts) AS t_us
  FROM t WHERE etype IN ('STEP_STARTED', 'STEP_FINISHED', 'STEP_ERROR'))
SELECT run_id, node_id, arg_max(display, seq) AS display_name,
  CASE WHEN count_if(etype = 'STEP_STARTED') > 0 THEN arg_max(step_type, seq) FILTER (WHERE etype = 'STEP_STARTED')
       ELSE arg_min(step_type, seq) END AS step_type,
  CASE arg_max(etype, seq) WHEN 'STEP_STARTED' THEN 'started' WHEN 'STEP_FINISHED' THEN 'finished' ELSE 'error' END AS status,
  CASE WHEN arg_max(etype, seq) = 'STEP_STARTED' THEN NULL
       ELSE coalesce(arg_max_null(dur, seq),
                     cast(floor((arg_max(t_us, seq) - arg_max(t_us, seq) FILTER (WHERE etype = 'STEP_STARTED')) / 1000) AS BIGINT)) END
    AS duration_ms
FROM s WHERE node_id <> '' GROUP BY run_id, node_id"""


@query("node_run_summary", A12_SQL)
def node_run_summary(spark, sf):
    return runs.node_run_summary(_staged(spark, sf))


@query("progress_step", f"""WITH t AS ({TRUNC_SQL}),
f AS (SELECT run_id, json_extract_string(body, '$.node_id') AS node_id, min(seq) AS first_seq FROM t
  WHERE etype = 'STEP_STARTED' AND coalesce(json_extract_string(body, '$.node_id'), '') <> '' GROUP BY ALL)
SELECT t.run_id, t.seq, t.etype, cast(sum(CASE WHEN f.first_seq = t.seq THEN 1 ELSE 0 END)
  OVER (PARTITION BY t.run_id ORDER BY t.seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS step
FROM t LEFT JOIN f ON f.run_id = t.run_id AND f.node_id = coalesce(json_extract_string(t.body, '$.node_id'), '')""")
def progress_step(spark, sf):
    return runs.progress_step(_staged(spark, sf))


@query("duration_fallback", """
SELECT run_id, seq, node_id, coalesce(dur, cast(floor((t_us - ls) / 1000) AS BIGINT)) AS duration_ms FROM (
  SELECT run_id, seq, etype, json_extract_string(body, '$.node_id') AS node_id,
    cast(json_extract(body, '$.duration_ms') AS BIGINT) AS dur, epoch_us(ts) AS t_us,
    last_value(CASE WHEN etype = 'STEP_STARTED' THEN epoch_us(ts) END IGNORE NULLS) OVER (
      PARTITION BY run_id, json_extract_string(body, '$.node_id') ORDER BY seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls
  FROM v_events WHERE etype IN ('STEP_STARTED', 'STEP_FINISHED', 'STEP_ERROR')
    AND json_extract_string(body, '$.node_id') <> '') x
WHERE etype <> 'STEP_STARTED'""")
def duration_fallback(spark, sf):
    return runs.duration_fallback(_staged(spark, sf))


@query("node_transitions", """
SELECT run_id, poll_no, current_node FROM (
  SELECT run_id, seq AS poll_no, current_node,
    coalesce(lag(coalesce(current_node, '')) OVER (PARTITION BY run_id ORDER BY seq), '') AS prev
  FROM (SELECT run_id, seq, CASE WHEN upper(event_type) LIKE 'STEP_%' THEN node_id END AS current_node
        FROM v_run_events) p) x
WHERE coalesce(current_node, '') <> '' AND current_node <> prev""")
def node_transitions(spark, sf):
    """W6 over polls: each run event is a poll whose current node is set on step events."""
    e = fx.v_run_events(spark, sf)
    polls = e.select("run_id", F.col("seq").alias("poll_no"),
                     F.when(F.upper("event_type").startswith("STEP_"), F.col("node_id")).alias("current_node"))
    return runs.node_transitions(polls)


@query("interrupted_runs", f"""
SELECT run_id, arg_max(event_type, seq) AS last_event_type FROM v_events GROUP BY run_id
HAVING NOT arg_max({STOP_SQL}, seq)""")
def interrupted_runs(spark, sf):
    return runs.interrupted_runs(_events(spark, sf))


@query("overdue_runs", f"""
SELECT run_id, cast(floor((max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000) AS BIGINT) AS elapsed_s FROM v_events
GROUP BY run_id HAVING count_if(etype IN {in_list(dims.TERMINAL_EVENTS)}) = 0
  AND (max(epoch_us(ts)) - min(epoch_us(ts))) / 1000000 >= {dims.RUN_TIMEOUT_S}""")
def overdue_runs(spark, sf):
    return runs.overdue_runs(_events(spark, sf))


@query("latest_run", """
SELECT workspace_id, arg_max(run_id, (started_at, run_id)) AS run_id, max(started_at) AS started_at
FROM v_runs GROUP BY workspace_id""")
def latest_run(spark, sf):
    return runs.latest_run(fx.runs_from_orders(spark, sf))


@query("run_context", """WITH last AS (SELECT workspace_id, arg_max(run_id, (started_at, run_id)) AS run_id FROM v_runs GROUP BY workspace_id),
asked AS (SELECT c_custkey AS workspace_id, CASE c_custkey % 3 WHEN 0 THEN (SELECT run_id FROM last l WHERE l.workspace_id = c_custkey) WHEN 1 THEN -1 - c_custkey END AS asked FROM customer)
SELECT a.workspace_id, CASE WHEN l.run_id IS NOT NULL AND (asked IS NULL OR asked = l.run_id) THEN l.run_id END AS run_id,
  CASE WHEN l.run_id IS NULL AND asked IS NULL THEN 'no last run' WHEN l.run_id IS NULL THEN 'run id without a last run' WHEN asked <> l.run_id THEN 'mismatch' ELSE 'found' END AS verdict,
  CASE WHEN asked <> l.run_id THEN l.run_id END AS expected
FROM asked a LEFT JOIN last l ON l.workspace_id = a.workspace_id""")
def run_context(spark, sf):
    """The run that each workspace means: a third asks for its last run, a third for another, a third for none."""
    last = runs.latest_run(fx.runs_from_orders(spark, sf))
    k = F.col("c_custkey")
    mine = last.select(F.col("workspace_id").alias("c_custkey"), "run_id")
    asked = table(spark, sf, "customer").select("c_custkey").join(mine, "c_custkey", "left")
    return runs.run_context(last, asked.select(k.alias("workspace_id"), F.when(k % 3 == 0, F.col("run_id")).when(k % 3 == 1, -1 - k).alias("run_id")))


NODE_OUT_SQL = """WITH snap AS (SELECT run_id, max(seq) AS seq, arg_max(body, seq) AS body FROM v_events WHERE etype = 'STATE_SNAPSHOT' GROUP BY run_id),
sn AS (SELECT run_id, seq, k AS node_id, json_extract_string(body, concat('$.snapshot.node_outputs.', k)) AS value
  FROM (SELECT run_id, seq, body, unnest(json_keys(body, '$.snapshot.node_outputs')) AS k FROM snap) x),
d AS (SELECT run_id, seq, json_extract_string(body, '$.delta[0].op') AS op,
  json_extract_string(body, '$.delta[0].path') AS path, json_extract_string(body, '$.delta[0].value') AS value
  FROM v_events WHERE etype = 'STATE_DELTA'),
ops AS (SELECT run_id, seq, node_id, 'add' AS op, value FROM sn
  UNION ALL SELECT d.run_id, d.seq, replace(replace(split_part(path, '/', 3), '~1', '/'), '~0', '~'), op, value FROM d LEFT JOIN snap ON snap.run_id = d.run_id
  WHERE starts_with(path, '/node_outputs/') AND len(string_split(path, '/')) = 3 AND (snap.seq IS NULL OR d.seq >= snap.seq)),
l AS (SELECT run_id, node_id, arg_max(op, seq) AS op, arg_max_null(value, seq) AS value FROM ops GROUP BY ALL)"""


@query("node_outputs_latest", NODE_OUT_SQL + " SELECT run_id, node_id, value FROM l WHERE op <> 'remove'")
def node_outputs_latest(spark, sf):
    return runs.node_outputs_latest(_staged(spark, sf))


@query("events_to_ndjson", """
SELECT run_id, seq, concat('{', CASE WHEN json_extract(body, '$.delta') IS NOT NULL
    THEN concat('"delta":[{"op":"', json_extract_string(body, '$.delta[0].op'), '","path":"',
                json_extract_string(body, '$.delta[0].path'), '","value":"', json_extract_string(body, '$.delta[0].value'), '"}],')
    ELSE '' END,
  CASE WHEN json_extract(body, '$.duration_ms') IS NOT NULL THEN concat('"duration_ms":', json_extract_string(body, '$.duration_ms'), ',') ELSE '' END,
  '"node_id":"', json_extract_string(body, '$.node_id'), '",',
  CASE WHEN json_extract(body, '$.snapshot') IS NOT NULL THEN concat('"snapshot":', json_extract(body, '$.snapshot'), ',') ELSE '' END,
  '"type":"', event_type, '"}') AS json
FROM v_events""")
def events_to_ndjson(spark, sf):
    return runs.events_to_ndjson(_events(spark, sf))


@query("run_result_json", f"""{NODE_OUT_SQL},
o AS (SELECT run_id, string_agg(concat('"', node_id, '":"', value, '"'), ',' ORDER BY node_id) AS kv FROM l
      WHERE op <> 'remove' GROUP BY run_id),
st AS (SELECT run_id, count(*) % 4 AS k FROM v_run_events GROUP BY run_id)
SELECT st.run_id, concat('{{"run_id":"', st.run_id, '","workflow_id":"w', cast(k AS VARCHAR), '","final_status":"',
  CASE k WHEN 0 THEN 'COMPLETED' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'WAITING_FOR_INPUT' ELSE 'FAILED' END,
  '","node_outputs":{{', coalesce(o.kv, ''), '}}}}') AS json
FROM st LEFT JOIN o ON o.run_id = st.run_id""")
def run_result_json(spark, sf):
    """K2: run state joined with the outputs that the state events of the run leave."""
    return runs.run_result_json(fx.event_run_states(spark, sf), runs.node_outputs_latest(_staged(spark, sf)))


@query("effective_status", f"""
SELECT run_id, CASE WHEN upper(status) = 'RUNNING' AND upper(execution_status) IN
  {in_list(dims.HITL_STATUSES + dims.TERMINAL_STATUSES)} THEN upper(execution_status) ELSE upper(status) END AS effective_status
FROM v_runs""")
def effective_status(spark, sf):
    r = fx.runs_from_orders(spark, sf)
    return r.select("run_id", runs.effective_status(F.col("status"), F.col("execution_status")).alias("effective_status"))


P8_SQL = """SELECT r.run_id, n.slug AS node_id, CASE
  WHEN upper(r.execution_status) = 'WAITING_FOR_INPUT' AND n.slug = 'n1' THEN 'WAITING_FOR_INPUT'
  WHEN upper(r.execution_status) = 'WAITING_FOR_REVIEW' AND n.slug = 'n2' THEN 'WAITING_FOR_REVIEW'
  WHEN n.slug = r.current_node_id AND upper(r.status) = 'RUNNING' THEN 'RUNNING'
  WHEN n.pos <= r.out_n THEN 'COMPLETED'
  WHEN n.pos <= r.hist_n THEN 'COMPLETED'
  ELSE 'PENDING' END AS status
FROM v_runs r JOIN v_nodes n ON n.workflow_id = r.workflow_id"""


def _node_status(spark, sf):
    r = fx.runs_from_orders(spark, sf)
    n = fx.v_nodes(spark, sf).select("workflow_id", F.col("slug").alias("node_id"))
    j = r.join(n, "workflow_id")
    return j.select("run_id", "node_id", runs.node_status(
        F.col("node_id"), F.col("execution_history"), F.col("current_node_id"), F.col("status"),
        F.col("node_outputs"), F.col("waiting_input_node_id"), F.col("review_node_id")).alias("status"))


@query("node_status", P8_SQL)
def node_status(spark, sf):
    return _node_status(spark, sf)


@query("run_progress", f"""SELECT run_id, cast(count_if(status = 'COMPLETED') AS BIGINT) AS completed,
  count(*) AS total FROM ({P8_SQL}) s GROUP BY run_id""")
def run_progress(spark, sf):
    return runs.run_progress(_node_status(spark, sf))


A17_SQL = """WITH c AS (SELECT doc_id, attempt, result, CASE WHEN result = 'success' THEN 'success'
    WHEN result IN ('failure', 'skipped') OR regexp_matches(result, '^http_4[0-9][0-9]$') THEN 'terminal'
    ELSE 'retry' END AS cls FROM v_attempts WHERE attempt <= 3),
past AS (SELECT doc_id, count_if(attempt > 3) AS n_past_policy, min(attempt) AS low FROM v_attempts GROUP BY doc_id),
g AS (SELECT doc_id, min(attempt) FILTER (WHERE cls <> 'retry') AS decided, max(attempt) AS last_attempt FROM c GROUP BY doc_id)
SELECT past.doc_id, coalesce(g.decided, g.last_attempt) AS attempts_used,
  CASE WHEN g.decided IS NULL THEN 'exhausted' WHEN d.result = 'success' THEN 'success' ELSE 'failed' END AS outcome,
  cast(coalesce((SELECT sum(30 * c.attempt) FROM c WHERE c.doc_id = g.doc_id
    AND c.attempt < coalesce(g.decided, g.last_attempt) AND c.attempt < 3), 0) AS BIGINT) AS wait_s, cast(past.n_past_policy AS BIGINT) AS n_past_policy
FROM past LEFT JOIN g ON g.doc_id = past.doc_id LEFT JOIN c d ON d.doc_id = g.doc_id AND d.attempt = g.decided"""


@query("attempt_outcome", A17_SQL)
def attempt_outcome(spark, sf):
    from quarry.operators.outcomes import attempt_outcome as ao
    return ao(fx.v_attempts(spark, sf))


@query("format_duration", """
SELECT event_id, ms, CASE WHEN ms < 1000 THEN concat(cast(ms AS VARCHAR), 'ms') ELSE
  CASE WHEN s <= 0 THEN '0s' ELSE concat_ws(' ', CASE WHEN s // 3600 > 0 THEN concat(cast(s // 3600 AS VARCHAR), 'h') END,
    CASE WHEN (s % 3600) // 60 > 0 THEN concat(cast((s % 3600) // 60 AS VARCHAR), 'm') END,
    CASE WHEN s % 60 > 0 OR (s // 3600 = 0 AND (s % 3600) // 60 = 0) THEN concat(cast(s % 60 AS VARCHAR), 's') END) END END AS text
FROM (SELECT event_id, cast(floor(value * 1000) AS BIGINT) AS ms, cast(floor(value * 1000) AS BIGINT) // 1000 AS s FROM events) x""")
def format_duration(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.floor(F.col("value") * 1000).cast("bigint").alias("ms"))
    return e.select("event_id", "ms", tf.format_duration_ms(F.col("ms")).alias("text"))


@query("event_preview", """
SELECT doc_id, CASE WHEN length(text) > 200 THEN concat(left(text, 200), '...') ELSE text END AS output_preview,
  left(text, 200) AS content_preview,
  CASE WHEN length(shown) > most THEN concat(left(shown, most), '...') ELSE shown END AS payload_preview
FROM (SELECT *, CASE doc_id % 3 WHEN 2 THEN 100 ELSE 200 END AS most, CASE doc_id % 3 WHEN 2 THEN concat('{"other":', cast(doc_id AS VARCHAR), ',"more":"', repeat('x', cast(doc_id % 200 AS INTEGER)), '"}') ELSE CASE WHEN text = '' THEN '{"content":""}' ELSE text END END AS shown FROM documents) x""")
def event_preview(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id") % 3
    payload = (F.when(k == 0, F.to_json(F.struct(F.lit("").alias("text"), F.col("text").alias("content"))))
               .when(k == 1, F.to_json(F.struct(F.col("text").alias("response")))).otherwise(F.concat(F.lit('{"other":'), F.col("doc_id").cast("string"), F.lit(',"more":"'), F.repeat(F.lit("x"), (F.col("doc_id") % 200).cast("int")), F.lit('"}'))))
    return d.select("doc_id", tf.output_preview(F.col("text")).alias("output_preview"),
                    tf.content_preview(F.col("text")).alias("content_preview"),
                    tf.event_preview(payload).alias("payload_preview"))


@query("stream_events", """
SELECT run_id, seq, etype, CASE WHEN etype IN ('RUN_FINISHED', 'RUN_ERROR') THEN true ELSE false END AS is_terminal,
  etype IN ('WAITING_FOR_INPUT', 'WAITING_FOR_REVIEW') AS is_pausing FROM v_events""")
def stream_events(spark, sf):
    """The event lines as a file stream (``availableNow``), parsed by the batch Column code."""
    from quarry.streaming import events as st

    path = st.stage_lines(fx.event_lines(spark, sf))
    out = st.run_to_table(st.stream_events(spark, path).select("run_id", "seq", "etype", "is_terminal", "is_pausing"),
                          "stream-events")
    return out


@query("save_node_outputs", NODE_OUT_SQL + """ SELECT run_id, node_id, concat(node_id, '/output.json') AS path,
  trim(concat(node_id, '/output.json')) <> '' AND NOT starts_with(concat(node_id, '/output.json'), '/')
  AND NOT list_contains(string_split(concat(node_id, '/output.json'), '/'), '..') AS path_ok
FROM l WHERE op <> 'remove'""")
def save_node_outputs(spark, sf):
    """K3: latest node outputs with their templated relative path and the confinement check."""
    from quarry.sources.sinks import node_output_paths
    out = runs.node_outputs_latest(_staged(spark, sf))
    return node_output_paths(out).select("run_id", "node_id", "path", "path_ok")


TERM_SQL = f"""SELECT e.* FROM v_events e LEFT JOIN (SELECT run_id, min(seq) AS stop_seq FROM v_events
  WHERE etype IN {in_list(dims.TERMINAL_EVENTS)} GROUP BY run_id) s ON s.run_id = e.run_id
  WHERE s.stop_seq IS NULL OR e.seq <= s.stop_seq"""


def _streamed(spark, sf, build, name):
    """The event lines as a file stream through ``build``, run to the end (``availableNow``)."""
    from quarry.streaming import events as st

    return st.run_to_table(build(st.stream_events(spark, st.stage_lines(fx.event_lines(spark, sf)))), name)


@query("stream_node_summary", A12_SQL.replace(TRUNC_SQL, TERM_SQL))
def stream_node_summary(spark, sf):
    """Per-node map state per run; the standing entry of each node after the stream."""
    from quarry.streaming import state

    return state.latest_entries(_streamed(spark, sf, state.stream_node_summary, "node-summary"))


@query("stream_waiting_queue", f"""WITH t AS ({TERM_SQL}), l AS (SELECT run_id, arg_max(etype, seq) AS etype, max(seq) AS seq, arg_max(body, seq) AS body FROM t
  WHERE {STOP_SQL} OR etype IN {in_list(dims.STEP_EVENTS + ['REVIEW_COMPLETE'])} GROUP BY run_id)
SELECT run_id, seq, etype AS waiting_for, coalesce(json_extract_string(body, '$.node_id'), '') AS node_id FROM l WHERE etype IN {in_list(dims.PAUSING_EVENTS)}""")
def stream_waiting_queue(spark, sf):
    """Runs that wait for input or review when the stream ends."""
    from quarry.streaming import state

    changes = _streamed(spark, sf, state.stream_waiting_queue, "waiting-queue")
    last = changes.groupBy("run_id").agg(F.max_by(F.struct("waiting", "seq", "waiting_for", "node_id"), F.struct("seq", "waiting")).alias("l"))
    return last.where("l.waiting").select("run_id", "l.seq", "l.waiting_for", "l.node_id")


@query("stream_timeouts", f"""SELECT run_id, cast(floor(min(epoch_us(ts)) / 1000) AS BIGINT) AS started_ms, cast(floor(min(epoch_us(ts)) / 1000) AS BIGINT) + {dims.RUN_TIMEOUT_S * 1000} AS deadline_ms
FROM v_events GROUP BY run_id HAVING count_if(etype IN {in_list(dims.TERMINAL_EVENTS)}) = 0
  AND cast(floor(min(epoch_us(ts)) / 1000) AS BIGINT) + {dims.RUN_TIMEOUT_S * 1000} <= (SELECT floor(max(epoch_us(ts)) / 1000) FROM v_events)""")
def stream_timeouts(spark, sf):
    """T4: event-time timers; runs past the limit without a terminal event when the stream's watermark passes."""
    from quarry.streaming import state

    return _streamed(spark, sf, state.stream_timeouts, "timeouts")


@query("submission_preflight", """WITH n AS (SELECT workflow_id, slug, CASE WHEN slug = 'n2' THEN 'human_review' ELSE type END AS type FROM v_nodes),
s AS (SELECT r.*, concat('n', cast(run_id % 4 AS VARCHAR)) AS node_id, run_id % 2 = 0 AS review, run_id % 5 <> 0 AND run_id % 3 <> 0 AS approve, run_id % 3 = 0 AS reject,
  CASE WHEN run_id % 7 = 0 THEN '' ELSE 'why' END AS comment,
  CASE WHEN upper(execution_status) = 'WAITING_FOR_INPUT' THEN 'n1' END AS wait_node, CASE WHEN upper(execution_status) = 'WAITING_FOR_REVIEW' THEN 'n2' END AS review_node FROM v_runs r)
SELECT run_id AS sub_id, CASE WHEN review THEN CASE
    WHEN approve::INT + reject::INT <> 1 THEN 'one decision needed' WHEN NOT approve AND comment = '' THEN 'comment needed' WHEN upper(status) = 'COMPLETED' THEN 'run has ended'
    WHEN wait_node IS NOT NULL THEN 'paused for input' WHEN n.type IS NULL THEN 'node not found' WHEN n.type <> 'human_review' THEN 'not a review node'
    WHEN coalesce(review_node, '') <> node_id THEN 'not paused for this review' ELSE 'ok' END
  ELSE CASE WHEN n.type IS NULL THEN 'node not found' WHEN upper(status) = 'COMPLETED' THEN 'run has ended' WHEN review_node IS NOT NULL THEN 'paused for review'
    WHEN coalesce(wait_node, '') <> node_id THEN 'not waiting for this input' ELSE 'ok' END END AS verdict
FROM s LEFT JOIN n ON n.workflow_id = s.workflow_id AND n.slug = s.node_id""")
def submission_preflight(spark, sf):
    """One review decision or input per run against the run's state and nodes."""
    from quarry.operators.preflight import submission_preflight as check

    r, k = fx.runs_from_orders(spark, sf), F.col("run_id")
    nodes = fx.v_nodes(spark, sf).select("workflow_id", F.col("slug").alias("node_id"), F.when(F.col("slug") == "n2", "human_review").otherwise(F.col("type")).alias("type"))
    subs = r.select(k.alias("sub_id"), F.when(k % 2 == 0, "review").otherwise("input").alias("kind"), "run_id", F.concat(F.lit("n"), (k % 4).cast("string")).alias("node_id"),
                    ((k % 5 != 0) & (k % 3 != 0)).alias("approve"), (k % 3 == 0).alias("reject"), F.lit(None).cast("boolean").alias("revise"),
                    F.when(k % 7 == 0, "").otherwise("why").alias("comment"))
    state = r.select("run_id", "workflow_id", "status", "execution_status", "current_node_id", "waiting_input_node_id", "review_node_id")
    return check(subs, state, nodes)


@query("templated_output_paths", NODE_OUT_SQL + """, o AS (SELECT run_id, node_id, value FROM l WHERE op <> 'remove'),
p AS (SELECT *, CASE WHEN NOT regexp_matches(node_id, '^[a-zA-Z0-9_-]+$') THEN concat('out/{{', node_id, '.output.text}}.json')
  WHEN node_id = 'n1' THEN NULL WHEN node_id = 'n2' THEN concat('/abs/', value, '.json') ELSE concat('out/', value, '.json') END AS path FROM o)
SELECT run_id, node_id, value, path, coalesce(path NOT LIKE '/%' AND NOT list_contains(string_split(path, '/'), '..'), false) AS path_ok FROM p""")
def templated_output_paths(spark, sf):
    """K3 with templates: each node's path names its own output (``n1`` refers to a field that is missing, ``n2`` leaves the root)."""
    from quarry.sources.sinks import templated_output_paths as paths

    out = cut_lineage(runs.node_outputs_latest(_staged(spark, sf)))
    n = F.col("node_id")
    ref = F.concat(F.lit("{{"), n, F.when(n == "n1", F.lit(".output.other")).otherwise(F.lit(".output.text")), F.lit("}}.json"))
    templates = out.select("run_id", "node_id", F.concat(F.when(n == "n2", F.lit("/abs/")).otherwise(F.lit("out/")), ref).alias("template"))
    values = out.select("run_id", n.alias("slug"), F.lit("text").alias("field"), "value")
    return paths(out, templates, values)
