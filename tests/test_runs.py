"""Event-line parsing and node folding on literal lines (reset on STARTED, creation on FINISHED)."""

import datetime as dt

from quarry.operators import runs


def _lines(spark, lines):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r1", i, t0 + dt.timedelta(seconds=i), l) for i, l in enumerate(lines)]
    return spark.createDataFrame(rows, "run_id string, seq long, ts timestamp, line string")


def test_parse_drops_junk(spark):
    df = _lines(spark, ['data: {"type":"RUN_STARTED"}', "", ": keep-alive", "event: x", "data: nope",
                        "data: [1,2]", '  data: {"node_id":"a"}  '])
    got = [r.event_type for r in runs.parse_event_lines(df).orderBy("seq").collect()]
    assert got == ["RUN_STARTED", "UNKNOWN"]


def test_node_fold(spark):
    df = _lines(spark, [
        'data: {"type":"STEP_FINISHED","node_id":"b","step_type":"llm","duration_ms":5}',
        'data: {"type":"STEP_STARTED","node_id":"a","step_type":"agent","node_slug":"A"}',
        'data: {"type":"step_finished","node_id":"a"}',
        'data: {"type":"STEP_STARTED","node_id":"c"}',
        'data: {"type":"WAITING_FOR_INPUT"}',
        'data: {"type":"STEP_FINISHED","node_id":"c"}',
    ])
    ev = runs.event_flags(runs.parse_event_lines(df))
    got = {r.node_id: (r.display_name, r.step_type, r.status, r.duration_ms)
           for r in runs.node_run_summary(ev).collect()}
    assert got == {"b": ("b", "llm", "finished", 5), "a": ("a", "agent", "finished", 1000),
                   "c": ("c", "", "started", None)}
    whole = {r.node_id: r.status for r in runs.node_run_summary(ev, until="terminal").collect()}
    assert whole["c"] == "finished"


def test_buckets_do_not_change_results(spark, monkeypatch):
    """A hot run: the same rows whether a run is one bucket or cut into many."""
    import random

    rng = random.Random(1)
    kinds = ["STEP_STARTED", "STEP_FINISHED", "STEP_ERROR", "STATE_DELTA"]
    lines = ['data: {"type":"%s","node_id":"n%d"}' % (rng.choice(kinds), rng.randint(0, 5)) for _ in range(300)]
    ev = runs.typed_events(runs.event_flags(runs.parse_event_lines(_lines(spark, lines))))
    polls = spark.createDataFrame([("r", i, rng.choice([None, "", "a", "b"])) for i in range(200)], "run_id string, poll_no long, current_node string")

    def all_rows():
        return [sorted(map(str, df.collect())) for df in (runs.progress_step(ev, "terminal"), runs.duration_fallback(ev), runs.node_transitions(polls))]

    whole = all_rows()
    monkeypatch.setattr(runs, "BUCKET_SEQS", 7)
    assert all_rows() == whole and all(whole)


def test_outputs_fold_over_snapshots_and_paths(spark):
    ev = runs.event_flags(runs.parse_event_lines(_lines(spark, [
        'data: {"type":"STATE_DELTA","delta":[{"op":"add","path":"/node_outputs/old","value":"x"}]}',
        'data: {"type":"STATE_SNAPSHOT","snapshot":{"node_outputs":{"a":"1","b":"2"}}}',
        'data: {"type":"STATE_DELTA","delta":[{"op":"replace","path":"/node_outputs/a/part","value":"no"},{"op":"remove","path":"/node_outputs/b"}]}',
        'data: {"type":"STATE_DELTA","delta":[{"op":"add","path":"/node_outputs/c~1d~0e","value":"3"}]}',
    ])))
    assert {r.node_id: r.value for r in runs.node_outputs_latest(ev).collect()} == {"a": "1", "c/d~e": "3"}


def test_a_run_resumed_after_a_pause_is_interrupted(spark):
    ev = runs.event_flags(runs.parse_event_lines(_lines(spark, ['data: {"type":"WAITING_FOR_INPUT"}', 'data: {"type":"STEP_STARTED","node_id":"a"}'])))
    assert [r.last_event_type for r in runs.interrupted_runs(ev).collect()] == ["STEP_STARTED"]
