"""State that starts from a batch, and flags of ended runs that go."""

import random

import pandas as pd
from pyspark.sql import functions as F

from quarry.operators import runs
from quarry.sources import fixtures as fx
from quarry.streaming import events as st
from quarry.streaming import state

SF = "/root/testdata/sf0.001"


def changes(rows):
    return sorted((r.run_id, r.node_id, r.seq, r.display_name, r.step_type, r.status, r.duration_ms) for r in rows.collect())


def test_batch_then_stream_equals_stream_over_all(spark):
    lines = fx.event_lines(spark, SF).where("seq % 3 > 0 or seq < 300").cache()
    cut = lines.approxQuantile("seq", [0.5], 0)[0]
    early, late = lines.where(F.col("seq") <= cut), lines.where(F.col("seq") > cut)

    def streamed(rows, start=None):
        return changes(st.run_to_table(state.stream_node_summary(st.stream_events(spark, st.stage_lines(rows)), start), "split"))

    begin = state.node_state(runs.event_flags(runs.parse_event_lines(early)))
    both = sorted(streamed(early) + streamed(late, begin))
    assert both == streamed(lines) and len(both) > 50


def test_ended_flags_live_for_their_time(spark):
    def line(seq, kind):
        return ("r1", seq, f"2024-01-01 00:00:{seq:02d}", f'data: {{"type":"{kind}","node_id":"n1"}}')

    def frame(rows):
        return spark.createDataFrame(rows, "run_id string, seq long, ts string, line string").withColumn("ts", F.col("ts").cast("timestamp"))

    for keep, reopened in ((state.KEEP_ENDED, 0), (1, 1)):
        path, folder = st.scratch_dir(spark, "lines"), st.scratch_dir(spark, "ttl")
        for rows in ([line(1, "STEP_STARTED"), line(2, "RUN_FINISHED")], [line(3, "STEP_STARTED")]):
            frame(rows).write.mode("append").option("timestampFormat", st.TIME_FORMAT).json(path)
            q = (state.stream_node_summary(st.stream_events(spark, path), keep=keep).writeStream.format("parquet").option("path", f"{folder}/out")
                 .option("checkpointLocation", f"{folder}/ckpt").trigger(processingTime="1 second").start())
            try:
                assert not q.awaitTermination(12)
            finally:
                q.stop()
        assert spark.read.parquet(f"{folder}/out").count() == 1 + reopened


class Handle:
    """State in memory that notes the calls that reach it."""

    def __init__(self):
        self.calls = []

    def getValueState(self, name, *_):
        return Held(name, self.calls)

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls.append(("registerTimer", at))

    def deleteTimer(self, at):
        self.calls.append(("deleteTimer", at))


class Held:
    def __init__(self, name, calls):
        self.name, self.calls, self.rows = name, calls, {}

    def _noted(self, call, value=None):
        self.calls.append((self.name, call))
        return value

    def exists(self):
        return self._noted("exists", bool(self.rows))

    def get(self):
        return self._noted("get", self.rows.get(None))

    def update(self, value):
        self._noted("update")
        self.rows[None] = value

    def clear(self):
        self._noted("clear")
        self.rows = {}

    def containsKey(self, key):
        return self._noted("containsKey", key in self.rows)

    def getValue(self, key):
        return self._noted("getValue", self.rows.get(key))

    def updateValue(self, key, value):
        self._noted("updateValue")
        self.rows[key] = value


def batch(*kinds):
    rows = [(i, pd.Timestamp(1000 + i, unit="s"), k, k == "RUN_FINISHED", "n1", "", "", "t", None) for i, k in enumerate(kinds)]
    return iter([pd.DataFrame(rows, columns=["seq", "ts", "etype", "is_terminal", "node_id", "node_slug", "step_name", "step_type", "duration_ms"])])


def test_state_is_read_and_written_once_a_batch():
    """A run that ends in its first batch sets one timer, and a node's entry is read and written once."""
    handle, run = Handle(), state.Timeouts(60, keep=5000)
    run.init(handle)
    assert list(run.handleInputRows(("r",), batch("STEP_STARTED", "RUN_FINISHED"), None)) == []
    assert [c for c in handle.calls if "Timer" in c[0]] == [("registerTimer", 1_000_000 + 60_000 + 5000)] and len(handle.calls) <= 4

    handle, run = Handle(), state.Timeouts(60, keep=5000)
    run.init(handle)
    list(run.handleInputRows(("r",), batch("STEP_STARTED"), None))
    list(run.handleInputRows(("r",), batch("RUN_FINISHED"), None))
    assert [c for c in handle.calls if "Timer" in c[0]] == [("registerTimer", 1_060_000), ("deleteTimer", 1_060_000), ("registerTimer", 1_065_000)]

    handle, run = Handle(), state.NodeSummary()
    run.init(handle)
    (out,) = run.handleInputRows(("r",), batch("STEP_STARTED", "STEP_FINISHED", "STEP_STARTED", "STEP_FINISHED"), None)
    assert out["duration_ms"].fillna(-1).tolist() == [-1, 1000, -1, 1000] and run.nodes.rows == {("n1",): (1_002_000_000, "t")}
    assert handle.calls == [("ended", "exists"), ("nodes", "getValue"), ("nodes", "updateValue")]


EVENTS = ["run_id", "seq", "ts", "etype", "is_terminal", "is_pausing", "node_id", "node_slug", "step_name", "step_type", "duration_ms"]
KINDS = ["STEP_STARTED", "STEP_FINISHED", "STEP_ERROR", "WAITING_FOR_INPUT", "REVIEW_COMPLETE", "RUN_FINISHED"]


def mixed_batches():
    """Four batches of events of 30 runs, out of order; one run has no id."""
    rng = random.Random(6)
    seqs = rng.sample(range(1000), 600)
    rows = []
    for i, seq in enumerate(seqs):
        run, kind = rng.randrange(30), rng.choices(KINDS, [5, 5, 2, 2, 1, 1 if i > 300 else 0])[0]
        rows.append((f"r{run}" if run else None, seq, pd.Timestamp(1000 + seq, unit="s"), kind, kind == "RUN_FINISHED", kind == "WAITING_FOR_INPUT", rng.choice(["n1", "n2", "", None]), rng.choice(["", None, "s"]), "", rng.choice([None, "t"]), rng.choice([None, 5.0])))
    return [pd.DataFrame(rows[i : i + 150], columns=EVENTS) for i in range(0, 600, 150)]


def test_buckets_of_runs_give_what_single_runs_give():
    """And a bucket's state is read and written once a batch, however many runs it has."""
    rows = lambda parts: sorted((tuple(None if pd.isna(v) else v for v in r) for p in parts for r in p.itertuples(index=False)), key=str)
    batches = mixed_batches()
    for single, many in ((state.NodeSummary, state.NodeSummaries), (state.WaitingQueue, state.WaitingQueues)):
        want, alone = [], {}
        for b in batches:
            for run in {r if isinstance(r, str) else None for r in b["run_id"]}:
                if run not in alone:
                    alone[run] = single()
                    alone[run].init(Handle())
                part = b[b["run_id"].isna()] if run is None else b[b["run_id"] == run]
                want += alone[run].handleInputRows((run,), iter([part]), None)
        handle, bucket, got = Handle(), many(), []
        bucket.init(handle)
        for b in batches:
            got += bucket.handleInputRows((0,), iter([b[:70], b[70:]]), None)
        assert rows(got) == rows(want) and len(rows(got)) > 100
        assert handle.calls == [("runs", "get"), ("runs", "update")] * len(batches)


def test_timeouts_of_buckets(spark):
    """Deadlines at, before and after the watermark, an end after the deadline, and flags that go: as for single runs."""
    def line(run, at, kind="STEP_STARTED"):
        return (run, at, pd.Timestamp(10_000 + at, unit="s").to_pydatetime(), f'data: {{"type":"{kind}","node_id":"n1"}}')

    parts = [[line("a", 0), line("b", 60), line("c", 10), line("c", 20, "RUN_FINISHED"), line("d", 30), line("f", 5), line(None, 1)],
             [line("d", 61, "RUN_FINISHED"), line("a", 62), line("e", 200), line("f", 90, "RUN_FINISHED"), line("f", 91)], [line("b", 201), line("g", 400)]]
    got = {}
    for buckets in (None, 2):
        path, folder = st.scratch_dir(spark, "lines"), st.scratch_dir(spark, "timeouts")
        for rows in parts:
            spark.createDataFrame(rows, "run_id string, seq long, ts timestamp, line string").write.mode("append").option("timestampFormat", st.TIME_FORMAT).json(path)
            found = st.run_to_table(state.stream_timeouts(st.stream_events(spark, path), limit_s=60, buckets=buckets), "timeouts", folder)
        got[buckets] = sorted(map(repr, found.collect()))
    assert got[2] == got[None] and len(got[2]) >= 4
