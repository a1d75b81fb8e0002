"""Stateful run-event streams (T2 node summary, T3 waiting queue, T4 timeouts).

Each is a ``transformWithStateInPandas`` processor. A call from Spark to Python and
each call to the state store cost far more than an event, so the key is a bucket of
runs (``buckets``, by hash of the run): its state is one packed value, read once and
written once a batch, and has one timer, the earliest of its runs. With ``buckets=None``
the key is the run, for streams of few, long runs. State lives in the state store
with its checkpoint in the shared folder; ``buckets`` must stay as it was when a
stream goes on from a checkpoint. A pause keeps state,
since the run goes on; only a terminal event drops it, leaving a flag that
keeps late events of an ended run from starting it anew. In a stream that runs
on, the flag should go too: T4 drops it by an event-time timer, T2 and T3 by a
time to live, ``keep`` milliseconds. A time to live needs processing time, which
keeps a stream busy for ever, so a run to the end of the input
(``availableNow``) leaves ``keep`` out. Within a micro-batch a run's events are taken in
``seq`` order. A node summary may start from the state that a batch of earlier
events leaves (``node_state``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry import dims
from quarry.operators import runs

KEEP_ENDED = 7 * 24 * 3600 * 1000  # milliseconds
BUCKETS = 1024
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SUMMARY_SCHEMA = "run_id string, node_id string, seq long, display_name string, step_type string, status string, duration_ms long"
QUEUE_SCHEMA = "run_id string, seq long, waiting boolean, waiting_for string, node_id string"
TIMEOUT_SCHEMA = "run_id string, started_ms long, deadline_ms long"


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(rows)
    if not parts:
        return pd.DataFrame()
    batch = parts[0] if len(parts) == 1 else pd.concat(parts)
    return batch if len(batch) == 1 else batch.sort_values("seq", kind="stable")


def _text(value) -> str:
    return value if isinstance(value, str) else ""


class _Ended(StatefulProcessor):
    """A processor with a flag for runs that have ended, which lives for ``keep`` milliseconds (null: as long as the state)."""

    def __init__(self, keep: int | None = None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ended = handle.getValueState("ended", "ended boolean", self.keep)

    def close(self) -> None:
        pass


class NodeSummary(_Ended):
    """The entry of a node whenever a step event changes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.nodes = handle.getMapState("nodes", "node_id string", "started_us long, step_type string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for r in initialState.itertuples(index=False):
            if r.ended:
                self.ended.update((True,))
            else:
                self.nodes.updateValue((r.node_id,), (None if pd.isna(r.started_us) else int(r.started_us), _text(r.step_type)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            return
        out, held, ended = [], {}, False  # a node's state is read once and written once
        for r in _ordered(rows).itertuples(index=False):
            node = _text(r.node_id)
            if r.etype in runs.STEP_STATUS and node:
                known = held[node] if node in held else self.nodes.getValue((node,))
                t_us = int(r.ts.value // 1000)
                duration = None if pd.isna(r.duration_ms) else int(r.duration_ms)
                if r.etype == "STEP_STARTED":
                    known, duration = (t_us, _text(r.step_type)), None
                else:
                    if duration is None and known is not None and known[0] is not None:
                        duration = (t_us - known[0]) // 1000
                    known = (known[0], known[1]) if known is not None else (None, _text(r.step_type))
                held[node] = known
                out.append((key[0], node, int(r.seq), _text(r.node_slug) or _text(r.step_name) or node, known[1], runs.STEP_STATUS[r.etype], duration))
            if r.is_terminal:
                ended = True
                break
        if ended:
            self.nodes.clear()
            self.ended.update((True,))
        else:
            for node, known in held.items():
                self.nodes.updateValue((node,), known)
        if out:
            names = ["run_id", "node_id", "seq", "display_name", "step_type", "status", "duration_ms"]
            yield pd.DataFrame(out, columns=names).astype({"duration_ms": "Int64"})


class WaitingQueue(_Ended):
    """A row when a run starts to wait and one when it stops waiting."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getValueState("waiting", "waiting_for string, node_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            return
        out = []
        for r in _ordered(rows).itertuples(index=False):
            if r.is_pausing:
                self.waiting.update((r.etype, _text(r.node_id)))
                out.append((key[0], int(r.seq), True, r.etype, _text(r.node_id)))
            elif (r.is_terminal or r.etype == "REVIEW_COMPLETE" or r.etype in dims.STEP_EVENTS) and self.waiting.exists():
                kind, node = self.waiting.get()
                self.waiting.clear()
                out.append((key[0], int(r.seq), False, kind, node))
            if r.is_terminal:
                self.ended.update((True,))
                break
        if out:
            yield pd.DataFrame(out, columns=["run_id", "seq", "waiting", "waiting_for", "node_id"])


class Timeouts(_Ended):
    """T4: an event-time timer per run, set by its first event and dropped by a terminal one."""

    def __init__(self, limit_s: int, keep: int = KEEP_ENDED):
        super().__init__(None)  # event time has no time to live
        self.limit_ms, self.stay = limit_s * 1000, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.started = handle.getValueState("started", "started_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.ended.exists():
            batch = pd.concat(list(rows))
            known = self.started.get()
            first = int(batch["ts"].min().value // 1_000_000) if known is None else known[0]
            if batch["is_terminal"].any():
                if known is not None:
                    self.handle.deleteTimer(first + self.limit_ms)
                    self.started.clear()
                self.ended.update((True,))
                self.handle.registerTimer(first + self.limit_ms + self.stay)
            elif known is None:
                self.started.update((first,))
                self.handle.registerTimer(first + self.limit_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            self.ended.clear()
        elif self.started.exists():
            first = self.started.get()[0]
            yield pd.DataFrame([(key[0], first, first + self.limit_ms)], columns=["run_id", "started_ms", "deadline_ms"])


class _Bucket(StatefulProcessor):
    """A processor for a bucket of runs; ``known`` has what it keeps of each run, packed as one value.

    Of a run that has ended it keeps a number: when it ended, or 0 where flags have no time to live (``keep`` null).
    """

    def __init__(self, keep: int | None = None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.packed = handle.getValueState("runs", "packed string", None)

    def read(self, now: int) -> dict:
        held = self.packed.get()
        known = {run: was for run, was in json.loads(held[0])} if held is not None else {}
        return known if self.keep is None else {run: was for run, was in known.items() if not isinstance(was, int) or was + self.keep > now}

    def write(self, known: dict) -> None:
        self.packed.update((json.dumps(list(known.items()), separators=(",", ":")),))

    def now(self, timerValues) -> int:
        return 0 if self.keep is None else int(timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def _run(value) -> str | None:
    return value if isinstance(value, str) else None


def _columns(batch: pd.DataFrame, *names: str) -> list[list]:
    return [batch[n].tolist() for n in names]


def _since_epoch(ts: pd.Series, unit: int) -> pd.Series:
    """Times as whole numbers of so many nanoseconds."""
    return ts.astype("datetime64[ns]").astype("int64") // unit


class NodeSummaries(_Bucket):
    """``NodeSummary`` for a bucket of runs: of a run it keeps start and step type by node."""

    def handleInitialState(self, key, initialState, timerValues) -> None:
        known = self.read(now := self.now(timerValues))
        for run, node, started, kind, ended in zip(*_columns(initialState, "run_id", "node_id", "started_us", "step_type", "ended")):
            if ended:
                known[_run(run)] = now
            elif not isinstance(nodes := known.setdefault(_run(run), {}), int):
                nodes[node] = (None if pd.isna(started) else int(started), _text(kind))
        self.write(known)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, out, acted = self.read(now := self.now(timerValues)), [], False
        batch = _ordered(rows)
        events = _columns(batch, "run_id", "seq", "etype", "is_terminal", *runs.TEXT_FIELDS, "duration_ms")
        for run, seq, etype, terminal, node, slug, name, kind, duration, t_us in zip(*events, _since_epoch(batch["ts"], 1000).tolist()):
            nodes = known.get(run := _run(run), {})
            if isinstance(nodes, int):
                continue
            node = _text(node)
            if etype in runs.STEP_STATUS and node:
                was, duration = nodes.get(node), None if pd.isna(duration) else int(duration)
                if etype == "STEP_STARTED":
                    was, duration = (t_us, _text(kind)), None
                else:
                    if duration is None and was is not None and was[0] is not None:
                        duration = (t_us - was[0]) // 1000
                    was = was if was is not None else (None, _text(kind))
                nodes[node] = was
                known[run], acted = nodes, True
                out.append((run, node, int(seq), _text(slug) or _text(name) or node, was[1], runs.STEP_STATUS[etype], duration))
            if terminal:
                known[run], acted = now, True
        if acted:
            self.write(known)
        if out:
            names = ["run_id", "node_id", "seq", "display_name", "step_type", "status", "duration_ms"]
            yield pd.DataFrame(out, columns=names).astype({"duration_ms": "Int64"})


class WaitingQueues(_Bucket):
    """``WaitingQueue`` for a bucket of runs: of a run it keeps what it waits for."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, out, acted = self.read(now := self.now(timerValues)), [], False
        for run, seq, etype, terminal, pausing, node in zip(*_columns(_ordered(rows), "run_id", "seq", "etype", "is_terminal", "is_pausing", "node_id")):
            was = known.get(run := _run(run))
            if isinstance(was, int):
                continue
            if pausing:
                known[run], acted = (etype, _text(node)), True
                out.append((run, int(seq), True, etype, _text(node)))
            elif (terminal or etype == "REVIEW_COMPLETE" or etype in dims.STEP_EVENTS) and was is not None:
                acted = known.pop(run) is not None
                out.append((run, int(seq), False, *was))
            if terminal:
                known[run], acted = now, True
        if acted:
            self.write(known)
        if out:
            yield pd.DataFrame(out, columns=["run_id", "seq", "waiting", "waiting_for", "node_id"])


class TimeoutsOfRuns(_Bucket):
    """``Timeouts`` for a bucket of runs: of a run it keeps its first event's time and when something is due (null: no more).

    A run that has ended is due when its flag goes; the bucket's timer stands at the earliest that is due.
    """

    def __init__(self, limit_s: int, keep: int = KEEP_ENDED):
        super().__init__(None)
        self.limit_ms, self.stay = limit_s * 1000, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.timer = handle.getValueState("timer", "at long")

    def _set(self, known: dict, at: int | None) -> None:
        """Write the runs and move the timer, which stands at ``at``."""
        self.write(known)
        due = min((d for _, d, _ in known.values() if d is not None), default=None)
        if due == at:
            return
        if at is not None:
            self.handle.deleteTimer(at)
        if due is None:
            self.timer.clear()
        else:
            self.timer.update((due,))
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, acted = self.read(0), False
        batch = pd.concat([b[["run_id", "ts", "is_terminal"]] for b in rows])
        per = batch.assign(run_id=[_run(r) for r in batch["run_id"]]).groupby("run_id", dropna=False, sort=False).agg(ts=("ts", "min"), ended=("is_terminal", "any"))
        for run, first, ends in zip(per.index.tolist(), _since_epoch(per["ts"], 1_000_000).tolist(), per["ended"].tolist()):
            first, _, ended = known.get(run := _run(run), (first, None, False))
            if ended or not ends and run in known:
                continue
            known[run], acted = (first, first + self.limit_ms + (self.stay if ends else 0), ends), True
        if acted:
            at = self.timer.get()
            self._set(known, None if at is None else at[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, passed, out = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), []
        known = self.read(0)
        for run, (first, due, ended) in list(known.items()):
            if due is None or not (due <= at or due < passed):
                continue
            if ended:
                del known[run]
            else:
                known[run] = (first, None, False)
                out.append((run, first, first + self.limit_ms))
        self._set(known, None)  # the timer that rings is gone
        if out:
            yield pd.DataFrame(out, columns=["run_id", "started_ms", "deadline_ms"])


def _processed(events: DataFrame, processor: StatefulProcessor, schema: str, buckets: int | None, time_mode: str = "None", start: DataFrame | None = None, only: Column | None = None) -> DataFrame:
    """``only``: the events that the processor acts on; the others never reach it."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    ev = runs.typed_events(events).select("run_id", "seq", "ts", "etype", "is_terminal", "is_pausing", *runs.TEXT_FIELDS, "duration_ms")
    if only is not None:
        ev = ev.where(only)

    def keyed(df: DataFrame) -> GroupedData:
        return df.groupBy("run_id") if buckets is None else df.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets))).groupBy("bucket")

    return keyed(ev).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time_mode,
                                               initialState=None if start is None else keyed(start))


def _mode(keep: int | None) -> str:
    return "None" if keep is None else "ProcessingTime"


def node_state(events: DataFrame) -> DataFrame:
    """The state that T2 holds after a batch of events: ``run_id, node_id, started_us, step_type, ended``.

    A run that has ended is one row with ``ended``; of others each node has the
    time and type of its last start, or the type of its first event.
    """
    ev = runs.typed_events(events).select("run_id", "seq", "ts", "etype", "is_terminal", "node_id", "step_type")
    ended = ev.groupBy("run_id").agg(F.max("is_terminal").alias("ended")).where("ended").select("run_id")
    steps = ev.where(F.col("etype").isin(*runs.STEP_STATUS) & (F.coalesce("node_id", F.lit("")) != "")).join(ended, "run_id", "left_anti")
    began = F.when(F.col("etype") == "STEP_STARTED", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.coalesce("step_type", F.lit("")).alias("kind")))
    rows = steps.groupBy("run_id", "node_id").agg(F.max_by(began, F.when(began.isNotNull(), F.col("seq"))).alias("b"), F.min_by(F.coalesce("step_type", F.lit("")), "seq").alias("kind"))
    rows = rows.select("run_id", "node_id", F.col("b.us").alias("started_us"), F.coalesce("b.kind", "kind").alias("step_type"), F.lit(False).alias("ended"))
    return rows.unionByName(ended.select("run_id", F.lit("").alias("node_id"), F.lit(None).cast("long").alias("started_us"), F.lit("").alias("step_type"), F.lit(True).alias("ended")))


def stream_node_summary(events: DataFrame, start: DataFrame | None = None, keep: int | None = None, buckets: int | None = BUCKETS) -> DataFrame:
    """Changes of A12 entries up to each run's terminal event; the last per (run, node) is its entry.

    ``start``: a state from ``node_state``, where the stream goes on from a batch. ``keep``, ``buckets``: see above.
    """
    acts = (F.col("etype").isin(*runs.STEP_STATUS) & (F.coalesce("node_id", F.lit("")) != "")) | F.col("is_terminal")
    return _processed(events, NodeSummary(keep) if buckets is None else NodeSummaries(keep), SUMMARY_SCHEMA, buckets, _mode(keep), start, acts)


def stream_waiting_queue(events: DataFrame, keep: int | None = None, buckets: int | None = BUCKETS) -> DataFrame:
    """When runs begin and cease to wait for input or review."""
    acts = F.col("is_pausing") | F.col("is_terminal") | F.col("etype").isin("REVIEW_COMPLETE", *dims.STEP_EVENTS)
    return _processed(events, WaitingQueue(keep) if buckets is None else WaitingQueues(keep), QUEUE_SCHEMA, buckets, _mode(keep), only=acts)


def stream_timeouts(events: DataFrame, limit_s: int = dims.RUN_TIMEOUT_S, delay: str = "0 seconds", buckets: int | None = BUCKETS) -> DataFrame:
    """T4: runs without a terminal event when the watermark passes their first event by ``limit_s``."""
    return _processed(events.withWatermark("ts", delay), Timeouts(limit_s) if buckets is None else TimeoutsOfRuns(limit_s), TIMEOUT_SCHEMA, buckets, "EventTime")


def latest_entries(changes: DataFrame) -> DataFrame:
    """The standing T2 entry of each (run, node)."""
    cols = ["display_name", "step_type", "status", "duration_ms"]
    return changes.groupBy("run_id", "node_id").agg(F.max_by(F.struct(*cols), "seq").alias("l")).select("run_id", "node_id", *[f"l.{c}" for c in cols])
