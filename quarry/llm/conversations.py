"""Conversation structure repair: least edits, and of equal ones the least audit string.

A conversation's rows, by turn, are edited so that the initials of their roles
read ``(s?(ua)+)?``. Per row: Keep (cost 0), Rerole to user or assistant (2) or
Delete (3); anywhere: Insert an empty user or assistant row (2). Rows that are
blank or repeat an earlier row's role and text must be deleted; a truncated row
that stays adds 1. The audit is the edits' initials in order.

The edits are arcs of a graph with a node per (rows done, state); the states
are nothing yet, after ``s``, after ``u``, after ``a``.

* Cost DP: the least cost from every node to the end, backward over the rows.
* Optimal arcs are those that lie on a cheapest way. From one node no two of
  them have the same initial (initial and state name the target), so a string
  of initials has one end.
* Prefix doubling: nodes are ranked by the least string of 1, 2, 4, ... arcs
  that leaves them: the rank for twice the length is that of the pair (own
  rank, rank of the node where the own string ends), and the pointer to that
  end doubles with it. A node's way starts with the optimal arc that ranks
  least; binary steps over the doubled pointers read it off.

All copies of one row of one turn are one step: the first copy's edit, then the
deletion of the others, which comes before any insert since D < I.

Long conversations are split. Rows are sorted over the whole table (so a hot
conversation is many sorted ranges) and cut into segments of at most
``SEGMENT`` steps. A segment that is not a whole conversation gives a 4 x 4
table of least costs, min-plus products of the tables are doubled along the
segments' pointers (rounds: logarithm of the longest conversation's segments),
and the cheapest way's state is handed forward the same way. Only the SHA-256 of
a repaired conversation is sequential by definition: its rows stream through
one task, in sorted order and never as a whole.

Defined results: nulls in ``role`` and ``text`` are one space, null ``turn``
sorts first, a null ``conv_id`` is a conversation of its own. Rows of one turn
are ordered by role, then by the SHA-256 of the text. An empty role has no
initial: it must be reroled or deleted. Other columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage

SEGMENT = 1024
STEPS = 1 << 16  # steps whose graphs are ranked together

BLANKS = " \t\n\x0b\x0c\r"
INITIALS = {"s": 0, "u": 1, "a": 2}
LEGAL = {(0, 1), (1, 2), (2, 1)}
INF = 1 << 50
END = np.array([0, 4, 2, 0])  # least cost from each state after the last row
TURN = np.array([2, 2, 3, 2])  # state after a user or assistant row, whichever fits
KEEP = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])  # [state, initial]
ROLE = {2: "user", 3: "assistant"}
LETTERS = "DIKR"

KEY = ["cn", "c"]
ORDER = ["cn", "c", "tn", "t", "role", "sha"]


# ---- one batch of segments -------------------------------------------------


@dataclass
class Graph:
    """The graphs of several segments, their nodes in one array."""

    sizes: np.ndarray  # steps of each segment, longest first
    kind: np.ndarray  # per step: initial, + 4 if truncated, + 8 if it must go
    copies: np.ndarray
    exits: np.ndarray  # (segments, 4): least cost to the end from each state after the segment
    last: np.ndarray  # segments that end their conversation

    def __post_init__(self):
        self.rows = np.cumsum(self.sizes) - self.sizes
        self.nodes = 4 * (self.rows + np.arange(len(self.sizes)))

    def costs(self) -> np.ndarray:
        """The cost DP."""
        h = np.full(4 * int((self.sizes + 1).sum()), INF, np.int64)
        four = np.arange(4)
        h[(self.nodes + 4 * self.sizes)[:, None] + four] = np.minimum(self.exits, INF)
        for t in range(int(self.sizes.max(initial=0)) - 1, -1, -1):
            n = int(np.searchsorted(-self.sizes, -t, side="left"))  # segments longer than t
            row, node = self.rows[:n] + t, self.nodes[:n] + 4 * t
            after = h[node[:, None] + 4 + four]
            kind, copies = self.kind[row], self.copies[row][:, None]
            best = after + 3 * copies
            stay = (3 * (copies - 1) + (kind & 4)[:, None] // 4)
            keep = KEEP[:, kind & 3].T
            kept = np.where(keep >= 0, np.take_along_axis(after, np.maximum(keep, 0), 1) + stay, INF)
            free = (kind < 8)[:, None]
            best = np.where(free, np.minimum(best, np.minimum(kept, after[:, TURN] + 2 + stay)), best)
            best[:, 2:] = np.minimum(best[:, 2:], best[:, :1:-1] + 2)
            best[:, :2] = np.minimum(best[:, :2], best[:, 2:3] + 2)
            h[node[:, None] + four] = np.minimum(best, INF)
        return h

    def arcs(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per node the least initial of its optimal arcs (0 to 3 in the order of ``LETTERS``, -1 for none) and the arc's target."""
        v = np.arange(len(h))
        state = v & 3
        segment = np.repeat(np.arange(len(self.sizes)), 4 * (self.sizes + 1))
        step = (v - self.nodes[segment]) >> 2
        inside = step < self.sizes[segment]
        row = np.where(inside, self.rows[segment] + step, 0)
        kind, copies = (self.kind[row], self.copies[row]) if len(self.kind) else (np.zeros_like(v), np.ones_like(v))
        below = np.where(inside, v - state + 4, v)
        stay = 3 * (copies - 1) + (kind & 4) // 4
        free = inside & (kind < 8)
        turned, kept = TURN[state], KEEP[state, kind & 3]
        letter, target = np.full(len(h), -1), v.copy()
        live = h < INF // 2
        for number, ok, to, cost in (
            (3, free, below + turned, 2 + stay),
            (2, free & (kept >= 0), below + np.maximum(kept, 0), stay),
            (1, inside | self.last[segment], v - state + turned, np.full(len(h), 2)),
            (0, inside, below + state, 3 * copies),
        ):
            to = np.where(ok, to, v)
            best = ok & live & (h == h[to] + cost)
            letter[best], target[best] = number, to[best]
        return letter, target

    def solve(self, entries: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], np.ndarray]:
        """Costs to the end from each segment's entry node, the least way as (letter, step, state after), and the end state from each of the 4 entries."""
        h = self.costs()
        letter, target = self.arcs(h)
        rank, steps, pointers = letter + 1, (letter >= 0).astype(np.int64), [target]
        while (pointers[-1][pointers[-1]] != pointers[-1]).any():
            to = pointers[-1]
            _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[to], return_inverse=True)
            steps, to = steps + steps[to], to[to]
            pointers.append(to)
        start = self.nodes + entries
        length = steps[start]
        at = np.repeat(start, length)
        j = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
        for k, to in enumerate(pointers):
            at = np.where((j >> k) & 1, to[at], at)
        segment = np.repeat(np.arange(len(start)), length)
        ways = np.stack([letter[at], (at - self.nodes[segment]) >> 2, target[at] & 3], axis=1).tolist()
        ends = np.cumsum(length).tolist()
        ways = [ways[a:b] for a, b in zip([0, *ends], ends)]
        stops = pointers[-1][self.nodes[:, None] + np.arange(4)] & 3
        return h[start], ways, stops


def graphs(segments: list[dict]) -> Iterator[tuple[list[dict], Graph]]:
    """Segments, longest first, in groups of about ``STEPS`` steps."""
    segments = sorted(segments, key=lambda s: -len(s["kind"]))
    held, size = [], 0
    for i, s in enumerate(segments):
        held.append(s)
        size += len(s["kind"]) + 1
        if size >= STEPS or i + 1 == len(segments):
            yield held, Graph(np.array([len(x["kind"]) for x in held]), np.concatenate([np.asarray(x["kind"], np.int64) for x in held]), np.concatenate([np.asarray(x["copies"], np.int64) for x in held]),
                              np.array([x["exits"] for x in held], np.int64), np.array([x["last"] for x in held], bool))
            held, size = [], 0


def matrices(segments: list[dict]) -> dict[int, list[int]]:
    """Per segment 16 numbers: least cost from entry state i to exit state j."""
    found: dict[int, list[int]] = {}
    for j in range(4):
        exits = [0 if i == j else INF for i in range(4)]
        for held, graph in graphs([s | {"exits": exits, "last": False} for s in segments]):
            h = graph.costs()
            for s, at in zip(held, graph.nodes.tolist()):
                found.setdefault(s["seg"], [INF] * 16)[j::4] = h[at : at + 4].tolist()
    return found


# ---- tables ----------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` after faults chosen by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20."""
    def shown(c: str) -> F.Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), fault.alias("fault"))
    return rows.where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _keyed(rows: DataFrame) -> DataFrame:
    """The sort key in place of nullable columns, and the text."""
    text = F.coalesce("text", F.lit(" "))
    return rows.select(F.col("conv_id").isNull().alias("cn"), F.coalesce("conv_id", F.lit(0)).cast("long").alias("c"), F.col("turn").isNotNull().alias("tn"), F.coalesce("turn", F.lit(0)).cast("long").alias("t"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"), *(["copies"] if "copies" in rows.columns else [F.lit(1).cast("long").alias("copies")]))


_SEGMENT_SCHEMA = pa.schema([
    ("seg", pa.int64()), ("cn", pa.bool_()), ("c", pa.int64()), ("lone", pa.bool_()), ("tn", pa.list_(pa.bool_())), ("t", pa.list_(pa.int64())), ("role", pa.list_(pa.string())), ("sha", pa.list_(pa.binary())),
    ("copies", pa.list_(pa.int64())), ("kind", pa.list_(pa.int32())), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()),
    ("first", pa.int32()), ("final", pa.int32())])
_SEGMENT = ("seg long, cn boolean, c long, lone boolean, tn array<boolean>, t array<long>, role array<string>, sha array<binary>, copies array<long>, kind array<int>, "
            "blank long, duplicate long, truncated long, illegal long, turns long, first int, final int")


def _cut(limit: int):
    """Sorted rows of one range -> segments, numbered by range and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        done, touched = 0, True  # touched: the rows before may belong to the same conversation

        def closed(open_right: bool) -> dict:
            kinds, faults = [], [0, 0, 0]
            for row in held:
                *_, role, _, copies, blank, cut, repeated = row
                kinds.append(INITIALS.get(role[:1], 3) + 4 * cut + 8 * (blank or repeated))
                if blank:
                    faults[0] += copies
                else:
                    faults[1] += copies if repeated else copies - 1
                    faults[2] += cut and not repeated
            first = [k & 3 for k in kinds]
            turns = [r[3] for r in held if r[2]]
            return {"seg": base + done, "cn": held[0][0], "c": held[0][1], "lone": not touched and not open_right, "tn": [r[2] for r in held], "t": [r[3] for r in held], "role": [r[4] for r in held],
                    "sha": [r[5] for r in held], "copies": [r[6] for r in held], "kind": kinds, "blank": faults[0], "duplicate": faults[1], "truncated": faults[2],
                    "illegal": sum(r[6] - 1 for r in held) + sum(p not in LEGAL for p in zip(first, first[1:])), "turns": sum(a != b for a, b in zip(turns, turns[1:])) + bool(turns), "first": first[0], "final": first[-1]}

        for b in batches:
            out = []
            for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                if held and (same := row[:2] == held[0][:2], len(held) == limit) != (True, False):
                    out.append(closed(same))
                    done, touched, held = done + 1, same, []
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=_SEGMENT_SCHEMA)
        if held:
            yield pa.RecordBatch.from_pylist([closed(True)], schema=_SEGMENT_SCHEMA)

    return run


def segments(rows: DataFrame, limit: int = SEGMENT) -> DataFrame:
    """Sorted segments of all conversations, staged. No texts: a row is its hash and its faults."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = _keyed(rows).withColumn("blank", bare == "").withColumn("cut", ~F.substring(bare, -1, 1).isin(".", "!", "?"))
    lines = light.groupBy(*ORDER).agg(F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    again = lines.groupBy(*KEY, "role", "sha").agg(F.min(F.struct("tn", "t")).alias("before"), F.count("*").alias("n")).where("n > 1").drop("n")
    lines = lines.join(again, [*KEY, "role", "sha"], "left").withColumn("repeated", F.coalesce(F.struct("tn", "t") > F.col("before"), F.lit(False)))
    lines = lines.select(*ORDER, "copies", "blank", "cut", "repeated").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return stage(lines.mapInArrow(_cut(limit), _SEGMENT), "segments")


def _product(a: str, b: str) -> str:
    """SQL: min-plus product of two 4 x 4 tables of 16 numbers."""
    return f"transform(sequence(0, 15), x -> least({INF}L, array_min(transform(sequence(0, 3), k -> {a}[cast(floor(x / 4) as int) * 4 + k] + {b}[k * 4 + x % 4]))))"


def _doubled(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``seg, to, v``: v becomes the product along all pointers ``to``, in a logarithmic number of rounds. ``value`` joins v and w, the value at the pointer."""
    while True:
        rows = stage(rows, name)
        if rows.where("to is not null").isEmpty():
            return rows.select("seg", "v")
        ahead = rows.select(F.col("seg").alias("to"), F.col("to").alias("next"), F.col("v").alias("w"))
        rows = rows.join(ahead, "to", "left").select("seg", F.col("next").alias("to"), F.expr(f"if(w is null, v, {value})").alias("v"))


def _linked(cut: DataFrame) -> DataFrame:
    """For segments that may be a part of a conversation: entry state, costs after the segment, whether it is the last, and faults at the seam."""
    spark = cut.sparkSession
    ranges = cut.groupBy(F.shiftright("seg", 32).alias("range")).agg(F.min("seg").alias("low"), F.max("seg").alias("high")).orderBy("range").collect()  # a row per range
    seams = spark.createDataFrame([(a["high"], b["low"]) for a, b in zip(ranges, ranges[1:])], "seg long, over long")
    parts = cut.where("not lone").select("seg", *KEY, "kind", "copies", "first", "final", F.element_at("t", 1).alias("t1"), F.element_at("tn", 1).alias("tn1"), F.element_at("t", -1).alias("t2"), F.element_at("tn", -1).alias("tn2"))
    parts = parts.join(F.broadcast(seams), "seg", "left").withColumn("ahead", F.coalesce("over", F.col("seg") + 1))
    nexts = parts.select(F.col("seg").alias("ahead"), *KEY, F.col("first").alias("first_n"), F.col("t1").alias("t_n"), F.col("tn1").alias("tn_n"), F.lit(True).alias("more"))
    parts = parts.join(nexts, ["ahead", *KEY], "left").withColumn("to", F.expr("if(more, ahead, null)"))
    legal = " or ".join(f"(final = {a} and first_n = {b})" for a, b in sorted(LEGAL))
    parts = stage(parts.select("seg", "to", "kind", "copies", F.expr(f"if(more and not ({legal}), 1L, 0L)").alias("seam"), F.expr("if(more and tn2 and tn_n and t2 = t_n, 1L, 0L)").alias("shared")), "parts")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = matrices(b.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["seg", "v"])

    costs = parts.select("seg", "kind", "copies").mapInArrow(tables, "seg long, v array<long>")
    costs = _doubled(costs.join(parts.select("seg", "to"), "seg"), _product("v", "w"), "costs")
    end = ", ".join(f"v[i * 4 + {j}] + {c}L" for j, c in enumerate(END.tolist()))
    after = costs.select(F.col("seg").alias("to"), F.expr(f"transform(sequence(0, 3), i -> array_min(array({end})))").alias("exits"))
    parts = stage(parts.join(after, "to", "left").withColumn("last", F.col("to").isNull()).withColumn("exits", F.coalesce("exits", F.array(*[F.lit(c).cast("long") for c in END.tolist()]))), "exits")

    def stops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segs, ends = [], []
            for held, graph in graphs(b.to_pylist()):
                segs += [s["seg"] for s in held]
                ends += graph.solve(np.zeros(len(held), np.int64))[2].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], names=["seg", "ends"])

    ends = parts.select("seg", "kind", "copies", "exits", "last").mapInArrow(stops, "seg long, ends array<int>")
    back = parts.where("to is not null").select(F.col("to").alias("seg"), F.col("seg").alias("from")).join(ends.withColumnRenamed("seg", "from"), "from")
    back = parts.select("seg").join(back, "seg", "left").select("seg", F.col("from").alias("to"), F.coalesce("ends", F.array(*[F.lit(i) for i in range(4)])).alias("v"))
    entry = _doubled(back, "transform(w, s -> v[s])", "entries").select("seg", F.expr("v[0]").alias("entry"))
    return parts.select("seg", "exits", "last", "seam", "shared").join(entry, "seg")


_EDITS = "array<struct<tail:boolean,tn:boolean,t:long,role:string,sha:binary,before:string,letter:string,as_role:string>>"
_EDIT = pa.list_(pa.struct([("tail", pa.bool_()), ("tn", pa.bool_()), ("t", pa.int64()), ("role", pa.string()), ("sha", pa.binary()), ("before", pa.string()), ("letter", pa.string()), ("as_role", pa.string())]))


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        segs, costs, audits, edits = [], [], [], []
        for held, graph in graphs(b.to_pylist()):
            entries = np.array([s["entry"] for s in held])
            cost, ways, stops = graph.solve(entries)
            for s, total, way, stop in zip(held, cost.tolist(), ways, stops.tolist()):
                audit, mine, before = [], [], ""
                for code, step, state in way:
                    letter = LETTERS[code]
                    if letter == "I":
                        audit.append("I")
                        before += ROLE[state][0]
                        continue
                    audit.append(letter + "D" * (s["copies"][step] - 1))
                    mine.append({"tail": False, "tn": s["tn"][step], "t": s["t"][step], "role": s["role"][step], "sha": s["sha"][step], "before": before, "letter": letter, "as_role": ROLE[state] if letter == "R" else None})
                    before = ""
                if before:
                    # inserts before the next segment's first row, or after all rows
                    mine.append({"tail": True, "tn": True, "t": s["seg"], "role": "", "sha": b"", "before": before, "letter": "I", "as_role": None})
                segs.append(s["seg"])
                costs.append(total - (0 if s["last"] else s["exits"][stop[s["entry"]]]))
                audits.append("".join(audit))
                edits.append(mine)
        yield pa.RecordBatch.from_arrays([pa.array(segs, pa.int64()), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(edits, _EDIT)], names=["seg", "cost", "audit", "edits"])


class Repair:
    """The repair of all conversations of ``rows``: ``conv_id, turn, role, text`` and, if there, ``copies``."""

    def __init__(self, rows: DataFrame, limit: int = SEGMENT):
        self.rows = rows
        cut = segments(rows, limit)
        alone = cut.where("lone").select("*", F.array(*[F.lit(c).cast("long") for c in END.tolist()]).alias("exits"), F.lit(True).alias("last"), F.lit(0).cast("long").alias("seam"), F.lit(0).cast("long").alias("shared"), F.lit(0).alias("entry"))
        parts = cut.where("not lone").join(_linked(cut), "seg").select(*alone.columns)
        every = alone.unionByName(parts)
        solved = every.mapInArrow(_with_head, f"cn boolean, c long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, seg long, cost long, audit string, edits {_EDITS}")
        self.solved = stage(solved, "solved")

    def report(self) -> DataFrame:
        """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``."""
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        parts = F.array_sort(F.collect_list(F.struct("seg", "audit")))
        one = self.solved.groupBy(*KEY).agg(*sums, F.sum("turns").alias("turns"), F.min("low").alias("low"), F.max("high").alias("high"), F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
        gaps = F.expr("coalesce(try_cast(cast(high as decimal(38,0)) - low + 1 - turns as bigint), if(low is null, 0L, null))")
        return one.select(F.expr("if(cn, null, c)").alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def turns(self) -> DataFrame:
        """The repaired rows: ``conv_id, position, role, text, inserted``; a conversation's rows are in one partition, in order."""
        edits = self.solved.select(*KEY, F.inline("edits")).select(*KEY, "tail", "tn", "t", "role", "sha", F.lit(0).alias("tag"), "before", "letter", "as_role", F.lit(None).cast("string").alias("text"))
        none = F.lit(None).cast("string")
        texts = _keyed(self.rows).select(*KEY, F.lit(False).alias("tail"), "tn", "t", "role", "sha", F.lit(1).alias("tag"), none.alias("before"), none.alias("letter"), none.alias("as_role"), "text")
        both = edits.unionByName(texts).repartition(*KEY).sortWithinPartitions(*KEY, "tail", "tn", "t", "role", "sha", "tag")
        return both.mapInArrow(_merged, "conv_id long, position long, role string, text string, inserted boolean")

    def digests(self) -> DataFrame:
        """``conv_id, repaired_sha256`` of conversations that have repaired rows."""
        return self.turns().mapInArrow(_digested, "conv_id long, repaired_sha256 string")


def _with_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_solved`` with the segment's key and counts beside it."""
    for b in batches:
        heads = {s["seg"]: s for s in b.to_pylist()}
        for done in _solved(iter([b])):
            rows = []
            for row in done.to_pylist():
                s = heads[row["seg"]]
                seen = [t for t, some in zip(s["t"], s["tn"]) if some]
                rows.append({"cn": s["cn"], "c": s["c"], "blank": s["blank"], "duplicate": s["duplicate"], "truncated": s["truncated"], "illegal": s["illegal"] + s["seam"], "turns": s["turns"] - s["shared"],
                             "low": seen[0] if seen else None, "high": seen[-1] if seen else None, **row})
            head = pa.schema([("cn", pa.bool_()), *((c, pa.int64()) for c in ("c", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high"))])
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*head, *done.schema]))


_TURN = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("inserted", pa.bool_())])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and texts in sorted order -> repaired rows: an edit comes right before the text that it is for."""
    now, place, wanted = None, 0, None
    for b in batches:
        out = []
        for cn, c, _, tn, t, role, sha, tag, before, letter, as_role, text in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            if (cn, c) != now:
                now, place, wanted = (cn, c), 0, None
            if tag == 0:
                for initial in before:
                    out.append((None if cn else c, place, "user" if initial == "u" else "assistant", "", True))
                    place += 1
                wanted = (tn, t, role, sha, as_role or role) if letter in "KR" else None
            elif wanted and wanted[:4] == (tn, t, role, sha):
                out.append((None if cn else c, place, wanted[4], text, False))
                place, wanted = place + 1, None
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [()] * 5, _TURN)], schema=_TURN)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    started, now, digest = False, None, None
    for b in batches:
        out = []
        for conv, _, role, text, _ in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
            if not started or conv != now:
                if started:
                    out.append({"conv_id": now, "repaired_sha256": digest.hexdigest()})
                started, now, digest = True, conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_pylist(out, schema=schema)
    if started:
        yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": digest.hexdigest()}], schema=schema)


def repair_report(conversations: DataFrame, rows: DataFrame, limit: int = SEGMENT) -> DataFrame:
    """Report and digest of ``rows`` for every ``conv_id`` of ``conversations``; one without rows has zeros and the digest of nothing."""
    done = Repair(rows, limit)
    ids = conversations.select("conv_id").distinct()
    told, digests = done.report(), done.digests()
    joined = ids.join(told.withColumnRenamed("conv_id", "__i"), F.col("conv_id").eqNullSafe(F.col("__i")), "left").drop("__i")
    joined = joined.join(digests.withColumnRenamed("conv_id", "__i"), F.col("conv_id").eqNullSafe(F.col("__i")), "left").drop("__i")
    # a conversation with rows has an audit; only its gaps may be out of a bigint's range
    zeros = [F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
