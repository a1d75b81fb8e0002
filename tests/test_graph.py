"""G1/G2 on hand-made graphs (cycle with tail, chain, self-loop, dangling edge)."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph


def _g(spark):
    wf = spark.createDataFrame([(1, "a", "c"), (2, "a", "c"), (3, "s", "s"), (4, "x", "zz")],
                               "workflow_id long, entry string, exit string")
    nodes = spark.createDataFrame(
        [(1, s) for s in "abcd"] + [(2, s) for s in "abc"] + [(3, "s"), (3, "t")] + [(4, "x"), (4, "y")],
        "workflow_id long, slug string")
    edges = spark.createDataFrame(
        [(1, "a", "b", "STATIC"), (1, "b", "c", "STATIC"), (1, "c", "a", "STATIC"), (1, "d", "a", "STATIC"),
         (2, "a", "b", "STATIC"), (2, "b", "c", "STATIC"), (2, "c", "a", "RECURSIVE"),
         (3, "s", "s", "STATIC"),
         (4, "x", "ghost", "STATIC"), (4, "ghost", "y", "STATIC")],
        "workflow_id long, src string, dst string, type string")
    return wf, nodes, edges


def test_unreachable(spark):
    wf, n, e = _g(spark)
    got = sorted((r.workflow_id, r.slug) for r in graph.unreachable_nodes(wf, n, e).collect())
    assert got == [(1, "d"), (3, "t"), (4, "y")]


def test_cycles(spark):
    wf, n, e = _g(spark)
    got = sorted((r.workflow_id, r.n_core_nodes) for r in graph.cyclic_workflows(n, e).collect())
    assert got == [(1, 3), (3, 1)]


def test_integrity(spark):
    wf, n, e = _g(spark)
    got = sorted((r.workflow_id, r.kind, r.ref) for r in graph.edge_integrity(wf, n, e).collect())
    assert got == [(4, "edge_from", "ghost"), (4, "edge_to", "ghost"), (4, "exit", "zz")]


def _random(rng, n_graphs, size):
    nodes, edges, wf = [], [], []
    for w in range(n_graphs):
        n = rng.randint(1, size)
        nodes += [(w, f"n{i:02d}") for i in range(n)]
        wf.append((w, f"n{rng.randrange(n):02d}", "n00"))
        edges += [(w, f"n{rng.randrange(n):02d}", f"n{rng.randrange(n + 1):02d}", rng.choice(["STATIC", "STATIC", "RECURSIVE"])) for _ in range(rng.randint(0, int(n * rng.choice([0.7, 1.2, 3]))))]
    return wf, nodes, edges


def _brute(wf, nodes, edges):
    """Reach, core, components and the least-successor cycle of each graph, by plain loops."""
    unreached, core, members, witness = set(), {}, set(), {}
    for w, entry, _ in wf:
        mine = {s for x, s in nodes if x == w}
        succ = {s: {d for x, a, d, _ in edges if x == w and a == s} for s in mine}
        static = {s: {d for x, a, d, t in edges if x == w and a == s and t != "RECURSIVE" and d in mine} for s in mine}

        def closure(s, succ):
            seen, todo = set(), [s]
            while todo:
                for d in succ.get(todo.pop(), ()):
                    if d not in seen:
                        seen.add(d)
                        todo.append(d)
            return seen

        unreached |= {(w, s) for s in mine - closure(entry, succ) - {entry}}
        far = {s: closure(s, static) for s in mine}
        on = {s for s in mine if s in far[s]}
        members |= {(w, s, min(d for d in far[s] if s in far[d])) for s in on}
        inner = {s for s in mine if far[s] & on or s in on} & {d for s in on for d in far[s]}
        if inner:
            core[w] = len(inner)
            walk = [min(inner)]
            while walk.count(walk[-1]) < 2:
                walk.append(min(static[walk[-1]] & inner))
            ring = walk[walk.index(walk[-1]) : -1]
            i = ring.index(min(ring))
            witness[w] = " -> ".join([*ring[i:], *ring[:i], ring[i]])
    return unreached, core, members, witness


@pytest.mark.parametrize("growth", [4, 0.1])
def test_random_graphs_equal_brute_force(spark, monkeypatch, growth):
    monkeypatch.setattr(graph, "GROWTH", growth)
    wf, nodes, edges = _random(random.Random(6), 60, 9)
    want = _brute(wf, nodes, edges)
    w = spark.createDataFrame(wf, "workflow_id long, entry string, exit string")
    n = spark.createDataFrame(nodes, "workflow_id long, slug string")
    e = spark.createDataFrame(edges, "workflow_id long, src string, dst string, type string")
    assert {tuple(r) for r in graph.unreachable_nodes(w, n, e).collect()} == want[0]
    assert {r.workflow_id: r.n_core_nodes for r in graph.cyclic_workflows(n, e).collect()} == want[1]
    if growth < 1:
        return  # the rest does not depend on it
    assert {tuple(r) for r in graph.cycle_members(n, e).collect()} == want[2]
    assert {r.workflow_id: r.cycle_path for r in graph.cycle_witness(n, e).collect()} == want[3]


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    for name in ("cut_lineage", "cut_and_count"):
        real = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda df, real=real: (rounds.append(1), real(df))[1])
    size = 5000
    n = spark.range(size).select(F.lit(1).alias("workflow_id"), F.col("id").cast("string").alias("slug"))
    e = spark.range(size - 1).select(F.lit(1).alias("workflow_id"), F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"), F.lit("STATIC").alias("type"))
    w = spark.createDataFrame([(1, "1", "0")], "workflow_id int, entry string, exit string")
    assert [r.slug for r in graph.unreachable_nodes(w, n, e).collect()] == ["0"]
    assert len(rounds) <= 20
    rounds.clear()
    assert graph.cyclic_workflows(n, e).collect() == []
    assert len(rounds) <= 20
    back = e.union(spark.createDataFrame([(1, str(size - 1), "0", "STATIC")], e.schema))
    rounds.clear()
    assert len(graph.cycle_witness(n, back).first().cycle_path.split(" -> ")) == size + 1
    assert len(rounds) <= 45


def test_members_of_a_long_cycle(spark):
    size = 200
    n = spark.range(size).select(F.lit(1).alias("workflow_id"), F.col("id").cast("string").alias("slug"))
    e = spark.range(size).select(F.lit(1).alias("workflow_id"), F.col("id").cast("string").alias("src"), ((F.col("id") + 1) % size).cast("string").alias("dst"), F.lit("STATIC").alias("type"))
    assert graph.cycle_members(n, e).where("component = '0'").count() == size
