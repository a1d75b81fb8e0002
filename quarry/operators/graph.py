"""Graph checks over tables of many workflow graphs.

Every frontier / edge row is keyed by ``(workflow_id, node)``, never by
``workflow_id`` alone, so one huge workflow still spreads over all tasks.
The loops run on the driver but each round is a distributed join, and walks
double from round to round. Lineage is cut with a reliable ``checkpoint()`` into
the shared checkpoint folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from quarry.session import cut_and_count, cut_lineage

COMPACT_EVERY = 6
GROWTH = 4


def edge_integrity(workflows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(workflow_id, kind, ref)`` for missing nodes, entry, exit and edge endpoints."""
    slugs = nodes.select("workflow_id", F.col("slug").alias("ref")).distinct()
    no_nodes = (workflows.join(nodes.select("workflow_id").distinct(), "workflow_id", "left_anti")
                .select("workflow_id", F.lit("no_nodes").alias("kind"), F.lit(None).cast("string").alias("ref")))

    def missing(df, col, kind):
        return (df.select("workflow_id", F.col(col).alias("ref"))
                .join(slugs, ["workflow_id", "ref"], "left_anti")
                .select("workflow_id", F.lit(kind).alias("kind"), "ref"))

    return (no_nodes
            .unionByName(missing(workflows, "entry", "entry"))
            .unionByName(missing(workflows, "exit", "exit"))
            .unionByName(missing(edges, "src", "edge_from"))
            .unionByName(missing(edges, "dst", "edge_to")))


def _cut(df: DataFrame, **counts: Column) -> tuple[DataFrame, Row]:
    """A reliable checkpoint and some aggregates of it, in one job."""
    seen = Observation()
    cut = cut_lineage(df.observe(seen, *[c.alias(k) for k, c in counts.items()]))
    return cut, Row(**seen.get)


def reachable(workflows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(workflow_id, n)`` reached from each entry, in rounds that grow with the logarithm of the longest path.

    Only edges leaving a defined node are followed (targets that are not nodes
    are reached but lead nowhere), as in the single-graph walk. A table holds
    the nodes reached (rows without ``src``) and the walks of exactly ``2**i``
    steps; a round joins it with those walks, which doubles both. A chain keeps
    one walk per node. Where walks branch they may multiply: once there are more
    than ``GROWTH`` times as many as edges, they are kept as they are, and a
    frontier goes on in strides of ``2**i`` steps.
    """
    node_keys = nodes.select("workflow_id", F.col("slug").alias("src")).distinct()
    adj = edges.select("workflow_id", "src", "dst").join(node_keys, ["workflow_id", "src"], "left_semi").distinct()
    start = workflows.select("workflow_id", F.lit(None).cast("string").alias("src"), F.col("entry").alias("dst")).distinct()
    roots, walks = F.count_if(F.col("src").isNull()), F.count_if(F.col("src").isNotNull())
    known, now = _cut(adj.unionByName(start), roots=roots, walks=walks)
    most, before, walked = GROWTH * now.walks, -1, known
    while now.roots != before and now.walks <= most:
        on = known.where("src is not null").select("workflow_id", F.col("src").alias("dst"), F.col("dst").alias("far"))
        step = known.join(on, ["workflow_id", "dst"]).select("workflow_id", "src", F.col("far").alias("dst"))
        before = now.roots
        walked = known
        known, now = _cut(known.where("src is null").unionByName(step).distinct(), roots=roots, walks=walks)
    visited = known.where("src is null").select("workflow_id", F.col("dst").alias("n"))
    if now.roots != before:
        visited = _strides(visited, walked.where("src is not null"))
    return visited


def _strides(visited: DataFrame, walks: DataFrame) -> DataFrame:
    """All that ``visited`` reaches by one walk after another, a job per stride."""
    walks = cut_lineage(walks.repartition("workflow_id", "src"))
    frontier, found = cut_and_count(visited)
    visited, parts = frontier, 1
    while found:
        step = (frontier.withColumnRenamed("n", "src").join(walks, ["workflow_id", "src"])
                .select("workflow_id", F.col("dst").alias("n")).distinct()
                .join(visited, ["workflow_id", "n"], "left_anti"))
        frontier, found = cut_and_count(step)
        visited, parts = visited.unionByName(frontier), parts + 1
        if parts == COMPACT_EVERY and found:
            visited, parts = cut_lineage(visited.repartition("workflow_id", "n")), 1
    return visited


def unreachable_nodes(workflows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G1: nodes not reachable from the workflow's entry over all edge types."""
    seen = reachable(workflows, nodes, edges)
    return (nodes.select("workflow_id", "slug")
            .join(seen.withColumnRenamed("n", "slug"), ["workflow_id", "slug"], "left_anti"))


def _static_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    keys = nodes.select("workflow_id", F.col("slug").alias("n")).distinct()
    return (edges.where(F.col("type") != "RECURSIVE").select("workflow_id", "src", "dst")
            .join(keys.withColumnRenamed("n", "src"), ["workflow_id", "src"], "left_semi")
            .join(keys.withColumnRenamed("n", "dst"), ["workflow_id", "dst"], "left_semi")
            .distinct())


def _composed(first: DataFrame, then: DataFrame) -> DataFrame:
    """Walks of ``first`` followed by walks of ``then``."""
    on = then.select("workflow_id", F.col("src").alias("dst"), F.col("dst").alias("far"))
    return first.join(on, ["workflow_id", "dst"]).select("workflow_id", "src", F.col("far").alias("dst")).distinct()


def _endless(walks: DataFrame, end: str, other: str) -> DataFrame:
    """Nodes at ``end`` of walks that can be followed for ever: one stride less per round until nothing changes."""
    left, n = cut_and_count(walks.select("workflow_id", F.col(end).alias("n")).distinct())
    while n:
        before = n
        left, n = cut_and_count(walks.join(left.withColumnRenamed("n", other), ["workflow_id", other], "left_semi").select("workflow_id", F.col(end).alias("n")).distinct())
        if n == before:
            break
    return left


def cyclic_walks(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The cyclic core and shortcuts in it, both ``(workflow_id, src, dst)``.

    RECURSIVE edges are ignored and self-loops count. The core is the edges
    between nodes that lie on or between cycles. Walks of exactly ``2**i`` steps
    double until they are longer than any workflow has nodes: a node that still
    begins one reaches a cycle, a node that ends one is reached from a cycle.
    Where there are no cycles, walks run out after the logarithm of the longest
    path. Where walks multiply (``GROWTH``), strides of the length reached so far
    settle the rest. The shortcuts are the walks of all lengths.
    """
    e, size = cut_and_count(_static_edges(nodes, edges))
    sizes = e.select("workflow_id", F.col("src").alias("n")).union(e.select("workflow_id", "dst")).distinct().groupBy("workflow_id").agg(F.count("*").alias("n"))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    walks, n, steps, every = e, size, 1, e
    while n and steps < longest and n <= GROWTH * size:
        longer, n = cut_and_count(_composed(walks, walks))
        if n <= GROWTH * size:
            walks, steps, every = longer, 2 * steps, every.unionByName(longer)
    if steps < longest and n:
        begin, finish = _endless(walks, "src", "dst"), _endless(walks, "dst", "src")
    else:
        begin, finish = (walks.select("workflow_id", F.col(c).alias("n")).distinct() for c in ("src", "dst"))
    core = cut_lineage(begin.join(finish, ["workflow_id", "n"], "left_semi"))

    def inside(df: DataFrame) -> DataFrame:
        return df.join(core.withColumnRenamed("n", "src"), ["workflow_id", "src"], "left_semi").join(core.withColumnRenamed("n", "dst"), ["workflow_id", "dst"], "left_semi")

    return inside(e), inside(every.distinct())


def cyclic_core(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges between nodes on or between cycles, ``(workflow_id, src, dst)``."""
    return cyclic_walks(nodes, edges)[0]


def cycle_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that lie on a cycle: ``(workflow_id, n, component)``, named by the component's least node.

    Forward-backward colouring of the cyclic core: every node takes the least
    node that reaches it as its colour, and the nodes of a colour that reach
    that node back are its component. Components leave, the rest is coloured
    anew. Colours travel over the shortcuts, so a round is a long way.
    """
    core, shortcuts = cyclic_walks(nodes, edges)
    loops = core.where("src = dst").select("workflow_id", F.col("src").alias("n")).distinct()
    ways = cut_lineage(shortcuts.where("src <> dst"))
    left, n = cut_and_count(core.select("workflow_id", F.col("src").alias("n")).union(core.select("workflow_id", "dst")).distinct())
    parts = []
    while n:
        colour, changed = left.withColumn("c", F.col("n")), 1
        while changed:
            sent = ways.join(colour.select("workflow_id", F.col("n").alias("src"), F.col("c").alias("sent")), ["workflow_id", "src"]).groupBy("workflow_id", F.col("dst").alias("n")).agg(F.min("sent").alias("sent"))
            moved = colour.join(sent, ["workflow_id", "n"], "left").select("workflow_id", "n", F.least("c", "sent").alias("c"), (F.col("sent") < F.col("c")).alias("new"))
            moved, seen = _cut(moved, changed=F.count_if("new"))
            colour, changed = moved.drop("new"), seen.changed
        back = ways.join(colour.select("workflow_id", F.col("n").alias("src"), F.col("c").alias("cs")), ["workflow_id", "src"]).join(
            colour.select("workflow_id", F.col("n").alias("dst"), F.col("c").alias("cd")), ["workflow_id", "dst"]).where("cs = cd")
        roots = colour.select("workflow_id", F.col("c").alias("n")).distinct()  # a component's least node has its own name as colour
        found = _strides(roots, back.select("workflow_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
        part = cut_lineage(colour.join(found, ["workflow_id", "n"], "left_semi").withColumnRenamed("c", "component"))
        parts.append(part)
        left, n = cut_and_count(left.join(part, ["workflow_id", "n"], "left_anti"))
        ways = cut_lineage(ways.join(left.withColumnRenamed("n", "src"), ["workflow_id", "src"], "left_semi").join(left.withColumnRenamed("n", "dst"), ["workflow_id", "dst"], "left_semi"))
    if not parts:
        return core.select("workflow_id", F.col("src").alias("n"), F.col("src").alias("component")).limit(0)
    every = cut_lineage(reduce(DataFrame.union, parts))
    large = every.groupBy("workflow_id", "component").agg(F.count("*").alias("k")).where("k > 1").drop("k")
    return every.join(large, ["workflow_id", "component"], "left_semi").select("workflow_id", "n", "component").union(
        every.join(loops, ["workflow_id", "n"], "left_semi").select("workflow_id", "n", "component")).distinct()


def cycle_witness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One cycle per cyclic workflow: ``(workflow_id, cycle_path)``, from its least node back to it.

    Every node of the core points to its least successor there; the walk from
    the workflow's least core node ends in a cycle. Doubled pointers find a node
    on it and then its nodes with their places, in logarithmic rounds.
    """
    core = cut_lineage(cyclic_core(nodes, edges))
    jump, n = cut_and_count(core.groupBy("workflow_id", "src").agg(F.min("dst").alias("dst")))
    longest = jump.groupBy("workflow_id").count().agg(F.max("count")).first()[0] or 0
    jumps = [jump]
    while 1 << (len(jumps) - 1) < longest:
        jumps.append(cut_lineage(_composed(jumps[-1], jumps[-1])))
    first = jump.groupBy("workflow_id").agg(F.min("src").alias("src"))
    on = first.join(jumps[-1], ["workflow_id", "src"]).select("workflow_id", F.col("dst").alias("n"), F.lit(0).cast("long").alias("place"))
    for k, jump in enumerate(jumps):
        ahead = on.withColumnRenamed("n", "src").join(jump, ["workflow_id", "src"]).select("workflow_id", F.col("dst").alias("n"), (F.col("place") + (1 << k)).alias("place"))
        on = cut_lineage(on.union(ahead).groupBy("workflow_id", "n").agg(F.min("place").alias("place")))
    # one row per workflow: the cycle is the answer
    ring = on.groupBy("workflow_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "n"))), lambda x: x["n"]).alias("ring"))
    at = F.array_position("ring", F.array_min("ring")).cast("int")
    turned = F.concat(F.slice("ring", at, F.size("ring")), F.slice("ring", F.lit(1), at - 1), F.array(F.array_min("ring")))
    return ring.select("workflow_id", F.array_join(turned, " -> ").alias("cycle_path"))


def cyclic_workflows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G2 verdict per workflow: ``(workflow_id, n_core_nodes)`` for workflows with a cycle."""
    core = cyclic_core(nodes, edges)
    members = (core.select("workflow_id", F.col("src").alias("n"))
               .unionByName(core.select("workflow_id", F.col("dst").alias("n"))).distinct())
    return members.groupBy("workflow_id").agg(F.count("*").alias("n_core_nodes"))
