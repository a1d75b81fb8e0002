"""Registered resolution / sync queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as tf
from quarry.operators import resolve as rs
from quarry.operators import suggest as sg
from quarry.plans.catalog import query
from quarry.session import spread, tasks_for
from quarry.sources import fixtures as fx
from quarry.sources.tables import table

U = ("concat_ws('-', substr(md5(concat_ws('|', {a})), 1, 8), substr(md5(concat_ws('|', {a})), 9, 4), "
     "substr(md5(concat_ws('|', {a})), 13, 4), substr(md5(concat_ws('|', {a})), 17, 4), substr(md5(concat_ws('|', {a})), 21, 12))")


def usql(*parts: str) -> str:
    return U.format(a=", ".join(f"cast({p} AS VARCHAR)" for p in parts))


UUID_RE = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _catalog(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("name"),
                    rs.uuid_of(F.lit("cat"), F.col("s_suppkey")).alias("id"))


def _resolved(spark, sf):
    refs = fx.v_refs(spark, sf).select(F.col("ref").alias("key"), F.substring("ref", 7, 1 << 20).alias("name"))
    s = table(spark, sf, "supplier")
    cache = s.where(F.col("s_suppkey") % 3 == 0).select(
        F.concat(F.lit("agent:"), F.upper("s_name")).alias("key"), rs.uuid_of(F.lit("cache"), F.col("s_suppkey")).alias("id"))
    return rs.resolve_names(refs, cache, _catalog(spark, sf), "first")


J2_SQL = f"""WITH r AS (SELECT DISTINCT ref AS key, substr(ref, 7) AS name FROM v_refs),
cache AS (SELECT concat('agent:', upper(s_name)) AS key, {usql("'cache'", 's_suppkey')} AS id FROM supplier WHERE s_suppkey % 3 = 0),
cat AS (SELECT lower(s_name) AS lname, arg_min({usql("'cat'", 's_suppkey')}, s_suppkey) AS cat_id FROM supplier GROUP BY 1),
res AS (SELECT r.key, r.name, coalesce(CASE WHEN regexp_matches(r.name, '{UUID_RE}') THEN r.name END, cache.id, cat.cat_id) AS id,
  CASE WHEN regexp_matches(r.name, '{UUID_RE}') THEN 'uuid' WHEN cache.id IS NOT NULL THEN 'cache'
       WHEN cat.cat_id IS NOT NULL THEN 'catalog' END AS resolved_by
  FROM r LEFT JOIN cache ON cache.key = r.key LEFT JOIN cat ON cat.lname = lower(r.name))"""


@query("resolve_names", J2_SQL + " SELECT key, name, id, resolved_by FROM res")
def resolve_names(spark, sf):
    return _resolved(spark, sf)


@query("unresolved_names", J2_SQL + """ SELECT key, name, (SELECT count(*) FROM supplier) AS n_available, 'agent' AS catalog,
  concat('Cannot resolve agent ', chr(39), name, chr(39), '. Available agents:') AS message FROM res WHERE id IS NULL""")
def unresolved_names(spark, sf):
    return rs.unresolved_names(_resolved(spark, sf), _catalog(spark, sf))


@query("available_names", "SELECT 'agent' AS catalog, count(*) AS n_available, string_agg(s_name, ', ' ORDER BY s_suppkey) AS names FROM supplier")
def available_names(spark, sf):
    """The names that an unresolved reference could have meant."""
    return rs.available_names(_catalog(spark, sf), "agent")


@query("run_identifier", f"""WITH r AS (SELECT DISTINCT upper(p_name) AS key, upper(p_name) AS name FROM part),
cache AS (SELECT upper(p_name) AS key, arg_max({usql("'local'", 'p_partkey')}, p_partkey) AS id FROM part
  WHERE p_partkey % 4 = 0 GROUP BY 1),
cat AS (SELECT lower(p_name) AS lname, arg_max({usql("'wf'", 'p_partkey')}, p_partkey) AS cat_id FROM part GROUP BY 1)
SELECT r.key, r.name, coalesce(CASE WHEN regexp_matches(r.name, '{UUID_RE}') THEN r.name END, cache.id, cat.cat_id) AS id,
  CASE WHEN regexp_matches(r.name, '{UUID_RE}') THEN 'uuid' WHEN cache.id IS NOT NULL THEN 'cache'
       WHEN cat.cat_id IS NOT NULL THEN 'catalog' END AS resolved_by
FROM r LEFT JOIN cache ON cache.key = r.key LEFT JOIN cat ON cat.lname = lower(r.name)""")
def run_identifier(spark, sf):
    """Identifier -> workflow id; the catalog's LAST row wins on duplicate names."""
    p = table(spark, sf, "part")
    refs = p.select(F.upper("p_name").alias("key"), F.upper("p_name").alias("name"))
    cache = (p.where(F.col("p_partkey") % 4 == 0)
             .groupBy(F.upper("p_name").alias("key"))
             .agg(F.max_by(rs.uuid_of(F.lit("local"), F.col("p_partkey")), F.col("p_partkey")).alias("id")))
    cat = p.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("name"),
                   rs.uuid_of(F.lit("wf"), F.col("p_partkey")).alias("id"))
    return rs.resolve_names(refs, cache, cat, "last")


@query("reverse_resolve", f"""WITH l AS (SELECT l_orderkey AS owner, l_linenumber AS pos, {usql("'cat'", 'l_suppkey')} AS id FROM v_line),
c AS (SELECT {usql("'cat'", 's_suppkey')} AS id, s_name AS nm FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT owner, bool_and(c.nm IS NOT NULL) AS all_resolved,
  CASE WHEN bool_and(c.nm IS NOT NULL) THEN string_agg(c.nm, ',' ORDER BY pos) ELSE string_agg(l.id, ',' ORDER BY pos) END AS "values"
FROM l LEFT JOIN c ON c.id = l.id GROUP BY owner""")
def reverse_resolve(spark, sf):
    """Per workflow, its ordered supplier-id list becomes names only if every id resolves."""
    line = fx.v_line(spark, sf)
    lists = line.select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("pos"),
                        rs.uuid_of(F.lit("cat"), F.col("l_suppkey")).alias("id"))
    cat = _catalog(spark, sf).where(F.col("pos") % 7 != 0)
    return rs.reverse_resolve(lists, cat)


@query("reverse_resolve_one", f"""WITH c AS (SELECT {usql("'cat'", 's_suppkey')} AS id, s_name AS nm FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT concat(cast(l_orderkey AS VARCHAR), '-', cast(l_linenumber AS VARCHAR)) AS owner, coalesce(c.nm, {usql("'cat'", 'l_suppkey')}) AS value, c.nm IS NOT NULL AS resolved
FROM v_line LEFT JOIN c ON c.id = {usql("'cat'", 'l_suppkey')}""")
def reverse_resolve_one(spark, sf):
    """J4, scalar form: the supplier id of each line -> its name if known."""
    refs = fx.v_line(spark, sf).select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("owner"),
                                       rs.uuid_of(F.lit("cat"), F.col("l_suppkey")).alias("id"))
    return rs.reverse_resolve_one(refs, _catalog(spark, sf).where(F.col("pos") % 7 != 0))


@query("unresolved_ids", f"""SELECT {usql("'cat'", 'l_suppkey')} AS id FROM lineitem
EXCEPT SELECT {usql("'cat'", 's_suppkey')} FROM supplier WHERE s_suppkey % 7 <> 0""")
def unresolved_ids(spark, sf):
    """Referenced ids minus known ids (set difference)."""
    ref = table(spark, sf, "lineitem").select(rs.uuid_of(F.lit("cat"), F.col("l_suppkey")).alias("id"))
    known = _catalog(spark, sf).where(F.col("pos") % 7 != 0).select("id")
    return ref.subtract(known)


@query("find_by_name", f"""WITH n AS (SELECT {usql("'part'", 'p_partkey')} AS id, p_name AS name FROM part
  UNION ALL SELECT {usql("'copy'", 'p_partkey')}, p_name FROM part WHERE p_partkey % 50 = 0
  UNION ALL SELECT {usql("'long'", 'p_partkey')}, concat(repeat('x', 300), p_name, cast(p_partkey AS VARCHAR)) FROM part WHERE p_partkey % 97 = 0),
t AS (SELECT DISTINCT term FROM (SELECT split_part(p_name, ' ', 1) AS term FROM part UNION ALL SELECT upper(p_name) FROM part
  UNION ALL SELECT concat(p_name, cast(p_partkey AS VARCHAR)) FROM part UNION ALL SELECT substr(p_name, 1, cast(p_partkey % 3 AS INTEGER)) FROM part) x),
h AS (SELECT t.term, n.id, n.name, lower(n.name) = lower(t.term) AS ex FROM t JOIN n ON contains(lower(n.name), lower(t.term))),
g AS (SELECT term, count_if(ex) AS n_exact, count(*) AS n_matches, min(id) FILTER (WHERE ex) AS exact_id, arg_min(name, id) FILTER (WHERE ex) AS exact_name,
      min(id) AS any_id, arg_min(name, id) AS any_name FROM h GROUP BY term)
SELECT t.term, CASE WHEN n_exact = 1 OR n_matches = 1 THEN 'found' WHEN coalesce(n_matches, 0) = 0 THEN 'none' ELSE 'ambiguous' END AS verdict,
  CASE WHEN n_exact = 1 THEN exact_id WHEN n_matches = 1 THEN any_id END AS match_id,
  CASE WHEN n_exact = 1 THEN exact_name WHEN n_matches = 1 THEN any_name END AS match,
  cast(coalesce(n_matches, 0) AS BIGINT) AS n_matches
FROM t LEFT JOIN g USING (term)""")
def find_by_name(spark, sf):
    """J9 over a catalog of part names, some twice and some over 300 characters long.

    Terms are each name in capitals, its first word, its first 0 to 2 characters and names that only a long entry holds.
    """
    p = table(spark, sf, "part")
    k, name = F.col("p_partkey"), F.col("p_name")
    names = p.select(rs.uuid_of(F.lit("part"), k).alias("id"), name.alias("name"))
    names = names.unionByName(p.where(k % 50 == 0).select(rs.uuid_of(F.lit("copy"), k).alias("id"), name.alias("name")))
    names = names.unionByName(p.where(k % 97 == 0).select(
        rs.uuid_of(F.lit("long"), k).alias("id"), F.concat(F.repeat(F.lit("x"), F.lit(300)), name, k.cast("string")).alias("name")))
    terms = p.select(F.explode(F.array(F.split(name, " ").getItem(0), F.upper(name), F.concat(name, k.cast("string")),
                                       F.substring(name, F.lit(1), (k % 3).cast("int")))).alias("term"))
    return rs.find_by_name(terms, names)


def _catalog_names(spark, sf):
    """Part, supplier, customer and nation names, each part name also in capitals."""
    p, s, c, n = (table(spark, sf, t) for t in ("part", "supplier", "customer", "nation"))
    parts = p.groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    rows = [parts.select((F.col("k") * 10).alias("pos"), F.col("p_name").alias("name")), parts.select((F.col("k") * 10 + 1).alias("pos"), F.upper("p_name").alias("name")),
            s.select((F.col("s_suppkey") * 10 + 2).alias("pos"), F.col("s_name").alias("name")), c.select((F.col("c_custkey") * 10 + 3).alias("pos"), F.col("c_name").alias("name")),
            n.select((F.col("n_nationkey") * 10 + 4).alias("pos"), F.col("n_name").alias("name"))]
    return reduce(DataFrame.unionByName, [r.withColumn("pos", F.col("pos").cast("long")) for r in rows])


def _asked_names(spark, sf):
    """Misspelt names: part names without their second letter, reversed or with one word only; numbers and nations garbled; and nobody."""
    p, s, n = (table(spark, sf, t) for t in ("part", "supplier", "nation"))
    name = F.col("p_name")
    parts = p.select("p_name").distinct().select(F.explode(F.array(F.concat(F.substring(name, 1, 1), F.substring(name, 3, 99)), F.reverse(name), F.split(name, " ").getItem(0), F.concat(name, F.lit(" "), name))).alias("target"))
    numbers = s.select(F.explode(F.array(F.upper("s_name"), F.replace("s_name", F.lit("ppl"), F.lit("pl")), F.concat(F.lit("Customer"), F.substring("s_name", 9, 11)))).alias("target"))
    return reduce(DataFrame.unionByName, [parts, numbers, n.select(F.replace("n_name", F.lit("NATION_"), F.lit("nation ")).alias("target")), spark.createDataFrame([("nobody",), ("",), ("zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz",)], "target string")])


@query("suggest_names", """WITH p AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY 1),
cat AS (SELECT lower(name) AS name, arg_max(name, pos) AS shown FROM (SELECT k * 10 AS pos, p_name AS name FROM p UNION ALL SELECT k * 10 + 1, upper(p_name) FROM p
  UNION ALL SELECT s_suppkey * 10 + 2, s_name FROM supplier UNION ALL SELECT c_custkey * 10 + 3, c_name FROM customer UNION ALL SELECT n_nationkey * 10 + 4, n_name FROM nation) x GROUP BY 1),
t AS (SELECT DISTINCT target FROM (SELECT unnest([concat(substr(p_name, 1, 1), substr(p_name, 3)), reverse(p_name), split_part(p_name, ' ', 1), concat(p_name, ' ', p_name)]) AS target FROM p
  UNION ALL SELECT unnest([upper(s_name), replace(s_name, 'ppl', 'pl'), concat('Customer', substr(s_name, 9, 11))]) FROM supplier
  UNION ALL SELECT replace(n_name, 'NATION_', 'nation ') FROM nation UNION ALL SELECT unnest(['nobody', '', 'zzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzzz'])) y),
s AS (SELECT target, shown, cat.name, CASE WHEN greatest(length(target), length(cat.name)) = 0 THEN 1.0 ELSE 1 - levenshtein(lower(target), cat.name) / greatest(length(target), length(cat.name)) END AS score FROM t, cat),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, name DESC) AS rank FROM s WHERE score >= 0.4)
SELECT target, cast(rank AS INTEGER) AS rank, shown AS name, cast(score AS DOUBLE) AS score FROM r WHERE rank <= 3""")
def suggest_names(spark, sf):
    """J10 by edit distance over a catalog of all names of the tables."""
    return sg.suggest_names(_asked_names(spark, sf), _catalog_names(spark, sf), measure="edit")


@query("suggest_names_ratio")
def suggest_names_ratio(spark, sf):
    """J10 by matching blocks (no SQL for that measure; held against brute force in tests)."""
    return sg.suggest_names(_asked_names(spark, sf), _catalog_names(spark, sf), measure="ratio")


@query("catalog_listing", f"""WITH w AS (SELECT {usql("'wf'", 'n_nationkey')} AS id, n_nationkey, n_regionkey, n_name FROM nation),
m AS (SELECT w.id, concat(w.n_name, ' / ', r.r_name) AS name FROM w JOIN region r ON r.r_regionkey = w.n_regionkey WHERE w.n_regionkey <> 4)
SELECT w.id, coalesce(m.name, concat('Workflow ', substr(w.id, 1, 8))) AS name FROM w LEFT JOIN m ON m.id = w.id""")
def catalog_listing(spark, sf):
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    wf = n.select(rs.uuid_of(F.lit("wf"), F.col("n_nationkey")).alias("id"), "n_regionkey", "n_name")
    meta = (wf.where(F.col("n_regionkey") != 4).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("id", F.concat(F.col("n_name"), F.lit(" / "), F.col("r_name")).alias("name")))
    return rs.catalog_listing(wf.select("id"), meta)


@query("scan_catalog", f"""SELECT {usql("'cat'", 's_suppkey')} AS id, s_name AS name, s_nationkey AS organization_id FROM supplier""")
def scan_catalog(spark, sf):
    """Catalog rows, organization filter and offset/limit optional; all rows by default."""
    from quarry.sources.catalog import scan_catalog as sc
    s = table(spark, sf, "supplier").select(
        rs.uuid_of(F.lit("cat"), F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("organization_id"))
    return sc(s)


def _lines(spark, sf):
    """Order lines dealt by order, and the number of tasks that they are dealt to: the rows of the table (from its files' footers) set it."""
    tasks = tasks_for(spark, table(spark, sf, "lineitem").count())
    return fx.v_line(spark, sf, tasks), tasks


def _edges_pos(spark, sf, line=None, tasks=None):
    from pyspark.sql import Window
    e = spread(fx.v_edges(spark, sf, line), tasks, "workflow_id")
    w = Window.partitionBy("workflow_id").orderBy("src", "dst", "type")
    return e.withColumn("pos", F.row_number().over(w).cast("bigint"))


@query("pair_by_position", f"""SELECT e.workflow_id, e.pos, e.src, e.dst, {usql("'edge'", 'l.l_orderkey', 'l.l_linenumber')} AS edge_id
FROM (SELECT workflow_id, src, dst, row_number() OVER (PARTITION BY workflow_id ORDER BY src, dst, type) AS pos FROM v_edges) e
JOIN (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS pos FROM v_line) l
  ON l.l_orderkey = e.workflow_id AND l.pos = e.pos""")
def pair_by_position(spark, sf):
    from pyspark.sql import Window
    line, tasks = _lines(spark, sf)
    resp = (line
            .withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
                        .cast("bigint"))
            .select(F.col("l_orderkey").alias("workflow_id"), "pos",
                    rs.uuid_of(F.lit("edge"), F.col("l_orderkey"), F.col("l_linenumber")).alias("edge_id")))
    return rs.pair_by_position(_edges_pos(spark, sf, line, tasks).select("workflow_id", "pos", "src", "dst"), resp, tasks)


STORED_SQL = f"""SELECT l_orderkey AS workflow_id, concat('n', cast(l_linenumber AS VARCHAR)) AS key,
  {usql("'node'", 'l_orderkey', 'l_linenumber')} AS id FROM v_line WHERE l_partkey % 5 <> 0
UNION ALL SELECT DISTINCT l_orderkey, 'n0', {usql("'node'", 'l_orderkey', '0')} FROM v_line WHERE l_orderkey % 7 = 0"""


def _stored(line):
    a = line.where(F.col("l_partkey") % 5 != 0).select(
        F.col("l_orderkey").alias("workflow_id"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("key"),
        rs.uuid_of(F.lit("node"), F.col("l_orderkey"), F.col("l_linenumber")).alias("id"))
    b = line.where(F.col("l_orderkey") % 7 == 0).select(
        F.col("l_orderkey").alias("workflow_id"), F.lit("n0").alias("key"),
        rs.uuid_of(F.lit("node"), F.col("l_orderkey"), F.lit(0)).alias("id")).distinct()
    return a.unionByName(b)


DIFF_SQL = f"""WITH s AS ({STORED_SQL}), d AS (SELECT workflow_id, slug AS key FROM v_nodes),
m AS (SELECT DISTINCT workflow_id FROM s)
SELECT coalesce(d.workflow_id, s.workflow_id) AS workflow_id, coalesce(d.key, s.key) AS key, s.id,
  CASE WHEN d.key IS NOT NULL AND s.key IS NOT NULL THEN 'kept' WHEN d.key IS NOT NULL THEN 'added' ELSE 'removed' END AS change,
  CASE WHEN m.workflow_id IS NOT NULL THEN 'update' ELSE 'create' END AS mode
FROM d FULL OUTER JOIN s ON s.workflow_id = d.workflow_id AND s.key = d.key
LEFT JOIN m ON m.workflow_id = coalesce(d.workflow_id, s.workflow_id)"""


def _diff(spark, sf):
    line, tasks = _lines(spark, sf)
    d = fx.v_nodes(spark, sf, line).select("workflow_id", F.col("slug").alias("key"))
    return rs.snapshot_diff(d, _stored(line), tasks)


@query("snapshot_diff", DIFF_SQL)
def snapshot_diff(spark, sf):
    return _diff(spark, sf)


@query("snapshot_diff_edges", f"""WITH d AS (SELECT DISTINCT workflow_id, concat(src, '->', dst) AS key FROM v_edges),
s AS (SELECT workflow_id, key, {usql("'edge'", 'workflow_id', 'key')} AS id FROM d WHERE workflow_id % 3 <> 0
  UNION ALL SELECT DISTINCT l_orderkey, 'n0->n1', {usql("'edge'", 'l_orderkey', "'gone'")} FROM v_line WHERE l_orderkey % 7 = 0),
m AS (SELECT DISTINCT workflow_id FROM s)
SELECT coalesce(d.workflow_id, s.workflow_id) AS workflow_id, coalesce(d.key, s.key) AS key, s.id,
  CASE WHEN d.key IS NOT NULL AND s.key IS NOT NULL THEN 'kept' WHEN d.key IS NOT NULL THEN 'added' ELSE 'removed' END AS change,
  CASE WHEN m.workflow_id IS NOT NULL THEN 'update' ELSE 'create' END AS mode
FROM d FULL OUTER JOIN s ON s.workflow_id = d.workflow_id AND s.key = d.key LEFT JOIN m ON m.workflow_id = coalesce(d.workflow_id, s.workflow_id)""")
def snapshot_diff_edges(spark, sf):
    """J13 on edges: definition edges ``src->dst`` against the stored edge map."""
    line, tasks = _lines(spark, sf)
    d = spread(fx.v_edges(spark, sf, line).select("workflow_id", tf.edge_key(F.col("src"), F.col("dst")).alias("key")), tasks, "workflow_id", "key").distinct()
    stored = d.where("workflow_id % 3 <> 0").withColumn("id", rs.uuid_of(F.lit("edge"), F.col("workflow_id"), F.col("key")))
    gone = line.where("l_orderkey % 7 = 0").select(F.col("l_orderkey").alias("workflow_id"), F.lit("n0->n1").alias("key"),
                                                                  rs.uuid_of(F.lit("edge"), F.col("l_orderkey"), F.lit("gone")).alias("id")).distinct()
    return rs.snapshot_diff(d, stored.unionByName(gone), tasks)


@query("save_id_map", f"""SELECT workflow_id, 'node' AS kind, key,
  coalesce(id, {usql("'new'", 'workflow_id', 'key')}) AS id FROM ({DIFF_SQL}) x WHERE change <> 'removed'""")
def save_id_map(spark, sf):
    """K4: the whole-map replacement per workflow (kept ids, new ids for added keys)."""
    from quarry.sources.sinks import id_map_rows
    return id_map_rows(_diff(spark, sf))


FN_SQL = "CASE pos % 3 WHEN 0 THEN NULL WHEN 1 THEN type ELSE concat(type, '_2') END"
SLUG_SQL = ("trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower({c}), '_', '-'), ' ', '-'), "
            "'[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'))")


@query("unique_slugs", f"""WITH RECURSIVE b AS (SELECT workflow_id, pos,
  row_number() OVER (PARTITION BY workflow_id ORDER BY pos) AS i,
  CASE WHEN trim(coalesce(fn, '')) <> '' THEN lower(trim(fn)) ELSE {SLUG_SQL.format(c='type')} END AS base
  FROM (SELECT workflow_id, pos, type, {FN_SQL} AS fn FROM v_nodes) x),
r(workflow_id, i, pos, slug, seen) AS (
  SELECT workflow_id, i, pos, base, [base] FROM b WHERE i = 1
  UNION ALL
  SELECT b.workflow_id, b.i, b.pos, s.slug2, list_append(r.seen, s.slug2)
  FROM r JOIN b ON b.workflow_id = r.workflow_id AND b.i = r.i + 1,
  LATERAL (SELECT CASE WHEN NOT list_contains(r.seen, b.base) THEN b.base ELSE concat(b.base, '_',
    cast((SELECT min(k) FROM range(2, len(r.seen) + 3) t(k) WHERE NOT list_contains(r.seen, concat(b.base, '_', cast(k AS VARCHAR))))
    AS VARCHAR)) END AS slug2) s)
SELECT workflow_id, pos, slug FROM r""")
def unique_slugs(spark, sf):
    n = fx.v_nodes(spark, sf).withColumn("function_name", F.expr(FN_SQL))
    return rs.unique_slugs(n)


@query("slugify", f"""SELECT p_partkey, {SLUG_SQL.format(c='p_name')} AS name_slug, {SLUG_SQL.format(c='p_type')} AS type_slug FROM part""")
def slugify(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", tf.slugify(F.col("p_name")).alias("name_slug"), tf.slugify(F.col("p_type")).alias("type_slug"))


@query("edge_key", """SELECT workflow_id, concat_ws('->', src, dst) AS key, replace(src, '-', '_') AS function_name FROM v_edges""")
def edge_key(spark, sf):
    e = fx.v_edges(spark, sf)
    return e.select("workflow_id", tf.edge_key(F.col("src"), F.col("dst")).alias("key"),
                    tf.function_name(F.col("src")).alias("function_name"))


@query("is_uuid", f"""SELECT v, regexp_matches(v, '{UUID_RE}') AS is_uuid FROM (
  SELECT substr(ref, 7) AS v FROM v_refs
  UNION ALL SELECT CASE WHEN s_suppkey % 5 = 0 THEN substr({usql("'cat'", 's_suppkey')}, 1, 35)
    WHEN s_suppkey % 2 = 1 THEN upper({usql("'cat'", 's_suppkey')}) ELSE {usql("'cat'", 's_suppkey')} END FROM supplier) x""")
def is_uuid(spark, sf):
    refs = fx.v_refs(spark, sf).select(F.substring("ref", 7, 1 << 20).alias("v"))
    s = table(spark, sf, "supplier")
    u = rs.uuid_of(F.lit("cat"), F.col("s_suppkey"))
    ids = s.select(F.when(F.col("s_suppkey") % 5 == 0, F.substring(u, 1, 35))
                   .when(F.col("s_suppkey") % 2 == 1, F.upper(u)).otherwise(u).alias("v"))
    return refs.unionByName(ids).select("v", tf.is_uuid(F.col("v")).alias("is_uuid"))


# One row per reference, one join, then back to one row per text.
@query("rewrite_refs", f"""WITH s AS MATERIALIZED ({STORED_SQL}),
t AS MATERIALIZED (SELECT l_orderkey AS workflow_id, l_linenumber AS ln, l_partkey AS pk, concat('n', cast(l_linenumber - 1 AS VARCHAR)) AS a, concat('n', cast(l_suppkey % 9 AS VARCHAR)) AS b FROM v_line),
need AS MATERIALIZED (SELECT workflow_id, ln, 1 AS side, a AS key FROM t UNION ALL SELECT workflow_id, ln, 2, b FROM t),
met AS MATERIALIZED (SELECT n.workflow_id, n.ln, max(coalesce(s.id, n.key)) FILTER (WHERE side = 1) AS a, max(coalesce(s.id, n.key)) FILTER (WHERE side = 2) AS b
  FROM need n LEFT JOIN s ON s.workflow_id = n.workflow_id AND s.key = n.key GROUP BY n.workflow_id, n.ln)
SELECT t.workflow_id, concat('n', cast(t.ln AS VARCHAR)) AS node, CASE WHEN pk % 7 = 0 THEN 'Nothing to fill in' WHEN pk % 5 = 0 THEN concat('From {{{{', met.a, '}}}} on')
  ELSE concat('Use {{{{', met.a, '.output.text}}}} then {{{{', met.b, '.output.files}}}}') END AS rewritten
FROM t JOIN met ON met.workflow_id = t.workflow_id AND met.ln = t.ln""")
def rewrite_refs(spark, sf):
    """template slugs -> stored node ids (slugs with no stored id are left as is)."""
    t = fx.v_templates(spark, sf)
    m = _stored(fx.v_line(spark, sf)).select("workflow_id", F.col("key").alias("slug"), "id")
    return rs.rewrite_refs(t, m).select("workflow_id", "node", "rewritten")


@query("restore_refs", f"""WITH s AS ({STORED_SQL})
SELECT l.l_orderkey AS workflow_id, concat('n', cast(l.l_linenumber AS VARCHAR)) AS node,
  concat('Take {{{{', coalesce(s.key, {usql("'node'", 'l.l_orderkey', 'l.l_linenumber')}), '.output.text}}}} or {{{{',
    CASE WHEN l.l_linenumber > 1 THEN concat('n', cast(l.l_linenumber AS VARCHAR)) ELSE 'nodeN1' END, '.output.text}}}} or {{{{nodeN2}}}}') AS restored
FROM v_line l LEFT JOIN s ON s.workflow_id = l.l_orderkey AND s.key = concat('n', cast(l.l_linenumber AS VARCHAR))""")
def restore_refs(spark, sf):
    """F13 reversed: node ids and mixed-case function names in a text -> slugs (a name without a path stays)."""
    line, ln = fx.v_line(spark, sf), F.col("l_linenumber").cast("string")
    node = F.concat(F.lit("n"), ln)
    ident = rs.uuid_of(F.lit("node"), F.col("l_orderkey"), F.col("l_linenumber"))
    t = line.select(F.col("l_orderkey").alias("workflow_id"), node.alias("node"), F.concat(
        F.lit("Take {{"), ident, F.lit(".output.text}} or {{nodeN"), ln, F.lit(".output.text}} or {{nodeN2}}")).alias("template"))
    names = line.where("l_linenumber > 1").select(F.col("l_orderkey").alias("workflow_id"), F.concat(F.lit("nodeN"), ln).alias("function_name"), node.alias("slug"))
    m = _stored(fx.v_line(spark, sf)).select("workflow_id", F.col("key").alias("slug"), "id")
    return rs.restore_refs(t, m, names).select("workflow_id", "node", "restored")


def _outputs(spark, sf, line=None):
    line = fx.v_line(spark, sf) if line is None else line
    slug = F.concat(F.lit("n"), F.col("l_linenumber").cast("string"))
    txt = line.select(F.col("l_orderkey").alias("workflow_id"), slug.alias("slug"), F.lit("text").alias("field"),
                      F.concat(F.lit("T"), F.col("l_orderkey").cast("string"), F.lit("-"),
                               F.col("l_linenumber").cast("string")).alias("value"))
    files = line.where(F.col("l_returnflag") == "A").select(
        F.col("l_orderkey").alias("workflow_id"), slug.alias("slug"), F.lit("files").alias("field"),
        F.concat(F.lit("F"), F.col("l_partkey").cast("string")).alias("value"))
    return txt.unionByName(files)


@query("render_template", """WITH l AS MATERIALIZED (SELECT l_orderkey AS workflow_id, l_linenumber AS ln, l_partkey AS pk, l_suppkey % 9 AS other, l_returnflag AS flag FROM v_line),
o AS MATERIALIZED (SELECT workflow_id, ln AS no, 'text' AS field, concat('T', cast(workflow_id AS VARCHAR), '-', cast(ln AS VARCHAR)) AS value FROM l
  UNION ALL SELECT workflow_id, ln, 'files', concat('F', cast(pk AS VARCHAR)) FROM l WHERE flag = 'A'),
need AS MATERIALIZED (SELECT workflow_id, ln, ln - 1 AS no, 'text' AS field FROM l UNION ALL SELECT workflow_id, ln, other, 'files' FROM l),
met AS MATERIALIZED (SELECT n.workflow_id, n.ln, max(o.value) FILTER (WHERE n.field = 'text') AS v1, max(o.value) FILTER (WHERE n.field = 'files') AS v2,
    coalesce(string_agg(concat('n', cast(n.no AS VARCHAR), '.output.', n.field), ',' ORDER BY concat('n', cast(n.no AS VARCHAR), '.output.', n.field)) FILTER (WHERE o.value IS NULL), '') AS missing
  FROM need n LEFT JOIN o ON o.workflow_id = n.workflow_id AND o.no = n.no AND o.field = n.field GROUP BY n.workflow_id, n.ln)
SELECT l.workflow_id, concat('n', cast(l.ln AS VARCHAR)) AS node, CASE WHEN pk % 7 = 0 THEN 'Nothing to fill in' WHEN pk % 5 = 0 THEN concat('From {{n', cast(l.ln - 1 AS VARCHAR), '}} on')
  WHEN v1 IS NOT NULL AND v2 IS NOT NULL THEN concat('Use ', v1, ' then ', v2) END AS rendered, CASE WHEN pk % 7 = 0 OR pk % 5 = 0 THEN '' ELSE missing END AS missing
FROM l JOIN met ON met.workflow_id = l.workflow_id AND met.ln = l.ln""")
def render_template(spark, sf):
    line, tasks = _lines(spark, sf)
    return rs.render_template(fx.v_templates(spark, sf, line), _outputs(spark, sf, line), tasks=tasks)


ROUTE_EDGES = [("r0", "escalate", "CONDITIONAL", 'priority == "1-URGENT"'),
               ("r0", "batch", "CONDITIONAL", 'priority == "5-LOW"'),
               ("r1", "done", "CONDITIONAL", 'status == "F"'),
               ("r1", "batch", "CONDITIONAL", 'priority == "5-LOW"'),
               ("r1", "broken", "CONDITIONAL", "priority is low"),
               ("r0", "audit", "STATIC", None),
               ("r2", "audit", "STATIC", None),
               ("r2", "archive", "STATIC", None)]


@query("route_rows", """SELECT o_orderkey, concat('r', cast(o_orderkey % 4 AS VARCHAR)) AS src, dst FROM orders JOIN (VALUES
  (0, 'escalate', '1-URGENT', NULL), (0, 'batch', '5-LOW', NULL), (1, 'done', NULL, 'F'), (1, 'batch', '5-LOW', NULL),
  (0, 'audit', NULL, NULL), (2, 'audit', NULL, NULL), (2, 'archive', NULL, NULL)) AS e(r, dst, prio, stat)
  ON o_orderkey % 4 = e.r AND (e.prio IS NULL OR e.prio = o_orderpriority) AND (e.stat IS NULL OR e.stat = o_orderstatus)""")
def route_rows(spark, sf):
    """Orders at four routers, each with its own conditional and static edges (the fourth has none)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus",
                                          F.concat(F.lit("r"), (F.col("o_orderkey") % 4).cast("string")).alias("src"))
    edges = spark.createDataFrame(ROUTE_EDGES, "src string, dst string, type string, condition string")
    values = F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus"))
    return rs.route_rows(o, edges, values).select("o_orderkey", "src", "dst")
