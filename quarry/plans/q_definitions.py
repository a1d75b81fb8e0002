"""Registered definition-check queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry import dims
from quarry.operators import checks, contract, graph
from quarry.plans.catalog import query
from quarry.plans.sqlgen import in_list, q
from quarry.session import cut_lineage, ensure_checkpoint_dir, stage
from quarry.sources import definition_files
from quarry.sources import fixtures as fx
from quarry.sources import registry as reg
from quarry.sources.definitions import composite_records, explode_composite_edges, explode_composite_nodes, split_definitions

PAT = dims.VAR_REF_PATTERN

# ---------------------------------------------------------------- SQL pieces
REFS_SQL = f"""SELECT workflow_id, slug AS node, cast(i - 1 AS INTEGER) AS ref_no,
  regexp_extract(m[i], '{PAT}', 1) AS slug, regexp_extract(m[i], '{PAT}', 2) AS path
FROM (SELECT workflow_id, slug, regexp_extract_all(concat(template, CASE WHEN workflow_id % 97 = 0 OR (workflow_id % 5003 = 0 AND slug = 'n1') THEN '{{{{ghost.output.late}}}}' ELSE '' END), '{PAT}') AS m FROM v_node_cfg) x,
  LATERAL (SELECT unnest(generate_series(1, len(m))) AS i) g"""

J1_SQL = """SELECT workflow_id, 'entry' AS kind, entry AS ref FROM v_workflows w
  WHERE NOT EXISTS (SELECT 1 FROM v_nodes n WHERE n.workflow_id = w.workflow_id AND n.slug = w.entry)
UNION ALL SELECT workflow_id, 'exit', exit FROM v_workflows w
  WHERE NOT EXISTS (SELECT 1 FROM v_nodes n WHERE n.workflow_id = w.workflow_id AND n.slug = w.exit)
UNION ALL SELECT workflow_id, 'edge_from', src FROM v_edges e
  WHERE NOT EXISTS (SELECT 1 FROM v_nodes n WHERE n.workflow_id = e.workflow_id AND n.slug = e.src)
UNION ALL SELECT workflow_id, 'edge_to', dst FROM v_edges e
  WHERE NOT EXISTS (SELECT 1 FROM v_nodes n WHERE n.workflow_id = e.workflow_id AND n.slug = e.dst)"""

REACH_CTES = """adj AS (SELECT DISTINCT e.workflow_id, e.src, e.dst FROM v_edges e
  JOIN v_nodes n ON n.workflow_id = e.workflow_id AND n.slug = e.src),
reach(workflow_id, n) AS (SELECT workflow_id, entry FROM v_workflows
  UNION SELECT a.workflow_id, a.dst FROM reach r JOIN adj a ON a.workflow_id = r.workflow_id AND a.src = r.n),
unreach AS (SELECT workflow_id, slug FROM v_nodes n
  WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.workflow_id = n.workflow_id AND r.n = n.slug))"""

CYCLE_CTES = """ce AS (SELECT DISTINCT x.workflow_id, x.src, x.dst FROM v_edges x WHERE x.type <> 'RECURSIVE'
  AND EXISTS (SELECT 1 FROM v_nodes n WHERE n.workflow_id = x.workflow_id AND n.slug = x.src)
  AND EXISTS (SELECT 1 FROM v_nodes n WHERE n.workflow_id = x.workflow_id AND n.slug = x.dst)),
cr(workflow_id, a, b) AS (SELECT workflow_id, src, dst FROM ce
  UNION SELECT cr.workflow_id, cr.a, ce.dst FROM cr JOIN ce ON ce.workflow_id = cr.workflow_id AND ce.src = cr.b),
cyc AS (SELECT DISTINCT workflow_id, a AS n FROM cr WHERE a = b),
fromc AS (SELECT DISTINCT cr.workflow_id, cr.b AS n FROM cr JOIN cyc c ON c.workflow_id = cr.workflow_id AND c.n = cr.a),
toc AS (SELECT DISTINCT cr.workflow_id, cr.a AS n FROM cr JOIN cyc c ON c.workflow_id = cr.workflow_id AND c.n = cr.b),
core AS (SELECT workflow_id, n FROM fromc INTERSECT SELECT workflow_id, n FROM toc),
cyclic AS (SELECT workflow_id, count(*) AS n_core_nodes FROM core GROUP BY workflow_id)"""

J5_SQL = """SELECT workflow_id, node, slug AS invalid_slug, concat('{{', slug, '.', arg_min(path, ref_no), '}}') AS reference
FROM refs r WHERE NOT EXISTS (SELECT 1 FROM v_nodes n WHERE n.workflow_id = r.workflow_id AND n.slug = r.slug)
GROUP BY workflow_id, node, slug"""


def _reg_outputs_sql() -> str:
    rows = []
    for t in reg.SAMPLE["all_node_types"]:
        outs = [v["path"] for v in t.get("output_variables", []) if v.get("path")]
        if outs:
            rows.append(f"({q(t['type'])}, [{', '.join(q(o) for o in outs)}])")
    return f"(VALUES {', '.join(rows)}) AS reg(rtype, outputs)"


J6_SQL = f"""SELECT r.workflow_id, r.node, r.slug AS referenced_node, upper(n.type) AS referenced_type, r.path,
  array_to_string(list_sort(reg.outputs), ', ') AS valid_paths
FROM refs r JOIN v_nodes n ON n.workflow_id = r.workflow_id AND n.slug = r.slug
JOIN {_reg_outputs_sql()} ON reg.rtype = upper(n.type)
WHERE upper(n.type) NOT IN {in_list(dims.OUTPUT_CHECK_EXEMPT_TYPES)} AND NOT list_contains(reg.outputs, r.path)"""

INACTIVE = [t["type"] for t in reg.SAMPLE["all_node_types"] if t.get("status") == "inactive"]
J7_SQL = f"""SELECT workflow_id, slug, type AS node_type, 'FAIL' AS status FROM v_nodes
  WHERE type IN {in_list(dims.UNSUPPORTED_NODE_TYPES)}
UNION ALL SELECT workflow_id, slug, upper(type), 'WARN' FROM v_nodes WHERE upper(type) IN {in_list(INACTIVE)}"""


def _drift_rows():
    """Per registered active type: model-only / registry-only field lists (as SQL VALUES)."""
    rows = []
    for t in reg.SAMPLE["all_node_types"]:
        fields = [f["name"] for f in t.get("fields", []) if f.get("name")]
        if t.get("status") == "inactive" or not fields:
            continue
        rows.append((t["type"], sorted(set(fields) - set(dims.FIELD_DRIFT_IGNORED))))
    return rows


def _model_sql() -> str:
    vals = ", ".join(f"({q(t.upper())}, {q(f)})" for t, fs in dims.MODEL_FIELDS.items() for f in fs)
    return f"(VALUES {vals}) AS mf(utype, field)"


def _regfields_sql() -> str:
    vals = ", ".join(f"({q(t)}, {q(f)})" for t, fs in _drift_rows() for f in fs)
    return f"(VALUES {vals}) AS rf(utype, field)"


J8_SQL = f"""WITH mf AS (SELECT * FROM {_model_sql()}), rf AS (SELECT * FROM {_regfields_sql()}),
act AS (SELECT DISTINCT utype FROM rf),
cli AS (SELECT utype, field FROM mf WHERE utype IN (SELECT utype FROM act) EXCEPT SELECT utype, field FROM rf),
ro AS (SELECT utype, field FROM rf WHERE utype IN (SELECT utype FROM mf) EXCEPT SELECT utype, field FROM mf),
d AS (SELECT a.utype,
   coalesce((SELECT array_to_string(list_sort(list(field)), ', ') FROM cli WHERE cli.utype = a.utype), '') AS cli_only,
   coalesce((SELECT array_to_string(list_sort(list(field)), ', ') FROM ro WHERE ro.utype = a.utype), '') AS registry_only
   FROM act a WHERE a.utype IN (SELECT utype FROM mf)),
drift AS (SELECT * FROM d WHERE cli_only <> '' OR registry_only <> '')
SELECT DISTINCT n.workflow_id, d.utype AS node_type, d.cli_only, d.registry_only
FROM v_nodes n JOIN drift d ON upper(n.type) = d.utype"""

F23_SQL = """SELECT workflow_id, slug, type, violation FROM (
  SELECT workflow_id, slug, type, 'temperature must be between 0 and 2' AS violation FROM v_node_cfg
    WHERE type IN ('agent', 'llm_call') AND (temperature < 0 OR temperature > 2)
  UNION ALL SELECT workflow_id, slug, type, 'maxTokens must be greater than 0' FROM v_node_cfg
    WHERE type IN ('agent', 'llm_call') AND maxTokens <= 0
  UNION ALL SELECT workflow_id, slug, type, 'topK must be greater than 0' FROM v_node_cfg
    WHERE type IN ('rag_agent', 'retrieve') AND topK <= 0
  UNION ALL SELECT workflow_id, slug, type, 'scoreThreshold must be between 0 and 1' FROM v_node_cfg
    WHERE type = 'retrieve' AND (scoreThreshold < 0 OR scoreThreshold > 1)
  UNION ALL SELECT workflow_id, slug, type, 'RAG_AGENT config requires either agentId (UUID) or agent_name' FROM v_node_cfg
    WHERE type = 'rag_agent' AND agent_name IS NULL
  UNION ALL SELECT workflow_id, slug, type, 'RAG_AGENT config requires either knowledgeBaseIds (UUIDs) or knowledge_base_names' FROM v_node_cfg
    WHERE type = 'rag_agent' AND NOT has_kb_names
  UNION ALL SELECT workflow_id, slug, type, 'RETRIEVE config requires knowledgeBaseId, knowledge_base_name, or knowledge_base_names' FROM v_node_cfg
    WHERE type = 'retrieve' AND NOT has_kb_names) x"""

P10_SQL = """SELECT workflow_id, slug, type, field, message FROM (
  SELECT workflow_id, slug, type, 'topP' AS field, 'LLM_CALL nodes no longer support topP. Remove this field.' AS message
    FROM v_node_cfg WHERE type = 'llm_call' AND ln % 3 = 0
  UNION ALL SELECT workflow_id, slug, type, 'extractionPrompt', 'STRUCTURED_OUTPUT nodes no longer support extractionPrompt. Remove this field.'
    FROM v_node_cfg WHERE type = 'structured_output' AND ln % 4 = 0
  UNION ALL SELECT workflow_id, slug, type, 'disableRAG', 'RAG_AGENT nodes no longer support disableRAG. Remove this field.'
    FROM v_node_cfg WHERE type = 'rag_agent' AND ln % 5 = 0) x"""

# The client-only keys are gone and the others renamed before a schema sees a config.
F24_SQL = """SELECT workflow_id, node, field, kind, message, suggestion FROM (
  SELECT workflow_id, slug AS node, 'temperature' AS field, 'maximum' AS kind,
    concat(cast(temperature AS VARCHAR), ' is greater than the maximum of 2') AS message, NULL AS suggestion FROM v_node_cfg
    WHERE type = 'llm_call' AND temperature > 2
  UNION ALL SELECT workflow_id, slug, 'max_tokens', 'exclusiveMinimum',
    concat(cast(maxTokens AS VARCHAR), ' is less than or equal to the minimum of 0'), NULL FROM v_node_cfg
    WHERE type = 'llm_call' AND maxTokens <= 0
  UNION ALL SELECT workflow_id, slug, '(root)', 'required', '''owner'' is a required property', 'Add the required field ''owner'' to your LLM_CALL config' FROM v_node_cfg WHERE type = 'llm_call'
  UNION ALL SELECT workflow_id, slug, 'meta.{{ghost.output.x}}', 'type', '''key only'' is not of type ''integer''', 'Change the value to type ''integer''' FROM v_node_cfg WHERE type = 'llm_call'
  UNION ALL SELECT workflow_id, slug, '(root)', 'required', '''query'' is a required property',
    'Add the required field ''query'' to your RETRIEVE config' FROM v_node_cfg WHERE type = 'retrieve'
  UNION ALL SELECT workflow_id, slug, 'meta', 'closed', 'Additional properties are not allowed (''{{ghost.output.x}}'' was unexpected)', NULL FROM v_node_cfg WHERE type = 'retrieve'
  UNION ALL SELECT workflow_id, slug, 'top_k_results', 'minimum', concat(cast(topK AS VARCHAR), ' is less than the minimum of 1'), NULL
    FROM v_node_cfg WHERE type IN ('retrieve', 'rag_agent') AND topK < 1
  UNION ALL SELECT workflow_id, slug, 'extractionPrompt', 'type', '''x'' is not of type ''integer'', ''null''',
    'Change the value to type [''integer'', ''null'']' FROM v_node_cfg WHERE type = 'retrieve' AND ln % 4 = 0
  UNION ALL SELECT c.workflow_id, c.slug, 'zz_note', 'anyOf',
    concat('''{{n', cast(l.l_partkey % 8 AS VARCHAR), '.output.note}}'' is not valid under any of the given schemas'), 'Expected number or null'
    FROM v_node_cfg c JOIN v_line l ON l.l_orderkey = c.workflow_id AND l.l_linenumber = c.ln WHERE type = 'rag_agent'
  UNION ALL SELECT c.workflow_id, c.slug, 'knowledge_base_names.0', 'type',
    concat('''kb-', cast(l.l_partkey % 7 AS VARCHAR), ''' is not of type ''integer'''), 'Change the value to type ''integer'''
    FROM v_node_cfg c JOIN v_line l ON l.l_orderkey = c.workflow_id AND l.l_linenumber = c.ln WHERE type = 'structured_output' AND has_kb_names) x"""

REPORT_SQL = f"""WITH RECURSIVE refs AS ({REFS_SQL}),
{REACH_CTES},
{CYCLE_CTES},
j1 AS ({J1_SQL}), f23 AS ({F23_SQL}), p10 AS ({P10_SQL}),
j5 AS ({J5_SQL}), j6 AS ({J6_SQL}), j7 AS ({J7_SQL}),
j8 AS ({J8_SQL.replace('WITH mf AS', 'SELECT * FROM (WITH mf AS')} ) z),
fl AS (SELECT w.workflow_id, (w.workflow_id % 13 = 0 OR w.workflow_id % 17 = 0) AS f_syntax,
  (w.workflow_id IN (SELECT workflow_id FROM j1) OR w.workflow_id IN (SELECT workflow_id FROM f23)
   OR w.workflow_id IN (SELECT workflow_id FROM p10)) AS f_schema,
  w.workflow_id IN (SELECT workflow_id FROM unreach) AS f_reach,
  w.workflow_id IN (SELECT workflow_id FROM cyclic) AS f_cycle,
  w.workflow_id IN (SELECT workflow_id FROM j5) AS f_refs,
  w.workflow_id IN (SELECT workflow_id FROM j7 WHERE status = 'FAIL') AS f_unsup,
  w.workflow_id IN (SELECT workflow_id FROM j6) AS f_paths,
  w.workflow_id IN (SELECT workflow_id FROM j7 WHERE status = 'WARN') AS f_inactive,
  w.workflow_id IN (SELECT workflow_id FROM j8) AS f_drift
  FROM v_workflows w),
rep AS (SELECT workflow_id, check_no, check_name, status FROM (
  SELECT workflow_id, f_schema, f_syntax, unnest([
    {{'check_no': 1, 'check_name': 'YAML Syntax', 'status': CASE WHEN f_syntax THEN 'FAIL' ELSE 'PASS' END}},
    {{'check_no': 2, 'check_name': 'WDF Schema Conformance', 'status': CASE WHEN f_schema THEN 'FAIL' ELSE 'PASS' END}},
    {{'check_no': 3, 'check_name': 'Graph Reachability', 'status': CASE WHEN f_reach THEN 'FAIL' ELSE 'PASS' END}},
    {{'check_no': 4, 'check_name': 'Cycle Detection', 'status': CASE WHEN f_cycle THEN 'FAIL' ELSE 'PASS' END}},
    {{'check_no': 5, 'check_name': 'Variable References', 'status': CASE WHEN f_refs THEN 'FAIL' ELSE 'PASS' END}},
    {{'check_no': 6, 'check_name': 'Unsupported Node Types', 'status': CASE WHEN f_unsup THEN 'FAIL' ELSE 'PASS' END}},
    {{'check_no': 7, 'check_name': 'Output Variable Paths', 'status': CASE WHEN f_paths THEN 'FAIL' ELSE 'PASS' END}},
    {{'check_no': 8, 'check_name': 'Inactive Node Types', 'status': CASE WHEN f_inactive THEN 'WARN' ELSE 'PASS' END}},
    {{'check_no': 9, 'check_name': 'Field Coverage', 'status': CASE WHEN f_drift THEN 'WARN' ELSE 'PASS' END}},
    {{'check_no': 10, 'check_name': 'Node Type Recognition', 'status': 'PASS'}},
    {{'check_no': 11, 'check_name': 'Edge References', 'status': 'PASS'}},
    {{'check_no': 12, 'check_name': 'Entry/Exit Points', 'status': 'PASS'}},
    {{'check_no': 13, 'check_name': 'Node Config Validation', 'status': 'PASS'}}], max_depth := 2) FROM fl) x
  WHERE (NOT f_schema OR check_no <= 2) AND (NOT f_syntax OR check_no = 1))"""


# ---------------------------------------------------------------- Spark side
def _graph(spark, sf):
    return fx.v_workflows(spark, sf), fx.v_nodes(spark, sf), fx.v_edges(spark, sf)


def _staged_graph(spark, sf, line=None):
    """The graph tables written once, for the loops that read them in every round; their common input is read once."""
    line = stage(fx.v_line(spark, sf)) if line is None else line
    return tuple(cut_lineage(f(spark, sf, line)) for f in (fx.v_workflows, fx.v_nodes, fx.v_edges))


def _cfg(spark, sf):
    return fx.v_node_configs(spark, sf)


def _long_cfg(spark, sf, line=None):
    """The configs, some with one more field: a prompt of thousands of escapes and, at its end, a reference.

    Every 97th workflow gets about 3,000 characters, the first node of every 5003rd one million.
    """
    k = F.col("workflow_id")
    times = F.when((k % 5003 == 0) & (F.col("slug") == "n1"), 33_000).when(k % 97 == 0, 100)
    prompt = F.concat(F.substring("config", F.lit(1), F.length("config") - 1), F.lit(',"prompt" : "'), F.repeat(F.lit(r'He said \"go\" to C:\\x\\ \u00e9\n '), times), F.lit('{{ghost.output.late}}"}'))
    return fx.v_node_configs(spark, sf, line).withColumn("config", F.coalesce(prompt, "config"))


def _refs_impl(spark, sf):
    return _refs_of(_long_cfg(spark, sf))


def _refs_of(cfg):
    r = checks.extract_variable_refs(cfg.withColumnRenamed("slug", "node"))
    return r.select("workflow_id", "node", F.col("ref_no").cast("int").alias("ref_no"), "slug", "path")


@query("edge_integrity", J1_SQL)
def edge_integrity(spark, sf):
    w, n, e = _graph(spark, sf)
    return graph.edge_integrity(w, n, e)


@query("unreachable_nodes", f"WITH RECURSIVE {REACH_CTES} SELECT workflow_id, slug FROM unreach")
def unreachable_nodes(spark, sf):
    """G1: walks from every entry at once, doubled round by round (SQL oracle uses recursion)."""
    w, n, e = _staged_graph(spark, sf)
    return graph.unreachable_nodes(w, n, e)


@query("cyclic_workflows", f"WITH RECURSIVE {CYCLE_CTES} SELECT workflow_id, n_core_nodes FROM cyclic")
def cyclic_workflows(spark, sf):
    """``n_core_nodes`` counts nodes on or between cycles."""
    _, n, e = _staged_graph(spark, sf)
    return graph.cyclic_workflows(n, e)


@query("cycle_members", f"""WITH RECURSIVE {CYCLE_CTES}
SELECT a.workflow_id, a.a AS n, min(a.b) AS component FROM cr a JOIN cr b ON a.workflow_id = b.workflow_id AND a.a = b.b AND a.b = b.a GROUP BY 1, 2""")
def cycle_members(spark, sf):
    """Nodes that lie on a cycle, by strongly connected component."""
    _, n, e = _staged_graph(spark, sf)
    return graph.cycle_members(n, e)


@query("cycle_witness", f"""WITH RECURSIVE {CYCLE_CTES},
f AS (SELECT ce.workflow_id, ce.src, min(ce.dst) AS dst FROM ce JOIN core a ON a.workflow_id = ce.workflow_id AND a.n = ce.src JOIN core b ON b.workflow_id = ce.workflow_id AND b.n = ce.dst GROUP BY 1, 2),
walk(workflow_id, n, seen, again) AS (SELECT workflow_id, min(src), list_value(min(src)), false FROM f GROUP BY 1
  UNION ALL SELECT w.workflow_id, f.dst, list_append(w.seen, f.dst), list_contains(w.seen, f.dst) FROM walk w JOIN f ON f.workflow_id = w.workflow_id AND f.src = w.n WHERE NOT w.again),
ring AS (SELECT workflow_id, seen[list_position(seen, n) : len(seen) - 1] AS r FROM walk WHERE again)
SELECT workflow_id, array_to_string(r[list_position(r, list_min(r)) :] || r[1 : list_position(r, list_min(r)) - 1] || [list_min(r)], ' -> ') AS cycle_path FROM ring""")
def cycle_witness(spark, sf):
    """One cycle of each cyclic workflow."""
    _, n, e = _staged_graph(spark, sf)
    return graph.cycle_witness(n, e)


@query("extract_variable_refs", REFS_SQL)
def extract_variable_refs(spark, sf):
    return _refs_impl(spark, sf)


@query("invalid_variable_refs", f"WITH refs AS ({REFS_SQL}) {J5_SQL}")
def invalid_variable_refs(spark, sf):
    return checks.invalid_variable_refs(_refs_impl(spark, sf), fx.v_nodes(spark, sf))


@query("output_path_check", f"WITH refs AS ({REFS_SQL}) {J6_SQL}")
def output_path_check(spark, sf):
    return checks.output_path_check(_refs_impl(spark, sf), fx.v_nodes(spark, sf), reg.registry_frame(spark))


@query("type_status_check", J7_SQL)
def type_status_check(spark, sf):
    return checks.type_status_check(fx.v_nodes(spark, sf), reg.registry_frame(spark))


@query("field_drift", J8_SQL)
def field_drift(spark, sf):
    return checks.field_drift(fx.v_nodes(spark, sf), reg.registry_frame(spark))


P9_PATH = ("CASE {ln} % 6 WHEN 5 THEN concat(chr(9), chr(10)) WHEN 0 THEN '/abs/out.json' WHEN 1 THEN 'a/../b.json' WHEN 2 THEN '   ' "
           "WHEN 3 THEN '..' ELSE concat('runs/', {slug}, '/output.json') END")


@query("path_confined", f"""
SELECT workflow_id, slug, path, trim(path, ' ' || chr(9) || chr(10)) <> '' AND NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..') AS ok
FROM (SELECT workflow_id, slug, {P9_PATH.format(ln='pos', slug='slug')} AS path FROM v_nodes) x""")
def path_confined(spark, sf):
    n = fx.v_nodes(spark, sf)
    p = F.expr(P9_PATH.format(ln="pos", slug="slug"))
    return n.select("workflow_id", "slug", p.alias("path")).withColumn("ok", checks.path_confined(F.col("path")))


@query("removed_fields", P10_SQL)
def removed_fields(spark, sf):
    return checks.removed_fields(_cfg(spark, sf))


@query("config_rules", F23_SQL)
def config_rules(spark, sf):
    return checks.config_rules(_cfg(spark, sf))


@query("schema_rules", F24_SQL)
def schema_rules(spark, sf):
    return contract.schema_rules(_cfg(spark, sf))


def _report(spark, sf):
    """The checks that a syntax or schema failure would stop run on the other workflows only."""
    line = stage(fx.v_line(spark, sf))
    w, n, e = _staged_graph(spark, sf, line)
    cfg = stage(_long_cfg(spark, sf, line))
    registry = reg.registry_frame(spark)
    _, rejects = split_definitions(stage(_definition_files(w, n, e)))
    syntax_fail = cut_lineage(rejects.select(F.regexp_extract("file", r"(\d+)", 1).cast("bigint").alias("workflow_id")))
    schema_fail = cut_lineage(graph.edge_integrity(w, n, e).select("workflow_id")
                              .unionByName(checks.config_rules(cfg).select("workflow_id"))
                              .unionByName(checks.removed_fields(cfg).select("workflow_id")).distinct())
    stopped = cut_lineage(syntax_fail.union(schema_fail).distinct())
    w2, n2, e2 = (cut_lineage(df.join(stopped, "workflow_id", "left_anti")) for df in (w, n, e))
    refs = cut_lineage(_refs_of(cfg.join(stopped, "workflow_id", "left_anti")))
    ts = checks.type_status_check(n2, registry)
    return checks.check_report(
        w, n, e, registry, schema_fail,
        graph.unreachable_nodes(w2, n2, e2), graph.cyclic_workflows(n2, e2),
        checks.invalid_variable_refs(refs, n2), ts.where(F.col("status") == "FAIL"),
        checks.output_path_check(refs, n2, registry), ts.where(F.col("status") == "WARN"),
        checks.field_drift(n2, registry), syntax_fail)


def _definition_files(workflows, nodes, edges):
    """One definition text per workflow; every 13th is cut short and every 17th is a list."""
    comp = composite_records(workflows, nodes, edges, keep=["workflow_id"])
    k = F.col("workflow_id")
    text = F.when(k % 13 == 0, F.substring("json", F.lit(1), F.length("json") - 1)).when(k % 17 == 0, F.concat(F.lit("["), F.col("json"), F.lit("]"))).otherwise(F.col("json"))
    return comp.select(F.concat(F.lit("wf-"), k.cast("string"), F.lit(".json")).alias("file"), text.alias("value"))


@query("scan_definitions", """SELECT concat('wf-', cast(workflow_id AS VARCHAR), '.json') AS file,
  CASE WHEN workflow_id % 13 = 0 THEN 'invalid JSON' WHEN workflow_id % 17 = 0 THEN 'not an object' ELSE 'accepted' END AS verdict FROM v_workflows""")
def scan_definitions(spark, sf):
    """Definition texts -> accepted ones and rejects with the reason."""
    ok, bad = split_definitions(_definition_files(*_graph(spark, sf)))
    return ok.select("file", F.lit("accepted").alias("verdict")).unionByName(bad.withColumnRenamed("reason", "verdict"))


def _yaml_files(spark, sf):
    """A folder of YAML streams with one definition per workflow, written by Spark.

    Every 13th text breaks the syntax in its second line, every 17th is a list, every 19th lacks its edges.
    """
    w, n, e = _graph(spark, sf)
    k, quoted = F.col("workflow_id"), lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    nl = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    one = nl("  ", F.col("slug"), ":\n    type: ", F.col("type"), "\n    execution_mode: ", F.when(F.col("pos") % 2 == 0, F.lit("FLOW")).otherwise(F.lit("INPUT")),
             "\n    config: {place: ", F.col("pos").cast("string"), ', note: "{{', F.col("slug"), '.output.text}} \\"x\\""}\n')
    nodes = n.groupBy("workflow_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", one.alias("y")))), lambda x: x["y"]), "").alias("nodes"))
    two = nl("  - from: ", quoted("src"), "\n    to: ", quoted("dst"), F.when(F.col("type") != "STATIC", nl("\n    type: ", F.col("type"))).otherwise(F.lit("")), "\n")
    edges = e.groupBy("workflow_id").agg(F.array_join(F.array_sort(F.collect_list(two)), "").alias("edges"))
    full = nl("---\nname: wf-", k.cast("string"), F.when(k % 13 == 0, F.lit(": broken")).otherwise(F.lit("")), "\nentry: ", F.col("entry"), "\nexit: ", F.col("exit"), "\nnodes:\n", F.col("nodes"),
              F.when(k % 19 == 0, F.lit("")).otherwise(F.coalesce(nl("edges:\n", F.col("edges")), F.lit("edges: []\n"))))
    text = F.when((k % 17 == 0) & (k % 13 != 0), nl("---\n- wf-", k.cast("string"), "\n")).otherwise(full)
    folder = f"{ensure_checkpoint_dir(spark)}/definitions-{uuid.uuid4().hex}"
    w.join(nodes, "workflow_id").join(edges, "workflow_id", "left").select(text.alias("value")).write.text(folder)
    return folder


def _definitions(spark, sf):
    return definition_files.read_definitions(spark, _yaml_files(spark, sf), many=True)


_SOUND = "workflow_id % 13 <> 0 AND workflow_id % 17 <> 0 AND workflow_id % 19 <> 0"


@query("definition_workflows", f"""SELECT concat('wf-', cast(workflow_id AS VARCHAR)) AS name, entry, exit, (SELECT cast(count(*) AS INTEGER) FROM v_nodes n WHERE n.workflow_id = w.workflow_id) AS n_nodes,
  (SELECT cast(count(*) AS INTEGER) FROM v_edges e WHERE e.workflow_id = w.workflow_id) AS n_edges FROM v_workflows w WHERE {_SOUND}""")
def definition_workflows(spark, sf):
    """The workflow rows of YAML files."""
    return definition_files.workflow_rows(_definitions(spark, sf)).select("name", "entry", "exit", "n_nodes", "n_edges")


@query("definition_nodes", f"""SELECT concat('wf-', cast(workflow_id AS VARCHAR)) AS name, cast(row_number() OVER (PARTITION BY workflow_id ORDER BY pos) - 1 AS INTEGER) AS pos, slug, type,
  CASE WHEN pos % 2 = 0 THEN 'FLOW' ELSE 'INPUT' END AS execution_mode, concat('{{"place":', cast(pos AS VARCHAR), ',"note":"{{{{', slug, '.output.text}}}} \\"x\\""}}') AS config FROM v_nodes WHERE {_SOUND}""")
def definition_nodes(spark, sf):
    """The node rows of YAML files."""
    return definition_files.node_rows(_definitions(spark, sf)).select("name", "pos", "slug", "type", "execution_mode", "config")


@query("definition_edges", f"SELECT concat('wf-', cast(workflow_id AS VARCHAR)) AS name, src, dst, type FROM v_edges WHERE {_SOUND}")
def definition_edges(spark, sf):
    """The edge rows of YAML files."""
    return definition_files.edge_rows(_definitions(spark, sf)).select("name", "src", "dst", "type")


@query("definition_rejects", """SELECT kind, line, col, message, count(*) AS n FROM (
  SELECT CASE WHEN workflow_id % 13 = 0 THEN 'syntax' ELSE 'schema' END AS kind, CASE WHEN workflow_id % 13 = 0 THEN 2 END AS line,
    CASE WHEN workflow_id % 13 = 0 THEN cast(length(concat('name: wf-', cast(workflow_id AS VARCHAR), ':')) AS INTEGER) END AS col,
    CASE WHEN workflow_id % 13 = 0 THEN 'mapping values are not allowed here' WHEN workflow_id % 17 = 0 THEN 'a definition is a mapping' ELSE 'edges: Field required' END AS message
  FROM v_workflows WHERE workflow_id % 13 = 0 OR workflow_id % 17 = 0 OR workflow_id % 19 = 0) x GROUP BY ALL""")
def definition_rejects(spark, sf):
    """Bad definitions by kind, line, column and message."""
    return definition_files.reject_rows(_definitions(spark, sf)).groupBy("kind", "line", "col", "message").agg(F.count("*").alias("n"))


@query("check_report", REPORT_SQL + "\nSELECT workflow_id, check_no, check_name, status FROM rep")
def check_report(spark, sf):
    return _report(spark, sf)


@query("check_tally", REPORT_SQL + """
SELECT workflow_id, cast(count_if(status = 'PASS') AS BIGINT) AS n_pass, cast(count_if(status = 'FAIL') AS BIGINT) AS n_fail,
  cast(count_if(status = 'WARN') AS BIGINT) AS n_warn, cast(count_if(status = 'SKIP') AS BIGINT) AS n_skip,
  CASE WHEN count_if(status = 'FAIL') > 0 THEN 'failed' WHEN count_if(status = 'WARN') > 0 THEN 'passed with warnings'
  WHEN count_if(status = 'SKIP') > 0 THEN 'passed with skips' ELSE 'passed' END AS verdict
FROM rep GROUP BY workflow_id""")
def check_tally(spark, sf):
    return checks.check_tally(_report(spark, sf))


@query("explode_composite", """SELECT workflow_id, cast(row_number() OVER (PARTITION BY workflow_id ORDER BY pos) - 1 AS INTEGER) AS node_pos,
  slug, type FROM v_nodes""")
def explode_composite(spark, sf):
    """One nested composite record per workflow (JSON) -> flat node rows via ``from_json`` + ``posexplode``."""
    return explode_composite_nodes(composite_records(*_graph(spark, sf)))


@query("explode_composite_edges", "SELECT workflow_id, src, dst, type FROM v_edges")
def explode_edges(spark, sf):
    """The edges of the same composite records."""
    return explode_composite_edges(composite_records(*_graph(spark, sf)))


def _pairs(fields: dict) -> str:
    return ", ".join(f"({q(t)}, {i}, {q(k)}, {q(v or k)})" for t, m in fields.items() for i, (k, v) in enumerate(m.items()))


# Entries of the stand-in configs by key: (place, key, JSON value or null where absent).
RENAME_SQL = rf"""WITH e AS (SELECT workflow_id, slug, upper(type) AS type, unnest([
    {{'pos': 1, 'key': 'zz_note', 'value': to_json(note)}}, {{'pos': 2, 'key': 'model', 'value': '"m1"'}}, {{'pos': 3, 'key': 'template', 'value': to_json(text)}},
    {{'pos': 4, 'key': 'temperature', 'value': regexp_replace(cast(temperature AS VARCHAR), '\.0$', '')}}, {{'pos': 5, 'key': 'maxTokens', 'value': cast(maxTokens AS VARCHAR)}}, {{'pos': 6, 'key': 'topK', 'value': cast(topK AS VARCHAR)}},
    {{'pos': 7, 'key': 'scoreThreshold', 'value': regexp_replace(cast(scoreThreshold AS VARCHAR), '\.0$', '')}}, {{'pos': 10, 'key': 'topP', 'value': CASE WHEN ln % 3 = 0 THEN '0.9' END}},
    {{'pos': 13, 'key': 'meta', 'value': '{{"{{{{ghost.output.x}}}}":"key only"}}'}},
    {{'pos': 8, 'key': 'agent_name', 'value': to_json(agent_name)}}, {{'pos': 9, 'key': 'knowledge_base_names', 'value': CASE WHEN has_kb_names THEN concat('["kb-', cast(kb AS VARCHAR), '"]') END}},
    {{'pos': 11, 'key': 'extractionPrompt', 'value': CASE WHEN ln % 4 = 0 THEN '"x"' END}}, {{'pos': 12, 'key': 'disableRAG', 'value': CASE WHEN ln % 5 = 0 THEN 'true' END}},
    {{'pos': 14, 'key': 'system_prompt', 'value': CASE WHEN ln % 2 = 0 THEN '"late"' END}}], max_depth := 2)
  FROM (SELECT c.*, concat('{{{{n', cast(l.l_partkey % 8 AS VARCHAR), '.output.note}}}}') AS note, l.l_partkey % 7 AS kb,
    substr(template, length(concat('{{{{n', cast(l.l_partkey % 8 AS VARCHAR), '.output.note}}}}')) + 1) AS text
    FROM v_node_cfg c JOIN v_line l ON l.l_orderkey = c.workflow_id AND concat('n', cast(l.l_linenumber AS VARCHAR)) = c.slug) x),
drops AS (SELECT * FROM (VALUES {", ".join(f"({q(t)}, {q(k)})" for t, ks in dims.CLIENT_ONLY_FIELDS.items() for k in ks)}) v(type, key)),
names AS (SELECT * FROM (VALUES {_pairs(dims.SCHEMA_ALIASES)}) v(type, rule, key, target))
SELECT e.workflow_id, e.slug, coalesce(n.target, e.key) AS key, cast(arg_max(e.value, e.pos) AS VARCHAR) AS value
FROM e LEFT JOIN names n ON n.type = e.type AND n.key = e.key
WHERE e.value IS NOT NULL AND NOT EXISTS (SELECT 1 FROM drops d WHERE d.type = e.type AND d.key = e.key) GROUP BY ALL"""


@query("rename_config", RENAME_SQL)
def rename_config(spark, sf):
    """F15 over all node configs; every second one has a late ``system_prompt``."""
    from quarry.operators import configs
    c = _cfg(spark, sf)
    late = F.concat(F.regexp_replace("config", r"\}$", ""), F.lit(',"system_prompt":"late"}'))
    c = c.withColumn("config", F.when(F.substring("slug", 2, 9).cast("int") % 2 == 0, late).otherwise(F.col("config")))
    return configs.rename_config(c)


@query("merge_config", f"""WITH n AS (SELECT workflow_id, slug, ln, upper(type) AS type FROM (SELECT l_orderkey AS workflow_id, concat('n', cast(l_linenumber AS VARCHAR)) AS slug,
    l_linenumber AS ln, CASE l_partkey % 6 WHEN 0 THEN 'plain_txt_input' WHEN 1 THEN 'llm_call' WHEN 2 THEN 'retrieve' WHEN 3 THEN 'rag_agent'
    WHEN 4 THEN 'structured_output' ELSE 'mystery' END AS type FROM v_line) x),
p AS (SELECT workflow_id, slug, type, unnest([{{'key': 'systemPrompt', 'value': concat('"P', cast(ln AS VARCHAR), '"')}}, {{'key': 'topK', 'value': cast(ln AS VARCHAR)}},
  {{'key': 'system_prompt', 'value': CASE WHEN ln % 2 = 0 THEN '"Q"' END}}, {{'key': 'agentId', 'value': CASE WHEN ln % 3 = 0 THEN '""' ELSE '"a1"' END}},
  {{'key': 'knowledgeBaseId', 'value': CASE WHEN ln % 2 = 1 THEN '[]' END}}], max_depth := 2) FROM n),
c AS (SELECT workflow_id, slug, type, unnest([{{'key': 'type', 'value': '"ui"'}}, {{'key': 'agent_id', 'value': concat('"c', cast(ln AS VARCHAR), '"')}},
  {{'key': 'knowledge_base_ids', 'value': '["k"]'}}, {{'key': 'knowledge_base_id', 'value': CASE WHEN ln % 4 = 1 THEN 'null' ELSE '"kb"' END}},
  {{'key': 'model', 'value': '"m"'}}, {{'key': 'other', 'value': '{{"x":[1,2]}}'}}], max_depth := 2) FROM n),
pf AS (SELECT * FROM (VALUES {_pairs(dims.PARAMETER_FIELDS)}) v(type, rule, key, target)), cf AS (SELECT * FROM (VALUES {_pairs(dims.CONFIG_FIELDS)}) v(type, rule, key, target)),
a AS (SELECT workflow_id, slug, target, arg_max(value, rule) AS value FROM p JOIN pf USING (type, key) WHERE value IS NOT NULL
  AND NOT (key IN {in_list(dims.DEPENDENCY_FIELDS)} AND value IN ('null', '""', '[]')) GROUP BY ALL),
b AS (SELECT workflow_id, slug, target, arg_min(value, rule) AS value FROM c JOIN cf USING (type, key) WHERE NOT (key IN {in_list(dims.DEPENDENCY_FIELDS)} AND value IN ('null', '""', '[]')) GROUP BY ALL),
m AS (SELECT workflow_id, slug, target AS key, coalesce(a.value, b.value) AS value FROM a FULL JOIN b USING (workflow_id, slug, target))
SELECT * FROM m UNION ALL SELECT workflow_id, slug, key, value FROM c
  WHERE key NOT IN {in_list(dims.UI_FIELDS)} AND NOT EXISTS (SELECT 1 FROM m WHERE m.workflow_id = c.workflow_id AND m.slug = c.slug)""")
def merge_config(spark, sf):
    """F16 over stored nodes: parameters first, config fills the gaps, unknown types keep their config."""
    from quarry.operators import configs
    return configs.merge_config(fx.v_stored_nodes(spark, sf))


NODE_ID = "concat('id-', cast(workflow_id AS VARCHAR), '-', slug)"


def _ids(spark, sf):
    return fx.v_nodes(spark, sf).select("workflow_id", "slug", F.concat(F.lit("id-"), F.col("workflow_id").cast("string"), F.lit("-"), F.col("slug")).alias("id"))


@query("node_parameters", f"""WITH c AS (SELECT c.*, l.l_partkey FROM v_node_cfg c JOIN v_line l ON l.l_orderkey = c.workflow_id AND l.l_linenumber = c.ln),
t AS (SELECT *, substr(template, length(concat('{{{{n', cast(l_partkey % 8 AS VARCHAR), '.output.note}}}}')) + 1) AS text,
  concat('n', cast(ln - 1 AS VARCHAR)) AS a FROM c),
e AS (SELECT t.*, regexp_extract(text, 'then [{{][{{](n[0-9]+)', 1) AS b FROM t),
r AS (SELECT e.*, coalesce(x.id, e.a) AS a_id, coalesce(y.id, e.b) AS b_id FROM e
  LEFT JOIN (SELECT workflow_id, slug, {NODE_ID} AS id FROM v_nodes) x ON x.workflow_id = e.workflow_id AND x.slug = e.a
  LEFT JOIN (SELECT workflow_id, slug, {NODE_ID} AS id FROM v_nodes) y ON y.workflow_id = e.workflow_id AND y.slug = e.b)
SELECT workflow_id, slug, p.key, p.value FROM (SELECT workflow_id, slug, unnest([
  {{'key': 'type', 'value': CASE type WHEN 'plain_txt_input' THEN '"plainTextInput"' WHEN 'llm_call' THEN '"llmPrompt"' WHEN 'retrieve' THEN '"retrieve"'
     WHEN 'rag_agent' THEN '"ragAgent"' WHEN 'structured_output' THEN '"structuredOutput"' ELSE '"documentExtraction"' END}},
  {{'key': 'label', 'value': CASE WHEN ln % 2 = 0 THEN concat('"Node ', cast(ln AS VARCHAR), '"') ELSE concat('"', slug, '"') END}},
  {{'key': 'function_name', 'value': concat('"', slug, '"')}},
  {{'key': 'model', 'value': CASE WHEN type IN ('llm_call', 'rag_agent', 'structured_output') THEN '"m1"' END}},
  {{'key': 'temperature', 'value': CASE WHEN type IN ('llm_call', 'rag_agent', 'structured_output') THEN regexp_replace(cast(temperature AS VARCHAR), '\\.0$', '') END}},
  {{'key': 'maxTokens', 'value': CASE WHEN type IN ('llm_call', 'rag_agent', 'structured_output') THEN cast(maxTokens AS VARCHAR) END}},
  {{'key': 'template', 'value': CASE WHEN type = 'llm_call' THEN concat('"Use {{{{', a_id, '.output.text}}}} then {{{{', b_id, '.output.files}}}}"') END}},
  {{'key': 'variables', 'value': CASE WHEN type = 'llm_call' THEN '[]' END}},
  {{'key': 'topK', 'value': CASE WHEN type IN ('retrieve', 'rag_agent') THEN cast(topK AS VARCHAR) END}},
  {{'key': 'scoreThreshold', 'value': CASE WHEN type = 'retrieve' THEN regexp_replace(cast(scoreThreshold AS VARCHAR), '\\.0$', '') END}}]) AS p FROM r) z
WHERE p.value IS NOT NULL""")
def node_parameters(spark, sf):
    """F17 over all node configs; slug references become node ids."""
    from quarry.operators import configs
    ln = F.substring("slug", 2, 9)
    nodes = _cfg(spark, sf).withColumn("label", F.when(ln.cast("int") % 2 == 0, F.concat(F.lit("Node "), ln)))
    return configs.node_parameters(nodes, _ids(spark, sf))


@query("assemble_definition", f"""WITH n AS (SELECT *, {NODE_ID} AS id FROM v_nodes),
nj AS (SELECT workflow_id, string_agg(concat('{{"id":"', id, '","config_type":"', upper(type), '","function_name":"', slug, '","timeout_seconds":30,"retry_policy":{{"max_retries":3}}}}'), ',' ORDER BY pos) AS nodes,
  coalesce(string_agg(concat('{{"node_id":"', id, '","output_name":"output","sequence_order":0}}'), ',' ORDER BY pos) FILTER (WHERE type <> 'structured_output'), '') AS outs,
  coalesce(string_agg(concat('{{"node_id":"', id, '","input_name":"input","sequence_order":0}}'), ',' ORDER BY pos) FILTER (WHERE type <> 'plain_txt_input'), '') AS ins FROM n GROUP BY workflow_id),
ed AS (SELECT e.workflow_id, a.id AS s, b.id AS d, e.type FROM v_edges e LEFT JOIN n a ON a.workflow_id = e.workflow_id AND a.slug = e.src LEFT JOIN n b ON b.workflow_id = e.workflow_id AND b.slug = e.dst),
ej AS (SELECT workflow_id, coalesce(string_agg(concat('{{"source_node_id":"', s, '","target_node_id":"', d, '","edge_type":"', type, '"}}'), ',' ORDER BY s, d, type) FILTER (WHERE s IS NOT NULL AND d IS NOT NULL), '') AS edges,
  count_if(s IS NULL OR d IS NULL) AS unknown_edges FROM ed GROUP BY workflow_id)
SELECT w.workflow_id, concat('{{"workflow":{{"entry_point":"', a.id, '"', CASE WHEN b.id IS NOT NULL THEN concat(',"exit_point":"', b.id, '"') ELSE '' END, '}},"nodes":[', nodes,
  '],"node_outputs":[', outs, '],"node_inputs":[', ins, '],"edges":[', coalesce(edges, ''), ']}}') AS json, cast(coalesce(unknown_edges, 0) AS BIGINT) AS unknown_edges
FROM v_workflows w JOIN nj USING (workflow_id) LEFT JOIN ej USING (workflow_id)
LEFT JOIN n a ON a.workflow_id = w.workflow_id AND a.slug = w.entry LEFT JOIN n b ON b.workflow_id = w.workflow_id AND b.slug = w.exit""")
def assemble_definition(spark, sf):
    """One nested record per workflow from its nodes and edges."""
    from quarry.operators import configs
    return configs.assemble_definition(*_graph(spark, sf), _ids(spark, sf))
