from pyspark.sql import functions as F

from quarry.functions import text as tf
from quarry.operators import checks, contract, outcomes, resolve, tables


def test_find_by_name_counts_entries(spark):
    names = [(f"id{i}", n) for i, n in enumerate(["Alpha", "alpha beta", "Twin", "twin", "x" * 300 + "needle", "Ab", "é漢"])]
    names.append(("idn", None))
    terms = ["ALPHA", "beta", "twin", "needle", "", "zz", "ab", "l", "漢", "xn"]
    got = {r.term: (r.verdict, r.match_id, r.n_matches) for r in resolve.find_by_name(
        spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(names, "id string, name string")).collect()}
    assert got == {"ALPHA": ("found", "id0", 2), "beta": ("found", "id1", 1), "twin": ("ambiguous", None, 2), "needle": ("found", "id4", 1), "": ("ambiguous", None, 7),
                   "zz": ("none", None, 0), "ab": ("found", "id5", 1), "l": ("ambiguous", None, 3), "漢": ("found", "id6", 1), "xn": ("found", "id4", 1)}


def test_references_are_rewritten_and_restored(spark):
    ident = "4a8611ec-ee1e-4d4d-a66e-76ae207d34ee"
    texts = spark.createDataFrame([(1, "a", "{{n1}} {{n1.output.text}} {{n2.x}} {{N1}} none"), (1, "b", "nothing"), (2, "a", "{{n1}}"), (1, "c", None)], "workflow_id long, node string, template string")
    ids = spark.createDataFrame([(1, "n1", ident), (1, "n1", "zzz"), (3, "n1", "other")], "workflow_id long, slug string, id string")
    got = {(r.workflow_id, r.node): r.rewritten for r in resolve.rewrite_refs(texts, ids).collect()}
    assert got == {(1, "a"): f"{{{{{ident}}}}} {{{{{ident}.output.text}}}} {{{{n2.x}}}} {{{{N1}}}} none", (1, "b"): "nothing", (2, "a"): "{{n1}}", (1, "c"): None}
    back = spark.createDataFrame([(1, "a", f"{{{{{ident}.output.text}}}} {{{{fileUp_1.output}}}} {{{{fileUp_1}}}} {{{{other.x}}}}")], "workflow_id long, node string, template string")
    names = spark.createDataFrame([(1, "fileUp_1", "fileup_1")], "workflow_id long, function_name string, slug string")
    assert resolve.restore_refs(back, ids, names).first()["restored"] == "{{n1.output.text}} {{fileup_1.output}} {{fileUp_1}} {{other.x}}"


def test_template_without_references_is_rendered(spark):
    texts = spark.createDataFrame([(1, "a", "plain"), (1, "b", "{{s.output.v}}!"), (1, "c", "{{s.output.w}}")], "workflow_id long, node string, template string")
    outs = spark.createDataFrame([(1, "s", "v", "val")], "workflow_id long, slug string, field string, value string")
    got = {r.node: (r.rendered, r.missing) for r in resolve.render_template(texts, outs).collect()}
    assert got == {"a": ("plain", ""), "b": ("val!", ""), "c": (None, "s.output.w")}


def test_slugs_are_linear_and_unique(spark):
    bases = ["a", "a", "a_2", "a", "a_2", "b"] + ["hot"] * 5000
    nodes = spark.createDataFrame([(1, i, b, "t") for i, b in enumerate(bases)], "workflow_id long, pos int, function_name string, type string")
    got = [r.slug for r in resolve.unique_slugs(nodes).orderBy("pos").collect()]
    assert got[:6] == ["a", "a_2", "a_2_2", "a_3", "a_2_3", "b"] and got[6:9] == ["hot", "hot_2", "hot_3"] and len(set(got)) == len(got)


def test_routes_stay_with_their_router(spark):
    rows = spark.createDataFrame([(1, "r0", "x"), (2, "r1", "x"), (3, "r9", "x")], "k int, src string, v string")
    edges = spark.createDataFrame([("r0", "a", "CONDITIONAL", 'v == "x"'), ("r1", "b", "CONDITIONAL", 'v == "y"'), ("r1", "c", "STATIC", None)], "src string, dst string, type string, condition string")
    got = {(r.k, r.dst) for r in resolve.route_rows(rows, edges, F.create_map(F.lit("v"), F.col("v"))).collect()}
    assert got == {(1, "a"), (2, "c")}


def test_references_come_in_document_order(spark):
    cfg = '{"z": "{{q.one}}", "{{key.no}}": 1, "a": ["x {{p.two}} \\"{{r.three}}\\""]}'
    rows = spark.createDataFrame([(1, "n", cfg), (1, "m", "not json {{a.b}}")], "workflow_id long, node string, config string")
    got = [(r.ref_no, r.slug, r.path) for r in checks.extract_variable_refs(rows).orderBy("ref_no").collect()]
    assert got == [(0, "q", "one"), (1, "p", "two"), (2, "r", "three")]


def test_types_may_be_lists(spark):
    snap = {"all_node_types": [{"type": "T", "config_json_schema": {"properties": {"f": {"type": ["string", "null"]}, "g": {"type": "integer"}}}}]}
    rows = spark.createDataFrame([(1, "a", "t", '{"f": "x", "g": 1.0}'), (1, "b", "t", '{"f": null, "g": 2}'), (1, "c", "t", '{"f": 3}')], "workflow_id long, slug string, type string, config string")
    got = [(r.node, r.message, r.suggestion) for r in contract.schema_rules(rows, snap).collect()]
    assert got == [("c", "3 is not of type 'string', 'null'", "Change the value to type ['string', 'null']")]


def test_schemas_share_definitions_and_alternatives(spark):
    snap = {"schema_definitions": {"N": {"type": "integer"}, "M": {"type": "string"}}, "all_node_types": [{"type": "T", "config_json_schema": {
        "$defs": {"M": {"type": "boolean"}}, "properties": {"a": {"$ref": "#/$defs/N"}, "b": {"$ref": "#/$defs/M"}, "c": {"anyOf": [{"type": "string"}, {"type": "number"}]}}}}]}
    rows = [(1, "ok", "t", '{"a": 1, "b": true, "c": 2}'), (1, "bad", "t", '{"a": "x", "b": "y", "c": []}')]
    got = {(r.node, r.field): (r.kind, r.suggestion) for r in contract.schema_rules(spark.createDataFrame(rows, "workflow_id long, slug string, type string, config string"), snap).collect()}
    assert got == {("bad", "a"): ("type", "Change the value to type 'integer'"), ("bad", "b"): ("type", "Change the value to type 'boolean'"), ("bad", "c"): ("anyOf", "Expected string or number")}


def test_small_fixes(spark):
    one = spark.range(1)
    times = {"2024-03-01T10:00:00+02:00": "2024-03-01 10:00", "2024-03-01T10:00:00Z": "2024-03-01 10:00", "2024-03-01": "2024-03-01 00:00", "later": "later", "2024-03-01 09:05:01.5-0530": "2024-03-01 09:05"}
    for raw, shown in times.items():
        assert one.select(tf.format_datetime(F.lit(raw))).first()[0] == shown, raw
    assert one.select(checks.path_confined(F.lit("\t\n"))).first()[0] is False
    cells = spark.createDataFrame([(1, 1, "t", 0, 0, None, None, False)], "table_id int, cell_no int, text string, r0 int, c0 int, r1 int, c1 int, header boolean")
    shapes = spark.createDataFrame([(1, 0, 1), (2, 1, 1)], "table_id int, num_rows int, num_cols int")
    assert {r.table_id: r.html for r in tables.cells_to_html(cells, shapes).collect()} == {1: "<table></table>", 2: ""}
    parts = spark.createDataFrame([(1, 1, ["e"], "", "m1", "{}", False, "a"), (1, 2, ["f"], "d2", "", "{}", False, "b"), (1, 3, ["g"], "d3", "m3", "{}", False, "c")],
                                  "doc_id int, start_page int, elements array<string>, doctags string, md string, json string, failed boolean, label string")
    r = outcomes.merge_page_batches(parts).first()
    assert (r.doctags, r.md) == ("d2\nd3", "m1\n\nm3")


def test_attempts_past_the_policy_and_the_deadline(spark):
    log = [(1, a, "http_503", 10 * a) for a in (1, 2, 3)] + [(1, 4, "success", 40)] + [(2, 1, "read_timeout", 0), (2, 2, "success", 2000)] + [(3, 1, "http_503", 0), (3, 2, "success", 50)]
    rows = spark.createDataFrame(log, "doc_id int, attempt int, result string, started_s int")
    got = {r.doc_id: (r.attempts_used, r.outcome, r.wait_s, r.n_past_policy) for r in outcomes.attempt_outcome(rows, deadline_s=1800).collect()}
    assert got == {1: (3, "exhausted", 90, 1), 2: (1, "timed_out", 0, 1), 3: (2, "success", 30, 0)}


def test_tasks_follow_the_input_and_change_no_row(spark):
    from quarry.session import ROWS_PER_TASK, tasks_for

    assert tasks_for(spark, 0) == spark.sparkContext.defaultParallelism and tasks_for(spark, 100 * ROWS_PER_TASK + 1) == 101
    defs = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c"), (None, 1, "d")], "workflow_id long, pos long, src string")
    ids = spark.createDataFrame([(1, 1, "x"), (1, 1, "y"), (2, 1, "z"), (None, 1, "w")], "workflow_id long, pos long, edge_id string")
    d, s = defs.select("workflow_id", F.col("src").alias("key")), spark.createDataFrame([(1, "a", "i"), (1, "q", "j"), (None, "d", "k"), (3, "r", "l")], "workflow_id long, key string, id string")
    texts = spark.createDataFrame([(1, "n", "{{a.output.t}} {{b.output.t}}"), (1, "m", "{{a.output.t}}"), (2, "n", "plain"), (None, "n", "{{a.output.t}}"), (3, "n", None)], "workflow_id long, node string, template string")
    outs = spark.createDataFrame([(1, "a", "t", "v"), (1, "a", "t", "u"), (None, "a", "t", "w")], "workflow_id long, slug string, field string, value string")
    for run in (lambda **k: resolve.pair_by_position(defs, ids, **k), lambda **k: resolve.snapshot_diff(d, s, **k), lambda **k: resolve.render_template(texts, outs, **k)):
        got = [sorted(map(repr, run(**k).collect())) for k in ({}, {"tasks": 3})]
        assert got[0] == got[1] and got[0]
