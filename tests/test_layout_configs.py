import json

from quarry.operators import configs, layout


def test_walk_order_loops_and_empty_text(spark):
    doc = {"body": {"children": [{"$ref": "#/groups/0"}, {"$ref": "#/nope"}, {"$ref": "#/texts/1"}, {"$ref": "#/pictures/0"}, {"$ref": "#/pictures/1"}, {"$ref": "#/tables/0"}]},
           "texts": [{"self_ref": "#/texts/0", "label": "title", "text": "T", "children": [{"$ref": "#/groups/0"}, {"$ref": "#/texts/1"}], "prov": [{"page_no": 3}, {"page_no": 4}]},
                     {"self_ref": "#/texts/1", "label": "text", "text": "", "orig": "O"}, {"self_ref": "#/texts/2", "label": "text", "text": ""}, {"self_ref": "#/texts/3", "label": "unknown", "text": "x"}],
           "pictures": [{"self_ref": "#/pictures/0", "label": "picture", "image": None}, {"self_ref": "#/pictures/1", "label": "chart", "image": {"uri": "data:image/png;base64,Qk==", "mimetype": "image/png"}}],
           "tables": [{"self_ref": "#/tables/0", "label": "table", "data": {"num_rows": 2, "num_cols": 1, "table_cells": [{"text": "a", "column_header": True}, {"text": "b", "start_row_offset_idx": 1, "end_row_offset_idx": 2}]}}],
           "groups": [{"self_ref": "#/groups/0", "label": "list", "children": [{"$ref": "#/texts/0"}, {"$ref": "#/texts/2"}, {"$ref": "#/texts/3"}]}]}
    rows = [(1, json.dumps(doc)), (2, None), (3, "{}"), (4, "no json")]
    got = layout.layout_to_elements(spark.createDataFrame(rows, "doc_id long, layout string")).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.type, r.text, r.page_number) for r in got] == [
        (1, 0, "Title", "T", 3), (1, 1, "NarrativeText", "O", None), (1, 2, "NarrativeText", "O", None), (1, 3, "Image", "", None), (1, 4, "Image", "", None),
        (1, 5, "Table", "| a |\n| --- |\n| b |", None)]
    assert (got[4].image_base64, got[4].filetype) == ("Qk==", "image/png") and got[3].image_base64 is None
    assert got[5].text_as_html == "<table><tr><th>a</th></tr><tr><td>b</td></tr></table>"


def test_rename_takes_the_later_of_two_keys(spark):
    rows = [(1, "a", "llm_call", '{"template": "x", "system_prompt": "y", "odd": [1]}'), (1, "b", "LLM_CALL", '{"system_prompt": "y", "template": "x"}'),
            (1, "c", "agent", '{"tools": [], "model": "m", "agentId": "q"}'), (1, "d", "other", '{"model": 1}'), (1, "e", "agent", "{}")]
    got = {(r.slug, r.key): r.value for r in configs.rename_config(spark.createDataFrame(rows, "workflow_id long, slug string, type string, config string")).collect()}
    assert got == {("a", "system_prompt"): '"y"', ("a", "odd"): "[1]", ("b", "system_prompt"): '"x"', ("c", "model_name"): '"m"', ("d", "model"): "1"}


def test_merge_prefers_parameters_and_drops_empty_references(spark):
    rows = [(1, "a", "agent", '{"agentId": "", "model": "p"}', '{"agent_id": "c", "model": "q", "maxTokens": 5, "max_tokens": 4}'),
            (1, "b", "retrieve", '{"knowledgeBaseId": []}', '{"knowledge_base_id": null, "knowledge_base_ids": ["k"]}'),
            (1, "c", "mystery", "{}", '{"type": "t", "keep": 1, "collapsed": true}'), (1, "d", "human_review", '{"instructions": "i", "review_prompt": "r"}', "{}")]
    got = {(r.slug, r.key): r.value for r in configs.merge_config(spark.createDataFrame(rows, "workflow_id long, slug string, type string, parameters string, config string")).collect()}
    assert got == {("a", "model"): '"p"', ("a", "agentId"): '"c"', ("a", "maxTokens"): "4", ("b", "knowledgeBaseId"): '["k"]', ("c", "keep"): "1", ("d", "review_prompt"): '"r"'}


def test_entries_are_read_once_and_grouped_where_they_are(spark):
    """Keys with quotes are keys; documents are moved to their node, not their entries."""
    rows = [(1, "a", "other", """{"it's": 1.50, "b\\"": "x"}"""), (1, "a", "other", '{"it\\u0027s": 1.50}'), (None, None, "other", '{"k": null}'), (2, "b", "other", '{"k": 1, "k": 2}'), (3, "c", "other", "[1]")]
    got = configs.rename_config(spark.createDataFrame(rows, "workflow_id long, slug string, type string, config string"))
    assert sorted((r.workflow_id or 0, r.key, r.value) for r in got.collect()) == [(0, "k", "null"), (1, 'b"', '"x"'), (1, "it's", "1.5"), (2, "k", None)]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 1
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_a_record_is_read_once_for_all_its_lists(spark, capsys):
    item = lambda text: {"self_ref": "#/x/0", "label": "text", "text": text}
    rows = [(1, json.dumps({"texts": [item("first"), item("second")], "tables": None, "pictures": [item("third")]})), (1, json.dumps({"groups": [{"self_ref": ""}]})), (None, json.dumps({"texts": [item("n")]})), (2, None)]
    got = layout.layout_items(spark.createDataFrame(rows, "doc_id long, layout string"))
    capsys.readouterr()
    got.explain()
    assert capsys.readouterr().out.count("from_json(") == 1
    assert {(r.doc_id, r.ref, r.item.text) for r in got.collect()} == {(1, "#/x/0", "third"), (None, "#/x/0", "n")}


def test_texts_are_written_once(spark):
    """The walk carries numbers and paths: what the job keeps on disk is about one copy of the texts, however deep they lie."""
    import glob
    import os
    import random

    from quarry.session import ensure_checkpoint_dir

    rng = random.Random(3)
    texts = [{"self_ref": f"#/texts/{i}", "label": "text", "orig": "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=5000)), "children": [{"$ref": f"#/texts/{i + 1}"}]} for i in range(12)]
    rows = [(d, json.dumps({"body": {"children": [{"$ref": "#/texts/0"}]}, "texts": texts})) for d in range(4)]
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(p) for p in glob.glob(f"{folder}/**", recursive=True) if os.path.isfile(p))
    before = size()
    got = layout.layout_to_elements(spark.createDataFrame(rows, "doc_id long, layout string")).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.text) for r in got] == [(d, i, t["orig"]) for d in range(4) for i, t in enumerate(texts)]
    assert size() - before < 1.5 * 4 * 12 * 5000


def test_parameters_are_read_once(spark):
    """Documents are parsed once; rows of one node share their parameters, and each has its own type, label and name."""
    rows = [(1, "a", "llm_call", "", '{"model": "m", "template": "to {{b.x}} and {{zz.y}}"}'), (1, "a", "plain_txt_input", "L", '{"placeholder": "p"}'), (1, "b-c", "retrieve", None, '{"knowledge_base_id": "k", "knowledge_base_ids": ["q"]}'),
            (2, "d", "agent", None, '{"model": 1, "model": 2}'), (None, "e", "plain_txt_input", None, '{"placeholder": 1.50}'), (3, "f", "mystery", None, "[1]")]
    nodes = spark.createDataFrame(rows, "workflow_id long, slug string, type string, label string, config string")
    ids = spark.createDataFrame([(1, "b", "id-b"), (1, "b", "id-c")], "workflow_id long, slug string, id string")
    got = configs.node_parameters(nodes, ids)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "parse_json" not in plan and "from_json" not in plan
    found = sorted((r.workflow_id or 0, r.slug, r.key, r.value or "none") for r in got.collect())
    three = lambda k, s, t, label: [(k, s, "type", t), (k, s, "label", label), (k, s, "function_name", f'"{s.replace("-", "_")}"')]
    assert found == sorted([
        *three(1, "a", '"llmPrompt"', '"a"'), *three(1, "a", '"plainTextInput"', '"L"'), (1, "a", "variables", "[]"), (1, "a", "model", '"m"'), (1, "a", "template", '"to {{id-b.x}} and {{zz.y}}"'),
        (1, "a", "prompt", '"p"'), (1, "a", "text", '""'), *three(1, "b-c", '"retrieve"', '"b-c"'), (1, "b-c", "knowledge_base_ids", '["k"]'),
        *three(2, "d", '"agent"', '"d"'), (2, "d", "model", "none"), *three(0, "e", '"plainTextInput"', '"e"'), (0, "e", "prompt", "1.5"), *three(3, "f", '"mystery"', '"f"')])
