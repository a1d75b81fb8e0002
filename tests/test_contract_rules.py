"""Configs against schemas: renamed first, then at any depth."""

from quarry.operators import contract

NODES = "workflow_id long, slug string, type string, config string"


def test_config_is_renamed_before_the_check(spark):
    snap = {"all_node_types": [{"type": "LLM_CALL", "config_json_schema": {"required": ["model_name"], "properties": {"max_tokens": {"type": "integer", "exclusiveMinimum": 0}}}},
                               {"type": "AGENT", "config_json_schema": {"additionalProperties": False, "properties": {"model_name": {"minLength": 1}}}}]}
    rows = [(1, "a", "llm_call", '{"model":"m1","maxTokens":-5}'), (1, "b", "agent", '{"agent_name":"x","model":""}'), (1, "c", "agent", '{"model":"m","other":1,"more":2}'), (1, "d", "llm_call", "{}"), (1, "e", "llm_call", "[1]"),
            (1, "f", "llm_call", None), (1, "g", "nothing", "{}")]
    got = sorted(tuple(r) for r in contract.schema_rules(spark.createDataFrame(rows, NODES), snap).collect())
    assert got == sorted([
        (1, "a", "max_tokens", "exclusiveMinimum", "-5 is less than or equal to the minimum of 0", None),
        (1, "b", "model_name", "minLength", "'' should be non-empty", None),
        (1, "c", "(root)", "closed", "Additional properties are not allowed ('more', 'other' were unexpected)", None),
        (1, "d", "(root)", "required", "'model_name' is a required property", "Add the required field 'model_name' to your LLM_CALL config")])


def test_nested_and_recursive_schemas(spark):
    tree = {"type": "object", "required": ["id"], "properties": {"id": {"type": "integer"}, "kids": {"type": "array", "maxItems": 2, "items": {"$ref": "#/$defs/Tree"}}}}
    snap = {"schema_definitions": {"Tree": tree, "Tag": {"type": "string"}}, "all_node_types": [{"type": "T", "config_json_schema": {
        "$defs": {"Tag": {"enum": ["x", 1, None, True]}}, "properties": {"root": {"$ref": "#/$defs/Tree"}, "tags": {"items": {"$ref": "#/$defs/Tag"}}, "map": {"additionalProperties": {"type": ["number", "null"]}, "properties": {"s": {"pattern": "^a"}}},
                                                                         "all": {"allOf": [{"$ref": "#/$defs/Tag"}]}, "any": {"anyOf": [{"type": "string"}, {"$ref": "#/$defs/Tree"}]}, "k": {"const": 3}}}}]}
    config = ('{"root": {"id": 1, "kids": [{"id": "2"}, {"kids": [{"id": 4.0, "kids": [{}, {"id": 5}, {"id": 6}]}]}]}, "tags": ["x", 1, null, true, "y", 2, false], '
              '"map": {"s": "b", "a.b": 1, "n": null, "t": "no"}, "all": "z", "any": 3, "k": 4}')
    got = {(r.field, r.kind): r.message for r in contract.schema_rules(spark.createDataFrame([(1, "a", "t", config)], NODES), snap).collect()}
    assert got == {
        ("root.kids.0.id", "type"): "'2' is not of type 'integer'", ("root.kids.1", "required"): "'id' is a required property", ("root.kids.1.kids.0.kids", "maxItems"): got["root.kids.1.kids.0.kids", "maxItems"],
        ("root.kids.1.kids.0.kids.0", "required"): "'id' is a required property", ("tags.4", "enum"): "'y' is not one of ['x', 1, None, True]", ("tags.5", "enum"): "2 is not one of ['x', 1, None, True]",
        ("tags.6", "enum"): "False is not one of ['x', 1, None, True]", ("map.s", "pattern"): "'b' does not match '^a'", ("map.t", "type"): "'no' is not of type 'number', 'null'",
        ("all", "enum"): "'z' is not one of ['x', 1, None, True]", ("any", "anyOf"): "3 is not valid under any of the given schemas", ("k", "const"): "3 was expected"}
    assert got["root.kids.1.kids.0.kids", "maxItems"].endswith("is too long")


def test_empty(spark):
    assert contract.schema_rules(spark.createDataFrame([], NODES)).collect() == []


def test_levels_are_staged_as_columns(spark):
    import glob

    from quarry.session import ensure_checkpoint_dir

    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    snap = {"all_node_types": [{"type": "T", "config_json_schema": {"properties": {"a": {"type": "integer"}, "free": {}}}}]}
    before = set(glob.glob(f"{folder}/staged-*"))
    got = contract.schema_rules(spark.createDataFrame([(1, "a", "t", '{"a": "x", "free": {"b": 1}}'), (1, "b", "other", '{"a": "x"}')], NODES), snap).collect()
    assert [(r.node, r.field, r.kind) for r in got] == [("a", "a", "type")]
    counts = sorted(spark.read.parquet(p).count() for p in set(glob.glob(f"{folder}/staged-*")) - before)
    assert counts == [0, 1, 1]  # neither the type without a schema nor the place without rules


def test_a_value_is_read_once_for_all_rules(spark):
    """Type, text and keys of a value are read beside it, not by every rule that meets it; rows of one node are settled together."""
    snap = {"all_node_types": [{"type": "T", "config_json_schema": {"required": ["a", "b"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 1, "enum": [2, 3]}}}}]}
    rows = [(1, "x", "t", '{"a": 0}'), (1, "x", "t", '{"c": 1}'), (None, "y", "t", '{"a": 2}'), (2, "z", "t", '{"a": 2, "a": 3}'), (3, "w", "t", "[]")]
    found = contract.schema_rules(spark.createDataFrame(rows, NODES), snap)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schema_of_variant") <= 2 * plan.count("Union") + 2
    got = sorted((r.workflow_id or 0, r.field, r.kind) for r in found.collect())
    assert got == sorted(2 * [(1, "(root)", "closed"), (1, "(root)", "required"), (1, "a", "enum"), (1, "a", "minimum")] + 2 * [(0, "(root)", "required")])
