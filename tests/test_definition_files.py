"""The YAML/JSON data source: rows, rejects with their lines, many documents, hostile files."""

import json

import pytest

from quarry.sources import definition_files as df

GOOD = """name: Ünï flow
version: 2
tags: [a, b]
entry: in
exit: out
nodes:
  in: {type: plain_txt_input, execution_mode: INPUT, label: "In 漢"}
  out:
    type: llm_call
    config:
      template: |
        one {{in.output.text}}
        ---
        two
      topK: 3
      due: 2024-01-31
edges:
  - {from: in, to: out}
  - from: out
    to: in
    type: RECURSIVE
    condition: "x > 1"
"""
BOMB = "a: &a [x,x,x,x,x,x,x,x,x,x]\n" + "".join(f"{c}: &{c} [{','.join(['*' + p] * 10)}]\n" for p, c in zip("abcdefgh", "bcdefghi")) + "name: n\n"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("defs")
    (d / "good.workflow.yaml").write_text(GOOD)
    (d / "same.json").write_text(json.dumps({"name": "J", "entry": "a", "exit": "a", "nodes": {"a": {"type": "agent"}}, "edges": []}))
    (d / "cut.json").write_text('{"name": "J",\n "entry": }')
    (d / "scan.yaml").write_text("name: a\nentry: n1: x\n")
    (d / "list.yaml").write_text("- a\n- b\n")
    (d / "empty.yaml").write_text("")
    (d / "lacks.yaml").write_text("name: 5\nentry: a\nexit: a\nnodes:\n  a: {config: [1]}\n  7: {type: x}\nedges: [{from: a}, 3]\n")
    (d / "bomb.yaml").write_text(BOMB)
    (d / "loop.yaml").write_text("name: &a [*a]\n")
    (d / "deep.yaml").write_text("a: " + "[" * 3000 + "]" * 3000)
    (d / "bytes.yaml").write_bytes(b"name: \xff\xfe\nentry: [\n")
    (d / "two.yaml").write_text("name: a\n---\nname: b\n")
    (d / "_SUCCESS").write_text("")
    return d


def test_rows(spark, folder):
    rows = df.read_definitions(spark, str(folder)).cache()
    assert rows.count() == 12
    ok = {r.name: r for r in df.workflow_rows(rows).collect()}
    assert ok.keys() == {"Ünï flow", "J"}
    assert tuple(ok["Ünï flow"])[3:] == (2, ["a", "b"], "in", "out", 2, 2)
    nodes = {(r.name, r.slug): r for r in df.node_rows(rows).collect()}
    assert nodes["Ünï flow", "in"].label == "In 漢" and nodes["J", "a"].config == "{}"
    assert json.loads(nodes["Ünï flow", "out"].config) == {"template": "one {{in.output.text}}\n---\ntwo\n", "topK": 3, "due": "2024-01-31"}
    assert [(r.pos, r.src, r.dst, r.type, r.condition) for r in df.edge_rows(rows).orderBy("pos").collect()] == [(0, "in", "out", "STATIC", None), (1, "out", "in", "RECURSIVE", "x > 1")]
    bad = {r.file: r for r in df.reject_rows(rows).collect()}
    assert {f: (r.kind, r.line, r.col) for f, r in bad.items()} == {
        "cut.json": ("syntax", 2, 11), "scan.yaml": ("syntax", 2, 10), "list.yaml": ("schema", None, None), "empty.yaml": ("schema", None, None), "lacks.yaml": ("schema", None, None),
        "bomb.yaml": ("schema", None, None), "loop.yaml": ("schema", None, None), "deep.yaml": (bad["deep.yaml"].kind, None, None), "bytes.yaml": ("syntax", bad["bytes.yaml"].line, 1), "two.yaml": ("syntax", 2, 1)}
    assert bad["scan.yaml"].message == "mapping values are not allowed here"
    assert bad["lacks.yaml"].message.split("\n") == [
        "name: Input should be a valid string", "nodes -> a -> config: Input should be a mapping", "nodes -> a -> type: Field required", "nodes -> 7: Input should be a mapping under a string",
        "edges -> 0 -> to: Field required", "edges -> 1: Input should be a mapping"]
    texts = spark.read.text(str(folder), wholetext=True).selectExpr("regexp_extract(input_file_name(), '[^/]*$', 0) AS file", "value").where("file not like '\\\\_%'")
    again = df.parse_files(texts)
    assert sorted(map(str, again.select("file", "name", "nodes", "error").collect())) == sorted(map(str, rows.select("file", "name", "nodes", "error").where("file <> 'empty.yaml'").union(again.select("file", "name", "nodes", "error").where("file = 'empty.yaml'")).collect()))


def test_many_documents_and_groups(spark, tmp_path):
    plain = GOOD.replace("        ---\n", "")
    for i in range(5):
        (tmp_path / f"part-{i}.yaml").write_text("# first\n\n" * (i == 0) + "".join("---\n" + plain.replace("Ünï", f"w{i}{k}") if k != 2 else "--- {a: [}\n" for k in range(4)))
    rows = df.read_definitions(spark, f"file://{tmp_path}", many=True, group_bytes=1)
    assert rows.rdd.getNumPartitions() == 5
    assert df.workflow_rows(rows).count() == 15
    found = {(r.file, r.document): (r.kind, r.line, r.first_line) for r in df.reject_rows(rows).collect()}
    lines = plain.count("\n") + 1
    assert found[("part-1.yaml", 2)] == ("syntax", 1, 2 * lines + 1)
    assert len(found) == 6 and found[("part-0.yaml", 0)][0] == "schema"  # the comment before the first document
    assert df.read_definitions(spark, f"file://{tmp_path}", many=True).rdd.getNumPartitions() == 1
    with pytest.raises(Exception):
        df.read_definitions(spark, "/nowhere/at/all").collect()


PLAIN = [GOOD, "a: 1\nb: [x, 2.5, ~, yes, 0x1f, 1e3, 2024-01-31, 'q', \"\\u00e9\\n\"]\nc: {d: {e: []}}\n1: {2024-01-31: t}\na: again\n", "- a\n-\n  - b: \n", "just text", "|\n  block\n  text\n", "a: null\n~: b\n", "'': ''"]
OTHER = ["a: &x 1\nb: *x", "a: {<<: {b: 1}}", "a: !!str 1", "? [a]\n: b", "[" * 60 + "]" * 60, "", "# nothing", "a: 1\n---\nb: 2", "a: 2024-02-31", "a: =", "a: [", "a: b: c", "\x00"]


def outcome(text, by):
    try:
        return repr(by(text))
    except (df.Bad, df.yaml.YAMLError, ValueError, TypeError) as e:
        return type(e).__name__ if by is df.yaml.safe_load else "bad"


def test_plain_texts_are_read_from_events(monkeypatch):
    """Plain texts never build a node tree; all others give what the safe loader gives."""
    wanted = {t: outcome(t, df.yaml.safe_load) for t in PLAIN + OTHER}
    for t in OTHER:
        got = outcome(t, lambda x: df.load(x, False))
        assert got == wanted[t] or (got == "bad" and wanted[t].endswith("Error")), t
    monkeypatch.setattr(df.yaml, "load", None)
    monkeypatch.setattr(df.yaml, "safe_load", None)
    assert [outcome(t, lambda x: df.load(x, False)) for t in PLAIN] == [wanted[t] for t in PLAIN]


SIMPLE = ["name: a\nedges:\n- from: n1\n  to: 'it''s'\n-   from: x\n    to: \"a \\\"b\\\"\\n\"\n\nlast:\n", "a: {b: [1, 2.5, yes, 'x'], \"c\": {}, d: null}\nb:\n    c: 2024-01-31\n    d: http://x/y\na: again\n", "- a\n- b: 1\n  c:\n    - -5\n", "k: {n: \"{{n1.output.text}} \\\"x\\\"\"}"]
NOT_SIMPLE = ["a: b: c", "a: x #c", "a: |\n  b\n", "a: b\n  c", "a: [b, ]", "a: {b:1}", "a: &x 1", "a: \"\\u00e9\"", "a:\n\tb: 1", "? a", "a: [b: c]", "a: 1\n b: 2", "a: '", "---\na: 1", "-\n  - a", "a: {b}", "", "x"]


def test_simple_texts_are_read_line_by_line(monkeypatch):
    """They need no parser and give what it gives; all others are left to it."""
    for t in SIMPLE:
        assert repr(df._simple(t)) == repr(df.yaml.safe_load(t)), t
    for t in NOT_SIMPLE:
        with pytest.raises(df._Other):
            df._simple(t)
        assert outcome(t, lambda x: df.load(x, False)) in (outcome(t, df.yaml.safe_load), "bad"), t
    monkeypatch.setattr(df, "_plain", None)
    monkeypatch.setattr(df.yaml, "load", None)
    monkeypatch.setattr(df.yaml, "safe_load", None)
    assert [df.definition("f.yaml", 0, 1, t).get("error", {}).get("kind") for t in SIMPLE] == ["schema"] * 4
    good = df.definition("f.yaml", 0, 1, "name: n\nentry: a\nexit: b\nnodes:\n  a: {type: agent, config: {k: [1]}}\nedges:\n  - from: a\n    to: b\n")
    (batch,) = df._batches(iter([good, df.definition("g.yaml", 1, 9, "- x\n")]))
    assert batch.to_pylist()[0] == {f: good.get(f) for f in batch.schema.names} and batch.to_pylist()[1]["nodes"] is None
