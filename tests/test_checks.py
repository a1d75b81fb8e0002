"""Reference extraction on hard texts, and white space."""

import json
import re
import time

from pyspark.sql import functions as F

from quarry.functions.text import strip_ws
from quarry.operators import checks

PAT = re.compile(r"\{\{([a-zA-Z0-9_-]+)\.([a-zA-Z0-9_.]+)\}\}")


def leaves(v):
    if isinstance(v, str):
        yield v
    elif isinstance(v, dict):
        for x in v.values():
            yield from leaves(x)
    elif isinstance(v, list):
        for x in v:
            yield from leaves(x)


def test_refs_of_any_string(spark):
    quoted = 'say "{{a.b}}" \\ "{{c.d}}": {{e.f}}\n' * 2000
    configs = [{"prompt": "x" * 1_000_000 + "{{n1.output.text}}"}, {"{{key.no}}": "{{yes.output}}", "list": ["{{l.one}}", {"k": "{{l.two}}"}], "n": 1.5, "t": True, "z": None},
               {"p": quoted}, {"p": "\\" * 4001 + "{{z.z}}", "q": ":", "r": "{{q.r}}"}, {"e": "", "f": "{{f.f}}"}, {}, {"p": "\\{{w.w}}\\"}]
    texts = [json.dumps(c) for c in configs] + [json.dumps(configs[1], indent=3).replace(":", " \t:"), '{"cut": "{{a.b}}', None, "[]", '"{{s.t}}"']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, config string")
    got = {}
    for r in checks.extract_variable_refs(df).orderBy("i", "ref_no").collect():
        got.setdefault(r.i, []).append((r.slug, r.path))
    want = {}
    for i, t in enumerate(texts):
        try:
            found = [m for s in leaves(json.loads(t)) for m in PAT.findall(s)] if t else []
        except ValueError:
            found = []
        if found:
            want[i] = found
    assert got == want


def test_strip_is_linear_and_whole(spark):
    blanks = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2003\u2028\u3000"
    rows = [(blanks + "a" + blanks + "b" + blanks,), (blanks,), ("",), (None,), ("a" + " " * 1_000_000 + "b ",)]
    df = spark.createDataFrame(rows, "t string").select(strip_ws(F.col("t")).alias("t")).cache()
    started = time.time()
    got = [r.t for r in df.collect()]
    assert got == ["a" + blanks + "b", "", "", None, "a" + " " * 1_000_000 + "b"]
    assert time.time() - started < 20


def test_refs_are_found_without_a_step_per_string(spark):
    """One pass of built-in functions over a config: no function is called for each of its strings."""
    df = spark.createDataFrame([(1, '{"{{k.k}}" : ["{{a.b}}{{c.d}}", {"x":"\\\\"}], "y":"\\"{{e.f}}:"}')], "i int, config string")
    refs = checks.extract_variable_refs(df)
    assert [(r.slug, r.path) for r in refs.orderBy("ref_no").collect()] == [("a", "b"), ("c", "d"), ("e", "f")]
    assert "lambda" not in refs._jdf.queryExecution().toString()


def test_config_rules_at_their_bounds_and_read_once(spark, capsys):
    rows = [("agent", '{"temperature": 2, "max_iterations": 0.5, "maxTokens": 1}'), ("agent", '{"temperature": -0.1, "max_iterations": 0}'), ("llm_call", '{"temperature": "NaN", "maxTokens": 0, "max_iterations": 0}'),
            ("retrieve", '{"topK": 0, "scoreThreshold": 1.1, "knowledge_base_name": ""}'), ("rag_agent", '{"agentId": "", "knowledgeBaseIds": []}'), ("rag_agent", "no json"), ("odd", '{"topK": 0}'), (None, '{"topK": 0}'), ("human_review", None)]
    df = spark.createDataFrame([(i, "s", t, c) for i, (t, c) in enumerate(rows)], "workflow_id int, slug string, type string, config string")
    got = checks.config_rules(df)
    per = {}
    for r in got.collect():
        per.setdefault(r.workflow_id, []).append(r.violation.split(" ")[0])
    assert {k: sorted(v) for k, v in per.items()} == {1: ["max_iterations", "temperature"], 2: ["maxTokens", "temperature"], 3: ["RETRIEVE", "scoreThreshold", "topK"], 4: ["RAG_AGENT", "RAG_AGENT"], 5: ["RAG_AGENT", "RAG_AGENT"], 6: ["unknown"]}
    # no filter on the generated arrays, which would make them twice
    for plan in (got, checks.extract_variable_refs(df), checks.removed_fields(df)):
        capsys.readouterr()
        plan.explain()
        assert "size(" not in capsys.readouterr().out
