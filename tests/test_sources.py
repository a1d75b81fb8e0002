import datetime as dt

import pytest

from quarry.functions import text as tf
from quarry.operators import ingest, preflight, runs
from quarry.sources import definitions, files, sinks
from quarry.sources.registry import read_registry
from pyspark.sql import functions as F


def test_scan_files_feeds_ingest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"he\xffllo")
    (tmp_path / "sub" / "b.html").write_text("<h1>T</h1>")
    (tmp_path / "c.exe").write_bytes(b"x")
    got = files.scan_files(spark, str(tmp_path)).withColumn("doc_id", F.xxhash64("path"))
    assert {(r.filename, r.length) for r in got.collect()} == {("a.txt", 6), ("b.html", 10), ("c.exe", 1)}
    assert {(r.filename, r.type, r.text) for r in ingest.ingest_elements(got).collect()} == {("a.txt", "NarrativeText", "he\ufffdllo"), ("b.html", "Title", "T")}
    assert [r.filename for r in ingest.ingest_rejects(got).collect()] == ["c.exe"]


def test_definitions_and_event_files(spark, tmp_path):
    for name, text in (("ok.json", '{"workflow_id": 1}'), ("cut.json", '{"a":'), ("list.json", "[1]")):
        (tmp_path / name).write_text(text)
    ok, bad = definitions.scan_definitions(spark, str(tmp_path))
    assert [r.file.rsplit("/", 1)[1] for r in ok.collect()] == ["ok.json"]
    assert {r.file.rsplit("/", 1)[1]: r.reason for r in bad.collect()} == {"cut.json": "invalid JSON", "list.json": "not an object"}
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "run1.log").write_text('data: {"type":"RUN_STARTED"}\n\ndata: {"type":"RUN_FINISHED"}\n')
    lines = runs.scan_event_lines(spark, str(logs))
    assert [(r.run_id, r.event_type) for r in runs.parse_event_lines(lines).orderBy("seq").collect()] == [("run1", "RUN_STARTED"), ("run1", "RUN_FINISHED")]
    reg = tmp_path / "reg.json"
    reg.write_text('{"all_node_types": [{"type": "T", "status": null, "output_variables": [{"path": "o"}], "fields": [{"name": "f"}], "config_json_schema": {"type": "object"}}]}')
    r = read_registry(spark, str(reg)).first()
    assert (r.type, r.status, r.outputs, r.fields) == ("T", "active", ["o"], ["f"])


def test_id_maps_replace_only_their_workflows(spark, tmp_path):
    path = f"{tmp_path}/maps"
    frame = lambda rows: spark.createDataFrame(rows, "workflow_id long, kind string, key string, id string")
    sinks.save_id_map(frame([(w, "node", k, f"{w}{k}") for w in range(200) for k in "ab"]), path)
    sinks.save_id_map(frame([(3, "node", "c", "new"), (999, "edge", "a->b", "e")]), path)
    got = {(r.workflow_id, r.key): r.id for r in sinks.read_id_map(spark, path).collect()}
    assert len(got) == 200 * 2 and got[(3, "c")] == "new" and (3, "a") not in got and got[(4, "a")] == "4a" and got[(999, "a->b")] == "e"
    with pytest.raises(ValueError):
        sinks.save_id_map(frame([]), path, version=2)


def test_other_sinks(spark, tmp_path):
    out = spark.createDataFrame([("r", "n1", "v"), ("r", "../x", "v")], "run_id string, node_id string, value string")
    for _ in range(2):
        sinks.save_node_outputs(out, f"{tmp_path}/outs")
    assert [(r.node_id, r.path) for r in spark.read.json(f"{tmp_path}/outs").collect()] == [("n1", "n1/output.json")] * 2
    sinks.write_ndjson(spark.createDataFrame([('{"a":1}',)], "json string"), "json", f"{tmp_path}/nd")
    assert spark.read.json(f"{tmp_path}/nd").first()["a"] == 1


def test_preflight_and_freshness(spark):
    state = [("r1", "w", "RUNNING", "WAITING_FOR_REVIEW", "n", None, "rev"), ("r2", "w", "RUNNING", "WAITING_FOR_INPUT", "in", None, None), ("r3", "w", "completed", None, None, None, None)]
    states = spark.createDataFrame(state, "run_id string, workflow_id string, status string, execution_status string, current_node_id string, waiting_input_node_id string, review_node_id string")
    nodes = spark.createDataFrame([("w", "rev", "human_review"), ("w", "in", "plain_txt_input"), ("w", "rev2", "HUMAN_REVIEW")], "workflow_id string, node_id string, type string")
    subs = [(1, "review", "r1", "rev", True, False, False, None), (2, "review", "r1", "rev", True, True, None, "c"), (3, "review", "r1", "rev", False, True, None, ""),
            (4, "review", "r1", "rev2", True, None, None, None), (5, "review", "r1", "in", True, None, None, None), (6, "review", "r3", "rev", True, None, None, None),
            (7, "input", "r2", "in", None, None, None, None), (8, "input", "r2", "rev", None, None, None, None), (9, "input", "r1", "in", None, None, None, None),
            (10, "input", "r2", "zz", None, None, None, None), (11, "review", "gone", "rev", True, None, None, None)]
    frame = spark.createDataFrame(subs, "sub_id int, kind string, run_id string, node_id string, approve boolean, reject boolean, revise boolean, comment string")
    got = {r.sub_id: r.verdict for r in preflight.submission_preflight(frame, states, nodes).collect()}
    assert got == {1: "ok", 2: "one decision needed", 3: "comment needed", 4: "not paused for this review", 5: "not a review node", 6: "run has ended", 7: "ok",
                   8: "not waiting for this input", 9: "paused for review", 10: "node not found", 11: "run not found"}
    now = dt.datetime(2024, 1, 2)
    req = spark.createDataFrame([(k, None if k == "nohost" else "http://h/", now) for k in ("fresh", "old", "oldnofetch", "other", "none", "nohost")], "key string, host string, now timestamp")
    cache = spark.createDataFrame([("fresh", "http://h", now - dt.timedelta(hours=24), "c"), ("old", "http://h", now - dt.timedelta(hours=25), "c"), ("oldnofetch", "http://h", now - dt.timedelta(hours=99), "c"),
                                   ("other", "http://x", now, "c"), ("nohost", "http://h", now, "c")], "key string, host string, fetched_at timestamp, registry string")
    fetched = spark.createDataFrame([("fresh", "n"), ("old", "n"), ("other", "n")], "key string, registry string")
    assert {r.key: (r.source, r.registry) for r in preflight.registry_freshness(req, cache, fetched).collect()} == {
        "fresh": ("cache", "c"), "old": ("fetch", "n"), "oldnofetch": ("stale", "c"), "other": ("fetch", "n"), "none": ("none", None), "nohost": ("none", None)}


def test_error_details(spark):
    rows = [('{"detail":"d"}', 404), ('{"detail":{"detail":"e"}}', 400), ('{"error":{"message":"m"},"retry_after":"9"}', 429), (None, 500), ('{"retry_after":"x"}', 429)]
    got = spark.createDataFrame(rows, "body string, code int").select(tf.error_message(F.col("body"), F.col("code")).alias("m"), tf.retry_after(F.col("body"), F.col("code")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("d", None), ("e", None), ("m", 9), ("API request failed with status 500", None), ("API request failed with status 429", None)]
