import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.llm import fingerprint


def edited(rows):
    """Brute force: rows in doc_id order (null first, then text), each with its edit."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for i, (d, t) in enumerate(rows):
        n = len(t) // 2
        yield d, t, t[: len(t) - n] + rows[(i + 1) % len(rows)][1][:n]


@pytest.mark.parametrize("bucket", [2000, 3])
def test_edits_and_equality(docs, hard_docs, monkeypatch, bucket):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", bucket)
    got = fingerprint.edit_report(docs).collect()
    want = sorted((str(d), len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, e in edited(hard_docs))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == want
    by_text = {}
    for d, t in hard_docs:
        by_text.setdefault(t or "", set()).update(r.fingerprint for r in got if r.doc_id == d)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({min(v) for v in by_text.values()}) == len(by_text)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert all((r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint) or r.near_edited > 0.99 for r in got)
    tall = [r for r in got if r.n_chars > 300 and r.n_chars < 5000]
    assert sum(r.near_edited > r.near_next for r in tall) > 0.9 * len(tall)


def test_order_does_not_matter_and_members_can_be_moved(spark):
    a, b, c = "one fine line.", "two fine lines. And more.", "three"
    rows = [(0, f"{a}\n{b}\n{c}"), (1, f"{c}\n{a}\n{b}"), (2, f"{a}\n{b}"), (3, c), (4, f"{a}\n{a}\n{b}")]
    lanes = fingerprint.lanes_of(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text"), "lanes").select("doc_id", "lanes")
    got = {r.doc_id: r.lanes for r in lanes.collect()}
    assert got[0] == got[1] and got[2] != got[4]
    two = lanes.where("doc_id = 2").select(F.col("lanes").alias("x")).crossJoin(lanes.where("doc_id = 3").select(F.col("lanes").alias("y")))
    r = two.select(fingerprint.add_lanes(F.col("x"), F.col("y")).alias("sum"), "x", "y")
    r = r.withColumn("back", fingerprint.remove_lanes(F.col("sum"), F.col("y"))).first()
    assert r["sum"] == got[0] and r["back"] == got[2]


def test_no_python_and_empty(docs, no_docs):
    assert fingerprint.edit_report(no_docs).collect() == []
    plan = fingerprint.edit_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_many_equal_lines_do_not_wrap(spark):
    rows = [(0, "\n".join(["ab"] * 65_536)), (1, "\n".join(["cd"] * 65_536)), (2, "\n".join(["ab"] * 20_000)), (3, "")]
    got = {r.doc_id: r for r in fingerprint.edit_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len({r.fingerprint for r in got.values()}) == 4
    assert got[0].near_next < 0.3 and got[2].near_edited > 0.6
