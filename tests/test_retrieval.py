"""Retrieval against brute force: ties, equal vectors, both ways of meeting, pruning."""

import numpy as np
import pytest

from quarry.operators import retrieval


def brute(m, ids, q_ids, src, k, threshold, per_source):
    unit = m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) == 0, 1, n)
    at = {i: j for j, i in enumerate(ids)}
    out = []
    for q in q_ids:
        score = (unit * unit[at[q]]).sum(axis=1)
        for s in sorted(set(src)) if per_source else [None]:
            best = sorted((-score[j], ids[j], src[j]) for j in range(len(m)) if s is None or src[j] == s)
            out += [(q, r + 1, i, c) for r, (v, i, c) in enumerate([b for b in best if -b[0] >= threshold][:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(1200, 6))
    m[::2] = m[0]  # half of the vectors are one
    m[1::30] = 0
    m[3::40] = rng.integers(-1, 2, (len(m[3::40]), 6))
    ids = rng.permutation(1200).tolist()
    src = rng.integers(0, 3, 1200).tolist()
    corpus = spark.createDataFrame([(i, v.tolist(), s) for i, v, s in zip(ids, m, src)] + [(5000, None, 1)], "vec_id long, embedding array<double>, source int").repartition(4)
    q_ids = ids[::9]
    queries = spark.createDataFrame([(i, m[ids.index(i)].tolist()) for i in q_ids], "query_id long, embedding array<double>")
    return m, ids, src, q_ids, corpus, queries


@pytest.mark.parametrize("per_source", [False, True])
@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_equals_brute_force(spark, data, monkeypatch, per_source, limit):
    monkeypatch.setattr(retrieval, "SHARD_ROWS", 100)
    m, ids, src, q_ids, corpus, queries = data
    for k, threshold in ((5, 0.1), (3, -1.0)):
        got = retrieval.retrieve_top_k(queries, corpus, k, threshold, per_source, broadcast_bytes=limit).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.source) for r in got) == brute(m, ids, q_ids, src, k, threshold, per_source)


def test_empty(spark, data):
    *_, corpus, queries = data
    assert retrieval.retrieve_top_k(queries.limit(0), corpus).collect() == []
    assert retrieval.retrieve_top_k(queries, corpus.limit(0)).collect() == []


def test_blocks_are_pruned_and_state_is_bounded():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8))
    rows = retrieval._matrix(centres[rng.integers(20, size=5000)] + 0.02 * rng.normal(size=(5000, 8)))
    queries = rows[:200]
    search = retrieval.Search(np.arange(200), queries, retrieval.choose_pivots(rows[:500]), 5, 0.0, False)
    ids = np.arange(5000)
    assert list(search.batch(ids, np.zeros(5000, int), rows)) == []
    got = next(search.found()).sort_values(["query_id", "score"], ascending=[True, False])
    scores = queries @ rows.T
    want = -np.sort(-scores, axis=1)[:, :5]
    assert np.allclose(got["score"].to_numpy().reshape(200, 5), want)
    assert search.multiplied < 0.3 * (search.multiplied + search.skipped)
    equal = retrieval.Search(np.arange(10), queries[:10], queries[:1], 5, -1.0, False)
    list(equal.batch(ids, np.zeros(5000, int), np.repeat(rows[:1], 5000, axis=0)))
    assert len(next(equal.found())) == 50


def test_content(spark, data):
    *_, corpus, queries = data
    top = retrieval.retrieve_top_k(queries, corpus, 3, -1.0)
    store = corpus.where("vec_id % 2 = 0").selectExpr("vec_id", "concat('text ', vec_id) AS content", "map('source', string(source)) AS metadata")
    rows = retrieval.with_content(top, store).collect()
    assert len(rows) == queries.count()
    for r in rows:
        assert [x["rank"] for x in r.results] == [1, 2, 3]
        assert all(x.content == (f"text {x.vec_id}" if x.vec_id % 2 == 0 else None) for x in r.results)
