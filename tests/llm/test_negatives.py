import random

import numpy as np
import pytest

from quarry.llm import negatives


def brute(rows):
    """All pairs, plainly."""
    table = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        table.append((vec_id, [int(np.floor(256.0 * float(np.float32(x)))) for x in v], label))

    def order(score, vec_id):
        return (-score, vec_id is None, vec_id or 0)

    out = []
    for i, (anchor, a, label) in enumerate(table):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(p * q for p, q in zip(a, v)), vec_id, lab) for j, (vec_id, v, lab) in enumerate(table) if j != i]
        near = sorted((order(s, r), s, r) for s, r, lab in scored if lab == label)[:5]
        for _, p, positive in near:
            far = sorted((order(s, r), s, r) for s, r, lab in scored if lab != label and 30 * p <= 100 * s <= 90 * p)[:10]
            out += [(anchor, positive, k + 1, r, p, s) for k, (_, s, r) in enumerate(far)]
    return out


def vectors(rng, n, d):
    centres = rng.normal(size=(12, d))
    out = []
    for i in range(n):
        v = centres[rng.integers(12)] + 0.3 * rng.normal(size=d)
        out.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(rng.integers(10))))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    rows = vectors(rng, 700, 8)
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(300)]  # one vector, many times
    rows += [(300, rows[5][1], 2), (300, rows[5][1], 2), (400, None, 1), (500, rows[1][1], None), (2000, [0.1, None] * 4, 1), (2001, [0.1, float("nan")] * 4, 1), (2002, [float("inf")] * 8, 1),
             (2100, [0.0] * 8, 3), (2200, [-0.5, 0.5], 4), (2201, [], 4), (None, rows[7][1], 5), (None, rows[7][1], 6), (2300, [1000.0] * 8, 2)]
    random.Random(1).shuffle(rows)
    return rows


def canon(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("shard, leaf", [(64, 16), (8192, 128)])
def test_equals_brute_force(spark, rows, shard, leaf, monkeypatch):
    monkeypatch.setattr(negatives, "SHARD", shard)
    real = negatives.packed
    monkeypatch.setattr(negatives, "packed", lambda v: real(v, shard, leaf))
    df = spark.createDataFrame([(*r, 1, "r") for r in rows], "vec_id long, embedding array<float>, label int, shard int, row string").repartition(3)
    got = [tuple(r) for r in negatives.hard_negatives(df).collect()]
    assert canon(got) == canon(brute(rows))
    assert len(got) > 200


def test_boxes_bound_their_rows_and_prune():
    rng = np.random.default_rng(1)
    n = 2000
    vectors = np.sort(rng.integers(-100, 100, size=(n, 2)), axis=0)
    tree = negatives.Tree(np.arange(n), np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64), vectors)
    anchor = np.array([3, 5])
    low, high = tree.bounds(anchor)
    scores = vectors @ anchor
    for leaf, s in enumerate(tree.slices):
        assert low[leaf] <= scores[s].min() and scores[s].max() <= high[leaf]
    opened = {}
    got = tree._window(anchor, -1, 0, True, (100, 300), 7, low, high, opened)
    want = sorted((-int(x), False, i, i) for i, x in enumerate(scores) if 100 <= x <= 300)[:7]
    assert got == want and len(opened) < len(tree.slices) / 3


def test_large_components_are_exact():
    big = np.array([[(1 << 26) + 1, 3], [(1 << 26) - 1, 5]], np.int64)
    tree = negatives.Tree(np.arange(2), np.arange(2), np.zeros(2, bool), np.zeros(2, np.int64), big)
    got = tree.search(big[0], -1, 0, True, [(-(2**62), 2**62)], 2)[0]
    assert [-g[0] for g in got] == sorted((int(a) * int(big[0][0]) + int(b) * int(big[0][1]) for a, b in big), reverse=True)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(df).collect() == []
    df = spark.createDataFrame([(100, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(df).collect() == []
