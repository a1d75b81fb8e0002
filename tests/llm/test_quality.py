import random

import numpy as np
import pytest

from quarry.llm import quality


def make(n, seed):
    """Good prose, and junk with symbols behind words; half of the junk looks like prose to one view."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 200))]
        if not good:
            words = [w + rng.choice(["***", "|", "&&&"]) for w in words]
        rows.append((i, " ".join(words), rng.choice(["en", "de", None]), f"src{rng.randint(0, 4)}", int(good)))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = make(600, 1)
    docs = spark.createDataFrame([(*r[:4], len(r[1]), 3, "x") for r in rows] + [(1000, None, None, None, 0, 1, "y"), (1001, "", "en", "s", 0, 1, "y"), (None, "text", "en", "s", 4, 1, "y"), (3, "again", "en", "s", 5, 1, "y"), (1002, "z" * 300_000, "en", "s", 300_000, 1, "y")],
                                 "doc_id long, text string, lang string, source string, n_chars long, score int, keep string")
    labels = spark.createDataFrame([(r[0], r[4], 0) for r in rows[:200]] + [(5, rows[5][4], 0), (None, 1, 0), (6, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_held_out_accuracy(tables):
    rows, docs, labels = tables
    got = quality.score_documents(docs, quality.train(docs, labels)).collect()
    assert len(got) == len(rows) + 5
    truth = {r[0]: r[4] for r in rows if r[0] >= 200}
    right = [r.keep == bool(truth[r.doc_id]) for r in got if r.doc_id in truth]
    assert np.mean(right) > 0.97
    assert all(0 <= x <= 1 for r in got for x in (r.text_score, r.record_score, r.score))


def test_exchanged_labels_help_each_view():
    """Two independent views and few labels: labels from the other view make each view better."""
    gain = []
    for seed in range(5):
        rng = np.random.default_rng(seed)
        y = (rng.random(1600) < 0.5).astype(int)
        xt = rng.normal(size=(1600, 30)) + np.outer(2 * y - 1, np.r_[np.full(10, 0.7), np.zeros(20)])
        xr = rng.normal(size=(1600, 12)) + np.outer(2 * y - 1, np.r_[np.full(4, 0.9), np.zeros(8)])
        seen = np.where(np.arange(1600) < 40, y, -1)
        models = [quality.co_train(xt[:1200], xr[:1200], seen[:1200], rounds) for rounds in (0, 4)]
        right = [[np.mean((v.score(x[1200:]) > 0) == (y[1200:] == 1)) for v, x in ((m.text, xt), (m.record, xr))] for m in models]
        gain.append(np.subtract(right[1], right[0]))
    assert (np.mean(gain, axis=0) > 0).all(), gain


def test_nothing_to_learn(spark, tables, no_docs):
    _, docs, labels = tables
    n = docs.count()
    assert all(r.keep for r in quality.score_documents(docs, quality.train(docs, labels.limit(0))).collect())
    one = quality.train(docs, spark.createDataFrame([(1, 0)], "doc_id long, quality int"))
    assert sum(not r.keep for r in quality.score_documents(docs, one).collect()) == n
    assert quality.score_documents(no_docs, quality.train(no_docs, labels)).collect() == []
