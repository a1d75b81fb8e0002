import random
import re

import numpy as np
import pytest
import xxhash

from quarry.llm import simhash
from quarry.llm.components import components


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, bits=4):
    """Brute-force component (as smallest member) of each fingerprint."""
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def test_golay_words_at_distance_two_share_an_index():
    code, rng = simhash.golay(), np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000)
    masks = np.array([(1 << int(a)) | (1 << int(b)) for a, b in rng.integers(0, 23, (4000, 2))])
    for x, y in zip(code.indices(words), code.indices(words ^ masks)):
        assert set(x[x >= 0]) & set(y[y >= 0])
    assert ((code.indices(words) >= 0).sum(1).max(), (code.indices(words) >= 0).sum(1).min()) == (6, 1)


def test_every_four_bit_difference_shares_a_key():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 5)).astype(np.uint64)) for _ in fps])
    for x, y in zip(simhash.keys_of(fps), simhash.keys_of(fps ^ flips)):
        assert set(x[x >= 0].tolist()) & set(y[y >= 0].tolist())


def test_documents_match_brute_force(docs, hard_docs):
    got = simhash.near_duplicates(docs).collect()
    fps = [(d, slow_fingerprint(t)) for d, t in hard_docs]
    assert sorted((str(r.doc_id), r.fp % 2**64) for r in got) == sorted((str(d), f) for d, f in fps)
    root = groups([f for _, f in fps])
    lowest = {}
    for d, f in fps:
        if d is not None:
            lowest[root[f]] = min(d, lowest.get(root[f], d))
    assert all(r.component_id == lowest.get(root[r.fp % 2**64]) for r in got)
    assert {r.component_id for r in got if r.doc_id in (9, 500, 501)} == {9}


@pytest.mark.parametrize("bucket", [4096, 20])
def test_dense_groups_and_chains(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)]
    centre = rng.getrandbits(64)
    fps += [centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(400)]  # a dense ball
    chain = rng.getrandbits(64)
    for i in range(15):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        fps.append(chain)
    fps = sorted(set(fps))
    rows = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    links = simhash.link(rows)
    if bucket == 4096:  # forests, not pairs
        assert links.count() < 30 * len(fps)
    got = {r.node % 2**64: r.root % 2**64 for r in components(links).collect()}
    want = groups(fps)
    same = {}
    for f in fps:
        same.setdefault(got.get(f, f), set()).add(f)
    other = {}
    for f in fps:
        other.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, other.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 6), (7, 6)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
