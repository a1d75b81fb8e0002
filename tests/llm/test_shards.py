from quarry.llm import shards
from quarry.llm.common import stage  # noqa: F401


def check(rows, got, n):
    """Contiguous key ranges, gapless slots, and boundaries that no other cut improves."""
    size = lambda t: len((t or "").encode()) + 1
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted((str(d), t or "") for d, t in rows)
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [key((r.doc_id,)+(r.text,))[:2] for r in order] == sorted(key((r.doc_id, r.text))[:2] for r in got)
    for s in range(n):
        assert [r.slot for r in order if r.shard == s] == list(range(sum(r.shard == s for r in got)))
    assert all(r.size == size(r.text) for r in got)
    by_id = {}
    for d, t in rows:
        by_id[key((d, t))[:2]] = by_id.get(key((d, t))[:2], 0) + size(t)
    cuts, below = [0], 0
    for k in sorted(by_id):
        below += by_id[k]
        cuts.append(below)
    total = below
    for j in range(1, n):
        mine = sum(r.size for r in got if r.shard < j)
        assert abs(mine - total * j / n) == min(abs(c - total * j / n) for c in cuts)


def test_shards_match_brute_force(docs, hard_docs):
    for n, part in ((8, 64 << 20), (3, 5_000)):
        got = shards.shard_by_bytes(docs, n, tolerance=0, range_bytes=part).collect()
        check(hard_docs, got, n)


def test_sparse_keys_and_one_row(spark, no_docs):
    rows = [(d, "t" * (i % 17)) for i, d in enumerate([-(2**63), -5, 0, 3, 10**6, 10**12, 2**62, 2**63 - 2, *range(1000, 1100)])]
    got = shards.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 5, tolerance=0).collect()
    check(rows, got, 5)
    assert len(shards.shard_by_bytes(spark.createDataFrame(rows[:1], "doc_id long, text string"), 8).collect()) == 1
    assert shards.shard_by_bytes(no_docs, 8).collect() == []


def test_rows_of_one_id_are_cut(spark):
    """A third of the bytes has no id and a third is one repeated row: shards stay equal to a row's bytes."""
    rows = [(None, f"text {i:03}") for i in range(100)] + [(5, "same 000")] * 100 + [(1000 + i, f"text {i:03}") for i in range(100)]
    got = shards.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8, tolerance=0).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(d), t) for d, t in rows)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    for s in range(8):
        mine = [r for r in got if r.shard == s]
        assert abs(sum(r.size for r in mine) - 300 * 9 / 8) <= 9
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
