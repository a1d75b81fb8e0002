import hashlib
import random
import re

import pytest

from quarry.llm import decontam

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window):
    wins = {}
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[a : a + window]), set()).add(i)
    for d, t in docs:
        w = words(t)
        hit, names = set(), set()
        for a in range(len(w)):
            for n in {len(x) for x in wins}:
                if tuple(w[a : a + n]) in wins and a + n <= len(w):
                    hit.update(range(a, a + n))
                    names.update(wins[tuple(w[a : a + n])])
        yield str(d), len(words(t)), len(hit), len(names), hashlib.sha256(",".join(sorted(str(n) for n in names if n is not None)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items(spark, hard_docs):
    texts = dict(hard_docs)
    a, long = words(texts[3]), words(texts[507])
    rows = [(1, " ".join(a[2:14])), (2, " ".join(a[5:40])), (10, "A, b! c"), (11, ""), (12, None), (13, "?!"), (14, " ".join(long[100:111]).upper()), (14, " ".join(long[29990:])),
            (None, "a b c"), (15, "never anywhere at all in these documents of ours here"), (16, "same row"), (17, "😀😀")]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows], "item_id long, text string, doc_id int, terms string")


@pytest.mark.parametrize("tokens,block", [(1_000_000, 16 << 20), (40, 60)])
def test_matches_brute_force(docs, hard_docs, items, monkeypatch, tokens, block):
    monkeypatch.setattr(decontam.build_index, "__defaults__", (tokens,))
    monkeypatch.setattr(decontam.matches, "__defaults__", (10, block))
    got = decontam.contamination(docs, items[1]).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(brute(hard_docs, items[0], 10))
    assert sum(r.contaminated for r in got) > 5


def test_matches_have_positions(docs, hard_docs, items):
    index = decontam.build_index(docs, 500)
    texts = dict(hard_docs)
    wanted = {i: words(t) for i, t in items[0] if i in (1, 10)}
    rows = [r for r in decontam.matches(index, items[1], 10).collect() if r.item_id in ("1", "10") and r.doc_id != 512]
    assert rows
    for r in rows:
        got = words(texts[r.doc_id])[r.start : r.stop]
        assert " ".join(wanted[int(r.item_id)][:3]) in " ".join(got)


def test_proximity_matches_brute_force(spark):
    docs = [(1, "red big apple falls far from the tree"), (2, "apple red"), (3, "red x x x x x x apple"), (4, "tree"), (5, None), (6, "apple apple red apple")]
    items = spark.createDataFrame([(1, "red apple"), (2, "tree far"), (3, "")], "item_id long, text string")
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"), 4)
    got = {(r.doc_id, r.item_id) for r in decontam.proximity(index, items, 3).collect()}
    assert got == {(1, "1"), (2, "1"), (6, "1"), (1, "2")}


def test_empty(docs, no_docs, items, hard_docs):
    assert decontam.contamination(no_docs, items[1]).collect() == []
    got = decontam.contamination(docs, items[1].limit(0)).collect()
    assert len(got) == len(hard_docs) and not any(r.contaminated for r in got)


def test_rows_that_share_an_id_stay_apart(spark):
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, "short"), (1, text), (None, "clean"), (None, text), (None, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (7, text)], "item_id long, text string")
    got = sorted((r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.contamination(docs, items).collect())
    assert got == [(1, 0, 0, False), (1, 0, 0, False), (3, 0, 0, False), (11, 11, 2, True), (11, 11, 2, True)]


@pytest.mark.parametrize("tokens", [10, 1_000_000])
def test_gathered_matches_brute_force(spark, tokens):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40)))) for i in range(150)]
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 7)))) for i in range(40)]
    want = set()
    for d, t in docs:
        for i, u in items:
            w, need = t.split(), set(u.split())
            width = 2 * len(u.split())
            if need and any(need <= set(w[s : s + width]) for s in range(len(w))):
                want.add((d, str(i)))
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string"), tokens)
    got = [(r.doc_id, r.item_id) for r in decontam.gathered(index, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_index_is_read_in_small_pieces(spark, monkeypatch):
    """Rows are packed and row groups small, so that a reader of a large file holds a few segments, not all."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(decontam, "GROUP_BYTES", 1 << 18)
    rng = random.Random(2)
    docs = [(i, " ".join("".join(rng.choices("abcdefghijkl", k=6)) for _ in range(5000))) for i in range(60)]
    index = decontam.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 5000)
    (file,) = index.inputFiles()
    parts = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert parts.num_rows == 60 and max(parts.row_group(i).total_byte_size for i in range(parts.num_row_groups)) < 1 << 19
    assert decontam.SEGMENT_TOKENS <= 1 << 17 and decontam.document_words(index).agg({"n_words": "sum"}).first()[0] == 300_000
