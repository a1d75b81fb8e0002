"""W1/W2 against a brute-force Python greedy walk on small literal elements."""

import random

import pytest

from quarry.operators import chunk_udtf
from quarry.operators.chunking import chunk_documents


def brute(elements, max_tokens):
    out = {}
    for doc in sorted({e[0] for e in elements}):
        els = sorted([e for e in elements if e[0] == doc], key=lambda e: e[1])
        chunks, title, cur, acc, sec = [], None, [], 0, 0

        def flush():
            nonlocal cur, acc
            if cur:
                chunks.append((title, cur))
            cur, acc = [], 0

        for _, _, typ, text in els:
            if typ == "Title":
                flush()
                title = text if text != "" else None
                continue
            if text.strip() == "":
                continue
            cost = max(1, len(text) // 4)
            if cost > max_tokens:
                flush()
                chunks.append((title, [text], True))
                continue
            if cur and acc + cost > max_tokens:
                flush()
            cur.append(text)
            acc += cost
        flush()
        texts = []
        for c in chunks:
            t, parts = c[0], c[1]
            if len(c) == 3:
                body = parts[0]
                pieces = [body[i:i + 4 * max_tokens] for i in range(0, len(body), 4 * max_tokens)]
            else:
                pieces = ["\n".join(parts)]
            for p in pieces:
                txt = "\n".join([x for x in [t, p] if x is not None])
                if txt.strip():
                    texts.append(txt)
        out[doc] = texts
    return out


def test_chunks_match_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for doc in range(6):
        for pos in range(rnd.randint(1, 40)):
            typ = "Title" if rnd.random() < 0.15 else "NarrativeText"
            text = "" if rnd.random() < 0.05 else "x" * rnd.choice([1, 10, 60, 200, 700])
            rows.append((doc, pos, typ, text))
    df = spark.createDataFrame(rows, "doc_id long, pos int, type string, text string")
    for budget in (16, 64, 512):
        got = {}
        for r in chunk_documents(df, max_tokens=budget).orderBy("doc_id", "chunk_no").collect():
            got.setdefault(r.doc_id, []).append(r.text)
            assert r.tokens == max(1, len(r.text) // 4)
        exp = {k: v for k, v in brute(rows, budget).items() if v}
        assert got == exp, budget


def test_partition_count_invariance(spark):
    rows = [(d, p, "Title" if p % 5 == 0 else "NarrativeText", "y" * (p * 7 % 90)) for d in range(5) for p in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, type string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(chunk_documents(df, 32).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = sorted(chunk_documents(df, 32).collect())
    assert a == b


def test_headings_of_any_depth(spark, monkeypatch):
    """Window columns and the sorted pass give the same paths, and no level is folded into another."""
    from quarry.operators import chunking

    rng = random.Random(4)
    rows = [(d, p, "Title" if rng.random() < 0.5 else "NarrativeText", rng.choice(["", "A", "B", "C"]) + str(p % 7), rng.choice([None, 0, 1, 2, 5, 7, 8, 9, 20])) for d in range(12) for p in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, type string, text string, level int").repartition(5)
    want = {}
    for d in range(12):
        stack = []
        for _, p, kind, text, level in (r for r in rows if r[0] == d):
            if kind == "Title":
                stack = [s for s in stack if s[0] < max(1, level or 1)] + [(max(1, level or 1), text)]
            want[d, p] = " > ".join(t for _, t in stack if t) or None
    for most in (12, 3):
        monkeypatch.setattr(chunking, "WINDOW_LEVELS", most)
        got = chunking.section_path(df).collect()
        assert {(r.doc_id, r.pos): r.section_title for r in got} == want
        assert max(r.section_no for r in got) > 10


@pytest.mark.parametrize("budget, merge", [(20, True), (7, False)])
def test_table_function_equals_the_operator(spark, budget, merge):
    rng = random.Random(9)
    kinds, texts = ["Title", "NarrativeText", "NarrativeText", "ListItem"], ["short", "", " \u2003", "some words here " * 3, "x" * 300, "line\n" * 9, None]
    rows = [(d, p, rng.choice(kinds), rng.choice(texts), rng.choice([None, 1, 2, 3]), rng.choice([None, 4, 5])) for d in range(25) for p in range(rng.randint(0, 30))]
    df = spark.createDataFrame(rows, "doc_id long, pos int, type string, text string, level int, page_number int")
    chunk_udtf.register(spark)
    call = f"SELECT * FROM chunk_elements(TABLE({{e}}) PARTITION BY doc_id ORDER BY (pos), {budget}, {str(merge).lower()}, 'chars4')"
    got = spark.sql(call, e=df)
    want = chunk_documents(df, budget, merge).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_other_tokenizers(spark, monkeypatch):
    monkeypatch.setitem(chunk_udtf.TOKENIZERS, "letters", chunk_udtf.Tokenizer(len, lambda t, n: [t[i : i + n] for i in range(0, len(t), n)]))
    chunk_udtf.register(spark, "chunk_more")
    df = spark.createDataFrame([(1, 0, "Title", "T"), (1, 1, "P", "a b c d e"), (1, 2, "P", "f g")], "doc_id long, pos int, type string, text string")
    run = lambda budget, name: [(r.chunk_no, r.text, r.tokens) for r in spark.sql(f"SELECT * FROM chunk_more(TABLE({{e}}) PARTITION BY doc_id ORDER BY (pos), {budget}, true, '{name}')", e=df).orderBy("chunk_no").collect()]
    assert run(4, "words") == [(1, "T\na b c d", 5), (2, "T\ne", 2), (3, "T\nf g", 3)]
    assert run(5, "letters") == [(1, "T\na b c", 7), (2, "T\n d e", 6), (3, "T\nf g", 5)]
    with pytest.raises(Exception, match="unknown tokenizer"):
        run(4, "none")
