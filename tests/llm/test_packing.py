import random
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(lengths, capacity):
    """Best-fit decreasing, one piece at a time: how full the windows are (equally open windows are interchangeable)."""
    windows = []
    for n in sorted((x for x, c in lengths.items() for _ in range(c)), reverse=True):
        fits = [(room, i) for i, (room, _) in enumerate(windows) if room >= n]
        if fits:
            room, i = min(fits)
            windows[i] = (room - n, windows[i][1] + [n])
        else:
            windows.append((capacity - n, [n]))
    return sorted(sum(w) for _, w in windows)


@pytest.mark.parametrize("seed", range(6))
def test_histogram_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = 40
    lengths = {n: rng.randint(1, 9) for n in rng.sample(range(1, capacity + 1), 20)}
    windows = {}
    ranks = {n: [] for n in lengths}
    for length, rank, count, sequence, each, offset in packing.best_fit(lengths, capacity):
        for i in range(count):
            windows.setdefault(sequence + i // each, []).append((offset + i % each * length, length))
            ranks[length].append(rank + i)
    assert all(sorted(r) == list(range(lengths[n])) for n, r in ranks.items())
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(sum(n for _, n in w) for w in windows.values()) == one_by_one(lengths, capacity)


def test_ids_are_the_tokenizers(hard_docs):
    tok = Tokenizer.from_file(PATH)
    texts = [t or "" for _, t in hard_docs] + ["a\x1cb c d e don't I'LL 12 ½x", "<|endoftext|> x<|startoftext|>y", "é ́ Σας ΟΔΟΣ"]
    rng = random.Random(9)
    letters = "aBcÀéßñÿ×÷ªº²½µ09.,'<|>-_ \n\u00a0\u00adŁł漢\u0301"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    for t, got in zip(texts, packing.encode(texts, PATH)):
        assert got == packing._id_bytes(tok.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("salt_rows", [250_000, 4])
def test_packed_pieces_hold_every_id_once(docs, hard_docs, monkeypatch, salt_rows):
    monkeypatch.setattr(packing, "RANK_ROWS", salt_rows)
    tok, capacity = Tokenizer.from_file(PATH), 64
    pieces, places = packing.pack_documents(docs, PATH, capacity)
    got = places.collect()
    want = []
    for d, t in hard_docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        want += [(str(d), s, len(ids[s : s + capacity]), zlib.crc32(packing._id_bytes(ids[s : s + capacity])), len(ids)) for s in range(0, len(ids), capacity)]
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted(want)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(windows) == list(range(len(windows)))
    lengths = {}
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
            lengths[n] = lengths.get(n, 0) + 1
        assert at <= capacity
    assert sorted(sum(n for _, n in w) for w in windows.values()) == one_by_one(lengths, capacity)


def test_whole_sequences(docs):
    pieces, _ = packing.pack_documents(docs, PATH, 64)
    packed = packing.pack(pieces.withColumn("crc", F.crc32("ids")), 64)
    rows = packing.sequences(packed, 64).collect()
    assert sum(r.tokens for r in rows) == sum(r.length for r in pieces.collect())
    assert all(len(r.ids) == 4 * (r.tokens if r.tokens & (r.tokens - 1) == 0 else 64) for r in rows)


def test_empty(no_docs):
    assert packing.pack_documents(no_docs, PATH)[1].collect() == []
