import random
import re

import pytest

from quarry.llm import licences
from quarry.llm.licences import NOTICES, PHRASES, Template

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, templates):
    """Every start against every template, word by word."""
    w, found = words(text), []
    for n, t in enumerate(templates):
        tw = words(t.text)
        for s in range(-len(tw), len(w)):
            same = [0 <= s + i < len(w) and w[s + i] == x for i, x in enumerate(tw)]
            keys = [words(k) for k in t.keys]
            spans = [next(i for i in range(len(tw)) if tw[i : i + len(k)] == k) for k in keys]
            if sum(same) >= t.share * len(tw) - 1e-9 and all(all(same[a : a + len(k)]) for a, k in zip(spans, keys)):
                found.append((n, t.label, max(0, s), min(len(w), s + len(tw)), sum(same) / len(tw)))
    return found


def shaken(rng, text):
    w = text.split(" ")
    for _ in range(rng.randint(0, 3)):
        w[rng.randrange(len(w))] = rng.choice(["the", "license", "X", "2.0", "mit"])
    return " ".join(w[rng.randint(0, 1) :])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    parts = [t.text for t in (*PHRASES, *NOTICES)]
    out = []
    for _ in range(150):
        out.append(" -- ".join(shaken(rng, rng.choice(parts)) if rng.random() < 0.7 else "the of any license mit apache é漢" for _ in range(rng.randint(1, 5))))
    return [*out, None, "", "...", "Under THE MIT-license under the mit license", "under the mİt license", "cc by nc " * 3000, "mit " * 50_000, out[0], out[0]]


def test_places_equal_brute_force(spark, texts):
    templates = (*PHRASES, *NOTICES)
    ids = [None if i % 17 == 0 else i // 2 for i in range(len(texts))]  # null and shared ids
    docs = spark.createDataFrame(list(zip(ids, texts, ["x"] * len(texts))), "doc_id long, text string, places string")
    got = sorted((str(r.doc_id), r.n_words, [tuple(p) for p in r.places]) for r in licences.scan(docs, templates).collect())
    short = {t: (brute(t, templates) if len(t or "") < 100_000 else []) for t in texts}
    assert got == sorted((str(i), len(words(t)), short[t]) for i, t in zip(ids, texts))


def test_report(spark):
    docs = spark.createDataFrame([(1, "x Under the MIT license, y. Licensed under CC BY-NC 4.0, under the mit license"), (2, None), (3, "Permission is hereby granted, free of charge, to any one obtaining a copy of this software and associated documentation files (the Software) to deal in the Software without restriction")], "doc_id long, text string")
    got = {r.doc_id: r for r in licences.report(licences.scan(docs), len(PHRASES)).collect()}
    assert tuple(got[1])[1:] == (17, 3, 1, 13, "cc-by-nc,mit", "cc-by-nc,mit", 1.0)
    assert tuple(got[2])[1:] == (0, 0, None, None, "", "", 0.0)
    assert got[3].base_labels == "" and got[3].labels == "mit" and 0.9 < got[3].score < 1


def test_entry_is_the_rarest_key_word(spark):
    index = licences.Index([Template("a", "one two three", ("one two",), 1.0)])
    index.weigh({"one": 9, "two": 3, "three": 0}, 10)
    assert [w for w, i in index.vocabulary.items() if i == index.templates[0].entry] == [b"two"]
    with pytest.raises(ValueError):
        licences.Index([Template("a", "one two", ("three",))])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licences.report(licences.scan(empty), len(PHRASES)).count() == 0
