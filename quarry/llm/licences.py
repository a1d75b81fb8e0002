"""Licence scans: a positional index of licence templates, entered by rare words.

A template is a licence notice as a list of words, with key phrases that no
copy may lack. Its index entry is the word of its key phrases that is rarest
over all scanned files (highest IDF). For each file:

1. its licence words are looked up, highest IDF first; a word opens the
   templates that it is the entry of, if the file has all their key words;
2. each place of the entry word lines the template up with the file (place
   minus posting); the lists of the template's other words are intersected at
   the same relative position, which gives the share of words in place;
3. a line-up counts if every key phrase stands in full and the share reaches
   the template's own.

The entry word is part of a key phrase, so no counting line-up is missed.
Whether a line-up counts does not depend on the IDF; that only chooses where
the search starts.

Words are runs of ASCII letters, digits and all code points from U+0080 on,
A-Z lower-cased. Null and empty texts have no words and no places. Rows are
scanned one by one: repeated rows, shared and null ids are each reported, ties
do not arise, other columns of the input are not read, an empty table gives no
rows. A text is held by one task as a whole; line-ups are compared in blocks of
bounded size. Nothing but one count per licence word is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 0.8
#: Templates travel to the tasks with the function that uses them.
MAX_TEMPLATE_BYTES = 32 << 20
CELLS = 1 << 20  # words compared at a time

_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

PLACES = "array<struct<template:int,label:string,start:long,stop:long,share:double>>"
_PLACE = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())]))


@dataclass(frozen=True)
class Template:
    """A notice, its key phrases (each a part of the text) and the share of words that must be in place."""

    label: str
    text: str
    keys: tuple[str, ...]
    share: float = SHARE


# Phrases that are reported as such, each in full.
PHRASES = [
    Template("mit", "under the mit license", ("under the mit license",), 1.0),
    Template("apache-2", "apache license version 2", ("apache license version 2",), 1.0),
    Template("cc-by-nc", "cc by nc", ("cc by nc",), 1.0),
]

# Wording of well-known licence notices.
NOTICES = [
    Template("mit", "Released under the MIT License", ("MIT License",), 0.8),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("Permission is hereby granted, free of charge", "without restriction")),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", ("Apache License, Version 2.0",)),
    Template("apache-2", "SPDX-License-Identifier: Apache-2.0", ("License-Identifier: Apache-2.0",)),
    Template("mit", "SPDX-License-Identifier: MIT", ("License-Identifier: MIT",)),
    Template("gpl", "licensed under the GNU General Public License, version", ("GNU General Public License",)),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("GNU General Public License",)),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("GNU Lesser General Public License",)),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("GNU Affero General Public License",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("Redistribution and use in source and binary forms",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License, v. 2.0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution 4.0",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("Creative Commons Attribution-ShareAlike",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("Creative Commons Attribution-NonCommercial",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("CC BY-NC",)),
    Template("cc0", "has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related",)),
    Template("all-rights-reserved", "All rights reserved", ("All rights reserved",), 1.0),
]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPLIT).split()


class Compiled:
    """One template as numbers: its words and which of them belong to a key phrase."""

    def __init__(self, number: int, template: Template, vocabulary: dict[bytes, int]):
        words = words_of(template.text)
        self.number, self.label = number, template.label
        self.words = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64)
        key = np.zeros(len(words), bool)
        for phrase in template.keys:
            part = words_of(phrase)
            at = next((i for i in range(len(words) - len(part) + 1) if words[i : i + len(part)] == part), None)
            if at is None or not part:
                raise ValueError(f"{phrase!r} is no part of {template.text!r}")
            key[at : at + len(part)] = True
        if not key.any():
            raise ValueError(f"{template.text!r} has no key phrase")
        self.key = np.flatnonzero(key)
        self.least = math.ceil(template.share * len(words) - 1e-9)

    def enter(self, idf: np.ndarray) -> None:
        """Choose the entry: the key word of highest IDF, the first of equals."""
        self.at = int(self.key[np.argmax(idf[self.words[self.key]])])
        self.entry = int(self.words[self.at])
        self.needs = np.unique(self.words[self.key])


class Index:
    """Templates under their entry words."""

    def __init__(self, templates: Sequence[Template]):
        if sum(len(t.text) for t in templates) > MAX_TEMPLATE_BYTES:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_BYTES} characters: scan with a part of them at a time")
        self.vocabulary: dict[bytes, int] = {}
        self.templates = [Compiled(i, t, self.vocabulary) for i, t in enumerate(templates)]
        self.weigh({}, 0)

    def weigh(self, files_with: dict[str, int], files: int) -> None:
        """Set the IDF of every licence word and choose the entries."""
        self.idf = np.array([math.log((files + 1) / (files_with.get(w.decode("utf-8", "surrogatepass"), 0) + 1)) for w in self.vocabulary])
        self.entries: dict[int, list[Compiled]] = {}
        for t in self.templates:
            t.enter(self.idf)
            self.entries.setdefault(t.entry, []).append(t)

    def places(self, words: list[bytes]) -> list[dict]:
        """Every line-up that counts, by template and start."""
        known = self.vocabulary.get
        file = np.fromiter((known(w, -1) for w in words), np.int64, len(words))
        at = np.flatnonzero(file >= 0)
        if not len(at):
            return []
        at = at[np.argsort(file[at], kind="stable")]
        have, first = np.unique(file[at], return_index=True)
        lists = dict(zip(have.tolist(), np.split(at, first[1:])))
        found = []
        for word in have[np.argsort(-self.idf[have], kind="stable")].tolist():
            for t in self.entries.get(word, ()):
                if np.isin(t.needs, have, assume_unique=True).all():
                    found += self._line_up(t, file, lists[word] - t.at)
        return sorted(found, key=lambda p: (p["template"], p["start"]))

    def _line_up(self, t: Compiled, file: np.ndarray, starts: np.ndarray) -> Iterator[dict]:
        for block in np.array_split(starts, max(1, len(starts) * len(t.words) // CELLS)):
            spots = block[:, None] + np.arange(len(t.words))[None, :]
            inside = (spots >= 0) & (spots < len(file))
            same = inside & (file[np.where(inside, spots, 0)] == t.words[None, :])
            hits = same.sum(axis=1)
            for i in np.flatnonzero(same[:, t.key].all(axis=1) & (hits >= t.least)).tolist():
                start = int(block[i])
                yield {"template": t.number, "label": t.label, "start": max(0, start), "stop": min(len(file), start + len(t.words)), "share": int(hits[i]) / len(t.words)}


def word_frequencies(docs: DataFrame, index: Index) -> tuple[dict[str, int], int]:
    """In how many files each licence word occurs, over all files; and their number.

    One partial count per task and word is shuffled; the driver gets at most
    one row per licence word.
    """
    vocabulary = frozenset(index.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, files = dict.fromkeys(vocabulary, 0), 0
        for b in batches:
            for text in b.column(0):
                files += 1
                for w in vocabulary.intersection(words_of(text.as_py())):
                    seen[w] += 1
        yield pa.RecordBatch.from_pydict({"word": [None, *(w.decode("utf-8", "surrogatepass") for w in seen)], "n": pa.array([files, *seen.values()], pa.int64())},
                                         schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts, counts.pop(None, 0)


def scan(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *NOTICES)) -> DataFrame:
    """``doc_id, n_words, places`` for every row of ``docs`` (``doc_id, text``).

    ``places`` is an array of (template number, label, first word, word after
    the last, share of words in place), by template and first word.
    """
    index = Index(templates)
    index.weigh(*word_frequencies(docs, index))
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, places = [], []
            for text in b.column(1):
                words = words_of(text.as_py())
                sizes.append(len(words))
                places.append(index.places(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(places, _PLACE)], names=["doc_id", "n_words", "places"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n_words long, places {PLACES}")


def report(places: DataFrame, base: int) -> DataFrame:
    """One row of counts and labels per scanned file; the first ``base`` templates are the base phrases."""
    def labels(spots: F.Column) -> F.Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spots, lambda p: p["label"]))), ",")

    mine = F.filter("places", lambda p: p["template"] < base)
    starts = F.transform(mine, lambda p: p["start"])
    return places.select(
        "doc_id", "n_words", F.size(mine).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(mine).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))
