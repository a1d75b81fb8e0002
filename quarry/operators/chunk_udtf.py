"""Chunking as a SQL table function, with the tokenizer and the merge rule as arguments.

    SELECT * FROM chunk_elements(TABLE(elements) PARTITION BY doc_id ORDER BY (pos), 512, true, 'chars4')

``elements(doc_id, pos, type, text[, level][, page_number])``. With ``chars4`` the
rows are those of ``chunking.chunk_documents``. Elements stream through in order:
a task holds the open chunk and the open headings of one document.

A tokenizer is two functions: the cost of a text, and its pieces of at most a
budget. ``TOKENIZERS`` has an estimate by characters and one by words; add others
before ``register``, which sends them along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from quarry.functions.text import WHITE_SPACE

RETURNS = "doc_id long, chunk_no int, text string, tokens int, section_title string, page_number int, chunk_type string"


@dataclass(frozen=True)
class Tokenizer:
    cost: Callable[[str], int]
    pieces: Callable[[str, int], list[str]]


def _by_words(text: str, budget: int) -> list[str]:
    words = text.split()
    return [" ".join(words[i : i + budget]) for i in range(0, len(words), budget)]


TOKENIZERS: dict[str, Tokenizer] = {
    "chars4": Tokenizer(lambda t: max(1, len(t) // 4), lambda t, n: [t[i : i + 4 * n] for i in range(0, len(t), 4 * n)]),
    "words": Tokenizer(lambda t: max(1, len(t.split())), _by_words),
}


def _handler(tokenizers: dict[str, Tokenizer]) -> type:
    class ChunkElements:
        def __init__(self):
            self.doc, self.number, self.headings = None, 0, []
            self.open: list[str] = []
            self.cost, self.page, self.title, self.settings = 0, None, None, None

        def eval(self, row: Row, max_tokens: int, merge_peers: bool, tokenizer: str) -> Iterator[tuple]:
            if self.settings is None:
                if tokenizer not in tokenizers:
                    raise ValueError(f"unknown tokenizer {tokenizer!r}, there are {', '.join(sorted(tokenizers))}")
                self.settings = max_tokens, merge_peers, tokenizers[tokenizer]
            self.doc = row["doc_id"]
            text, names = row["text"] or "", row.__fields__
            if row["type"] == "Title":
                yield from self._close()
                level = max(1, (row["level"] if "level" in names else None) or 1)
                self.headings = [h for h in self.headings if h[0] < level] + [(level, text)]
                return
            if not text.strip(WHITE_SPACE):
                return
            cost = self.settings[2].cost(text)
            if self.open and (not merge_peers or self.cost + cost > max_tokens):
                yield from self._close()
            self.open.append(text)
            self.cost = max_tokens + 1 if cost > max_tokens else self.cost + cost
            if self.page is None and "page_number" in names:
                self.page = row["page_number"]

        def terminate(self) -> Iterator[tuple]:
            yield from self._close()

        def _close(self) -> Iterator[tuple]:
            if not self.open:
                return
            max_tokens, _, tokenizer = self.settings
            body, title = "\n".join(self.open), " > ".join(t for _, t in self.headings if t) or None
            for part in tokenizer.pieces(body, max_tokens) if self.cost > max_tokens else [body]:
                text = part if title is None else f"{title}\n{part}"
                if text.strip(WHITE_SPACE):
                    self.number += 1
                    yield self.doc, self.number, text, tokenizer.cost(text), title, self.page, "text"
            self.open, self.cost, self.page = [], 0, None

    return ChunkElements


def register(spark: SparkSession, name: str = "chunk_elements") -> None:
    """Make the function callable from SQL, with the tokenizers known now."""
    spark.udtf.register(name, udtf(_handler(dict(TOKENIZERS)), returnType=RETURNS))
