"""Personal data: checked patterns plus a linear-chain conditional random field.

The patterns (email, ip, card, phone) give the base spans. The random field
labels white-space tokens with O, B-kind and I-kind from word-shape features
of the token and its neighbours; its spans that touch no base span are added.
It is trained from a small labelled table: windows around numbers and addresses in
a bounded sample of the documents, labelled by the base spans, copies with a
broken span (a wrong check digit, an octet over 255) labelled as nothing, pairs
of base spans side by side, and some written forms that the patterns do not
cover (``VARIANTS``).

A token without a digit or ``@`` is O by definition of the model. The other
tokens form short chains with O on both sides, independent of each other given
the words around them; training and Viterbi run over padded batches of chains.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hashed_sample

KINDS = ["email", "ip", "card", "phone"]
STATES = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
TRAIN_DOCS = 4000
TRAIN_ROWS = 3000
Span = tuple[int, int, int]  # start, kind number, end

# Patterns fixed by the task; a look-behind keeps the search linear where a run of
# characters cannot start a match once its first character did not.
_LOCAL = r"A-Za-z0-9._%+-"
_EMAIL = rf"[{_LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
EMAIL_AT = re.compile(_EMAIL)
EMAIL = re.compile(rf"(?<![{_LOCAL}]){_EMAIL}")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]+")
_NO_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while True:
        # right behind a match the look-behind would hide a start
        found = EMAIL_AT.match(text, at) if at else None
        found = found or EMAIL.search(text, at)
        if not found:
            return
        yield found.span()
        at = found.end()


def base_spans(text: str) -> list[Span]:
    """Pattern spans of a whole text, by start and then kind; offsets are code points."""
    spans = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _MARK.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = _NO_DIGITS.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_NO_DIGITS.sub("", m[0])) <= 15:
                    spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# Features ---------------------------------------------------------------------

_SHAPES = str.maketrans({**dict.fromkeys(map(chr, range(65, 91)), "A"), **dict.fromkeys(map(chr, range(97, 123)), "a"), **dict.fromkeys("0123456789", "d")})
_RUN = re.compile(r"(.)\1*", re.S)
_FOREIGN = re.compile(r"[^\x00-\x7f]")


def shape(word: str) -> tuple[str, str, int]:
    """(fine shape, coarse shape, class) of a token; class 0 has neither digit nor @, 1 has digits, 2 has @.

    Fine shapes keep run lengths up to 4 and whether check digits or octets hold; very long tokens keep their first and last 64 characters.
    """
    kind = 2 if "@" in word else 1 if any("0" <= c <= "9" for c in word) else 0
    short = word if len(word) <= 128 else word[:64] + word[-64:]
    plain = _FOREIGN.sub("a", short).translate(_SHAPES)
    coarse = _RUN.sub(r"\1", plain)
    fine = _RUN.sub(lambda m: m[1] + str(min(4, len(m[0]))), plain)
    if kind == 1:
        core = word.strip(".,;:!?()|\"'")
        digits = _NO_DIGITS.sub("", word)
        if coarse.strip(".,;:!?()|\"'") == "d.d.d.d":
            fine += "/octets" if all(p and len(p) <= 3 and int(p) <= 255 for p in core.split(".")) else "/broken"
        elif len(digits) > 11:
            fine += f"/{min(20, len(digits))}" + ("/luhn" if len(digits) < 20 and luhn(digits) else "/broken")
    return fine, coarse, kind


def chains(text: str) -> Iterator[tuple[list[tuple[int, int]], str, str]]:
    """Runs of tokens that have a digit or @, with the tokens before and after each run."""
    spans: list[tuple[int, int]] = []
    for m in _MARK.finditer(text):
        if spans and m.start() < spans[-1][1]:
            continue
        start, end = m.start(), m.end()
        low = spans[-1][1] if spans else 0
        while start > low and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        spans.append((start, end))
    run: list[tuple[int, int]] = []
    for span in [*spans, None]:
        if run and (span is None or text[run[-1][1] : span[0]].strip()):
            before = text[max(0, run[0][0] - 200) : run[0][0]].split()
            after = text[run[-1][1] : run[-1][1] + 200].split()
            yield run, before[-1] if before else "", after[0] if after else ""
            run = []
        if span:
            run.append(span)


# Labelled rows ----------------------------------------------------------------

# Written forms that the patterns leave out, and look-alikes that are nothing: (kind, text); each digit is replaced by rule.
VARIANTS = [
    ("", "2021-03-04"),
    ("", "12345 2021-03-04"),
    ("", "04.03.2021"),
    ("", "10:30"),
    ("", "3.14"),
    ("", "1,000,000"),
    ("", "90210"),
    ("", "5.6.7.999"),
    ("", "777.888.999.444"),
    ("phone", "(555) 010-4477"),
    ("phone", "555-010-4477"),
    ("phone", "555.010.4477"),
    ("phone", "0044 20 7946 0958"),
    ("email", "first.last@intranet"),
    ("email", "user7@mailhost"),
]


def _turned(text: str, step: int) -> str:
    return "".join(str((int(c) * 3 + step + i) % 10) if c.isdigit() else c for i, c in enumerate(text))


def labelled_windows(text: str, around: int = 60, most: int = 20) -> list[tuple[str, list[Span]]]:
    """Training rows from one text: a window around each of its first ``most`` chains, and again with a base span broken.

    Chains longer than ``40 * around`` characters give no training row (they are decoded like all others).
    """
    rows, base = [], base_spans(text)
    for at, _, _ in islice(chains(text), most):
        start, end = at[0][0], at[-1][1]
        if end - start > 40 * around:
            continue
        # whole tokens only
        low, high = max(0, start - around), min(len(text), end + around)
        while low and low < start and not text[low - 1].isspace():
            low += 1
        while high < len(text) and high > end and not text[high].isspace():
            high -= 1
        inside = [(s - low, k, e - low) for s, k, e in base if s >= low and e <= high]
        window = text[low:high]
        rows.append((window, inside))
        for s, k, e in inside:
            if k in (1, 2) and s >= start - low and e <= end - low:
                wrong = _broken(window[s:e], k)
                shift = len(wrong) - (e - s)
                kept = [(a + shift * (a >= e), q, z + shift * (a >= e)) for a, q, z in inside if z <= s or a >= e]
                rows.append((window[:s] + wrong + window[e:], kept))
    return rows


def _broken(span: str, kind: int) -> str:
    if kind == 1:
        return "9" + span.partition(".")[0][:2].rjust(2, "7") + "." + span.partition(".")[2]
    return span[:-1] + str((int(span[-1]) + 1) % 10)


def variant_rows(context: list[str], each: int = 40) -> list[tuple[str, list[Span]]]:
    """Rows with the ``VARIANTS`` between words of the sample."""
    words = [w for t in context for w in t.split() if w.isalpha()][: 4 * each * len(VARIANTS)] or ["the"]
    rows = []
    for v, (kind, form) in enumerate(VARIANTS):
        for i in range(each):
            at = (v * each + i) * 4 % max(1, len(words) - 4)
            left, right = " ".join(words[at : at + 2]), " ".join(words[at + 2 : at + 4])
            text = _turned(form, i) if kind else form
            rows.append((f"{left} {text} {right}", [(len(left) + 1, KINDS.index(kind), len(left) + 1 + len(text))] if kind else []))
    return rows


def pair_rows(rows: list[tuple[str, list[Span]]], most: int = 150) -> list[tuple[str, list[Span]]]:
    """Rows with two labelled spans side by side, which the patterns may take for one number and drop."""
    found = [(text[s:e], k) for text, spans in rows for s, k, e in spans]
    step = max(1, len(found) // 2)
    out = []
    for (a, j), (b, k) in islice(zip(found, found[step:] + found[:step]), most):
        out.append((f"see {a} {b} here", [(4, j, 4 + len(a)), (5 + len(a), k, 5 + len(a) + len(b))]))
    return out


# The random field ---------------------------------------------------------------

class Field:
    """Weights of the random field; feature 0 of each table is "never seen" and stays 0."""

    def __init__(self, fine: dict[str, int], coarse: dict[str, int]):
        s = len(STATES)
        self.fine, self.coarse = fine, coarse
        self.w = {"fine": np.zeros((len(fine) + 1, s)), "here": np.zeros((len(coarse) + 1, s)), "before": np.zeros((len(coarse) + 1, s)),
                  "after": np.zeros((len(coarse) + 1, s)), "kind": np.zeros((3, s)), "move": np.zeros((s, s))}

    def numbered(self, words: list[str]) -> np.ndarray:
        """(n, 5) feature numbers of a token sequence: fine, here, before, after, class."""
        shapes = [shape(w) for w in words]
        here = [self.coarse.get(c, 0) for _, c, _ in shapes]
        return np.array([(self.fine.get(f, 0), here[i], here[i - 1] if i else 0, here[i + 1] if i + 1 < len(here) else 0, k)
                         for i, (f, _, k) in enumerate(shapes)], np.int64).reshape(-1, 5)

    def chain(self, text: str, at: list[tuple[int, int]], before: str, after: str) -> np.ndarray:
        """Feature numbers of one chain, its neighbours on both sides included as context."""
        return self.numbered([before, *(text[a:b] for a, b in at), after])[1:-1]

    def emissions(self, x: np.ndarray) -> np.ndarray:
        w = self.w
        return w["fine"][x[..., 0]] + w["here"][x[..., 1]] + w["before"][x[..., 2]] + w["after"][x[..., 3]] + w["kind"][x[..., 4]]

    def viterbi(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best states of padded chains: ``e`` is (n, longest, states); each chain has O on both sides."""
        move = self.w["move"]
        score, back = e[:, 0] + move[0], np.zeros(e.shape, np.int8)
        for t in range(1, e.shape[1]):
            step = score[:, :, None] + move[None]
            back[:, t] = step.argmax(1)
            live = (t < sizes)[:, None]
            score = np.where(live, step.max(1) + e[:, t], score)
        state = (score + move[:, 0]).argmax(1)
        out = np.zeros(e.shape[:2], np.int8)
        rows = np.arange(len(e))
        for t in range(e.shape[1] - 1, -1, -1):
            live = t < sizes
            out[:, t] = np.where(live, state, 0)
            state = np.where(live & (t > 0), back[rows, t, state], state)
        return out


def train_field(rows: list[tuple[str, list[Span]]], epochs: int = 120, rate: float = 0.15, decay: float = 1e-3, longest: int = 24) -> Field:
    """Maximum likelihood with an L2 penalty by Adam on the chains of labelled ``(text, spans)`` rows."""
    data, shapes = [], []
    for text, spans in rows:
        for at, before, after in chains(text):
            at = at[:longest]
            labels = np.zeros(len(at), np.int64)
            for s, k, e in spans:
                inside = [i for i, (a, b) in enumerate(at) if a < e and b > s]
                labels[inside] = 2 + 2 * k
                labels[inside[:1]] = 1 + 2 * k
            data.append((text, at, before, after, labels))
            shapes += [shape(w) for w in (before, after, *(text[a:b] for a, b in at)) if w]
    field = Field({f: i + 1 for i, f in enumerate(dict.fromkeys(f for f, _, _ in shapes))}, {c: i + 1 for i, c in enumerate(dict.fromkeys(c for _, c, _ in shapes))})
    if not data:
        return field
    n, t = len(data), max(len(d[-1]) for d in data)
    x, y, live = np.zeros((n, t, 5), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for i, (text, at, before, after, labels) in enumerate(data):
        x[i, : len(labels)], y[i, : len(labels)], live[i, : len(labels)] = field.chain(text, at, before, after), labels, True
    m, v = ({k: np.zeros_like(w) for k, w in field.w.items()} for _ in range(2))
    for epoch in range(1, epochs + 1):
        grads = _gradients(field, x, y, live)
        for k, w in field.w.items():
            g = grads[k] / n + decay * w
            if k in ("fine", "here", "before", "after"):
                g[0] = 0
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w -= rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.99**epoch)) + 1e-8)
    return field


def _gradients(field: Field, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> dict[str, np.ndarray]:
    """Expected minus observed feature counts over all padded chains (scaled forward-backward)."""
    (n, t), s = y.shape, len(STATES)
    e, move = field.emissions(x), np.exp(field.w["move"])
    e = np.exp(e - e.max(axis=2, keepdims=True))
    forward, backward = np.zeros((n, t, s)), np.zeros((n, t, s))
    forward[:, 0] = move[0] * e[:, 0]
    for i in range(1, t):
        forward[:, i - 1] /= forward[:, i - 1].sum(1, keepdims=True)
        forward[:, i] = np.where(live[:, i, None], forward[:, i - 1] @ move * e[:, i], forward[:, i - 1])
    backward[:, t - 1] = move[:, 0]
    for i in range(t - 2, -1, -1):
        step = (e[:, i + 1] * backward[:, i + 1]) @ move.T
        step /= step.sum(1, keepdims=True)
        backward[:, i] = np.where(live[:, i + 1, None], step, move[:, 0])
    node = forward * backward
    node = node / node.sum(2, keepdims=True) * live[..., None]
    observed = (np.arange(s) == y[..., None]) & live[..., None]
    diff = (node - observed)[live]
    grads = {}
    for name, column in (("fine", 0), ("here", 1), ("before", 2), ("after", 3), ("kind", 4)):
        grads[name] = np.zeros_like(field.w[name])
        np.add.at(grads[name], x[live][:, column], diff)
    g = np.zeros((s, s))
    for i in range(1, t):
        right = e[:, i] * backward[:, i]
        z = ((forward[:, i - 1] @ move) * right).sum(1)
        on = live[:, i]
        g += (forward[on, i - 1] / z[on, None]).T @ right[on] * move
        np.add.at(g, (y[on, i - 1], y[on, i]), -1.0)
    last, rows = live.sum(1) - 1, np.arange(n)
    g[0] += (node[:, 0] - observed[:, 0]).sum(0)
    g[:, 0] += (node[rows, last] - observed[rows, last]).sum(0)
    grads["move"] = g
    return grads


def train_on(docs: DataFrame, max_docs: int = TRAIN_DOCS, max_rows: int = TRAIN_ROWS) -> Field:
    """Fit on at most ``max_rows`` windows from the ``max_docs`` documents that come first by hash of their id."""
    chosen = hashed_sample(docs.select("doc_id").where("doc_id is not null"), ["doc_id"], max_docs).distinct()
    few = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id", "left_semi")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(t, joined(s)) for text in b["text"] for t, s in labelled_windows(text)]
            yield pd.DataFrame(rows, columns=["text", "spans"])

    rows = few.mapInPandas(cut, "text string, spans string")
    rows = rows.orderBy(F.xxhash64("text"), "text", "spans").limit(max_rows).collect()
    found = [(r["text"], [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]) for r in rows]
    return train_field(found + variant_rows([t for t, _ in found[:400]]) + pair_rows(found))


# Finding ------------------------------------------------------------------------

_EDGE = {0: ".,;:!?()[]<>|\"'", 1: ".,;:!?()[]<>|\"'", 2: ".,;:!?()[]<>|\"'-", 3: ".,;:!?[]<>|\"'-"}


def _decoded(field: Field, texts: list[str]) -> list[list[Span]]:
    """Spans that the field finds in each text."""
    jobs = [(i, at, field.chain(text, at, before, after)) for i, text in enumerate(texts) for at, before, after in chains(text)]
    out: list[list[Span]] = [[] for _ in texts]
    jobs.sort(key=lambda j: len(j[1]))
    at = 0
    while at < len(jobs):
        stop = at + 1
        while stop < len(jobs) and (stop - at + 1) * len(jobs[stop][1]) <= 200_000:
            stop += 1
        part = jobs[at:stop]
        sizes = np.array([len(j[1]) for j in part])
        e = np.zeros((len(part), int(sizes.max()), len(STATES)))
        for r, (_, _, x) in enumerate(part):
            e[r, : len(x)] = field.emissions(x)
        for (i, spans, _), states in zip(part, field.viterbi(e, sizes)):
            for s, k, end in _entities(states[: len(spans)].tolist(), spans):
                while s < end and texts[i][s] in _EDGE[k]:
                    s += 1
                while end > s and texts[i][end - 1] in _EDGE[k] + (")(" if k == 3 else ""):
                    end -= 1
                if s < end:
                    out[i].append((s, k, end))
        at = stop
    return out


def _entities(states: list[int], spans: list[tuple[int, int]]) -> Iterator[Span]:
    start, kind = None, None
    for i, st in enumerate([*states, 0]):
        k = (st - 1) // 2 if st else None
        if start is not None and (k != kind or st % 2 == 1):
            yield spans[start][0], kind, spans[i - 1][1]
            start = None
        if st and start is None:
            start, kind = i, k


def find_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    out = []
    marked = [i for i, t in enumerate(texts) if _MARK.search(t)]
    extra = dict(zip(marked, _decoded(field, [texts[i] for i in marked])))
    for i, text in enumerate(texts):
        base = base_spans(text) if i in extra else []
        new = [x for x in extra.get(i, []) if not any(x[0] < e and x[2] > s for s, _, e in base)]
        out.append((base, sorted(base + new)))
    return out


def _slices(b: pd.DataFrame, size: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Row slices of about ``size`` characters."""
    ends = b["text"].str.len().cumsum() // size
    for _, part in b.groupby(ends.to_numpy(), sort=True):
        yield part


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """Per row: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``.

    Counts and digest are of the base spans; ``spans`` lists all spans and
    ``n_added`` how many of them the field added. Whole texts; null texts are
    empty; repeated rows are each reported; extra columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in _slices(b):
                rows = []
                for doc_id, (base, spans) in zip(part["doc_id"], find_spans(list(part["text"]), field)):
                    n = [sum(k == i for _, k, _ in base) for i in range(4)]
                    rows.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
                yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.mapInPandas(run, "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; null texts stay null, other columns stay."""

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts = [t or "" for t in b]
            out = []
            for text, (_, spans) in zip(texts, find_spans(texts, field)):
                parts, at = [], 0
                for s, k, e in spans:
                    if s >= at:
                        parts += [text[at:s], f"[{KINDS[k].upper()}]"]
                    at = max(at, e)
                out.append("".join(parts) + text[at:])
            yield pd.Series(out, dtype=object)

    return docs.withColumn("text", F.when(F.col("text").isNotNull(), cleaned(F.coalesce("text", F.lit("")))))
