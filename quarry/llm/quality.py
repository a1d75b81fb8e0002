"""Quality classifier by co-training of a text view and a page-record view.

* Text view: hashed byte trigrams of the whole text (square roots of their
  shares).
* Record view: language, source, length and layout figures (line count and
  length, shares of letters, digits, symbols and space, word length, repeated
  words).

Both start from a bounded sample of labelled rows. In each round either view
labels the documents of an unlabelled pool that it is most sure of, and the
other view trains on them too. A part of the labelled rows is held back from
training: it calibrates each view (a logistic map of its score) and fits the
combination. Every document is scored from its whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hashed_sample

DIMS = 1024
LANGS, SOURCES = 16, 64
LABELLED, POOL = 3000, 3000
ROUNDS, SURE, SHARE = 4, 0.97, 0.1


def text_view(data: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams (zeros for fewer than three bytes)."""
    out = np.zeros(DIMS)
    for at in range(0, max(0, len(data) - 2), 1 << 20):
        part = data[at : at + (1 << 20) + 2].astype(np.uint32)
        key = (part[:-2] << 16 | part[1:-1] << 8 | part[2:]) * np.uint32(2654435761)
        out += np.bincount(key >> np.uint32(32 - 10), minlength=DIMS)
    return np.sqrt(out / max(1, len(data) - 2))


_CLASSES = np.zeros(256, np.int64)
_CLASSES[[c for c in range(256) if chr(c).isdigit() and c < 128]] = 1
_CLASSES[65:91] = 2
_CLASSES[97:123] = 3
_CLASSES[128:] = 4
_CLASSES[[9, 11, 12, 13, 32]] = 5
_CLASSES[10] = 6


def record_view(data: np.ndarray, n_chars: int, lang: str | None, source: str | None) -> np.ndarray:
    """Language and source (hashed), length and layout figures; null and unknown values are values of their own."""
    share = np.bincount(_CLASSES[data], minlength=7) / max(1, len(data))
    lines = share[6] * len(data) + 1
    spaces = share[5] * len(data) + lines
    words = data.tobytes().split()
    distinct = np.log1p(len(set(words))) / np.log(len(words) + 2)
    again = sum(map(eq, words, words[1:])) / (len(words) + 1)
    figures = [np.log1p(n_chars) / 10, np.log1p(lines) / 5, np.log1p(len(data) / lines) / 5, np.log1p(len(data) / spaces), *share[:6] * 4, distinct, again]
    one_hot = np.zeros(LANGS + SOURCES)
    one_hot[zlib.crc32(str(lang).encode()) % LANGS] = 0.5
    one_hot[LANGS + zlib.crc32(str(source).encode()) % SOURCES] = 0.5
    return np.concatenate([figures, one_hot])


def both_views(text: str | None, lang: str | None, source: str | None) -> tuple[np.ndarray, np.ndarray]:
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return text_view(data), record_view(data, len(text), lang, source)


@dataclass
class Linear:
    """Logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w + self.b


def fit(x: np.ndarray, y: np.ndarray, decay: float, steps: int = 80) -> Linear:
    """Accelerated gradient descent on the class-balanced log-loss with an L2 penalty."""
    mean, scale = x.mean(0), x.std(0) + 0.02 * max(1e-6, float(x.std()))
    z = ((x - mean) / scale).astype(np.float32)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
    v, top = np.ones(z.shape[1], np.float32), 1.0
    for _ in range(15):  # curvature bound by power iteration
        v = z.T @ (share * (z @ v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    rate = 1.0 / (0.25 * (top + 1) + decay)
    w, b = np.zeros(z.shape[1], np.float32), 0.0
    ahead_w, ahead_b = w, b
    for i in range(steps):
        p = _sigmoid(z @ ahead_w + ahead_b)
        g = share * (p - y)
        new_w, new_b = ahead_w - rate * (z.T @ g + decay * ahead_w), ahead_b - rate * float(g.sum())
        step = i / (i + 3)
        ahead_w, ahead_b = new_w + step * (new_w - w), new_b + step * (new_b - b)
        w, b = new_w, new_b
    return Linear(mean, scale, w.astype(float), float(b))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Unweighted logistic regression by Newton steps; a few columns, the last one constant."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) / len(y) + penalty * w
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move * min(1.0, 2.0 / (np.abs(move).max() + 1e-9))
    return w


@dataclass
class Model:
    """Two views, their calibration (slope, shift) and the combination; ``constant`` where there is nothing to learn."""

    text: Linear | None = None
    record: Linear | None = None
    calibration: np.ndarray | None = None
    combination: np.ndarray | None = None
    threshold: float = 0.5
    constant: float = 1.0

    def score(self, text: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: text view, record view, combined."""
        if self.text is None:
            same = np.full(len(text), self.constant)
            return same, same, same
        logits = [c[0] * v.score(x) + c[1] for v, x, c in ((self.text, text, self.calibration[0]), (self.record, record, self.calibration[1]))]
        both = np.column_stack([*np.clip(logits, -12, 12), np.ones(len(text))]) @ self.combination
        return _sigmoid(logits[0]), _sigmoid(logits[1]), _sigmoid(both)


def co_train(xt: np.ndarray, xr: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Fit on rows with labels 1 and 0 and a pool of rows with label -1 (rows in a fixed order)."""
    known, pool = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
    if len(set(y[known].tolist())) < 2:
        return Model(constant=float(y[known][0]) if len(known) else 1.0)
    held = known[np.arange(len(known)) % 4 == 3]
    start = np.setdiff1d(known, held)
    if len(set(y[held].tolist())) < 2 or len(set(y[start].tolist())) < 2:
        held, start = known, known
    rate = float((y[start] == 1).mean())
    learned = {0: (start, y[start]), 1: (start, y[start])}  # rows and labels of each view
    views, decay = (xt, xr), (0.02, 0.005)

    def trained(view: int) -> Linear:
        rows, labels = learned[view]
        return fit(views[view][rows], labels, decay[view])

    for _ in range(rounds):
        if not len(pool):
            break
        models = [trained(0), trained(1)]
        taken = []
        for view in (0, 1):
            # sure at the rate that holds for this view's held-back rows
            own = models[view].score(views[view][held])
            a, b = _logistic(np.column_stack([own, np.ones(len(held))]), y[held])
            p = _sigmoid(a * models[view].score(views[view][pool]) + b)
            most = max(1, int(SHARE * len(pool)))
            good = [i for i in np.argsort(-p, kind="stable")[: max(1, int(most * rate))] if p[i] >= SURE]
            bad = [i for i in np.argsort(p, kind="stable")[: max(1, int(most * (1 - rate)))] if p[i] <= 1 - SURE]
            new = np.array([*good, *bad], np.int64)
            labels = np.array([1] * len(good) + [0] * len(bad))
            rows, old = learned[1 - view]
            learned[1 - view] = (np.concatenate([rows, pool[new]]).astype(np.int64), np.concatenate([old, labels]).astype(y.dtype))
            taken.append(new)
        pool = np.delete(pool, np.unique(np.concatenate(taken)).astype(np.int64))
    model = Model(trained(0), trained(1))
    scores = [model.text.score(xt[held]), model.record.score(xr[held])]
    model.calibration = np.array([_logistic(np.column_stack([s, np.ones(len(held))]), y[held]) for s in scores])
    logits = [np.clip(c[0] * s + c[1], -12, 12) for c, s in zip(model.calibration, scores)]
    model.combination = _logistic(np.column_stack([*logits, np.ones(len(held))]), y[held])
    return model


def _views(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    for at in range(0, len(b), 1000):
        part = b.iloc[at : at + 1000]
        pairs = [both_views(t, lang, s) for t, lang, s in zip(part["text"], part["lang"], part["source"])]
        yield part, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])


def _plain(docs: DataFrame) -> DataFrame:
    """The columns read; a table without lang or source has null ones."""
    have = {c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")}
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *[v.alias(c) for c, v in have.items()])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = LABELLED, max_pool: int = POOL, rounds: int = ROUNDS) -> Model:
    """Fit on at most ``max_labelled`` labelled and ``max_pool`` other documents, chosen by hash of doc_id.

    Repeated labels of a document are averaged (a tie is good); null labels and
    ids are left out. One class only gives a constant model, no labels keep all.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id").where("doc_id is not null").distinct()
    named = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))

    def first(rows: DataFrame, n: int) -> list:
        return hashed_sample(rows, ["doc_id"], n).collect()

    chosen = [(r["doc_id"], r["y"]) for r in first(named.join(ids, "doc_id", "left_semi"), max_labelled)]
    if len({y for _, y in chosen}) < 2:
        return Model(constant=float(chosen[0][1]) if chosen else 1.0)
    chosen += [(r["doc_id"], -1) for r in first(ids.join(named, "doc_id", "left_anti"), max_pool)]
    sample = spark.createDataFrame(chosen, "doc_id long, y int")
    rows = docs.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi")  # at most max_labelled + max_pool ids

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, xt, xr in _views(b):
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "t": [v.astype("<f4").tobytes() for v in xt], "r": [v.astype("<f4").tobytes() for v in xr]})

    found = {int(r["doc_id"]): (r["t"], r["r"]) for r in _plain(rows).mapInPandas(features, "doc_id string, t binary, r binary").collect()}
    kept = [(d, y) for d, y in chosen if d in found]
    xt = np.array([np.frombuffer(found[d][0], "<f4") for d, _ in kept])
    xr = np.array([np.frombuffer(found[d][1], "<f4") for d, _ in kept])
    return co_train(xt, xr, np.array([y for _, y in kept]), rounds)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, text_score, record_score, score, keep`` of every row (whole texts; null texts are empty)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, xt, xr in _views(b):
                t, r, p = model.score(xt, xr)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "text_score": t, "record_score": r, "score": p, "keep": p >= model.threshold})

    got = _plain(docs).mapInPandas(run, "doc_id string, text_score double, record_score double, score double, keep boolean")
    return got.withColumn("doc_id", F.col("doc_id").cast("long"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model keeps; nothing moves between tasks."""

    @F.pandas_udf("boolean")
    def keep(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, lang, source in batches:
            b = pd.DataFrame({"text": text, "lang": lang, "source": source})
            yield pd.Series(np.concatenate([np.empty(0, bool), *(model.score(xt, xr)[2] >= model.threshold for _, xt, xr in _views(b))]))

    have = [F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("lang", "source")]
    return docs.where(keep(F.coalesce("text", F.lit("")), *have))
