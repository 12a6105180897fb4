"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import resident, sample_by_hash, spare

BUCKETS, DIM, GRAMS = 1 << 15, 12, (1, 2, 3, 4)


@functools.cache
def _letters() -> np.ndarray:
    """Code point to itself if it is a letter, else to a blank; for the first plane."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], np.uint64)


def codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points; every run of other signs is one blank."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    far = c >= 0x10000
    out = _letters()[np.where(far, 32, c)]
    if far.any():
        at = np.flatnonzero(far)
        out[at] = [x if chr(x).isalpha() else 32 for x in c[at].tolist()]
    blank = out == 32
    return out[np.concatenate([[True], ~(blank[1:] & blank[:-1])])] if len(out) else out


def grams(c: np.ndarray, starts: int | None = None) -> np.ndarray:
    """Buckets of all grams of 1 to 4 signs that hold a letter; starts: of those that begin at the first so many signs."""
    found = []
    for n in GRAMS:
        if len(c) < n:
            break
        h = np.full(len(c) - n + 1, n, np.uint64)
        for j in range(n):
            h = (h ^ c[j : len(c) - n + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h = h[:starts]
        found.append((h & np.uint64(BUCKETS - 1)).astype(np.int32)[c[: len(h)] != 32] if n == 1 else (h & np.uint64(BUCKETS - 1)).astype(np.int32))
    return np.concatenate(found) if found else np.empty(0, np.int32)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket's embedding times the softmax weights: a gram's share of each language's logit
    bias: np.ndarray
    temperature: float
    floor: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether the prediction is rejected."""
        c = codes(text) if text else np.empty(0, np.uint64)
        if not len(self.langs) or not (c != 32).any():
            return "und", 0.0, True
        total, n = np.zeros(len(self.langs)), 0
        for a in range(0, len(c), 200_000):  # a gram is read with the piece that it begins in
            g = grams(c[a : a + 200_000 + 3], 200_000)
            total += self.table[g].sum(0, dtype=np.float64)
            n += len(g)
        z = (total / n + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.langs[k], float(p[k]), bool(p[k] < self.floor)


def fit(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 4.0, seed: int = 3) -> Model:
    """rows: (text, language). A fifth of them is held back to set the temperature and the floor of rejection."""
    rows = [(t, la) for t, la in rows if t and la]
    langs = sorted({la for _, la in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    r = np.random.default_rng(seed)
    sets, ys = [], []
    for t, la in rows:
        c = codes(t)
        for _ in range(2):  # a stretch of the text, so that short texts are met in training
            n = int(r.integers(20, 400))
            a = int(r.integers(0, max(1, len(c) - n)))
            g = grams(c[a : a + n])
            if len(g):
                sets.append(g)
                ys.append(langs.index(la))
    y = np.array(ys)
    order = r.permutation(len(sets))
    held, own = order[: len(order) // 5], order[len(order) // 5 :]
    E, W, b = r.normal(0, 0.1, (BUCKETS, DIM)), r.normal(0, 0.3, (DIM, len(langs))), np.zeros(len(langs))
    weight = len(y) / (len(langs) * np.maximum(1, np.bincount(y, minlength=len(langs))))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(r.permutation(own), max(1, len(own) // 32)):
            lens = np.array([len(sets[i]) for i in batch])
            idx = np.concatenate([sets[i] for i in batch])
            mean = np.add.reduceat(E[idx], np.concatenate([[0], np.cumsum(lens)[:-1]])) / lens[:, None]
            z = mean @ W + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p *= np.minimum(weight[y[batch]], 5)[:, None] / len(batch)
            back = np.repeat((p @ W.T) / lens[:, None], lens, 0)
            W -= 0.1 * step * mean.T @ p
            b -= 0.1 * step * p.sum(0)
            for d in range(DIM):
                E[:, d] -= 10 * step * np.bincount(idx, back[:, d], BUCKETS)
    table = (E @ W).astype(np.float32)
    z = np.array([table[sets[i]].mean(0) for i in held]) + b if len(held) else np.zeros((0, len(langs)))

    def shares(t: float) -> np.ndarray:
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    temperature, floor = 1.0, 0.0
    if len(held):
        loss = lambda t: -np.log(np.maximum(shares(t)[np.arange(len(held)), y[held]], 1e-12)).mean()
        temperature = min(np.geomspace(0.2, 5, 30), key=loss)
        p = shares(temperature)
        right = p.max(1)[p.argmax(1) == y[held]]
        floor = min(0.5, float(np.quantile(right, 0.001))) if len(right) else 0.0
    return Model(langs, table, b, float(temperature), floor)


def train(docs: DataFrame, sample_rows: int = 4000, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on about sample_rows rows with a text and a language, taken by a hash of their id; of each three
    stretches of 600 signs. Rows without language are not used; an empty table gives a model that rejects all."""
    start = "least(greatest(length({0}) - 600, 0), length({0}) div 2) + 1".format(text)
    stretch = F.expr(f"concat(substring({text}, 1, 600), ' ', substring({text}, {start}, 600), ' ', right({text}, 600))")
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = sample_by_hash(known, id, sample_rows).select(F.xxhash64(F.col(id)).alias("k"), stretch.alias("t"), F.col(lang).alias("la"))
    return fit([(r["t"], r["la"]) for r in sorted(rows.collect())])


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred, score and lang_rejected, from the whole text alone.

    Null texts and texts without a letter are `und`, score 0, rejected. Columns with these names are replaced; others
    stay as they are. Repeated rows get the same answer each."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows of one number a language

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        resident()
        for part in parts:
            yield pd.DataFrame([shared.value.predict(t) for t in part], columns=["lang_pred", "score", "lang_rejected"])

    # not deterministic to the planner, so that a filter on what it gives does not run it a second time
    udf = F.pandas_udf(run, "lang_pred string, score double, lang_rejected boolean").asNondeterministic()
    kept = docs.drop("lang_pred", "score", "lang_rejected")
    found = spare(kept, "found")
    return kept.withColumn(found, udf(F.col(text))).select("*", f"{found}.*").drop(found)
