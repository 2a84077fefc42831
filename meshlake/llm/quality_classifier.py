"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: single lower-cased words, and sequences of
one to three word shapes (letters, digits and other characters as one character
for each run; a word equal to the one before it has a shape of its own). All are
hashed to 2**bits cells. Each indicator is scaled by the log ratio of its
smoothed frequencies in the two classes, and a linear hinge-loss model is fitted
by dual coordinate descent. Margins become scores by a logistic curve fitted to
margins of models that did not see the rows.

The fit takes at most `max_rows` labels, those with the smallest hash of their id; scoring covers all rows and whole texts.

Nulls and odd cases: a null text counts as empty and gets the score of a text
without features; labels other than 0 and 1 are not learned from; without rows
of both classes the score is the share of label 1 learned from (0.5 without
any). An empty table gives an empty result. Repeated rows get equal scores.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import give_back
from .common import text_or_empty
from .textbytes import BASE, LOWER, chunks, distinct_pairs, mix, prefix_hashes, span_hashes, words

BITS = 18
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the distinct n-grams of every row."""
    starts, ends, rows = words(data, offsets)
    if not len(starts):
        return rows, rows
    word = span_hashes(prefix_hashes(LOWER[data]), starts, ends)
    shape = _SHAPE[data]
    keep = np.ones(len(shape), bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shape = span_hashes(prefix_hashes(shape[keep]), at[starts], at[ends])
    same = np.zeros(len(word), bool)
    same[1:] = (word[1:] == word[:-1]) & (rows[1:] == rows[:-1])
    shape = np.where(same, np.uint64(BASE), shape)
    found, of = [word, mix(shape)], [rows, rows]
    for n in (2, 3):
        if len(shape) >= n:
            gram = shape[: len(shape) - n + 1].copy()
            for k in range(1, n):
                gram = gram * np.uint64(BASE) + shape[k : len(shape) - n + 1 + k]
            inside = rows[: len(gram)] == rows[n - 1 :]
            found.append(mix(gram[inside] + np.uint64(n)))
            of.append(rows[: len(gram)][inside])
    return distinct_pairs(np.concatenate(of), np.concatenate(found) >> np.uint64(64 - BITS), BITS)


def _log_ratios(sets: list[np.ndarray], labels: np.ndarray, smooth: float) -> np.ndarray:
    counts = [np.bincount(np.concatenate([s for s, y in zip(sets, labels) if y == k] or [np.zeros(0, int)]), minlength=1 << BITS) + smooth for k in (0, 1)]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def fit_margins(sets: list[np.ndarray], labels: np.ndarray, cost: float, smooth: float, rounds: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of the cells, bias, and log ratios, by dual coordinate descent on scaled indicators, each row at unit length; rows of the rarer class weigh more."""
    ratio = _log_ratios(sets, labels, smooth)
    rng = np.random.default_rng(7)
    y = np.where(labels == 1, 1.0, -1.0)
    share = np.bincount(labels, minlength=2) / len(labels)
    limit = cost * 0.5 / share[labels]
    scaled = [ratio[s] / max(1e-9, np.sqrt((ratio[s] ** 2).sum())) for s in sets]
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(sets))
    square = np.array([(x**2).sum() + 1.0 for x in scaled])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(sets)):
            s, x = sets[i], scaled[i]
            gradient = y[i] * (w[s] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                moved = max(moved, abs(step))
                w[s] += step * x
                bias += step
                alpha[i] = new
        if moved < 1e-3:
            break
    return w * ratio, bias, ratio


@dataclass
class Scorer:
    """A fitted model: cell weights (already scaled), squared ratios for the length of a row, and the logistic curve."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, rows: np.ndarray, cells: np.ndarray, n: int) -> np.ndarray:
        length = np.sqrt(np.maximum(np.bincount(rows, self.squares[cells], n), 1e-18))
        margins = np.bincount(rows, self.weights[cells], n) / length + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -35, 35)))


def fit(sets: list[np.ndarray], labels: np.ndarray, cost: float = 4.0, smooth: float = 1.0, rounds: int = 12, folds: int = 3) -> Scorer:
    zero = np.zeros(1 << BITS)
    if len(set(labels.tolist())) < 2:
        p = float(labels.mean()) if len(labels) else 0.5
        return Scorer(zero, zero, 0.0, 0.0, float(np.log(max(p, 1e-6) / max(1 - p, 1e-6))))
    margins = np.zeros(len(sets))
    fold = np.arange(len(sets)) % folds
    for k in range(folds):
        seen = np.flatnonzero(fold != k)
        if len(set(labels[seen].tolist())) == 2:
            weights, bias, ratio = fit_margins([sets[i] for i in seen], labels[seen], cost, smooth, rounds)
            for i in np.flatnonzero(fold == k):
                margins[i] = weights[sets[i]].sum() / max(1e-9, np.sqrt((ratio[sets[i]] ** 2).sum())) + bias
    slope, shift = logistic(margins, labels)
    weights, bias, ratio = fit_margins(sets, labels, cost, smooth, rounds)
    return Scorer(weights, ratio**2, bias, slope, shift)


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve by Newton steps, with softened labels; the classes weigh the same."""
    n = np.bincount(labels, minlength=2)
    t = np.where(labels == 1, (n[1] + 1) / (n[1] + 2), 1 / (n[0] + 2))
    weight = 0.5 * len(labels) / n[labels]
    x = np.stack([margins, np.ones(len(margins))], 1)
    p = np.array([1.0, 0.0])
    for _ in range(50):
        s = 1 / (1 + np.exp(-np.clip(x @ p, -35, 35)))
        step = np.linalg.solve((x * (weight * s * (1 - s))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (s - t)))
        p -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(p[0], 1e-3)), float(p[1])


def _to_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch, "text"):
            rows, cells = features(data, offsets)
            at = np.searchsorted(rows, np.arange(b - a + 1))
            sets = [cells[at[i] : at[i + 1]].astype("<i4").tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(a, b - a), pa.array(sets, pa.binary())], ["label", "cells"])


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 6000) -> Scorer:
    """Fits to the rows of df with label 0 or 1 in labels: at most max_rows different labels, those with the smallest hash of their id, are broadcast and joined, and of each one row is collected, that with the least hash of its text."""
    key = F.col(id_col)
    chosen = labels.where(F.col(label_col).isin(0, 1) & key.isNotNull()).select(key.alias("id"), F.col(label_col).cast("int").alias("label")).distinct().orderBy(F.xxhash64("id"), "id", "label").limit(max_rows)
    texts = df.select(key.alias("id"), text_or_empty(text_col).alias("text"))
    one = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = one.select("label", "text").mapInArrow(_to_features, "label int, cells binary").collect()
    found.sort(key=lambda r: (r.label, r.cells))  # the same order for the same rows
    order = np.random.default_rng(11).permutation(len(found))
    return fit([np.frombuffer(found[i].cells, "<i4").astype(np.int64) for i in order], np.array([found[i].label for i in order], int))


def score(df: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of df."""
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            parts = [np.zeros(0)]
            for a, b, data, offsets in chunks(batch, "text"):
                parts.append(shared.value.scores(*features(data, offsets), b - a))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.concatenate(parts))], ["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(scored, f"id {kind}, score double")


def keep(df: DataFrame, scorer: Scorer, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df with at least this score, with all their columns, in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(scorer)
    at = [c.lower() for c in df.columns].index(text_col.lower())

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string()).fill_null("")], ["text"])
            for a, b, data, offsets in chunks(texts, "text"):
                good = shared.value.scores(*features(data, offsets), b - a) >= least
                yield batch.slice(a, b - a).filter(pa.array(good))
        give_back()

    return df.mapInArrow(kept, df.schema)
