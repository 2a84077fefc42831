"""Language identification by nearest centroids.

A text becomes a vector of byte n-grams (two and three bytes of lower-cased
text, runs of ASCII characters other than letters as one space) hashed to a
fixed number of cells, as square roots of counts times inverse document
frequencies, at unit length. Each language has several centroids, found by
clustering its rows on the sphere. A text gets the language of the centroid
with the largest cosine; if that lies below what nearly all rows of this
centroid reach in the fit, the text is marked as rejected.

The fit takes at most `per_language` different rows of each language, those with
the least hashes of id and text; prediction covers all rows and whole texts.

Nulls and odd cases: a text that is null or has no letter gets `und`, score 0
and is rejected. Rows with a null language are not learned from. With nothing
to learn from, every text gets `und`. Ties go to the first language by code
point. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty
from .textbytes import chunks

CELLS = 4096
#: Rows whose dense counts are held at once (16 MB).
ROWS = 512
UNKNOWN = "und"
#: Lower case; ASCII other than letters becomes a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the n-grams of each row: rows × CELLS."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    text = _FOLD[data]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != 32) | (text[:-1] != 32) | (row[1:] != row[:-1])
    text, row = text[keep].astype(np.uint32), row[keep]
    out = np.zeros(n * CELLS, np.int64)
    for size, seed in ((2, 0), (3, 0x5BD1E995)):
        if len(text) < size:
            continue
        last = len(text) - size + 1
        gram = text[:last].copy()
        for k in range(1, size):
            gram = (gram << np.uint32(8)) | text[k : last + k]
        cell = ((gram * np.uint32(0x9E3779B1) + np.uint32(seed)) >> np.uint32(20)).astype(np.int32)
        inside = row[:last] == row[size - 1 :]
        out += np.bincount((row[:last] * CELLS + cell)[inside], minlength=n * CELLS)
    return out.reshape(n, CELLS)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@dataclass
class Centroids:
    languages: list[str]
    #: Of each centroid: its language's number, its vector, the cosine under which a text is rejected.
    owner: np.ndarray
    vectors: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def nearest(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosines = unit(np.sqrt(counted).astype(np.float32) * self.idf) @ self.vectors.T
        best = cosines.argmax(1)
        return best, cosines[np.arange(len(best)), best]


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means; starts with the rows farthest from those chosen before."""
    centers = [unit(x.mean(0, keepdims=True))[0]]
    for _ in range(min(k, len(x)) - 1):
        centers.append(x[(x @ np.stack(centers).T).max(1).argmin()])
    centers = np.stack(centers)
    for _ in range(rounds):
        of = (x @ centers.T).argmax(1)
        centers = unit(np.stack([x[of == c].mean(0) if (of == c).any() else centers[c] for c in range(len(centers))]))
    return centers


def fit(counted: np.ndarray, languages: list[str], k: int = 4, reject: float = 0.002) -> Centroids:
    names = sorted(set(languages))
    seen = (counted > 0).sum(0)
    idf = (np.log((1 + len(counted)) / (1 + seen)) + 1).astype(np.float32)
    x = unit(np.sqrt(counted).astype(np.float32) * idf)
    which = np.array([names.index(v) for v in languages], int)
    vectors, owner, least = [], [], []
    for i in range(len(names)):
        own = x[which == i]
        centers = cluster(own, k)
        cosines = own @ centers.T
        of = cosines.argmax(1)
        vectors.append(centers)
        owner += [i] * len(centers)
        least += [float(np.quantile(cosines[of == c, c], reject)) if (of == c).any() else 0.0 for c in range(len(centers))]
    return Centroids(names, np.array(owner, int), np.concatenate(vectors).astype(np.float32) if names else np.zeros((0, CELLS), np.float32), np.array(least), idf)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch, "text", ROWS):
            table = counts(data, offsets)
            cells = [np.flatnonzero(r) for r in table]
            out = [pa.array([c.astype("<u2").tobytes() for c in cells], pa.binary()), pa.array([r[c].astype("<u4").tobytes() for r, c in zip(table, cells)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), *out], ["lang", "cells", "n"])


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 600) -> Centroids:
    """Fits to rows of df with a language and a letter in the text: of each language the per_language ones with the least hashes of id and text, of rows equal in both one."""
    text = F.col(text_col)
    rows = df.where(F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("rank"))
    # Tasks drop all but their own first per_language ranks of a language before the window.
    first = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    ranks = rows.select("lang", "rank").distinct().withColumn("at", first).where(F.col("at") <= per_language).select("lang", "rank")
    chosen = rows.join(F.broadcast(ranks), ["lang", "rank"]).dropDuplicates(["lang", "rank"])
    found = chosen.select("lang", "text").mapInArrow(_counted, "lang string, cells binary, n binary").collect()
    found.sort(key=lambda r: (r.lang, r.cells, r.n))
    table = np.zeros((len(found), CELLS), np.float32)
    for row, r in zip(table, found):
        row[np.frombuffer(r.cells, "<u2")] = np.frombuffer(r.n, "<u4")
    return fit(table, [r.lang for r in found])


def predict(df: DataFrame, centroids: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, nearest, score, rejected) of every row: the nearest language, its cosine from 0 to 1, and whether it is too far away."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            names, scores, far = [], [np.zeros(0)], [np.zeros(0, bool)]
            for a, b, data, offsets in chunks(batch, "text", ROWS):
                if len(c.owner):
                    best, cosine = c.nearest(counts(data, offsets))
                    known = letters[a:b]
                    names += [c.languages[c.owner[i]] if k else UNKNOWN for i, k in zip(best, known)]
                    scores.append(np.where(known, np.clip(cosine, 0, 1), 0.0))
                    far.append(~known | (cosine < c.least[best]))
                else:
                    names += [UNKNOWN] * (b - a)
                    scores.append(np.zeros(b - a))
                    far.append(np.ones(b - a, bool))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(np.concatenate(scores).astype(float)), pa.array(np.concatenate(far))], ["id", "nearest", "score", "rejected"])

    kind = df.schema[id_col].dataType.simpleString()
    text = text_or_empty(text_col)
    return df.select(F.col(id_col).alias("id"), text.alias("text"), text.rlike(r"\p{L}").alias("letters")).mapInArrow(predicted, f"id {kind}, nearest string, score double, rejected boolean")
