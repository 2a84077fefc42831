"""Benchmark decontamination: an FM-index per training shard finds the words that benchmark phrases cover.

A phrase is `window` consecutive words of an item, or all words of an item that
has fewer. Tasks gather their documents into shards of about shard_words words,
without a shuffle, and index each (fm_index). The index is written. Items are
dealt into blocks of about block_words words by a hash; for each block its
distinct phrases are sent to all tasks, which search them backward in every
shard, locate the occurrences and merge the words that they cover into spans.
With several blocks a document's spans and items are merged once more.

Words are those of `terms`, compared by 64-bit hashes: two of d different words
are taken for one another with a probability of some d² / 2**65.

Nulls and odd cases: a null text, or one without a word, has no words and is
reported with none; an item without words is never found. A null item id counts
as the empty text; items that share an id count as one. Repeated rows and null
ids are documents of their own. Empty tables give an empty result, or documents
without hits. Other columns are not read. A document is never split: one of n
words takes some 100 n bytes of its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fm_index
from .common import text_or_empty, written
from .terms import IS_TERM, runs, terms
from .textbytes import chunks

INDEX = "shard bigint, ids array<bigint>, payload binary"
FOUND = "shard bigint, number int, id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
#: Occurrences located at once.
LOCATED = 1 << 20


def _indexed(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, ids, many = TaskContext.get().partitionId() << 32, [], [], 0

        def shard() -> pa.RecordBatch:
            rows, hashes = (np.concatenate(x) for x in zip(*held))
            payload = fm_index.build(rows, hashes, len(ids))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([payload], pa.binary())], ["shard", "ids", "payload"])

        for batch in batches:
            names = batch.column("id").to_pylist()
            for a, b, data, offsets in chunks(batch, "text"):
                rows, hashes = terms(data, offsets)
                held.append((rows + len(ids), hashes))
                ids += names[a:b]
                many += len(rows)
                if many >= shard_words:
                    yield shard()
                    number, held, ids, many = number + 1, [], [], 0
        if ids:
            yield shard()

    return run


def build_index(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_words: int = 1 << 20) -> DataFrame:
    """(shard, ids, payload): the FM-indexes of all documents, as a written table."""
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    return written(docs.mapInArrow(_indexed(shard_words), INDEX))


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch, "text"):
            rows, hashes = terms(data, offsets)
            ends = np.searchsorted(rows, np.arange(b - a + 1)).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("item").slice(a, b - a), words], ["item", "words"])


def item_blocks(items: DataFrame, size: str, most: int) -> tuple[DataFrame, int]:
    """items with `block`, and the number of blocks: as many as keep the sum of `size` in each below twice `most`, or one item in each."""
    total, n = items.agg(F.sum(size), F.count("*")).first()
    blocks = max(1, -(-(total or 0) // most))
    while True:
        out = items.withColumn("block", F.pmod(F.xxhash64(*items.columns), F.lit(blocks)))
        largest = out.groupBy("block").agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] or 0
        if largest <= 2 * most or blocks >= 4 * n:
            return out, blocks
        blocks *= 2


class Phrases:
    """The distinct phrases of some items, aligned at their end, and the items of each."""

    def __init__(self, items: list[str], words: list[np.ndarray], window: int):
        self.names, which = np.unique(np.array(items, object), return_inverse=True) if items else (np.zeros(0, object), [])
        rows, of, lengths = [], [], []
        for k, w in zip(which, words):
            wide = min(window, len(w))
            if wide:
                part = np.zeros((len(w) - wide + 1, window), np.uint64)
                part[:, window - wide :] = np.lib.stride_tricks.sliding_window_view(w, wide)
                rows.append(part)
                of.append(np.full(len(part), k))
                lengths.append(np.full(len(part), wide))
        rows = np.concatenate(rows) if rows else np.zeros((0, window), np.uint64)
        keyed = np.concatenate([rows, np.concatenate(lengths).astype(np.uint64)[:, None] if len(rows) else np.zeros((0, 1), np.uint64)], 1)
        _, first, phrase = np.unique(np.ascontiguousarray(keyed).view(f"V{keyed.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        self.words, self.lengths = rows[first], keyed[first, -1].astype(np.int64)
        pairs = np.unique(phrase * max(1, len(self.names)) + (np.concatenate(of) if of else np.zeros(0, np.int64)))
        self.item = pairs % max(1, len(self.names))
        self.starts = np.searchsorted(pairs // max(1, len(self.names)), np.arange(len(first) + 1))


def _expanded(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... so many of each."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def search_shard(index: fm_index.Index, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the covered runs by position, and distinct (document, item) of what occurs."""
    low, high = index.ranges(phrases.words, phrases.lengths)
    hits = np.flatnonzero(high > low)
    change = np.zeros(index.n + 1, np.int64)
    found, upto = [np.zeros(0, np.int64)], np.cumsum((high - low)[hits])
    names = max(1, len(phrases.names))
    for a, b in zip(*_pieces(upto)):
        some = hits[a:b]
        sizes = high[some] - low[some]
        at, which = index.positions(_expanded(low[some], sizes)), np.repeat(some, sizes)
        np.add.at(change, at, 1)
        np.add.at(change, at + phrases.lengths[which], -1)
        pair = np.unique((np.searchsorted(index.starts, at, "right") - 1) * len(low) + which)
        doc, which = pair // len(low), pair % len(low)
        many = phrases.starts[which + 1] - phrases.starts[which]
        found.append(np.unique(np.repeat(doc, many) * names + phrases.item[_expanded(phrases.starts[which], many)]))
    step = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0)
    pairs = np.unique(np.concatenate(found))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1), pairs // names, pairs % names


def _pieces(upto: np.ndarray) -> tuple[list[int], list[int]]:
    """Cuts of running sums into runs of about LOCATED."""
    if not len(upto):
        return [], []
    cuts = np.unique(np.searchsorted(upto, np.arange(0, upto[-1] + LOCATED, LOCATED)))
    return [0, *cuts[(cuts > 0) & (cuts < len(upto))].tolist()], [*cuts[(cuts > 0) & (cuts < len(upto))].tolist(), len(upto)]


def _searched(phrases):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, ids, payload in zip(*(batch.column(c) for c in ("shard", "ids", "payload"))):
                index, p = fm_index.Index(payload.as_py()), phrases.value
                start, end, doc, item = search_shard(index, p)
                first, n = index.starts[:-1], len(ids.values)
                row = np.searchsorted(index.starts, start, "right") - 1
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start - first[row]), pa.array(end - first[row])], ["start", "end"]))
                names = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), pa.array(p.names[item], pa.string()))
                arrays = [pa.array(np.full(n, shard.as_py())), pa.array(np.arange(n, dtype=np.int32)), ids.values.cast(pa.int64()), pa.array(np.diff(index.starts) - 1), spans, names]
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "number", "id", "n_words", "spans", "items"])

    return run


def _merged(df: DataFrame) -> DataFrame:
    """One row of each document's rows of several blocks: spans merged, items joined."""
    grouped = df.groupBy("shard", "number").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    last = lambda out: F.element_at(out, -1)
    longer = lambda out, s: F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last(out)["start"].alias("start"), F.greatest(last(out)["end"], s["end"]).alias("end"))))
    merge = F.aggregate("spans", F.slice("spans", 1, 1), lambda out, s: F.when(s["start"] <= last(out)["end"], longer(out, s)).otherwise(F.concat(out, F.array(s))))
    return grouped.withColumn("spans", F.when(F.size("spans") > 0, merge).otherwise(F.col("spans")))


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 10, block_words: int = 200_000) -> DataFrame:
    """One row per indexed document: id, n_words, spans (words [start, end) that phrases cover, apart from one another), items (ids as sorted texts)."""
    spark = index.sparkSession
    texts = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), text_or_empty(text_col).alias("text"))
    words = texts.mapInArrow(_item_words, "item string, words array<bigint>").where(F.size("words") > 0)
    dealt, n = item_blocks(written(words.withColumn("size", F.size("words"))), "size", block_words)
    parts = []
    for k in range(n):
        rows = dealt.where(F.col("block") == k).select("item", "words").collect()
        phrases = Phrases([r.item for r in rows], [np.array(r.words, np.int64).view(np.uint64) for r in rows], window)
        parts.append(index.mapInArrow(_searched(spark.sparkContext.broadcast(phrases)), FOUND))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found if n == 1 else _merged(found)
    return found.select("id", "n_words", "spans", F.array_sort("items").alias("items"))


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10, shard_words: int = 1 << 20, block_words: int = 200_000) -> DataFrame:
    """`search` over an index of df."""
    return search(build_index(df, id_col, text_col, shard_words), items, window=window, block_words=block_words)


def _without_spans(text: pd.Series, spans: pd.Series) -> pd.Series:
    def cut(t, s):
        if t is None or s is None or not len(s):
            return t
        data = np.frombuffer(t.encode(), np.uint8)
        starts, ends, _ = runs(IS_TERM[data], np.array([0, len(data)]))
        out, at = [], 0
        for x in s:
            out.append(data[at : starts[x["start"]]].tobytes())
            at = ends[x["end"] - 1]
        return b"".join([*out, data[at:].tobytes()]).decode()

    return pd.Series([cut(t, s) for t, s in zip(text, spans)])


def without_spans(text: Column, spans: Column) -> Column:
    """Texts without the words in their spans; what stands between the words of a span goes with them. A null text stays null."""
    return F.pandas_udf(_without_spans, "string")(text, spans)
