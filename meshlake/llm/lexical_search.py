"""Ranked lexical search: a threshold-seeded join of items with documents.

The score of an item and a document sums, over the item's terms, the term's
weight times its saturated count in the document (its impact), times its count
in the item.

1. Documents become profiles: their number of terms, and the hashes and counts of
   those terms that a filter of the items' terms lets through. The filter has at
   most 2**FILTER_BITS cells; what it lets through by chance does no harm.
2. Tasks count documents by term and keep each term's k largest impacts; these
   are merged by term. The largest and the kth are stored.
3. k documents have at least a term's kth impact, so the largest kth impact of an
   item's terms is a lower bound of its kth score. The terms by falling largest
   impact have a suffix whose largest impacts add up to less than this bound: a
   document that has only these cannot come among the first k. They are pruned.
4. Items are dealt into blocks of about block_terms terms, which are sent to all
   tasks. A document that has an unpruned term of an item is a candidate and is
   scored exactly with all terms from its profile. A task keeps the best k of
   each item; their kth score raises the item's bound for what the task has still
   to read. The best k of all tasks are ranked.

All sums are of 64-bit integers. Terms are told apart by 64-bit hashes.

Nulls and odd cases: a null text has no term, and such a document is neither
counted nor found. Every row of items is an item of its own, also with a null or
repeated id. Repeated documents are found as often as they occur. Equal scores
go by ascending id, null ids last, and rows equal in both in any order. Empty
tables give an empty result. Other columns are not read. A text is worked on as
a whole: one of n bytes takes about 60 n bytes of its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .decontamination import _expanded, item_blocks
from .terms import terms
from .textbytes import chunks

#: Cells of the filter of the items' terms, as a power of two, at most.
FILTER_BITS = 22
#: Impacts that a task holds before it reduces them.
HELD = 1 << 21
#: Cells of the matrices of documents by terms and by items that a task works on at once.
CELLS = 1 << 22
PROFILE = "id bigint, n bigint, terms array<bigint>, counts array<bigint>"
LAST = np.iinfo(np.int64).max


def _counted(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the distinct ones, by row."""
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]))) if len(rows) else np.zeros(0, np.int64)
    return rows[first], hashes[first], np.diff(first, append=len(rows))


def _lists(rows: np.ndarray, n: int, *values: np.ndarray) -> list[pa.Array]:
    ends = pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int64) if v.dtype != np.uint64 else v.view(np.int64))) for v in values]


def _profiles(cells=None):
    """id, n, terms and counts of texts (id, text); with cells only of terms whose cell is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch, "text"):
                rows, hashes = terms(data, offsets)
                n = np.bincount(rows, minlength=b - a)
                if cells is not None:
                    keep = cells.value[(hashes & np.uint64(len(cells.value) - 1)).astype(np.int64)]
                    rows, hashes = rows[keep], hashes[keep]
                rows, hashes, counts = _counted(rows, hashes)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(n), *_lists(rows, b - a, hashes, counts)], ["id", "n", "terms", "counts"])

    return run


def profiles(df: DataFrame, id_col: str, text_col: str, cells=None) -> DataFrame:
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(_profiles(cells), PROFILE)


def term_filter(items: DataFrame, n_terms: int) -> np.ndarray:
    """Whether a term of the items has this cell; cells are the lowest bits of hashes."""
    bits = min(FILTER_BITS, max(10, (64 * n_terms).bit_length()))
    cells = np.zeros(1 << bits, bool)
    used = items.select(F.explode("terms").alias("t")).select(F.col("t").bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("c")).distinct()
    cells[used.toPandas()["c"].to_numpy(np.int64)] = True
    return cells


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(row, term, count) of profiles."""
    lists = batch.column("terms")
    rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    return rows, lists.flatten().to_numpy(zero_copy_only=False), batch.column("counts").flatten().to_numpy(zero_copy_only=False)


def saturation(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 8 * (25 + 75 * lengths * n_docs // n_terms))


def _largest(n_docs: int, n_terms: int, k: int):
    """(term, df, largest): documents that have a term, and the k largest saturations, of a task's profiles."""

    def reduced(term, df, top):
        """term and df have a 0 for saturations that were counted before."""
        order = np.lexsort((-top, term))
        term, df, top = term[order], df[order], top[order]
        first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        sizes = np.diff(first, append=len(term))
        total = np.add.reduceat(df, first)
        keep = np.arange(len(term)) - np.repeat(first, sizes) < k
        df = np.zeros(len(term), np.int64)
        df[first] = total
        return term[keep], df[keep], top[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            rows, term, counts = _flat(batch)
            if len(term):
                held.append((term, np.ones(len(term), np.int64), saturation(counts, batch.column("n").to_numpy()[rows], n_docs, n_terms)))
                many += len(term)
            if many >= HELD:
                held = [reduced(*map(np.concatenate, zip(*held)))]
                many = len(held[0][0]) // 2
        if held:
            term, df, top = reduced(*map(np.concatenate, zip(*held)))
            first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(term[first]), pa.array(df[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(term)).astype(np.int32)), pa.array(top))], ["term", "df", "largest"])

    return run


def term_stats(docs: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(term, w, most, kth): the weight of every term of the profiles, and its largest and kth largest impact (0 if fewer than k documents have it)."""
    parts = docs.mapInArrow(_largest(n_docs, n_terms, k), "term bigint, df bigint, largest array<bigint>")
    merged = parts.groupBy("term").agg(F.sum("df").alias("df"), F.slice(F.sort_array(F.flatten(F.collect_list("largest")), False), 1, k).alias("largest"))
    w = F.floor(1000 * F.ln((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    return merged.select("term", w.alias("w"), F.col("largest")[0].alias("_most"), F.coalesce(F.get("largest", F.lit(k - 1)), F.lit(0)).alias("_kth")).select("term", "w", (F.col("w") * F.col("_most")).alias("most"), (F.col("w") * F.col("_kth")).alias("kth"))


def seeded(items: DataFrame, stats: DataFrame) -> DataFrame:
    """(item, theta, terms: array of (term, weight, rest)): the bound of every item, and for each of its terms the most that it and the terms of no larger impact can add up to."""
    wide = items.select("item", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("item", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    joined = wide.join(stats, "term").where("w > 0").select("item", "term", (F.col("n") * F.col("w")).alias("weight"), (F.col("n") * F.col("most")).alias("most"), (F.col("n") * F.col("kth")).alias("kth"))
    rest = F.sum("most").over(Window.partitionBy("item").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return joined.withColumn("rest", rest).groupBy("item").agg(F.max("kth").alias("theta"), F.array_sort(F.collect_list(F.struct("term", "weight", "rest"))).alias("terms"))


class Block:
    """Items as arrays: entries (item, term, weight, rest) by item."""

    def __init__(self, rows):
        self.items = np.array([r.item for r in rows], np.int64)
        self.theta = np.array([r.theta for r in rows], np.int64)
        sizes = np.array([len(r.terms) for r in rows], np.int64)
        self.starts = np.append(0, np.cumsum(sizes))
        flat = np.array([tuple(t) for r in rows for t in r.terms], np.int64).reshape(-1, 3)
        self.vocabulary, self.term = np.unique(flat[:, 0], return_inverse=True)
        self.weight, self.rest = flat[:, 1], flat[:, 2]
        self.item = np.repeat(np.arange(len(rows)), sizes)


def _add_best(best, item, score, doc, k: int):
    """The k best of each item, with others added."""
    item, score, doc = (np.concatenate(x) for x in zip(best, (item, score, doc)))
    order = np.lexsort((doc, -score, item))
    item, score, doc = item[order], score[order], doc[order]
    first = np.searchsorted(item, item)
    keep = np.arange(len(item)) - first < k
    return item[keep], score[keep], doc[keep]


def _best(block, n_docs: int, n_terms: int, k: int):
    """(item, score, id): a task's k best documents of each item. The greatest 64-bit integer stands for a null id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Block = block.value
        theta = q.theta.copy()
        best = (np.zeros(0, np.int64),) * 3
        step = max(1, CELLS // (len(q.vocabulary) + len(q.items) + 1))
        for batch in batches:
            rows, term, counts = _flat(batch)
            ids = batch.column("id").fill_null(LAST).to_numpy()
            at = np.minimum(np.searchsorted(q.vocabulary, term), len(q.vocabulary) - 1)
            keep = q.vocabulary[at] == term
            rows, at, counts = rows[keep], at[keep], counts[keep]
            impact = saturation(counts, batch.column("n").to_numpy()[rows], n_docs, n_terms)
            for first in range(0, batch.num_rows, step):
                a, b = np.searchsorted(rows, [first, first + step])
                if a == b:
                    continue
                n = min(step, batch.num_rows - first)
                doc, t = rows[a:b] - first, at[a:b]
                dense = np.zeros((n, len(q.vocabulary)), np.int64)
                dense[doc, t] = impact[a:b]
                # Candidates: documents with an unpruned term of an item.
                use = np.flatnonzero(q.rest >= theta[q.item])
                use = use[np.argsort(q.term[use], kind="stable")]
                begin = np.searchsorted(q.term[use], np.arange(len(q.vocabulary) + 1))
                many = (begin[1:] - begin[:-1])[t]
                may = np.zeros((n, len(q.items)), bool)
                may[np.repeat(doc, many), q.item[use[_expanded(begin[t], many)]]] = True
                doc, item = np.nonzero(may)
                for c in range(0, len(doc), CELLS // 16):
                    best, theta = rescored(q, dense, doc[c : c + CELLS // 16], item[c : c + CELLS // 16], ids[first:], best, theta)
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(q.items[best[0]]), pa.array(best[1]), pa.array(best[2])], ["item", "score", "id"])

    def rescored(q, dense, doc, item, ids, best, theta):
        sizes = q.starts[item + 1] - q.starts[item]
        entry = _expanded(q.starts[item], sizes)
        score = np.add.reduceat(q.weight[entry] * dense[np.repeat(doc, sizes), q.term[entry]], np.cumsum(sizes) - sizes) if len(doc) else np.zeros(0, np.int64)
        good = (score > 0) & (score >= theta[item])
        best = _add_best(best, item[good], score[good], ids[doc[good]], k)
        full = np.flatnonzero(np.bincount(best[0], minlength=len(q.items)) == k)
        last = np.searchsorted(best[0], full, "right") - 1
        theta[full] = np.maximum(theta[full], best[1][last])
        return best, theta

    return run


def ranked(score: str, doc: str) -> list[Column]:
    return [F.col(score).desc(), F.col(doc).asc_nulls_last()]


def search(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 10, block_terms: int = 100_000) -> DataFrame:
    """(item_id, rank, id, score): the k documents of the highest scores above 0 of each row of items."""
    spark = df.sparkSession
    asked = written(items.select(F.monotonically_increasing_id().alias("id"), F.col(item_col).alias("item_id"), text_or_empty(item_text_col).alias("text")))
    queries = written(profiles(asked, "id", "text").withColumnRenamed("id", "item"))
    cells = spark.sparkContext.broadcast(term_filter(queries, queries.agg(F.sum(F.size("terms"))).first()[0] or 0))
    docs = written(profiles(df, id_col, text_col, cells).where("n > 0"))
    n_docs, n_terms = docs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    empty = spark.createDataFrame([], "item bigint, score bigint, id bigint")
    found = [empty]
    if n_docs:
        seeds = written(seeded(queries, term_stats(docs, n_docs, n_terms, k)).withColumn("size", F.size("terms")))
        dealt, n = item_blocks(seeds, "size", block_terms)
        for b in range(n):
            rows = dealt.where(F.col("block") == b).select("item", "theta", "terms").collect()
            if rows:
                found.append(docs.mapInArrow(_best(spark.sparkContext.broadcast(Block(rows)), n_docs, n_terms, k), "item bigint, score bigint, id bigint"))
    best = found[0]
    for part in found[1:]:
        best = best.unionByName(part)
    best = best.withColumn("id", F.when(F.col("id") != LAST, F.col("id")))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*ranked("score", "id")))).where(F.col("rank") <= k)
    return best.join(asked.select(F.col("id").alias("item"), "item_id"), "item").select("item_id", "rank", "id", "score")
