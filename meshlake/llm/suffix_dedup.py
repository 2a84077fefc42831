"""Suffix-array deduplication: bytes covered by a string of `length` bytes that also starts earlier are removed.

The suffix array is sparse. Of the k-grams (k = length / 2) in every window of
`length` bytes the one with the least hash is its anchor, so equal windows have
their anchors at the same place and can only be equal if the suffixes that start
at their anchors share k bytes. Only these suffixes are sorted:

1. Anchors of all documents are counted by hash. Tasks send one anchor of those
   they hold several times, so a frequent one costs a row per task. What occurs
   once in the corpus is dropped. A sample of the anchors of all documents goes
   with them, and what of it is repeated is told.
2. Each anchor that is left becomes a suffix of `length` bytes with the bytes in
   front of it. Splitters from the sampled repeated anchors, which tasks sort and
   thin out to one a range, range-partition suffixes by their first k bytes. A
   k-gram that several splitters equal is spread over their buckets.
3. A bucket sorts its suffixes by multikey quicksort and takes the common
   prefixes of neighbours; the same goes for the reversed bytes in front. Runs
   with long enough common prefixes on both sides are classes of equal windows,
   of which all but the earliest are marked.
4. What is first in a bucket of a k-gram spread over several is compared across
   these boundaries by the windows' hashes.
5. Marked windows are merged per document.

Between the steps, each row is a compressed block of many records (their arrays
in numpy), which Spark partitions, shuffles and groups.

Nulls and odd cases: a null text counts as empty; texts under `length` bytes
lose nothing. Null ids rank before all others. Rows that share an id, or have
none, are documents of their own, told apart and ordered by a 64-bit hash of id
and text. Of rows equal in both the first is such a document; the others are its
copies, sent once by a task's batch and counted, and lose all that a window
covers. The least 64-bit integer stands for a null id and is not told from it. An
empty table gives an empty result. Other columns are not read. A text is worked
on as a whole: the arrays of one of n bytes take about 60 n bytes of its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCKS, block_rows, by_bucket, doc_bucket, numbers_of, packed, planes, first_rows, picked, runs_of, sent_texts, texts_of, unpacked
from .common import row_key, text_or_empty, written
from .textbytes import chunks, mix, prefix_hashes, span_hashes

def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, position, first and last window start, hash) of the anchors of every row; positions count in data."""
    k = length // 2
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64)
    sums = prefix_hashes(data)
    at = np.arange(len(data) - k + 1)
    grams = span_hashes(sums, at, at + k)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    wide, span = length - k + 1, 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    starts = np.arange(len(least))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    inside = starts + length <= offsets[row + 1]
    starts, row = starts[inside], row[inside]
    if not len(starts):
        return none, none, none, none, none.astype(np.uint64)
    position = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (position[1:] != position[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(new[1:], len(starts)) - 1
    return row[new], position[new], starts[new], starts[last], grams[position[new]]


#: Anchors that a task holds before it sends them.
HELD = 1_500_000


def _sent_anchors(length: int, n: int, thin: int):
    """Blocks of anchors by hash range, of those a task already knows to be repeated (they only pass through the next step), and of the k-grams of one of `thin` anchors."""
    k = length // 2

    def flush(keys, number, hashes, picks, grams):
        token = hashes >> np.uint64(16)
        order = np.argsort(token, kind="stable")
        token, keys, number = token[order], keys[order], number[order]
        first = np.concatenate([[True], token[1:] != token[:-1]])
        last = np.append(first[1:], True)
        several = ~(first & last)
        repeated = np.empty(len(order), bool)
        repeated[order] = several
        bucket = (token * np.uint64(n) >> np.uint64(48)).astype(np.int64)
        out = []
        send = np.flatnonzero(first)
        for b, i in by_bucket(bucket[send]):
            i = send[i]
            names, which = np.unique(keys[i], return_inverse=True)
            out.append((b, packed("anchors", planes(np.diff(token[i], prepend=np.uint64(0))), planes(np.diff(names, prepend=0)), which.astype(np.uint32), number[i].astype(np.uint32))))
        if several.any():
            for b, i in by_bucket(doc_bucket(keys[several], n)):
                i = np.flatnonzero(several)[i]
                out.append((b, packed("known", keys[i], number[i].astype(np.uint32))))
        own = hashes[picks] >> np.uint64(16)
        for b, i in by_bucket((own * np.uint64(n) >> np.uint64(48)).astype(np.int64)):
            out.append((b, packed("sampled", own[i], repeated[picks[i]], grams[i])))
        return block_rows(out)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            batch, _ = first_rows(batch)
            keys = batch.column("key").to_numpy()
            for a, b, data, offsets in chunks(batch, "text"):
                row, position, _, _, hashes = anchors(data, offsets, length)
                first = np.searchsorted(row, np.arange(b - a))
                own = keys[a:b][row]
                picks = np.flatnonzero(mix(hashes ^ mix(own.view(np.uint64) + position.astype(np.uint64))) % np.uint64(thin) == 0)
                held.append((own, np.arange(len(row)) - first[row], hashes, many + picks, data[position[picks][:, None] + np.arange(k)]))
                many += len(row)
                if many >= HELD:
                    yield flush(*map(np.concatenate, zip(*held)))
                    held, many = [], 0
        if many:
            yield flush(*map(np.concatenate, zip(*held)))

    return send


def _repeated_anchors(n: int):
    """Of one bucket: (document bucket, keys and numbers of repeated anchors), and in bucket -1 the sampled k-grams of repeated ones."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens, keys, number, out, sampled = [], [], [], [], []
        for kind, *x in map(unpacked, pdf.payload):
            if kind == "known":
                out.append((int(pdf.bucket.iloc[0]), packed(*x)))
            elif kind == "sampled":
                sampled.append(x)
            else:
                tokens.append(np.cumsum(numbers_of(x[0])))
                keys.append(np.cumsum(numbers_of(x[1]).view(np.int64))[x[2]])
                number.append(x[3])
        if tokens:
            token, keys, number = map(np.concatenate, (tokens, keys, number))
            order = np.argsort(token, kind="stable")
            token = token[order]
            same = token[1:] == token[:-1]
            keep = order[np.append(same, False) | np.append(False, same)]
            for b, i in by_bucket(doc_bucket(keys[keep], n)):
                out.append((b, packed(keys[keep[i]], number[keep[i]])))
            if sampled:
                own, known, grams = map(np.concatenate, zip(*sampled))
                grams = grams[known | np.isin(own, token[1:][same])]
                if len(grams):
                    out.append((-1, packed(grams)))
        return pd.DataFrame(out, columns=["bucket", "payload"])

    return find


def _contexts(data: np.ndarray, begin: np.ndarray, end: np.ndarray, position: np.ndarray, length: int) -> np.ndarray:
    """The k bytes in front of each position and `length` bytes from it; zeros outside the document."""
    k = length // 2
    at = position[:, None] + np.arange(-k, length)
    inside = (at >= begin[:, None]) & (at < end[:, None])
    return np.where(inside, data[np.clip(at, 0, max(0, len(data) - 1))], 0).astype(np.uint8)


def _suffix_buckets(grams: np.ndarray, keys: np.ndarray, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each k-gram, and whether it is spread over several because several splitters equal it."""
    left, right = np.searchsorted(splitters, grams, "left"), np.searchsorted(splitters, grams, "right")
    spread = right - left > 1
    return np.where(spread, left + (mix(keys.view(np.uint64)) % np.maximum(right - left, 1).astype(np.uint64)).astype(np.int64), right), spread


def _as_bytes(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _sent_suffixes(length: int, splitters):
    """For one bucket of documents: blocks of the suffixes at repeated anchors, by range."""
    k = length // 2

    def send(key, docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(docs) and len(found):
            names, wanted = _coded(map(unpacked, found.payload))
            keys, ids, offsets, data = _only(*texts_of(docs.payload), names)
            held, many = [], 0
            for a, b in runs_of(offsets, np.ones(len(ids), bool)):
                base = offsets[a]
                row, position, low, high, _ = anchors(data[base : offsets[b]], offsets[a : b + 1] - base, length)
                number = np.arange(len(row)) - np.searchsorted(row, np.arange(b - a))[row]
                code = np.searchsorted(names, keys[a:b][row]).astype(np.int64) * (1 << 32) + number
                keep = wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code
                row, position, low, high = row[keep], position[keep], low[keep], high[keep]
                begin, end = offsets[a:b][row] - base, offsets[a + 1 : b + 1][row] - base
                context = _contexts(data[base : offsets[b]], begin, end, position, length)
                held.append((context, keys[a:b][row], ids[a:b][row], position - begin, (position - high).astype(np.uint8), (position - low).astype(np.uint8)))
                many += len(row)
                if many > 200_000 or b == len(ids):
                    context, *fields = map(np.concatenate, zip(*held))
                    held, many = [], 0
                    if len(context):
                        bucket, spread = _suffix_buckets(_as_bytes(context[:, k : 2 * k]), fields[0], splitters.value)
                        for name, i in by_bucket(bucket):
                            i = i[np.argsort(_as_bytes(context[i, k:]), kind="stable")]
                            out.append((name, packed(context[i], *(f[i] for f in (*fields, spread)))))
        return pd.DataFrame(out, columns=["bucket", "payload"])

    return send


def _coded(parts) -> tuple[np.ndarray, np.ndarray]:
    """The different keys of blocks of (keys, numbers), sorted, and their pairs as sorted codes."""
    keys, numbers = (np.concatenate(x) for x in zip(*parts))
    names, which = np.unique(keys, return_inverse=True)
    return names, np.unique(which.astype(np.int64) * (1 << 32) + numbers)


def _only(keys: np.ndarray, ids: np.ndarray, many: np.ndarray, offsets: np.ndarray, data: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, ...]:
    """(keys, ids, offsets, data) of the documents with one of these keys."""
    at = np.flatnonzero(np.isin(keys, names))
    return keys[at], ids[at], *picked(offsets, data, at)


def multikey_sort(words: np.ndarray, cut: int = 2048) -> np.ndarray:
    """Order of rows of words by multikey quicksort: three parts around a pivot word, the middle one goes on with the next word."""
    order = np.arange(len(words))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == words.shape[1]:
            continue
        part = order[a:b]
        if b - a <= cut:
            order[a:b] = part[np.lexsort(words[part][:, depth:].T[::-1])]
            continue
        value = words[part, depth]
        some = np.sort(value[:: max(1, len(value) // 257)])
        pivot = some[len(some) // 2]
        less, more = value < pivot, value > pivot
        same = ~(less | more)
        order[a:b] = np.concatenate([part[less], part[same], part[more]])
        x, y = a + int(less.sum()), b - int(more.sum())
        todo += [(a, x, depth), (x, y, depth + 1), (y, b, depth)]
    return order


def _words(rows: np.ndarray) -> np.ndarray:
    """Bytes as big-endian words, padded with zeros."""
    wide = -(-rows.shape[1] // 8) * 8
    out = np.zeros((len(rows), wide), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view(">u8").astype(np.uint64)


def _sorted_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix with the one before, in bytes)."""
    order = multikey_sort(_words(rows))
    same = rows[order[1:]] == rows[order[:-1]]
    common = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return order, np.concatenate([[0], common])


def repeated_windows(context: np.ndarray, age: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> np.ndarray:
    """mask[i, d]: the window that starts d bytes before the anchor of i has an equal one that is older."""
    n, k = len(context), length // 2
    mask = np.zeros((n, k + 1), bool)
    order, common = _sorted_prefixes(context[:, k:])
    back, left = _sorted_prefixes(context[:, k - 1 :: -1])
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    closest = np.zeros(n, np.int64)
    closest[order] = np.maximum(common, np.append(common[1:], 0))
    run, front = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for d in range(k + 1):
        use = np.flatnonzero((low <= d) & (d <= high) & (closest >= length - d))
        if not len(use):
            continue
        run[order] = np.cumsum(common < length - d)
        front[back] = np.cumsum(left < d)
        code = np.unique(run[use] * (n + 1) + front[use], return_inverse=True)[1].astype(np.uint64)
        both = np.sort((code << bits) | age[use].astype(np.uint64))
        later = both[1:][(both[1:] >> bits) == (both[:-1] >> bits)] & ((np.uint64(1) << bits) - np.uint64(1))
        at = np.empty(n, np.int64)
        at[age] = np.arange(n)
        mask[at[later.astype(np.int64)], d] = True
    return mask


def _spans(mask: np.ndarray, keys: np.ndarray, position: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, end) of the bytes that runs of marked windows cover."""
    wide = np.zeros((len(mask), mask.shape[1] + 2), np.int8)
    wide[:, 1:-1] = mask
    step = np.diff(wide, axis=1)
    i, first = np.nonzero(step == 1)
    last = np.nonzero(step == -1)[1] - 1
    return keys[i], position[i] - last, position[i] - first + length


def _marked_spans(length: int, n: int):
    """For one bucket of suffixes: blocks of spans by document, and of the first windows of spread k-grams by hash (buckets from n on)."""
    k = length // 2

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        context, keys, ids, position, low, high, spread = (np.concatenate(x) for x in zip(*map(unpacked, pdf.payload)))
        age = np.empty(len(ids), np.int64)
        age[np.lexsort((position, keys, ids))] = np.arange(len(ids))
        mask = repeated_windows(context, age, low, high, length)
        out = []
        of, start, end = _spans(mask, keys, position, length)
        for b, i in by_bucket(doc_bucket(of, n)):
            out.append((b, packed(of[i], start[i], end[i])))
        d = np.arange(k + 1)
        first = spread[:, None] & ~mask & (low[:, None] <= d) & (d <= high[:, None])
        i, d = np.nonzero(first)
        if len(i):
            hashes = []
            for some in np.array_split(np.arange(len(i)), 1 + len(i) // 100_000):
                flat = context[i[some]].ravel()
                at = np.arange(len(some)) * context.shape[1] + k - d[some]
                hashes.append(span_hashes(prefix_hashes(flat), at, at + length))
            hashes = np.concatenate(hashes)
            for b, j in by_bucket((hashes % np.uint64(n)).astype(np.int64)):
                out.append((n + b, packed(hashes[j], keys[i[j]], ids[i[j]], position[i[j]] - d[j])))
        return pd.DataFrame(out, columns=["bucket", "payload"])

    return mark


def _across(length: int, n: int):
    """Windows that are first in their own bucket but not of all buckets of their k-gram."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes, keys, ids, start = (np.concatenate(x) for x in zip(*map(unpacked, pdf.payload)))
        order = np.lexsort((start, keys, ids, hashes))
        hashes, keys, start = hashes[order], keys[order], start[order]
        later = np.flatnonzero(np.append(False, hashes[1:] == hashes[:-1]))
        out = [(b, packed(keys[later[i]], start[later[i]], start[later[i]] + length)) for b, i in by_bucket(doc_bucket(keys[later], n))]
        return pd.DataFrame(out, columns=["bucket", "payload"])

    return compare


RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, many bigint"
#: Equal rows that one row of the result stands for before it is repeated.
MOST = 10_000


def merged_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist())):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(length: int, digest: bool):
    """For one bucket of documents: their results, and those of their copies with the number of them."""
    told = lambda kept: hashlib.sha256(kept).digest() if digest else kept

    def cut(key, docs: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame(columns=["id", "n_bytes", "n_removed", "n_spans", "kept", "many"])
        keys, ids, many, offsets, data = texts_of(docs.payload)
        of = np.zeros(0, np.int64)
        if len(spans):
            of, start, end = (np.concatenate(x) for x in zip(*map(unpacked, spans.payload)))
            order = np.argsort(of, kind="stable")
            of, start, end = of[order], start[order], end[order]
        a, b = np.searchsorted(of, keys, "left"), np.searchsorted(of, keys, "right")
        rows = []
        for i in range(len(ids)):
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            gone = merged_spans(start[a[i] : b[i]], end[a[i] : b[i]]) if b[i] > a[i] else []
            kept = b"".join(text[x:y] for x, y in zip([0, *(g[1] for g in gone)], [*(g[0] for g in gone), len(text)])) if gone else text
            rows.append((ids[i], len(text), len(text) - len(kept), len(gone), told(kept), 1))
            copy = (len(text), 1, told(b"")) if len(text) >= length else (0, 0, told(text))
            rows += [(ids[i], len(text), *copy, min(MOST, many[i] - k)) for k in range(1, many[i], MOST)]
        return pd.DataFrame(rows, columns=["id", "n_bytes", "n_removed", "n_spans", "kept", "many"])

    return cut


#: Sampled k-grams for each range.
PER_RANGE = 256


def splitting_grams(found: DataFrame, length: int, per_range: float, max_ranges: int) -> np.ndarray:
    """Sorted k-grams that split the suffixes at repeated anchors into ranges of about per_range sampled ones. The sample is sorted and thinned out by tasks; only one k-gram a range comes to the driver."""
    k = length // 2

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([g.tobytes() for g in unpacked(payload)[0]], pa.binary())], ["gram"])

    some = written(found.where("bucket < 0").mapInArrow(grams, "gram binary"))
    many = some.count()
    step = max(1.0, per_range, many / max_ranges)

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at = np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            yield batch.filter(pa.array(np.floor((at + 0.5) / step + 0.5) > np.floor((at - 0.5) / step + 0.5)))

    ordered = some.repartitionByRange(max(1, -(-many // 100_000)), "gram").sortWithinPartitions("gram")
    return np.array([r.gram for r in ordered.mapInArrow(thinned, "gram binary").orderBy("gram").collect()], f"S{k}")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, digest: bool = False, bucket_bytes: int = 8 << 20, range_bytes: int = 8 << 20, max_ranges: int = 2_000_000) -> DataFrame:
    """One row per row of df: id, n_bytes, n_removed, n_spans, kept (the bytes that stay, or their SHA-256).

    Documents are dealt into buckets of about bucket_bytes of text. Suffixes are dealt into ranges of as many as range_bytes
    of text have if all are repeated, or wider ones where there would be more than max_ranges; the splitters that are
    broadcast have length / 2 bytes a range."""
    missing = F.lit(-(1 << 63))
    text = text_or_empty(text_col)
    docs = df.select(F.coalesce(F.col(id_col).cast("bigint"), missing).alias("id"), row_key(id_col, text).alias("key"), text.alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))

    # A text has about 2 anchors in length / 2 + 2 bytes.
    suffixes = max(range_bytes, total // max_ranges) * 2 / (length // 2 + 2)
    thin = max(1, int(suffixes) // PER_RANGE)
    dealt = lambda x: x.repartition(n, "bucket").groupBy("bucket")
    found = written(dealt(docs.mapInArrow(_sent_anchors(length, n, thin), BLOCKS)).applyInPandas(_repeated_anchors(n), BLOCKS))
    splitters = df.sparkSession.sparkContext.broadcast(splitting_grams(found, length, suffixes / thin, max_ranges))
    texts = docs.mapInArrow(sent_texts(n), BLOCKS)
    suffixes = dealt(texts).cogroup(dealt(found.where("bucket >= 0"))).applyInPandas(_sent_suffixes(length, splitters), BLOCKS)
    marked = written(dealt(suffixes).applyInPandas(_marked_spans(length, n), BLOCKS))
    across = dealt(marked.where(F.col("bucket") >= n)).applyInPandas(_across(length, n), BLOCKS)
    spans = marked.where(F.col("bucket") < n).unionByName(across)
    out = dealt(texts).cogroup(dealt(spans)).applyInPandas(_cut(length, digest), RESULT)
    out = out.withColumn("many", F.explode(F.sequence(F.lit(1), "many"))).drop("many")
    return out.withColumn("id", F.when(F.col("id") != missing, F.col("id")))
