"""Spelling variants: words one inserted, deleted or replaced code point apart, found in forward and reversed dictionaries.

One edit leaves a half intact: two near words share the first half of the shorter
one as a prefix or its other half as a suffix. So

1. words are counted; tasks send one row of each word that they hold;
2. a word joins the block of its own half and, as the longer word of a pair, that
   of half of its length less one, in the forward dictionary by prefix and in the
   reversed one by suffix. A block's words have two lengths;
3. a block of more than block_words words is subdivided: what its words do not
   share yet has a half that is intact, so they go on to blocks by more of the
   prefix and by more of the suffix. This ends when one code point is left;
4. blocks are range-partitioned, and each task scans its sorted part and verifies
   the words of a block with one another; only near pairs leave it;
5. a word's form is its most frequent near word if that is `factor` times as
   frequent; forms are followed to the last by pointer jumping.

Nulls and odd cases: a null text has no words. Words with no form have a null
form and form_n and are their own root. Of equally frequent near words the first
in code-point order is the form. Repeated rows count as often as they occur; an
empty table gives an empty result; other columns are not read. A text is worked
on as a whole: one of n bytes takes about 60 n bytes of its task. Words are told
apart by 64-bit hashes within a task's batch, by themselves everywhere else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written
from .terms import runs
from .textbytes import LOWER, chunks, prefix_hashes, span_hashes

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
#: The first byte in UTF-8 of U+00C0 to U+00FF.
LATIN = 0xC3
#: Distinct words that a task holds before it sends them.
HELD = 1_000_000


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1 == 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


CRC = _crc_table()


def crc_after(crc: np.ndarray, length: int) -> np.ndarray:
    """What a CRC-32 of a prefix adds to that of the text behind it, which has so many bytes: crc32(a + b) is crc_after(crc32(a), len(b)) ^ crc32(b)."""
    for _ in range(length):
        crc = (crc >> np.uint32(8)) ^ CRC[crc & np.uint32(255)]
    return crc


def joint_crc(prefix: np.ndarray, lengths: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """crc32 of prefix and word from the crc32 of each; words by their lengths in bytes."""
    out = np.empty(len(crc), np.uint32)
    order = np.argsort(lengths, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
        names, which = np.unique(prefix[part], return_inverse=True)
        out[part] = crc_after(names, int(lengths[part[0]]))[which] ^ crc[part]
    return out


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = LETTERS[data] | (data == LATIN)
    inside[1:] |= data[:-1] == LATIN
    return runs(inside, offsets)


def chunk_counts(ids: list, data: np.ndarray, offsets: np.ndarray, least: int, every: int | None) -> dict[bytes, int]:
    """How often the words of at least so many code points occur in texts. Where `every` divides the CRC-32 of `<id>:<word>` (a null id is empty), the code point at that number modulo the word's length is left out."""
    starts, ends, rows = _words(data, offsets)
    lower = LOWER[data]
    hashes = span_hashes(prefix_hashes(lower), starts, ends)
    points = ends - starts - np.diff(np.append(0, np.cumsum(data == LATIN))[np.stack([starts, ends])], axis=0)[0]
    # A word that loses a code point must still have `least` of them; shorter ones cannot count.
    keep = np.flatnonzero(points >= least)
    starts, ends, rows, hashes, points = starts[keep], ends[keep], rows[keep], hashes[keep], points[keep]
    _, first, which, many = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    view = lower.tobytes()
    words = [view[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    found = dict(zip(words, many.tolist()))
    if every:
        prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        crc = joint_crc(prefix[rows], ends - starts, np.array([zlib.crc32(w) for w in words], np.uint32)[which])
        for k in np.flatnonzero(crc % np.uint32(every) == 0).tolist():
            word = words[which[k]]
            found[word] -= 1
            if points[k] > least:
                text, at = word.decode(), int(crc[k]) % int(points[k])
                short = (text[:at] + text[at + 1 :]).encode()
                found[short] = found.get(short, 0) + 1
    return found


def _counted(least: int, every: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            ids = batch.column("id").to_pylist()
            for a, b, data, offsets in chunks(batch, "text"):
                for w, n in chunk_counts(ids[a:b], data, offsets, least, every).items():
                    held[w] = held.get(w, 0) + n
                if len(held) >= HELD:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return run


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, least_n: int = 5, every: int | None = None) -> DataFrame:
    """(word, n): words of at least `least` code points that occur at least least_n times."""
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), text_or_empty(text_col).alias("text"))
    counts = texts.mapInArrow(_counted(least, every), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# Blocks: l is the length of the shorter words, a and b are how much of their prefix and suffix all words of the block share.


def _block_key(l: Column, a: Column, b: Column) -> list[Column]:
    """Where b is 0 the key sorts by the word, where a is 0 by the reversed word."""
    head, tail = F.substring("word", F.lit(1), a), F.when(b > 0, F.reverse(F.substring("word", -b, b))).otherwise("")
    return [head.alias("head"), tail.alias("tail"), l.alias("l")]


def _blocks(rows: DataFrame) -> DataFrame:
    """rows (word, n, l, a, b) with the key of their block; a and b follow from it."""
    return rows.select("word", "n", *_block_key(F.col("l"), F.col("a"), F.col("b")))


def first_blocks(words: DataFrame) -> DataFrame:
    """The block of each word's half by prefix and by suffix, as the shorter word and as the longer one of a pair."""
    both = words.withColumn("m", F.char_length("word")).select("word", "n", F.explode(F.array("m", F.col("m") - 1)).alias("l")).where("l > 0")
    half = F.floor(F.col("l") / 2).cast("int")
    pairs = F.array(F.struct(half.alias("a"), F.lit(0).alias("b")), F.struct(F.lit(0).alias("a"), (F.col("l") - half).alias("b")))
    return _blocks(both.select("word", "n", "l", F.explode(pairs).alias("s")).select("word", "n", "l", "s.*"))


def halved(rows: DataFrame) -> DataFrame:
    """The blocks that a block's words go on to: by the first half of what they do not share, and by its second half."""
    a, b = F.char_length("head"), F.char_length("tail")
    rest = F.col("l") - a - b
    first = F.floor(rest / 2).cast("int")
    pairs = F.array(F.struct((a + first).alias("a"), b.alias("b")), F.struct(a.alias("a"), (b + rest - first).alias("b")))
    return rows.select("word", "n", "l", F.explode(pairs).alias("s")).select("word", "n", "l", "s.*").transform(_blocks)


def _near_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of the words of each block, of rows sorted by block; (word, other, other_n) both ways."""

    def pairs(words: list[str]):
        # Words of one length are near if they are equal but for a gap at the same place, of two lengths if one is the other with a gap.
        seen: dict[tuple[int, str], list[int]] = {}
        for i, w in enumerate(words):
            for k in range(len(w)):
                seen.setdefault((k, w[:k] + w[k + 1 :]), []).append(i)
        where = {w: i for i, w in enumerate(words)}
        for (_, gap), of in seen.items():
            j = where.get(gap)
            for x, i in enumerate(of):
                if j is not None:
                    yield i, j
                for other in of[:x]:
                    yield i, other

    def verified(words, counts):
        found = set(pairs(words))
        return [(words[i], words[j], counts[j]) for i, j in found | {(j, i) for i, j in found}]

    key, words, counts, out = None, [], [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("head", "tail", "l", "word", "n")]
        for head, tail, l, word, n in zip(*columns):
            if (head, tail, l) != key:
                out += verified(words, counts) if len(words) > 1 else []
                key, words, counts = (head, tail, l), [], []
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(("word", "other", "other_n"), r)) for r in out], SCHEMA)
                    out = []
            words.append(word)
            counts.append(n)
    out += verified(words, counts) if len(words) > 1 else []
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(("word", "other", "other_n"), r)) for r in out], SCHEMA)


SCHEMA = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])
KEY = ["head", "tail", "l"]


def near_words(words: DataFrame, block_words: int = 256) -> DataFrame:
    """(word, other, other_n): all near pairs of words (word, n), both ways, each once."""
    todo, found = written(first_blocks(words)), []
    while True:
        large = written(todo.groupBy(*KEY).agg(F.count("*").alias("_n")).where(F.col("_n") > block_words).where(F.col("l") - F.char_length("head") - F.char_length("tail") > 1).select(*KEY))
        if large.isEmpty():
            found.append(todo)
            break
        found.append(todo.join(large, KEY, "left_anti"))
        todo = written(halved(todo.join(large, KEY, "left_semi")))
    blocks = found[0]
    for more in found[1:]:
        blocks = blocks.unionByName(more)
    # By the forward dictionary where a block shares a prefix, by the reversed one where it shares a suffix.
    ordered = blocks.distinct().repartitionByRange("tail", "head", "l").sortWithinPartitions("tail", "head", "l", "word")
    pairs = ordered.mapInArrow(_near_in_blocks, "word string, other string, other_n bigint")
    return pairs.groupBy("word", "other").agg(F.first("other_n").alias("other_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form: forms are followed to the last. Each round doubles the way; a form is more frequent than its word, so ways end."""
    links = written(forms.select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = written(links.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        moved = not links.where("_moved").isEmpty()
        links = links.drop("_moved")
        if not moved:
            return links


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, least_n: int = 5, factor: int = 5, every: int | None = None, block_words: int = 256) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; see the module."""
    words = written(count_words(df, id_col, text_col, least, least_n, every))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    chosen = near_words(words, block_words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("_best"))
    told = words.join(chosen, "word", "left").withColumn("form_n", F.when(-F.col("_best.less") >= factor * F.col("n"), -F.col("_best.less")))
    told = written(told.select("word", F.when(F.col("form_n").isNotNull(), F.col("_best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"))
    last = roots(told.where("form is not null"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
