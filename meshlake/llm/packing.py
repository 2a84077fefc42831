"""Packing of tokenised documents into sequences of a fixed length: bin completion by branch and bound.

Documents are tokenised in one pass and only those longer than a sequence are
cut. Pieces are dealt by a hash into groups of about `group_size`. In a group, a
best-fit solution is the first incumbent. The search then takes the longest
piece left and enumerates, depth first, the undominated fillings of the rest of
its sequence: of any number of pieces, with no room for a piece left out, and
without a chosen piece that a longer one left out could replace. Fillings that
waste more than a better solution may are pruned; the others are tried by least
waste, and the search goes back when the waste so far shows that the incumbent
cannot be beaten. It ends at the lower bound (tokens / capacity, rounded up) or
after `work` partial fillings; a sequence's enumeration ends after `listed`
fillings or STEPS partial ones. Within these limits the search is complete; beyond them
the best solution found stands. The emptiest sequence of every group is packed
again with those of other groups.

Nulls and odd cases: a null text counts as empty; an empty document is its end
token alone. A null id is kept as null. Repeated rows are packed as often as
they occur. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import struct
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import CACHES, give_back
from .common import text_or_empty, written

#: Words kept in each of the two generations of a worker's cache of token ids.
CACHED_WORDS = 200_000
_coders: dict[str, WordCoder] = {}
CACHES.append(_coders)


class Recent(dict):
    """A bounded cache of what `make` gives: when full, it becomes the old generation, from which words still in use come back."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write for bytes: printable ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordCoder:
    """Token ids of a text as little-endian bytes, word by word: this tokenizer never joins across white space and ignores the case of A-Z."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.words = Recent(self.word)

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        letters = text[:-1] if len(text) > 1 and text[-1] in ".,|" else text
        plain = letters.isalpha() and letters == letters.lower() and unicodedata.is_normalized("NFC", letters)
        if plain and letters != text:
            return self.words[word[:-1]] + self.words[word[-1:]]
        if plain:
            tokens = self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.letters))
            return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return self.plain(text)

    def encode(self, raw: bytes) -> bytes:
        if b"<|" in raw:  # may hold a special token, whose letters' case counts
            return self.plain(raw.decode("utf-8", "replace"))
        return b"".join(map(self.words.__getitem__, raw.lower().split()))


def _coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(_coders)
        coder, end = _coder(tokenizer_path), int(end_id).to_bytes(4, "little")
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, raw in enumerate(batch.column("text")):
                ids = coder.encode(raw.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            ids = batch.column("id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["id", "piece", "start", "length", "ids_crc32"])
        give_back(_coders)

    kind = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(cut, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class Lengths:
    """A multiset of lengths that finds the largest one up to a bound."""

    def __init__(self, lengths):
        values, counts = np.unique(np.asarray(lengths, int), return_counts=True)
        self.sorted = values.tolist()
        self.count = dict(zip(self.sorted, counts.tolist()))

    def up_to(self, most: int) -> int:
        at = bisect_right(self.sorted, most)
        return self.sorted[at - 1] if at else 0

    def take(self, length: int) -> None:
        self.count[length] -= 1
        if not self.count[length]:
            del self.count[length]
            del self.sorted[bisect_right(self.sorted, length) - 1]

    def put(self, length: int) -> None:
        if length not in self.count:
            insort(self.sorted, length)
            self.count[length] = 0
        self.count[length] += 1


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best fit over falling lengths: each piece goes to the fullest sequence that has room."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for x in sorted(lengths, reverse=True):
        at = bisect_right(rooms, (x, -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
            bins[k].append(x)
        else:
            room, k = capacity, len(bins)
            bins.append([x])
        if room > x:
            insort(rooms, (room - x, k))
    return bins


#: Partial fillings that one enumeration looks at.
STEPS = 1000


def fillings(left: Lengths, room: int, allowed: int, listed: int = 32) -> tuple[list[tuple[int, tuple[int, ...]]], int]:
    """(undominated fillings (waste, lengths) of a room that waste at most `allowed`, least waste first; partial fillings looked at)."""
    values = left.sorted[: bisect_right(left.sorted, room)][::-1]
    counts = [left.count[v] for v in values]
    below = [0]  # tokens of this and all shorter pieces
    for v, c in zip(reversed(values), reversed(counts)):
        below.append(below[-1] + v * c)
    below.reverse()
    found: list[tuple[int, tuple[int, ...]]] = []
    # (place in values, room, least length left out so far, chosen as a chain of (place, number, chain))
    todo: list = [(0, room, room + 1, None)]
    steps = 0
    while todo and steps < STEPS and len(found) < listed:
        steps += 1
        at, rest, shortest, chain = todo.pop()
        while at < len(values) and values[at] > rest:
            at += 1
        if rest - below[at] > allowed or rest - below[at] >= shortest:
            continue
        if at == len(values):
            if not _dominated(values, counts, chain, rest):
                full = []
                while chain:
                    full += [values[chain[0]]] * chain[1]
                    chain = chain[2]
                found.append((rest, tuple(reversed(full))))
                if not rest:
                    break
            continue
        most = min(counts[at], rest // values[at])
        for n in range(most + 1):
            todo.append((at + 1, rest - n * values[at], min(shortest, values[at]) if n < counts[at] else shortest, (at, n, chain) if n else chain))
    return sorted(found), steps


def _dominated(values: list[int], counts: list[int], chain, rest: int) -> bool:
    """Whether a longer piece left out could take the place of a chosen one."""
    chosen = {}
    while chain:
        chosen[chain[0]] = chain[1]
        chain = chain[2]
    for at in chosen:
        k = at - 1
        while k >= 0 and values[k] <= values[at] + rest:
            if chosen.get(k, 0) < counts[k]:
                return True
            k -= 1
    return False


def bin_completion(lengths: list[int], capacity: int, work: int = 1_000_000) -> list[list[int]]:
    """Lengths dealt into as few sequences as the search finds; the best-fit solution stands if nothing better turns up."""
    incumbent = best_fit(lengths, capacity)
    total = sum(lengths)
    bound = -(-total // capacity)
    if len(incumbent) <= bound:
        return incumbent
    left, path = Lengths(lengths), []
    waste, open_choices, count = 0, [], len(lengths)
    placed = 0
    while work > 0:
        work -= 1
        if placed == count:
            if len(path) < len(incumbent):
                incumbent = [list(p) for p, _ in path]
            if len(incumbent) <= bound:
                break
            choices = []
        else:
            first = left.sorted[-1]
            left.take(first)
            spare = (len(incumbent) - 1) * capacity - total - waste
            found, steps = fillings(left, capacity - first, spare)
            work -= steps
            choices = [(w, (first, *f)) for w, f in found]
            left.put(first)
        open_choices.append(choices)
        while open_choices:
            allowed = (len(incumbent) - 1) * capacity - total  # waste of a solution with one sequence less
            while open_choices[-1] and waste + open_choices[-1][0][0] > allowed:
                open_choices[-1].pop(0)
            if open_choices[-1] and len(path) + 1 < len(incumbent):
                w, full = open_choices[-1].pop(0)
                for x in full:
                    left.take(x)
                path.append((full, w))
                waste += w
                placed += len(full)
                break
            open_choices.pop()
            if path:
                full, w = path.pop()
                for x in full:
                    left.put(x)
                waste -= w
                placed -= len(full)
        if not open_choices:
            break
    return incumbent


def _packed(capacity: int, level: int, work: int):
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "ids_crc32", "id", "piece"]).reset_index(drop=True)
        lengths = pdf.length.to_numpy()
        at = {int(v): list(range(a, b)) for v, a, b in zip(*_runs(lengths))}
        order, seq, offset = [], [], []
        for k, full in enumerate(bin_completion(lengths.tolist(), capacity, work)):
            place = 0
            for x in full:
                order.append(at[x].pop())
                seq.append(k)
                offset.append(place)
                place += x
        out = pdf.iloc[order].copy()
        seq, base = np.array(seq, np.int64), (np.int64(level) << 60) + (np.int64(pdf["group"].iloc[0]) << 24)
        fill = np.bincount(seq, out.length.to_numpy())
        return out.assign(sequence_id=base + seq, offset=np.array(offset, np.int64), last=seq == fill.argmin())

    return packed


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, starts = np.unique(values, return_index=True)
    return names, starts, np.append(starts[1:], len(values))


def pack(df: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", group_size: int = 16_384, work: int = 1_000_000) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = written(pieces(df, tokenizer_path, capacity, end_id, id_col, text_col))
    n = cut.count()
    names = [*cut.columns, "group", "sequence_id", "offset", "last"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", group bigint, sequence_id bigint, offset bigint, last boolean"
    # Equal rows are told apart by their place in the written table, so that no group has them all.
    deal = lambda groups: F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(max(1, groups)))
    one = written(cut.withColumn("group", deal(math.ceil(n / group_size))).groupBy("group").applyInPandas(_packed(capacity, 0, work), schema))
    rest = one.where("last").select(*cut.columns, deal(math.ceil(n / group_size / 256)).alias("group"))
    two = rest.groupBy("group").applyInPandas(_packed(capacity, 1, work), schema)
    return one.where("not last").select(*names).unionByName(two).drop("group", "last")
