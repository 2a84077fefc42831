r"""N-gram Jaccard join by several global token orders.

Texts are lower-cased (A-Z) and cut into words `[^\x20\x09-\x0D]+`; a document's
set are its distinct n-word shingles, as 64-bit hashes. Documents with equal
sets form a class and are compared once. Two classes link if 100 × shared
shingles >= percent × shingles of either.

A set of n shingles can only link with another if both have a shingle in common
among their first n - ceil(percent n / 100) + 1 ones, whatever order all
shingles are put in. So:

1. The first order begins with a fixed share of all shingles (by hash; a quarter
   for 90 percent), by document frequency, which is counted exactly up to CAP;
   the others follow by hash. The other orders are by hash alone.
2. Shingles of first-order prefixes join the classes that have them; what they
   connect, a cluster, is a superset of any linked group. A shingle known to be
   in one document only joins nothing and is not sent.
3. As tables grow, shingles of unrelated texts come to be in other documents, too,
   and chains of them join most classes to one cluster. A cluster of more than a
   block is connected anew by parts of its sets: hashes cut all shingles into
   parts, sets that may link differ in d shingles at most, so all but d parts are
   equal, and of each set the d + 1 parts with the most shingles must have one in
   common with the other's (the prefixes of 2., with parts for shingles). d
   follows from the sizes: sets lie in bands of sizes such that only those of
   neighbouring bands may link. A row for each of a set's parts is all that this
   sends, and equal parts of many shingles are rare but in near copies.
4. Clusters are cut into blocks, and every pair of blocks is one task's work.
   There a pair of classes must share a prefix shingle in every order; only such
   pairs are verified by their exact intersection. A task returns a spanning
   forest of its links, so that no group gives all its pairs.
5. Components over the links of all tasks.

Nulls and odd cases: a text without words has an empty set, links with nothing
and is its own component; with fewer than n words the whole sequence is one
shingle. Null ids rank behind all others. Rows that share an id, or have none,
are compared like other rows; they are told apart by a 64-bit hash of id and
text. Rows equal in both are sent once by a task's batch and counted. The
greatest 64-bit integer stands for a null id and is not told from it. An empty
table gives an empty result. Other columns are not read by `linked` and are kept
by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCKS, block_rows, by_bucket, doc_bucket, first_rows, give_back, numbers_of, packed, planes, runs_of, sent_texts, texts_of, unpacked
from .common import row_key, text_or_empty, written
from .components import components
from .repeats import join_groups
from .textbytes import BASE, LOWER, chunks, mix, prefix_hashes, span_hashes, words

#: Multipliers that put the shingles of one frequency into different orders.
ORDERS = (1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Shingles whose local counts are taken at once.
COUNTED = 2_000_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's shingles."""
    starts, ends, rows = words(data, offsets)
    word = span_hashes(prefix_hashes(LOWER[data]), starts, ends)
    first = np.searchsorted(rows, np.arange(len(offsets)))
    last = max(0, len(word) - size + 1)
    grams = word[:last].copy()
    for k in range(1, size):
        grams = grams * np.uint64(BASE) + word[k : last + k]
    grams = mix(grams)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(a, b):
                short = mix(short * np.uint64(BASE) + word[k : k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(grams: np.ndarray) -> bytes:
    """128 bits of the set; equal sets have equal ones."""
    with np.errstate(over="ignore"):
        total = mix(grams * np.uint64(ORDERS[1])).sum(dtype=np.uint64)
        other = mix(grams * np.uint64(ORDERS[2])).sum(dtype=np.uint64) ^ np.uint64(len(grams))
    return np.array([total, other], ">u8").tobytes()


def prefix_length(n, percent: int):
    return n - (n * percent + 99) // 100 + 1


def prefix(grams: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The first shingles of the set in an order by a hash."""
    n = prefix_length(len(grams), percent)
    return grams[np.argpartition(grams * np.uint64(order), n - 1)[:n]] if n < len(grams) else grams



def counted(grams: np.ndarray, percent: int) -> np.ndarray:
    """Which shingles come first in the first order, by document frequency; only theirs is counted. By hash a share of all, at least twice a prefix's share."""
    mask = 0
    while (mask + 1) * 4 * (100 - percent) <= 100:
        mask = mask * 2 + 1
    return (grams & np.uint64(mask)) == 0


#: Frequencies from this one on rank alike.
CAP = 16
#: Shingles that a task holds before it sends them.
HELD = 2_000_000


def _sent_shingles(size: int, percent: int, n: int):
    """Blocks of counted shingles by hash range. A task sends a shingle with its documents, or, once it has CAP of them, only that it has; these documents' ranks pass through the next step."""

    def flush(keys, tokens):
        order = np.argsort(tokens, kind="stable")
        tokens, keys = tokens[order], keys[order]
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        counts = np.diff(np.append(starts, len(tokens)))
        many = np.repeat(counts >= CAP, counts)
        known = tokens[starts[counts >= CAP]]
        bucket = lambda t: (t * np.uint64(n) >> np.uint64(48)).astype(np.int64)
        out = [(b, packed("full", known[i])) for b, i in by_bucket(bucket(known))] if len(known) else []
        keys, tokens, own, full = keys[~many], tokens[~many], keys[many], tokens[many]
        for b, i in by_bucket(bucket(tokens)) if len(tokens) else ():
            names, which = np.unique(keys[i], return_inverse=True)
            out.append((b, packed("shingles", planes(np.diff(tokens[i], prepend=np.uint64(0))), planes(np.diff(names, prepend=0)), which.astype(np.uint32))))
        for b, i in by_bucket(doc_bucket(own, n)) if len(own) else ():
            out.append((b, packed("known", own[i], full[i], np.full(len(i), CAP, np.uint8))))
        return block_rows(out)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        held, many = [], 0
        for batch in batches:
            batch, _ = first_rows(batch)
            keys = batch.column("key").to_numpy()
            for a, b, data, offsets in chunks(batch, "text"):
                sets = shingle_sets(data, offsets, size)
                tokens = np.concatenate(sets)
                use = counted(tokens, percent)
                held.append((np.repeat(keys[a:b], [len(s) for s in sets])[use], tokens[use] >> np.uint64(16)))
                many += int(use.sum())
                if many >= HELD:
                    yield flush(*map(np.concatenate, zip(*held)))
                    held, many = [], 0
        if many:
            yield flush(*map(np.concatenate, zip(*held)))
        held = None
        give_back()

    return send


def _frequencies(n: int):
    """For one hash range: blocks by document of (key, shingle, frequency up to CAP) of shingles that two rows or more have."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out, tokens, keys, weights = [], [], [], []
        for kind, *x in map(unpacked, pdf.payload):
            if kind == "known":
                out.append((int(pdf.bucket.iloc[0]), packed(*x)))
            elif kind == "full":
                tokens.append(x[0])
                keys.append(np.zeros(len(x[0]), np.int64))
                weights.append(np.full(len(x[0]), CAP, np.int64))
            else:
                tokens.append(np.cumsum(numbers_of(x[0])))
                keys.append(np.cumsum(numbers_of(x[1]).view(np.int64))[x[2]])
                weights.append(np.ones(len(tokens[-1]), np.int64))
        if tokens:
            token, of, weight = map(np.concatenate, (tokens, keys, weights))
            order = np.argsort(token, kind="stable")
            token, of, weight = token[order], of[order], weight[order]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            total = np.minimum(np.add.reduceat(weight, starts), CAP)
            total = np.repeat(total, np.diff(np.append(starts, len(token))))
            keep = np.flatnonzero((total > 1) & (weight < CAP))
            for b, i in by_bucket(doc_bucket(of[keep], n)) if len(keep) else ():
                i = keep[i]
                out.append((b, packed(of[i], token[i], total[i].astype(np.uint8))))
        give_back()
        return pd.DataFrame(out, columns=["bucket", "payload"])

    return count


def _first_order(grams: np.ndarray, tokens: np.ndarray, frequency: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of the first order's prefix that another document may have: all that are not known to be in one document only."""
    rank = np.where(counted(grams, percent), 1, CAP + 1)
    if len(tokens):
        own = grams >> np.uint64(16)
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        rank = np.where((tokens[at] == own) & (rank == 1), frequency[at], rank)
    first = np.lexsort((grams, rank))[: prefix_length(len(grams), percent)]
    return grams[first[rank[first] > 1]]


MEASURED = "id bigint, key bigint, many bigint, n bigint, sig binary, tokens array<bigint>, grams binary"


def _measured(size: int, percent: int):
    """For one bucket of documents: their sizes, signatures, first-order prefixes, and the sets of those that may link."""

    def measure(key, docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(docs):
            keys, ids, many, offsets, data = texts_of(docs.payload)
            of = token = frequency = np.zeros(0, np.int64)
            if len(found):
                of, token, frequency = (np.concatenate(x) for x in zip(*map(unpacked, found.payload)))
                order = np.lexsort((token, of))
                of, token, frequency = of[order], token[order], frequency[order].astype(np.int64)
            low, high = np.searchsorted(of, keys, "left"), np.searchsorted(of, keys, "right")
            for a, b in runs_of(offsets, np.ones(len(ids), bool)):
                base = offsets[a]
                for i, grams in zip(range(a, b), shingle_sets(data[base : offsets[b]], offsets[a : b + 1] - base, size)):
                    if not len(grams):
                        rows.append((ids[i], keys[i], many[i], 0, None, None, None))
                        continue
                    some = slice(low[i], high[i])
                    first = _first_order(grams, token[some], frequency[some], percent)
                    rows.append((ids[i], keys[i], many[i], len(grams), signature(grams), first.view(np.int64).tolist(), grams.tobytes() if len(first) else None))
        give_back()
        return pd.DataFrame(rows, columns=["id", "key", "many", "n", "sig", "tokens", "grams"])

    return measure


def measured(docs: DataFrame, size: int, percent: int, bucket_bytes: int) -> DataFrame:
    """MEASURED of every document, written; many is the number of a row among its equals, of which only the first has tokens and grams."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    dealt = lambda x: x.repartition(n, "bucket").groupBy("bucket")
    frequencies = dealt(docs.mapInArrow(_sent_shingles(size, percent, n), BLOCKS)).applyInPandas(_frequencies(n), BLOCKS)
    found = dealt(docs.mapInArrow(sent_texts(n), BLOCKS)).cogroup(dealt(frequencies)).applyInPandas(_measured(size, percent), MEASURED)
    found = found.withColumn("many", F.explode(F.sequence(F.lit(1).cast("bigint"), "many")))
    return written(found.withColumns({c: F.when(F.col("many") == 1, F.col(c)) for c in ("tokens", "grams")}))


def size_bands(largest: int, percent: int) -> np.ndarray:
    """The least size of each band, beyond `largest`; sets of sizes that are not in the same or in neighbouring bands cannot link."""
    low = [1]
    while low[-1] <= largest:
        low.append(low[-1] * 100 // percent + 1)
    return np.array([*low, low[-1] * 100 // percent + 1])


def _parts(grams: np.ndarray, differences: int, seed: int) -> np.ndarray:
    """Hashes of the parts of a set that have the most of its shingles; sets that differ in so many shingles at most share one."""
    n = differences + 1
    # Some parts more than are needed, so that those of few shingles are not among the first.
    k = n + n // 6
    part = ((grams >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    ends = np.cumsum(np.bincount(part, minlength=k))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams * np.uint64(ORDERS[1])), dtype=np.uint64)])[np.concatenate([[0], ends])]
    own = mix(sums[1:] - sums[:-1] + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(ORDERS[2]) + np.uint64(seed * BASE % (1 << 64)))
    return own[np.lexsort((own, -np.diff(ends, prepend=0)))[:n]]


def set_parts(grams: np.ndarray, bands: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of parts of a sorted set; two different sets that link have one in common. A set is cut for its own band, with the next one, and for the one before."""
    band = int(np.searchsorted(bands, len(grams), "right")) - 1
    out = []
    for b in (band - 1, band):
        if b >= 0:
            most = int(bands[b + 1]) - 1
            differences = (100 - percent) * (most + most * 100 // percent) // (100 + percent)
            # Sets of so few shingles only link when they are equal.
            if differences:
                out.append(_parts(grams, differences, b))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def refined(roots: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """(node, root) with the clusters of more than a block connected anew, by equal parts of sets (sig, grams)."""
    roots = roots.select("node", "root")
    large = roots.groupBy("root").agg(F.count("*").alias("members")).where(F.col("members") > block)
    # Fewer than a row for each block.
    kept, again = roots.join(F.broadcast(large.select("root")), "root", "left_anti"), roots.join(F.broadcast(large.select("root")), "root")
    chosen = sets.join(again.select(F.col("node").alias("sig")), "sig", "left_semi")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [np.frombuffer(g, np.uint64) for g in pdf.grams]
            bands = size_bands(max(map(len, found), default=0), percent)
            tokens = [set_parts(g, bands, percent) for g in found]
            if tokens:
                yield pd.DataFrame({"token": np.concatenate(tokens).view(np.int64), "sig": np.repeat(pdf.sig.to_numpy(), [len(t) for t in tokens])})

    return kept.select("node", "root").unionByName(connected(chosen.mapInPandas(cut, "token bigint, sig binary")))


def clusters(found: DataFrame) -> DataFrame:
    """(node, root): classes connected by shingles that their first-order prefixes share."""
    return connected(found.where("sig is not null").select(F.explode("tokens").alias("token"), "sig").distinct())


def connected(pairs: DataFrame) -> DataFrame:
    """(node, root): classes (token, sig) connected by tokens that they share."""
    pairs = written(pairs)
    shared = pairs.groupBy("token").agg(F.min("sig").alias("first"), F.count("*").alias("n")).where("n > 1")
    links = join_groups(pairs, shared, "token", "n", pairs.count())
    return components(links.where(F.col("sig") != F.col("first")).select(F.col("sig").alias("u"), F.col("first").alias("v")))


def shared_counts(rows: np.ndarray, tokens: np.ndarray, n: int, dense_from: int = 48) -> np.ndarray:
    """How many tokens each two of n rows share: pairs of rows for rarer tokens, products of indicator matrices for those of many rows."""
    order = np.argsort(tokens, kind="stable")
    rows, tokens = rows[order], tokens[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    sizes = np.diff(np.append(starts, len(tokens)))
    out = np.zeros((n, n), np.int32)
    for d in np.unique(sizes[(sizes > 1) & (sizes < dense_from)]):
        at = rows[starts[sizes == d][:, None] + np.arange(d)]
        for some in np.array_split(at, 1 + at.size * d // 2_000_000):
            np.add.at(out, (np.repeat(some, d, 1).ravel(), np.tile(some, d).ravel()), 1)
    dense = np.flatnonzero(sizes >= dense_from)
    for a in range(0, len(dense), 2048):
        some = dense[a : a + 2048]
        x = np.zeros((n, len(some)), np.float32)
        for k, g in enumerate(some):
            x[rows[starts[g] : starts[g] + sizes[g]], k] = 1
        out += (x @ x.T).astype(np.int32)
    np.fill_diagonal(out, 0)
    return out


def forest(links: np.ndarray) -> np.ndarray:
    """The least number that each row of a symmetric matrix of links can reach."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(1, initial=len(links)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def verified(sets: list[np.ndarray], side: np.ndarray, percent: int) -> np.ndarray:
    """Labels of the rows after all links between them; with two sides only links between the sides count."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    allowed = np.minimum.outer(sizes, sizes) * 100 >= percent * np.maximum.outer(sizes, sizes)
    if len(np.unique(side)) > 1:
        allowed &= side[:, None] != side[None, :]
    np.fill_diagonal(allowed, False)
    for order in ORDERS:
        parts = [prefix(s, order, percent) for s in sets]
        allowed &= shared_counts(np.repeat(np.arange(n), [len(p) for p in parts]), np.concatenate(parts), n) > 0
    use = np.flatnonzero(allowed.any(1))
    label = np.arange(n)
    if len(use):
        both = shared_counts(np.repeat(np.arange(len(use)), sizes[use]), np.concatenate([sets[i] for i in use]), len(use))
        union = np.add.outer(sizes[use], sizes[use]) - both
        linked = allowed[np.ix_(use, use)] & (100 * both.astype(np.int64) >= percent * union.astype(np.int64))
        label[use] = use[forest(linked)]
    return label


def links(found: DataFrame, percent: int, block: int) -> DataFrame:
    """(u, v): a spanning forest of the links between classes, by signature, from every pair of blocks."""
    # Copies of a class have equal sets; one of them is enough.
    sets = found.where("grams is not null").select("sig", "key").groupBy("sig").agg(F.min("key").alias("key"))
    sets = found.where("grams is not null").select("sig", "key", "grams").join(sets, ["sig", "key"], "left_semi").select("sig", "grams")
    roots = written(clusters(found))
    roots = written(refined(roots, sets, percent, block))
    blocks = roots.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("members"))
    members = join_groups(roots, blocks, "root", "members", roots.count()).drop("members")
    members = members.join(sets, members["node"] == sets["sig"]).select("sig", "grams", "root", "blocks")
    mine = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    members = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = F.struct("root", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("sig")
        label = verified([np.frombuffer(g, np.uint64) for g in pdf.grams], pdf.side.to_numpy(), percent)
        keep = label != np.arange(len(pdf))
        sigs = pdf.sig.to_numpy()
        return pd.DataFrame({"u": sigs[keep], "v": sigs[label[keep]]})

    rows = members.select(key.alias("key"), (F.col("mine") > F.col("other")).alias("side"), "sig", "grams")
    return rows.groupBy("key").applyInPandas(verify, "u binary, v binary")


#: Stands for a null id.
MISSING = (1 << 63) - 1


def _components(df: DataFrame, id_col: str, text_col: str, size: int, percent: int, block: int, bucket_bytes: int) -> DataFrame:
    """One row per row of df: id, key, many (its number among equal rows), n, and first, the least (id, key) of its component."""
    text = text_or_empty(text_col)
    docs = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(MISSING)).alias("id"), row_key(id_col, text).alias("key"), text.alias("text"))
    found = measured(docs, size, percent, bucket_bytes)
    roots = components(links(found, percent, block))
    one = F.struct("id", "key")
    classes = found.where("sig is not null").groupBy("sig").agg(F.min(one).alias("first"), F.count("*").alias("members"))
    classes = classes.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    classes = written(classes)
    least = classes.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("classes"))
    named = join_groups(classes, least, "root", "classes", classes.count()).select("sig", "component", "members")
    columns = ["id", "key", "many", "n"]
    rows = join_groups(found.where("sig is not null"), named, "sig", "members", found.count()).select(*columns, F.col("component").alias("first"))
    return rows.unionByName(found.where("sig is null").select(*columns, one.alias("first")))


def linked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, block: int = 800, bucket_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id."""
    rows = _components(df, id_col, text_col, size, percent, block, bucket_bytes)
    given = lambda c: F.when(c != MISSING, c)
    return rows.select(given(F.col("id")).alias("id"), F.col("n").alias("n_shingles"), given(F.col("first.id")).alias("component_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, block: int = 800, bucket_bytes: int = 8 << 20) -> DataFrame:
    """The rows of df that stay: one of every component, with all columns: that with the least id (null ids last), then the least hash of id and text. Rows without words all stay."""
    found = written(_components(df, id_col, text_col, size, percent, block, bucket_bytes).where("n > 0").select("key", (F.col("key") != F.col("first.key")).alias("gone")))
    # Keys of which not each row stays; those of many rows are broadcast, so their rows stay where they are.
    fates = written(found.groupBy("key").agg(F.first("gone").alias("gone"), F.count("*").alias("members")).where("gone or members > 1"))
    rows = df.select(F.struct("*").alias("row"), row_key(id_col, text_or_empty(text_col)).alias("key"))
    hot = F.broadcast(fates.where(F.col("members") * 1000 > found.count()))
    cold = fates.join(hot.select("key"), "key", "left_anti")
    told = rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(cold, "key", "left"))
    copies = told.where("not gone").groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return told.where("members is null").select("row").unionByName(copies.select("row")).select("row.*")
