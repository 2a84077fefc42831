"""Lexical search, decontamination and spelling variants against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from meshlake.llm import decontamination, fm_index, lexical_search, spelling

DOCS = "doc_id bigint, text string, lang string, item string, n bigint"
ITEMS = "item_id bigint, text string, id string, terms string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return TERM.findall((text or "").translate(LOWER))


def documents(seed, n=60, vocabulary=40):
    """Nulls, empty and long texts, repeated rows, null ids, and passages that come again."""
    rng = random.Random(seed)
    words = [f"{rng.choice('abcÀéß')}w{k}" for k in range(vocabulary)]
    passage = " ".join(rng.choices(words, k=25))
    out = [(1, None), (2, ""), (None, " .,- "), (3, " ".join(rng.choices(words, k=3000))), (None, passage), (None, passage), (4, passage.upper()), (4, passage.upper())]
    for k in range(n):
        text = rng.choices(words, weights=[1 / (j + 1) for j in range(vocabulary)], k=rng.randint(1, 60))
        if k % 5 == 0:
            text[len(text) // 2 : len(text) // 2] = [passage]
        out.append((10 + k, rng.choice((" ", ", ", "--")).join(text)))
    items = [(1, passage), (1, passage[:40]), (2, words[0]), (None, " ".join(rng.choices(words, k=12))), (3, None), (4, "..."), (5, f"{words[1]} {words[0]} {words[1]}"), (6, "unseen words only"), (7, " ".join(rng.choices(words, k=30)))]
    return out, items


@pytest.fixture(scope="module")
def frames(spark):
    def make(rows, items):
        return spark.createDataFrame([(*r, "x", "y", 0) for r in rows], DOCS), spark.createDataFrame([(*r, "x", "y") for r in items], ITEMS)

    return make


def brute_ranks(rows, items, k):
    docs = [(i, Counter(words_of(t))) for i, t in rows if words_of(t)]
    total = sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    out = []
    for item, text in items:
        asked, scores = Counter(words_of(text)), []
        for i, c in docs:
            n = sum(c.values())
            m = 100 - 75 + (75 * n * len(docs)) // total
            score = sum(q * math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w, q in asked.items() if c[w])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return Counter(out)


@pytest.mark.parametrize("k, block, cells", [(10, 100_000, 1 << 22), (3, 20, 200), (1, 1, 1 << 22)])
def test_lexical_search(spark, frames, monkeypatch, k, block, cells):
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    monkeypatch.setattr(lexical_search, "HELD", 50)
    rows, items = documents(k)
    df, asked = frames(rows, items)
    got = lexical_search.search(df.repartition(5), asked, k=k, block_terms=block)
    assert Counter((r.item_id, r["rank"], r.id, r.score) for r in got.collect()) == brute_ranks(rows, items, k)


def test_lexical_search_empty(frames):
    rows, items = documents(1, 3)
    df, asked = frames(rows, items)
    assert lexical_search.search(df.limit(0), asked).count() == 0
    assert lexical_search.search(df, asked.limit(0)).count() == 0
    assert lexical_search.search(df.where("doc_id < 3"), asked).count() == 0


def test_thresholds_prune_terms(spark, frames):
    """The seeded bound of an item never exceeds its kth score, and prunes terms."""
    rows, items = documents(4, 200, 30)
    ranks = brute_ranks(rows, [(k, t) for k, (_, t) in enumerate(items)], 3)
    df, asked = frames(rows, [(k, t) for k, (_, t) in enumerate(items)])
    queries = lexical_search.profiles(asked, "item_id", "text").withColumnRenamed("id", "item")
    docs = lexical_search.profiles(df, "doc_id", "text").where("n > 0")
    n, total = docs.selectExpr("count(*)", "sum(n)").first()
    seeds = lexical_search.seeded(queries, lexical_search.term_stats(docs, n, total, 3)).collect()
    last = defaultdict(int)
    for item, r, _, score in ranks:
        last[item] = score if r == 3 else last[item]
    assert all(s.theta <= last[s.item] for s in seeds if last[s.item])
    assert any(t.rest < s.theta for s in seeds for t in s.terms)


def brute_hits(rows, items, window):
    phrases = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        size = min(window, len(w))
        for j in range(len(w) - size + 1 if size else 0):
            phrases[tuple(w[j : j + size])].add("" if item is None else str(item))
    out = []
    for i, text in rows:
        w = words_of(text)
        hit, found = np.zeros(len(w), bool), set()
        for size in range(1, window + 1):
            for j in range(len(w) - size + 1):
                if tuple(w[j : j + size]) in phrases:
                    hit[j : j + size] = True
                    found |= phrases[tuple(w[j : j + size])]
        out.append((i, len(w), int(hit.sum()), tuple(sorted(found))))
    return Counter(out)


@pytest.mark.parametrize("window, shard, block, located", [(10, 1 << 20, 200_000, 1 << 20), (4, 50, 30, 7), (1, 500, 200_000, 100)])
def test_decontamination(spark, frames, monkeypatch, window, shard, block, located):
    monkeypatch.setattr(decontamination, "LOCATED", located)
    rows, items = documents(window)
    df, asked = frames(rows, items)
    got = decontamination.contamination(df.repartition(3), asked, window=window, shard_words=shard, block_words=block).collect()
    assert Counter((r.id, r.n_words, sum(s.end - s.start for s in r.spans), tuple(r["items"])) for r in got) == brute_hits(rows, items, window)
    assert all(a.end < b.start for r in got for a, b in zip(r.spans, r.spans[1:]))


def test_decontamination_empty(spark, frames):
    rows, items = documents(2, 4)
    df, asked = frames(rows, items)
    assert decontamination.contamination(df.limit(0), asked).count() == 0
    clean = decontamination.contamination(df, asked.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r.spans or r["items"] for r in clean)


def test_without_spans(spark):
    df = spark.createDataFrame([("One, two; three - four.", [(1, 3)]), ("À b", [(0, 2)]), ("x y", []), (None, [(0, 1)])], "t string, s array<struct<start:bigint,end:bigint>>")
    assert [r.x for r in df.select(decontamination.without_spans(df["t"], df["s"]).alias("x")).collect()] == ["One,  - four.", "", "x y", None]


@pytest.mark.parametrize("seed", range(6))
def test_fm_index(seed):
    """Order, ranges and positions against sorted suffixes, over texts with long repeats."""
    rng = np.random.default_rng(seed)
    rows, words = [], []
    base = rng.integers(1, 3 + seed, 70)
    for d in range(12):
        w = base if d % 3 == 0 else rng.integers(1, 3 + 4 * seed, rng.integers(0, 50))
        rows.append(np.full(len(w), d))
        words.append(w)
    rows, words = np.concatenate(rows), np.concatenate(words).astype(np.uint64)
    index = fm_index.Index(fm_index.build(rows, words, 12))
    text = np.zeros(index.n, np.int64)
    text[np.arange(len(rows)) + rows] = words
    ends = np.flatnonzero(text == 0)
    key = lambda i: [(int(v), 0) if v else (0, j) for j, v in enumerate(text[i : ends[np.searchsorted(ends, i)] + 1].tolist(), i)]
    symbols = np.searchsorted(np.unique(words), text) + 1
    symbols[text == 0] = 0
    assert fm_index.suffix_array(symbols.astype(np.uint32)).tolist() == sorted(range(index.n), key=key)
    for size in (1, 2, 5):
        for i in rng.integers(0, index.n - size, 20):
            phrase = text[i : i + size]
            want = [j for j in range(index.n - size + 1) if (text[j : j + size] == phrase).all()] if phrase.all() else []
            padded = np.concatenate([np.zeros(5 - size, np.int64), phrase]).astype(np.uint64)[None]
            low, high = index.ranges(padded, np.array([size]))
            if phrase.all():
                assert sorted(index.positions(np.arange(low[0], high[0])).tolist()) == want
    low, high = index.ranges(np.array([[0, 999]], np.uint64), np.array([1]))
    assert low[0] >= high[0]


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute_variants(rows, least, least_n, factor, every):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= least_n}
    out, form = {}, {}
    for w in n:
        others = sorted((-n[x], x) for x in n if near(w, x))
        good = others and -others[0][0] >= factor * n[w]
        form[w] = others[0][1] if good else None
        out[w] = (form[w], n[w], len(others), -others[0][0] if good else None)
    root = lambda w: root(form[w]) if form[w] else w
    return {(w, v[0], root(w), *v[1:]) for w, v in out.items()}


@pytest.mark.parametrize("block, every", [(256, 7), (3, 2), (8, None)])
def test_spelling(spark, monkeypatch, block, every):
    monkeypatch.setattr(spelling, "HELD", 100)
    rng = random.Random(block)
    stem = [rng.choice(("inter", "à", "")) + "".join(rng.choices("abé", k=rng.randint(4, 8))) + rng.choice(("ation", "ß", "")) for _ in range(60)]
    rows = [(None, None), (1, ""), (2, "12 34 ÿÿ×÷"), (3, "a" * 5000 + " " + "a" * 4999 + " ")] + [(3, "a" * 5000 + " " + "a" * 4999 + " ")] * 3
    for k in range(150):
        w = rng.choices(stem, weights=[1 / (j + 1) for j in range(60)], k=30)
        rows.append((rng.choice((k, None)), rng.choice((" ", "-", "1")).join(x.upper() if rng.random() < 0.1 else x for x in w)))
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "doc_id bigint, text string, n bigint, word string")
    got = spelling.variants(df, least=6, least_n=2, factor=3, every=every, block_words=block)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_variants(rows, 6, 2, 3, every)
    assert spelling.variants(df.limit(0), every=every).count() == 0


def test_near_in_hot_blocks(spark):
    """A third of the words share a prefix and others a suffix: blocks are subdivided and lose no pair."""
    rng = random.Random(2)
    make = lambda: "".join(rng.choices("abc", k=rng.randint(4, 6)))
    words = {"prefix" + make() for _ in range(150)} | {make() + "suffix" for _ in range(150)} | {"mid" + make() + "dle" for _ in range(150)}
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n bigint")
    got = {(r.word, r.other) for r in spelling.near_words(df, 4).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}
    assert spelling.near_words(df, 4).count() == len(got)
