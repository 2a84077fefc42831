import hashlib
import itertools
import os
import random
import re
import shutil
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import check
from pyspark.sql import functions as F

from meshlake.llm import exact_dedup, language_id, license_scan, license_texts, mixing, ngram_join, packing, quality_classifier, quality_rules, queries, suffix_dedup, warc
from meshlake.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE = r"[\x20\x09-\x0D]"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like results."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(30_000))
    base = " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(80))
    near = base.replace(base.split()[40], "changed", 1)
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (None, base), (None, None), (5, long), (6, long + " x"), (7, near), (8, "one two"), (9, "one  two\t"), (10, "!!! ### 123"), (11, "\n \n")]
    full = [(i, t, ["en", None, "fr"][k % 3], ["a", None, "b"][k % 3], None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS).withColumns({"keep_id": F.lit(9), "size": F.lit("x"), "block": F.lit(1), "digest": F.lit(None), "row": F.lit(2), "n_words": F.lit(0)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    check(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_exact_dedup_odd(odd, empty):
    got = exact_dedup.duplicate_groups(odd, bits_per_row=1).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[re.sub(SPACE + "+", " ", r.text or "")].append(r.doc_id)
    want = sorted((len(v), str(min((i for i in v if i is not None), default=None))) for v in groups.values() for _ in v)
    assert sorted((r.group_size, str(r.keep_id)) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert exact_dedup.duplicate_groups(empty).count() == 0


def brute_components(rows, size, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in members.items()}
    return sorted((str(rows[i][0]), len(sets[i]), str(least[find(i)])) for i in range(len(rows)))


def test_ngram_join_odd(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = ngram_join.linked(odd, size=3, percent=90)
    assert sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute_components(rows, 3, 90)
    assert ngram_join.linked(empty).count() == 0


def test_ngram_join_random(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.randint(5, 90))
        for _ in range(10):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for size, percent in ((3, 90), (5, 80), (1, 60)):
        got = ngram_join.linked(df, size=size, percent=percent, block=7, bucket_bytes=2000)
        assert sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute_components(rows, size, percent)


def test_ngram_join_of_chained_texts(spark):
    """Texts of few different shingles are one cluster by their shingles; by parts of their sets only near copies are together, and no link is lost."""
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(9)]
    rows = []
    for _ in range(60):
        base = rng.choices(vocabulary, k=rng.randint(30, 120))
        for k in range(3):
            rows.append((len(rows), " ".join(w if rng.random() > 0.005 * k else rng.choice(vocabulary) for w in base)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for percent in (90,):
        found = ngram_join.measured(df.selectExpr("doc_id AS id", "doc_id AS key", "text"), 3, percent, 2000)
        sizes = lambda roots: sorted(r["count"] for r in roots.groupBy("root").count().collect())
        roots = ngram_join.clusters(found)
        sets = found.where("grams is not null").dropDuplicates(["sig"]).select("sig", "grams")
        assert sizes(roots)[-1] > 100 and sizes(ngram_join.refined(roots, sets, percent, 20))[-1] < 20
        assert sizes(ngram_join.refined(roots, sets, percent, 1000)) == sizes(roots)
        got = ngram_join.linked(df, size=3, percent=percent, block=7, bucket_bytes=2000)
        assert sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in got.collect()) == brute_components(rows, 3, percent)


def test_parts_of_linked_sets():
    """Sets that just link have a part in common, whatever their sizes and wherever they differ."""
    rng = np.random.default_rng(1)
    for percent in (90, 80, 50):
        for trial in range(1500):
            n = int(rng.integers(1, (12, 60, 400)[trial % 3]))
            most = 100 * n // percent - n
            one = (0, most, int(rng.integers(0, most + 1)))[trial // 3 % 3]
            x = rng.integers(0, 1 << 63, n + most, dtype=np.uint64) * np.uint64(2)
            a, b = np.unique(x[: n + one]), np.unique(np.concatenate([x[:n], x[n + one :]]))
            parts = [ngram_join.set_parts(s, ngram_join.size_bands(len(s), percent), percent) for s in (a, b)]
            assert most == 0 or len(np.intersect1d(*parts))


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 103), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}


def brute_repeats(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(i), len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark, empty):
    rng = random.Random(9)
    passages = ["".join(rng.choices("ab é", k=rng.randint(30, 200))) for _ in range(6)]
    rows = [(k, "".join(rng.choices([*passages, "x" * rng.randint(1, 90), "zq"], k=rng.randint(0, 9)))) for k in range(60)] + [(None, passages[0]), (99, None), (98, "a" * 500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = suffix_dedup.remove_repeats(df, digest=True, bucket_bytes=700, range_bytes=700).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept.hex()) for r in got) == brute_repeats(rows, 100)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_spread(spark):
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefgh ", k=300))
    rows = [(k, "".join(rng.choices("stuvw", k=20)) + passage + "".join(rng.choices("stuvw", k=20))) for k in range(80)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), digest=True, bucket_bytes=500, range_bytes=500).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept.hex()) for r in got) == brute_repeats(rows, 100)


def test_suffix_ranges(spark, monkeypatch):
    """Few long documents are split into as many ranges as their repeated suffixes need, evenly, with the default sample."""
    rng = random.Random(9)
    half = "".join(rng.choices("abcdefghij ", k=150_000))
    rows = [(k, half + "".join(rng.choices("klmnop ", k=50_000))) for k in range(6)]
    seen = []
    real = suffix_dedup.splitting_grams
    monkeypatch.setattr(suffix_dedup, "splitting_grams", lambda found, length, *x: seen.append((found, real(found, length, *x))) or seen[0][1])
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), range_bytes=50_000).collect()
    # All six halves are repeated, 900,000 bytes in ranges of 50,000.
    assert [round(r.n_removed, -2) for r in sorted(got, key=lambda r: r.id)] == [0] + [150_000] * 5
    assert 12 <= len(seen[0][1]) <= 24


def test_suffix_brute_force_defaults(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, "/root/testdata/sf0.001").collect()]
    got = suffix_dedup.remove_repeats(queries.documents(spark, "/root/testdata/sf0.001"), digest=True).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept.hex()) for r in got) == brute_repeats(rows, 100)


def test_multikey_sort():
    words = np.random.default_rng(1).integers(0, 3, (9000, 6)).astype(np.uint64)
    order = suffix_dedup.multikey_sort(words, cut=50)
    assert (words[order] == words[np.lexsort(words.T[::-1])]).all()


def test_packing(spark, odd, empty):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    texts = ["Hello, World's Été <|endoftext|> x <|ENDOFTEXT|>", "don't ... a.b,c | d.", "été 中文 İstanbul ΣΣ", " x y 12345 'S 'll"]
    coder = packing.WordCoder(path)
    for x in texts:
        assert coder.encode(x.encode()) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
    rng = random.Random(8)
    signs = "abcXYZ .,|'-<>!09éÉßİıǅǆΣς中\u0301\u0307\u00a0\u200b\x00\n"
    for _ in range(6_000):
        x = "".join(rng.choices(signs, k=rng.randint(1, 9)))
        assert coder.encode(x.encode()) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes(), repr(x)
    for df in (odd, queries.documents(spark, "/root/testdata/sf0.001")):
        rows = packing.pack(df, path, capacity=64, group_size=40).collect()
        bins = defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for offset, length in sorted(b):
                assert offset == at
                at += length
            assert at <= 64
        want = []
        for r in df.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids + [1]
            want += [(str(r.doc_id), k, 64 * k, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for k, x in enumerate(ids[j : j + 64] for j in range(0, len(ids), 64))]
        assert sorted((str(r.id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert packing.pack(empty, path).count() == 0


def test_packing_splits_equal_rows(spark):
    df = spark.createDataFrame([(None, "")] * 900, "doc_id bigint, text string").repartition(3)
    rows = packing.pack(df, queries.tokenizer_path(), capacity=8, group_size=100).collect()
    groups = defaultdict(int)
    for r in rows:
        groups[r.sequence_id >> 24 if r.sequence_id >> 60 == 0 else "rest"] += 1
    assert len(rows) == 900 and len({r.sequence_id for r in rows}) == 113 and max(groups.values()) < 200


def brute_fillings(lengths, room):
    """Fillings that leave no room for a piece left out and have no piece that a longer one left out could replace."""
    found = set()
    for n in range(len(lengths) + 1):
        for some in itertools.combinations(range(len(lengths)), n):
            waste = room - sum(lengths[i] for i in some)
            out = [lengths[i] for i in range(len(lengths)) if i not in some]
            if waste >= 0 and all(y > waste for y in out) and not any(lengths[i] < y <= lengths[i] + waste for i in some for y in out):
                found.add((waste, tuple(sorted((lengths[i] for i in some), reverse=True))))
    return sorted(found)


def test_bin_completion():
    rng = random.Random(4)
    for _ in range(60):
        lengths, room = [rng.randint(3, 30) for _ in range(9)], rng.randint(20, 70)
        want = brute_fillings(lengths, room)
        got, _ = packing.fillings(packing.Lengths(lengths), room, 12, listed=10_000)
        assert got == ([w for w in want if w[0] <= 12] if want[0][0] else want[:1]) or (want[0][0] == 0 and got[0][0] == 0 and set(got) <= set(want))
    for _ in range(20):
        lengths = [rng.choice([7, 20, 33, 34, 41, 50, 60]) for _ in range(60)]
        bins = packing.bin_completion(lengths, 100)
        assert sorted(x for b in bins for x in b) == sorted(lengths) and max(map(sum, bins)) <= 100
        assert -(-sum(lengths) // 100) <= len(bins) <= len(packing.best_fit(lengths, 100))
    assert len(packing.bin_completion([60, 50, 40, 30, 20] * 4, 100)) == 8
    lengths = [rng.randint(900, 1100) for _ in range(400)]
    assert len(packing.bin_completion(lengths, 4096)) < len(packing.best_fit(lengths, 4096))
    lengths = [rng.randint(100, 400) for _ in range(2000)]
    assert len(packing.bin_completion(lengths, 4096)) < len(packing.best_fit(lengths, 4096))


def test_language_held_out(spark):
    data = "/root/testdata/sf0.01"
    docs = queries.documents(spark, data).select("doc_id", "lang")
    got = queries.QUERIES["op6_language_id"](spark, data).join(docs, "doc_id").where("held_out and lang_pred <> 'und'")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_odd(odd, empty):
    got = language_id.predict(odd, language_id.learn(odd)).collect()
    assert len(got) == 14 and all(0 <= r.score <= 1 for r in got)
    assert sorted(str(r.id) for r in got if r.nearest == "und") == ["10", "11", "3", "4", "None"]
    assert all(r.rejected and r.score == 0 for r in got if r.nearest == "und")
    assert language_id.predict(odd, language_id.learn(empty)).where("nearest <> 'und'").count() == 0


def test_language_brute_force(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(~queries.held_out(4, 2)))
    got = {r.id: r for r in language_id.predict(docs, model).collect()}
    for r in docs.where("text is not null").limit(60).collect():
        folded = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", r.text.encode()).lower()
        vector = np.zeros(language_id.CELLS)
        for size, seed in ((2, 0), (3, 0x5BD1E995)):
            for k in range(len(folded) - size + 1):
                vector[((int.from_bytes(folded[k : k + size], "big") * 0x9E3779B1 + seed) % 2**32) >> 20] += 1
        vector = np.sqrt(vector) * model.idf
        cosines = model.vectors @ (vector / np.linalg.norm(vector))
        assert abs(got[r.doc_id].score - cosines.max()) < 1e-4
        if np.sort(cosines)[-1] - np.sort(cosines)[-2] > 1e-4:
            assert got[r.doc_id].nearest == model.languages[model.owner[cosines.argmax()]]


def test_quality_held_out(spark):
    data = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality")
    got = queries.QUERIES["op9_quality_classifier"](spark, data).join(labels, "doc_id").where("held_out")
    assert got.select(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.95


def plain_cells(text):
    """Cells of a text's n-grams, one by one, in whole numbers."""
    base, most = quality_classifier.BASE, 1 << 64

    def mixed(x):
        for _ in range(2):
            x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 % most
        return x ^ (x >> 32)

    hashed = lambda raw: mixed(sum(int(quality_classifier.prefix_hashes(np.array([b], np.uint8))[1]) * pow(base, k, most) for k, b in enumerate(raw)) % most)
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    shape = lambda b: 48 if 48 <= b < 58 else 65 if 65 <= b < 91 else 97 if 97 <= b < 123 or b >= 128 else b
    found, shapes = set(), []
    for k, w in enumerate(words):
        low = bytes(b + 32 if 65 <= b < 91 else b for b in w)
        found.add(hashed(low))
        runs = bytes(c for c, _ in itertools.groupby(map(shape, w)))
        shapes.append(base if k and low == bytes(b + 32 if 65 <= b < 91 else b for b in words[k - 1]) else hashed(runs))
    found |= {mixed(x) for x in shapes}
    for n in (2, 3):
        for k in range(len(shapes) - n + 1):
            gram = shapes[k]
            for j in range(1, n):
                gram = (gram * base + shapes[k + j]) % most
            found.add(mixed((gram + n) % most))
    return sorted({x >> (64 - quality_classifier.BITS) for x in found})


def test_quality_brute_force(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").select("doc_id", "quality")
    model = quality_classifier.learn(docs, labels.where(~queries.held_out(3, 1)))
    got = {r.id: r.score for r in quality_classifier.score(docs, model).collect()}
    for r in docs.orderBy(F.length("text")).limit(40).collect():
        cells = plain_cells(r.text or "")
        length = max(1e-18, sum(model.squares[c] for c in cells)) ** 0.5
        margin = sum(model.weights[c] for c in cells) / length + model.bias
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-(model.slope * margin + model.shift)))) < 1e-9


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (8, 0), (5, 1), (10, 0), (None, 1), (7, None), (6, 5)], "doc_id bigint, quality int")
    scorer = quality_classifier.learn(odd, labels)
    got = quality_classifier.score(odd, scorer).collect()
    assert len(got) == 14 and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.keep(odd, scorer).columns == odd.columns
    assert quality_classifier.score(odd, quality_classifier.learn(odd, labels.limit(0))).where("score <> 0.5").count() == 0
    assert quality_classifier.score(empty, scorer).count() == 0


def test_rules_and_licenses_odd(odd, empty):
    judged = quality_rules.judge(odd)
    for r in judged.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        many = {x for x in windows if windows.count(x) > 1} if len(w) < 1000 else set()
        repeated = {k + j for k, x in enumerate(windows) if x in many for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)))
        assert len(w) >= 1000 or r.n_repeat_words == len(repeated)
    assert judged.count() == 14 and judged.where("kept and n_words < 50").count() == 0
    assert quality_rules.judge(empty).count() == 0
    scanned = license_scan.scan(odd)
    assert scanned.count() == 14 and scanned.where("n_matches > 0").count() == 0
    assert license_scan.scan(empty).count() == 0


def test_license_scan_finds(spark):
    texts = ["A b c.\nReleased under the MIT License!\nx", "released under the mit", "Licensed under CC BY-NC 4.0.", "mit license", "Released  under\nthe MIT License."]
    got = [r.best_license for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert got == ["MIT", "MIT", "CC-BY-NC-4.0", None, "MIT"]
    bodies = dict(license_texts.BODIES)
    words = " ".join(f"w{k}" for k in range(300))
    texts = [("MIT", "MIT License\n\nCopyright 2020 A. Uthor\n\n" + "\n\n".join(bodies["MIT"]).replace(", ", ",\n")), ("ISC", words + "\n\n" + "\n\n".join(bodies["ISC"]) + "\n\n" + words), ("BSD-3-Clause", "\n\n".join(bodies["BSD-3-Clause"])), ("Zlib", "\n".join(bodies["Zlib"])),
        ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."), ("GPL-3.0", words + ". This work is licensed under the GNU\nGeneral Public License, version 3. " + words), ("Apache-2.0", words + ". Licensed under the Apache\nLicense, Version 2.0\n" + words), (None, words)]
    got = [(r.best_license, r.licenses) for r in license_scan.scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert [g[0] for g in got] == [n for n, _ in texts] and got[4][1] == "GPL-2.0"
    known = license_scan.compiled(spark)
    telling = set(license_scan.telling_words(known, 0.8))
    for t in known:  # more bigrams have a telling word than a match can miss
        pairs = list(zip(t.words, t.words[1:]))
        assert sum(a in telling or b in telling for a, b in pairs) > len(pairs) - t.least


def test_mixing(spark, odd, empty):
    data = "/root/testdata/sf0.01"
    df = queries.documents(spark, data)
    got = queries.op8_mixing(spark, data).join(df.select("doc_id", "source"), "doc_id")
    by = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.max("size").alias("most")).collect()
    total = sum(r.source_size for r in by)
    assert abs(sum(r.target for r in by) - total) < 1e-6 * total
    for r in by:
        assert r.target <= 3 * r.source_size + 1e-6
        assert abs(r.taken - r.target) <= r.most
    assert got.where("taken > 3 * size").count() == 0
    again = {(r.doc_id, r.taken) for r in queries.op8_mixing(spark, data).collect()}
    assert again == {(r.doc_id, r.taken) for r in got.collect()}
    assert mixing.mix(odd).count() == 14
    assert mixing.apply_mix(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0


def test_mixing_brute_force(spark):
    df = queries.documents(spark, "/root/testdata/sf0.01")
    sizes = df.select("doc_id", "source", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")).join(queries.op8_mixing(spark, "/root/testdata/sf0.01"), "doc_id")
    rows = sizes.withColumn("u", (F.pmod(F.xxhash64(F.lit(17), "doc_id", "size", "key", F.lit(1).cast("bigint")), F.lit(1 << 40)) + 0.5) / float(1 << 40)).collect()
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    by = defaultdict(list)
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id]))
        by[r.source].append(r)
    names = sorted(by, key=lambda s: (s is None, s))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total = {s: sum(r.size for r in by[s]) for s in names}
    target, open_names, rest = {}, set(names), float(sum(total.values()))
    while open_names:
        share = rest / sum(weight[s] for s in open_names)
        over = {s for s in open_names if share * weight[s] > 3 * total[s]}
        for s in over or open_names:
            target[s] = 3.0 * total[s] if over else share * weight[s]
            rest -= target[s] if over else 0
        open_names = open_names - over if over else set()
    for s in names:
        kind = lambda r: 0.5 + 0.5 * min(8, int(np.log2(max(1, r.size)))) / 8
        low, high = 0.0, 100.0
        for _ in range(200):
            c = (low + high) / 2
            low, high = (c, high) if sum(min(3, c * kind(r)) * r.size for r in by[s]) < target[s] else (low, c)
        copies, ranked = {}, []
        for r in by[s]:
            rate = min(3.0, high * kind(r)) if r.size else 0.0
            copies[r.doc_id] = whole = int(rate + 1e-9)
            if 1e-9 < rate - whole < 1:
                ranked.append(((r.u / (1 - r.u)) / ((rate - whole) / (1 - rate + whole)), r.doc_id, r.size))
        taken = sum(copies[r.doc_id] * r.size for r in by[s])
        ranked.sort()
        for k, (_, i, n) in enumerate(ranked):
            if taken + n > target[s]:
                gap = target[s] - taken
                off, _, i, n = min((abs(gap - n), o, i, n) for o, i, n in ranked[k:])
                copies[i] += off < abs(gap)
                break
            copies[i] += 1
            taken += n
        assert all(abs(r.target - target[s]) < 1e-6 * target[s] and r.source_size == total[s] for r in by[s])
        assert {r.doc_id: r.taken for r in by[s]} == {r.doc_id: copies[r.doc_id] * r.size for r in by[s]}


def test_mixing_ties(spark, monkeypatch):
    """Equal rows, null ids and equal sizes are ranked one by one: every source comes near its target, in the mix and in the rows it takes."""
    monkeypatch.setattr(mixing, "SPREAD", 64)
    one = "a b c d e f g h i j k l"
    rows = [(None, one, "s1")] * 400 + [(7, one + " m", "s1")] * 50 + [(k, one + " n o", "s1") for k in range(300)] + [(None, f"{one} {k}", "s2") for k in range(200)] + [(None, None, "s2"), (3, "", None)] + [(k % 9, one * 3, None) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    mixed = mixing._mixed(df).cache()
    assert mixed.count() == len(rows)
    size = lambda t: len((t or "").split())
    most = max(size(r[1]) for r in rows)
    sums = {r.source: r for r in mixed.groupBy("source").agg(F.sum(F.expr("(whole + extra) * size")).alias("taken"), F.first("target").alias("target"), F.max(F.expr("whole + extra")).alias("copies")).collect()}
    assert all(abs(r.taken - r.target) <= most and r.copies <= 3 for r in sums.values())
    assert mixed.where("extra > 1 or extra < 0").count() == 0
    taken = defaultdict(int)
    out = mixing.apply_mix(df).collect()
    for r in out:
        taken[r.source] += size(r.text)
    assert dict(taken) == {k: r.taken for k, r in sums.items()}
    again = sorted(map(str, mixing.apply_mix(df.repartition(7)).collect()))
    assert again == sorted(map(str, out))
    assert mixing.apply_mix(df.limit(0)).count() == 0


def test_warc_audit(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", f"<p>{k}\r\n\r\né</p>" * (k % 7)) for k in range(300)] + [(None, None, None), (5, "http://h/5", "again")] + [(None, "u", "hot")] * 200, "page_id bigint, url string, html string")
    found = warc.records(pages, file_bytes=8000)
    warc.write_files(found, str(tmp_path / "a"))
    primary, replica = warc.manifest(found), warc.read_files(spark, str(tmp_path / "a"))
    assert max(r.n for r in primary.groupBy("file").agg(F.sum("length").alias("n")).collect()) < 16_000
    small = dict(range_bytes=1024, fanout=8)
    assert warc.audit(primary, replica, **small).groupBy("status").count().collect()[0].asDict() == {"status": "ok", "count": 502}
    page = lambda k: F.col("record_id") == f"urn:page:{k}"
    bad = replica.where(~page(17)).withColumn("sha256", F.when(page(3) | page(250), "0").otherwise(F.col("sha256")))
    got = {r.record_id: r.status for r in warc.audit(primary, bad, **small).where("status <> 'ok'").collect()}
    assert got == {"urn:page:3": "corrupt", "urn:page:250": "corrupt", "urn:page:17": "missing"}
    extra = {r.record_id: r.status for r in warc.audit(bad, primary, **small).where("status <> 'ok'").collect()}
    assert extra == {"urn:page:3": "corrupt", "urn:page:250": "corrupt", "urn:page:17": "extra"}
    assert warc.root(primary, **small).first().hash == warc.root(replica, **small).first().hash != warc.root(bad, **small).first().hash
    warc.write_damaged(spark, str(tmp_path / "a"), str(tmp_path / "b"), parts=9)
    status = {r.status: r.n for r in warc.audit(primary, warc.read_files(spark, str(tmp_path / "b")), **small).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert set(status) == {"ok", "corrupt", "missing", "extra", "moved"} and status["missing"] >= primary.select("file").distinct().count()
    none = warc.records(pages.limit(0))
    assert warc.audit(warc.manifest(none), warc.manifest(none)).count() == 0


def test_warc_reads_standard_records(spark, tmp_path):
    import gzip

    record = lambda key, body: b"WARC/1.0\r\nwarc-type: response\r\nwarc-record-id:  <urn:uuid:" + key + b">\r\nCONTENT-LENGTH: " + str(len(body)).encode() + b"\r\n\r\n" + body
    raw = [record(b"a-1", b"HTTP/1.1 200 OK\r\n\r\nx"), b"junk without a header", record(b"b-2", b"\xff\x00")]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in raw))
    got = warc.read_files(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r.record_id, r.sha256, r.length) for r in got] == [(k, hashlib.sha256(r).hexdigest(), len(r) + 4) for k, r in zip(("urn:uuid:a-1", None, "urn:uuid:b-2"), raw)]


def test_pipeline(spark):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.written(stage(spark, docs, data))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = docs.collect()
        assert all(texts[r.doc_id] == r.text for r in after)
        if name == "exact_dedup":
            assert sorted(r.doc_id for r in after) == sorted({re.sub(SPACE + "+", " ", r.text): r.doc_id for r in sorted(before, key=lambda r: -r.doc_id)}.values())
        if name == "ngram_join":
            want = brute_components([(r.doc_id, r.text) for r in before], 5, 80)
            assert sorted(str(r.doc_id) for r in after) == sorted({c for _, _, c in want})
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(r.doc_id for r in docs.collect())


def test_pipeline_odd(spark, odd, tmp_path):
    """Repeated rows, null ids, null sources and texts, and an empty table go through all stages."""
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = queries.documents(spark, data).limit(60)
    more = docs.limit(20).unionByName(docs.limit(20).withColumn("doc_id", F.lit(None).cast("bigint")))
    docs.unionByName(more).unionByName(odd.select(*names)).write.parquet(str(tmp_path / "a/documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    for folder in "ab":
        spark.read.parquet(f"{data}/labels.parquet").write.parquet(str(tmp_path / folder / "labels.parquet"))
    rows = spark.read.parquet(str(tmp_path / "a/documents.parquet"))
    kept = corpus_pipeline.written(corpus_pipeline.drop_copies(spark, corpus_pipeline.keep_good(spark, rows, str(tmp_path / "a")), str(tmp_path / "a")))
    texts = [re.sub(SPACE + "+", " ", r.text or "") for r in kept.collect()]
    assert kept.columns == names and len(texts) == len(set(texts)) and len(texts) > 20
    packed = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    total = defaultdict(int)
    for r in packed:
        total[r.sequence_id] += r.length
    assert packed and max(total.values()) <= 4096
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_left_out(tmp_path):
    """Without both folders and the pipeline the entry point imports and has the other queries; an error inside is not swallowed."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), [n for n in q if n.startswith('op') or n == 'pipeline'])"], cwd=copy, capture_output=True, text=True)
    assert "op4_ngram_join" in run().stdout
    with open(copy / "meshlake/llm/blocks.py", "a") as f:
        f.write("import no_such_module\n")
    assert run().returncode != 0
    for x in ("meshlake/llm", "tests/llm"):
        shutil.rmtree(copy / x)
    os.remove(copy / "corpus_pipeline.py")
    got = run()
    assert got.returncode == 0 and int(got.stdout.split()[0]) > 90 and got.stdout.strip().endswith("[]"), got.stderr


def repeated_rows():
    """(id, text): equal rows, and different texts that share an id or have none."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    a, b, c = text(300), text(260), text(280)
    return [(7, a)] * 5 + [(None, b)] * 4 + [(None, text(40) + a[50:200] + text(90)), (None, text(400)), (3, c), (3, text(60) + c[:150]), (3, "short"), (3, "short"), (None, None), (None, None), (8, text(30) + b + text(30))]


def test_suffix_dedup_repeated_rows(spark):
    df = spark.createDataFrame(repeated_rows(), "doc_id bigint, text string").repartition(3)
    keyed = df.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key")).collect()
    rows = [(r.doc_id, r.text) for r in sorted(keyed, key=lambda r: r.key)]
    got = suffix_dedup.remove_repeats(df, digest=True, bucket_bytes=300, range_bytes=300).collect()
    assert sorted((str(r.id), r.n_bytes, r.n_removed, r.n_spans, r.kept.hex()) for r in got) == brute_repeats(rows, 100)
    whole = {r.kept for r in suffix_dedup.remove_repeats(df).collect() if not r.n_removed}
    assert len([r for r in got if r.n_bytes == r.n_removed == 300]) == 4 and len(whole) >= 3


def test_near_duplicates_repeated_rows(spark):
    rng = random.Random(6)
    words = lambda: [f"w{rng.randrange(500)}" for _ in range(60)]
    a, b, c, d = words(), words(), words(), words()
    near = lambda w: " ".join([*w[:-1], "changed"])
    rows = [(5, near(a)), (5, " ".join(b)), (3, " ".join(a)), (2, " ".join(c)), (2, " ".join(c)), (2, near(c)), (None, " ".join(d)), (None, near(d)), (None, " ".join(d)), (None, near(a)), (None, None), (None, None), (4, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, row int").repartition(3)
    got = ngram_join.drop_near_duplicates(df, bucket_bytes=300)
    assert got.columns == df.columns
    kept = sorted((str(r.doc_id), (r.text or "").replace("changed", "").split(" ")[:5]) for r in got.collect())
    assert kept == sorted([("5", b[:5]), ("3", a[:5]), ("2", c[:5]), ("None", d[:5]), ("None", [""]), ("None", [""]), ("4", [""])])
    linked = ngram_join.linked(df, bucket_bytes=300).collect()
    assert sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in linked) == brute_components(rows, 5, 80)


def test_fits_are_bounded_by_rows(spark, monkeypatch):
    """Null and repeated ids and repeated rows take no more than their share of a sample."""
    used = {}
    monkeypatch.setattr(language_id, "fit", lambda table, languages: used.update(languages=sorted(languages), texts=len({r.tobytes() for r in table})))
    letters = ["".join(p) for p in itertools.permutations("abcdef")]
    rows = [(None, letters[k], "en") for k in range(400)] + [(1, letters[k], "fr") for k in range(300)] + [(2, "same text", "de")] * 200 + [(1000 + k, letters[k], "de") for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    language_id.learn(docs, per_language=50)
    assert used["languages"] == ["de"] * 50 + ["en"] * 50 + ["fr"] * 50 and used["texts"] >= 50
    monkeypatch.setattr(quality_classifier, "fit", lambda sets, labels: used.update(labels=sorted(labels.tolist())))
    labels = spark.createDataFrame([(1, 1)] * 90 + [(2, 0)] * 5 + [(1003, 0), (1004, 1), (None, 1), (None, 0)], "doc_id bigint, quality int")
    quality_classifier.learn(docs, labels)
    assert used["labels"] == [0, 0, 1, 1]
    quality_classifier.learn(docs, labels, max_rows=3)
    assert len(used["labels"]) == 3
