"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, shared_dir, written
from . import decontamination, language_id, lexical_search, license_scan, mixing, ngram_join, packing, quality_classifier, quality_rules, spelling, suffix_dedup, warc
from .exact_dedup import duplicate_groups


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_matches", "best_license", "best_dice", "licenses")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = duplicate_groups(documents(spark, sf_dir))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def held_out(parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(documents(spark, sf_dir), digest=True)
    return kept.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(documents(spark, sf_dir), size=3, percent=90).withColumnRenamed("id", "doc_id")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = language_id.predict(docs, language_id.learn(docs.where(~held_out(4, 2))))
    found = found.withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out(4, 2).alias("held_out"), F.col("nearest").alias("lang_pred"), "score", "rejected")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_upper_words", "n_lines")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).drop("copies").withColumnRenamed("id", "doc_id")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scorer = quality_classifier.learn(docs, labels.where(~held_out(3, 1)))
    scored = quality_classifier.score(docs, scorer)
    return scored.select(F.col("id").alias("doc_id"), "score").select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC files, and the audit of a replica of these files with known damage against the pages' own records."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = warc.records(pages)
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc.write_files(found, f"{path}/primary")
    warc.write_damaged(spark, f"{path}/primary", f"{path}/replica")
    audited = warc.audit(written(warc.manifest(found)), written(warc.read_files(spark, f"{path}/replica")))
    return audited.select("file", "offset", F.regexp_extract("record_id", r"^urn:page:(-?\d+)$", 1).try_cast("bigint").alias("page_id"), "copy", "length", "sha256", "status")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed("id", "doc_id")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    named = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), named.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir), every=199)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SQL_1 = r"""
WITH templates AS (SELECT row_number() OVER () AS tid, license, text FROM (VALUES {values}) v(license, text)),
norm AS (SELECT 'd' AS kind, doc_id AS id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS x FROM documents
  UNION ALL SELECT 't', tid, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') FROM templates),
lines AS (SELECT id, string_split(x, chr(10)) AS l FROM norm WHERE kind = 'd'),
rows_of AS (FROM lines UNION ALL SELECT doc_id, string_split(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[.!?]+[ \t]+', chr(10), 'g')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g'), chr(10)) AS l FROM documents),
parts AS (SELECT 'd' AS kind, id, unnest(l) AS u FROM rows_of
  UNION ALL SELECT 'd', id, unnest(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:i + 1], ' '))) FROM rows_of
  UNION ALL SELECT 'd', id, unnest(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:i + 2], ' '))) FROM rows_of
  UNION ALL SELECT kind, id, replace(unnest(regexp_split_to_array(x, '\n *\n')), chr(10), ' ') FROM norm WHERE kind = 'd' UNION ALL SELECT kind, id, replace(x, chr(10), ' ') FROM norm),
units AS (SELECT DISTINCT kind, id, trim(regexp_replace(u, ' +', ' ', 'g')) AS u FROM parts),
w AS (SELECT kind, id, u, string_split(u, ' ') AS w FROM units WHERE length(u) - length(replace(u, ' ', '')) BETWEEN 1 AND 1000),
b AS (SELECT kind, id, u, unnest(range(1, len(w))) AS i, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
n AS (SELECT kind, id, u, g, row_number() OVER (PARTITION BY kind, id, u, g ORDER BY i) AS k, count(*) OVER (PARTITION BY kind, id, u) AS size FROM b),
d AS (SELECT a.id AS doc_id, a.u, t.id AS tid, 2.0 * count(*) / (any_value(a.size) + any_value(t.size)) AS dice FROM n a JOIN n t ON a.kind = 'd' AND t.kind = 't' AND a.g = t.g AND a.k = t.k GROUP BY ALL),
m AS (SELECT doc_id, u, license, dice::DOUBLE AS dice FROM d JOIN templates USING (tid) WHERE dice >= {threshold} QUALIFY dice = max(dice) OVER (PARTITION BY doc_id, u)),
s AS (SELECT doc_id, count(DISTINCT u) AS n_matches, first(license ORDER BY dice DESC, license) AS best_license, max(dice) AS best_dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, best_license, best_dice, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN s USING (doc_id)
""".format(values=", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in license_scan.TEMPLATES), threshold=license_scan.THRESHOLD)

SQL_2 = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256 FROM t
"""

SQL_7 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM w WHERE len(w) >= 3),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  len(list_filter(w, lambda v: list_contains(string_split('{stop}', ' '), lower(v)))) AS n_stop_words,
  len(list_filter(w, lambda v: regexp_matches(v, '^[^a-z]*[A-Z]{{2}}[^a-z]*$'))) AS n_upper_words
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_stop_words, n_upper_words, n_lines,
  NOT base_failed AND n_words <= 100000 AND word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / word_chars <= 0.1 AND n_stop_words / n_words >= 0.03
  AND CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END <= 0.3 AND n_repeat_words / n_words <= 0.2 AND n_upper_words / n_words <= 0.3 AS kept FROM b
""".format(stop=" ".join(quality_rules.STOP_WORDS)).replace("\\\\", "\\")

SQL_10 = r"""
WITH r AS (SELECT page_id, concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: resource', 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, 'none') || '>',
  'WARC-Date: 1970-01-01T00:00:00Z', 'WARC-Target-URI: ' || url, 'WARC-Block-Digest: sha256:' || sha256(coalesce(html, '')), 'Content-Type: text/html', 'Content-Length: ' || strlen(coalesce(html, '')))
  || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS record FROM pages),
n AS (SELECT greatest(1, ceil(coalesce(sum(strlen(record)), 0) / 16777216))::BIGINT AS files FROM r),
h AS (SELECT page_id, record, sha256(record) AS sha256, row_number() OVER (PARTITION BY record) AS number FROM r),
f AS (SELECT page_id, record, sha256, number, strlen(record) + 4 AS length, ('0x' || substr(sha256(sha256 || ':' || number), 1, 8))::BIGINT % files AS file, ('0x' || substr(sha256, 57, 8))::BIGINT % 97 AS pick FROM h, n),
p AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY sha256, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  row_number() OVER (PARTITION BY file ORDER BY sha256 DESC, number DESC) = 1 AS last FROM f),
a AS (SELECT file, page_id, sha256, length, "offset", row_number() OVER (PARTITION BY file, page_id ORDER BY sha256, "offset") AS copy FROM p),
d AS (SELECT file, page_id, length, CASE WHEN pick = 0 THEN sha256(replace(record, 'WARC-Date: 1970', 'WARC-Date: 1971')) ELSE sha256 END AS sha256,
  unnest(CASE pick WHEN 1 THEN ["offset", 1099511627776 + "offset"] WHEN 2 THEN ["offset" + length + 1] ELSE ["offset"] END) AS place FROM p WHERE NOT last),
o AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY file ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM d),
b AS (SELECT *, row_number() OVER (PARTITION BY file, page_id ORDER BY sha256, "offset") AS copy FROM o)
SELECT coalesce(a.file, b.file) AS file, coalesce(a."offset", b."offset") AS "offset", coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.copy, b.copy) AS copy, coalesce(a.length, b.length) AS length, coalesce(a.sha256, b.sha256) AS sha256,
  CASE WHEN a.sha256 IS NULL THEN 'extra' WHEN b.sha256 IS NULL THEN 'missing' WHEN a.sha256 <> b.sha256 THEN 'corrupt' WHEN a."offset" <> b."offset" THEN 'moved' ELSE 'ok' END AS status
FROM a FULL JOIN b ON a.file = b.file AND a.page_id IS NOT DISTINCT FROM b.page_id AND a.copy = b.copy
"""

SQL_11 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
n AS (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0), g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT i, item_id, t, count(*) AS asked FROM (SELECT i, item_id, unnest(w) AS t FROM i) GROUP BY ALL),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM n) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
x AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, g GROUP BY t),
s AS (SELECT i, item_id, r, doc_id, sum(asked * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words))))::BIGINT AS score FROM q JOIN x USING (t) JOIN p USING (t) JOIN n USING (r), g GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST))::INT AS "rank", doc_id, score FROM s WHERE score > 0 QUALIFY "rank" <= 10
""".format(upper=UPPER, lower=UPPER.lower())

SQL_12 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
l AS (SELECT item, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT item, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS x FROM l),
s AS (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS j, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS x FROM d, (SELECT DISTINCT k FROM l) WHERE len(w) >= k),
h AS (SELECT DISTINCT s.r, s.j, s.k, p.item FROM s JOIN p ON s.k = p.k AND s.x = p.x),
c AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(j, j + k)) AS place FROM (SELECT DISTINCT r, j, k FROM h)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)
""".format(upper=UPPER, lower=UPPER.lower())

SQL_13 = r"""
WITH RECURSIVE t AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
u AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM t WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, length(run) AS l, xor(4294967295, list_reduce([4294967295] || list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::BIGINT, 2))::BIGINT), lambda c, b: xor(c >> 8, ({table})[(xor(c, b) & 255) + 1]))) AS h FROM u),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % l) || substr(run, h % l + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
k AS (SELECT word, n, unnest(range(0, length(word))) AS k FROM w),
g AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS gap FROM k),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM g a JOIN g b ON a.k = b.k AND a.gap = b.gap AND a.word <> b.word
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON g.gap = w.word UNION SELECT w.word, g.word, g.n FROM g JOIN w ON g.gap = w.word),
c AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM p GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n FROM w LEFT JOIN c USING (word)),
r AS (SELECT word, coalesce(form, word) AS root FROM f UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) JOIN f last ON last.word = r.root WHERE last.form IS NULL
""".format(upper=UPPER, lower=UPPER.lower(), table=spelling.CRC.tolist())

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_ngram_join": op4_ngram_join,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_warc_audit": op10_warc_audit,
    "op11_lexical_search": op11_lexical_search,
    "op12_decontamination": op12_decontamination,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE_SQL: dict[str, str] = {"op1_license_scan": SQL_1, "op2_exact_dedup": SQL_2, "op7_quality_rules": SQL_7, "op10_warc_audit": SQL_10, "op11_lexical_search": SQL_11, "op12_decontamination": SQL_12, "op13_spelling_variants": SQL_13}
