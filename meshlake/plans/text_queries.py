"""Names, paths and parsed header values, over parts, pages, events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import strings
from .registry import query, table


@query("str_sort_index", "SELECT p_partkey, try_cast(regexp_split_to_array(p_brand || '_' || p_size, '[|_. -]')[2] AS BIGINT) AS token FROM part")
def _(spark, d):
    name = F.concat("p_brand", F.lit("_"), "p_size")
    return table(spark, d, "part").select("p_partkey", strings.sort_token(name, 1).alias("token"))


@query("common_prefix", """WITH w AS (SELECT p_partkey, p_name AS a, lag(p_name) OVER (ORDER BY p_partkey) AS b FROM part)
SELECT p_partkey, (SELECT max(k) FROM range(0, least(len(a), len(b)) + 1) t(k) WHERE left(a, k) = left(b, k)) AS n FROM w WHERE b IS NOT NULL""")
def _(spark, d):
    a = table(spark, d, "part").select("p_partkey", "p_name")
    b = a.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return a.join(b, "p_partkey").select("p_partkey", strings.common_prefix(F.col("p_name"), F.col("other")).cast("bigint").alias("n"))


@query("glob_match", "SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1')")
def _(spark, d):
    return table(spark, d, "part").where(strings.matches(F.col("p_brand"), "Brand#1*")).select("p_partkey")


@query("unique_str", """WITH k AS (SELECT p_partkey, p_type AS name, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_partkey, CASE WHEN k = 0 THEN name ELSE name || '_' || CASE WHEN k < 10 THEN '0' ELSE '' END || k END AS unique_name FROM k""")
def _(spark, d):
    return strings.unique_names(table(spark, d, "part"), "p_type", "p_partkey").select("p_partkey", "unique_name")


@query("valid_name", "SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS name FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", strings.valid_name(F.col("p_name")).alias("name"))


@query("unit_value", "SELECT doc_id, CASE WHEN n_chars <= 1000 THEN printf('%.2fB', n_chars::DOUBLE) ELSE printf('%.2fkB', n_chars / 1024.0::DOUBLE) END AS size FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", strings.data_size(F.col("n_chars")).alias("size"))


@query("path_parts", r"SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '(\.[^.]*)$', 1) AS ext FROM pages")
def _(spark, d):
    p = strings.path_parts(F.col("url"))
    return table(spark, d, "pages").select("page_id", p["dir"].alias("dir"), p["ext"].alias("ext"))


@query("parse_heart_rate", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN round(60000.0::DOUBLE / (500 + event_id % 700), 6) WHEN event_id % 3 = 1 THEN (40 + event_id % 90)::DOUBLE END AS bpm FROM events")
def _(spark, d):
    n = F.col("event_id")
    text = F.when(n % 3 == 0, F.concat(F.lit("nominal RR "), (500 + n % 700).cast("string"))).when(n % 3 == 1, F.concat((40 + n % 90).cast("string"), F.lit(" bpm"))).otherwise("none")
    return table(spark, d, "events").select("event_id", F.round(strings.heart_rate(text), 6).alias("bpm"))


@query("catalog_lookup", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') AND p_size BETWEEN 5 AND 20")
def _(spark, d):
    return strings.looked_up(table(spark, d, "part"), "p_name", "a", F.col("p_size").between(5, 20)).select("p_partkey", "p_name")


@query("tag_values", "SELECT conv_id, CASE WHEN count(DISTINCT role) = 1 THEN [min(role)] ELSE list(role ORDER BY turn) END AS roles FROM conversations GROUP BY 1")
def _(spark, d):
    return strings.tag_values(table(spark, d, "conversations"), "conv_id", "turn", "role").withColumnRenamed("vals", "roles")


@query("find_field", "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, left((SELECT p_type FROM part WHERE p_partkey = 7), 3)) ORDER BY p_partkey LIMIT 1")
def _(spark, d):
    """The first name that a pattern matches."""
    part = table(spark, d, "part")
    asked = part.where("p_partkey = 7").first()
    if asked is None:
        return part.select("p_partkey", "p_type").limit(0)
    pattern = asked.p_type[:3] + "*"
    return strings.find_name(part, "p_type", pattern, "p_partkey").select("p_partkey", "p_type")
