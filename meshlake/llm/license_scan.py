r"""Licence scans: units of text compared with licence templates by the Dice coefficient over word bigrams.

A text is lower-cased, and every run of characters other than letters, digits
and line ends becomes one space. Its units are its lines, its sentences within lines,
two and three neighbouring ones of either, its paragraphs (split at blank lines)
and the text as a whole; equal units count once. A unit matches a template if 2 × shared
bigrams / (bigrams of both) reaches the threshold, counting repeated bigrams as
often as they occur, and no template is nearer to it. For a threshold t that
needs a unit of t / (2 - t) to (2 - t) / t times the template's bigrams, so units
of other sizes are dropped by their word count before bigrams are built, and
each template looks only at units of its own range.

A match shares at least t / (2 - t) of the template's bigrams. So a set of words
that occur in more than the rest of each template's bigrams has a word in every
text with a match: texts without any of these words have none and are not cut
into units at all.

Built-in functions over one row do it all: no shuffle, no Python.

Nulls and odd cases: a null or empty text has no matches (0 matches, null
licence and coefficient, empty list). Ties go to the first licence by name.
Repeated rows get equal rows. An empty table gives an empty result. `scan` keeps
the other columns and replaces columns of the names it adds.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, let, text_or_empty
from .license_texts import templates as all_templates
from .quality_rules import STOP_WORDS

TEMPLATES = all_templates()
THRESHOLD = 0.8


@dataclass(frozen=True)
class Template:
    license: str
    words: tuple[str, ...]
    grams: tuple[int, ...]
    least: int
    most: int


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


#: The end of a sentence within a line.
SENTENCE_END = r"[.!?]+[ \t]+"


def _units(text: Column) -> Column:
    joined = lambda x: F.replace(x, F.lit("\n"), F.lit(" "))
    norm = normalised(text)
    neighbours = lambda x, k: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.array_join(F.slice(x, i, k), " "))
    windows = lambda x: F.concat(x, neighbours(x, F.lit(2)), neighbours(x, F.lit(3)))
    sentences = F.split(normalised(F.regexp_replace(text, SENTENCE_END, "\n")), "\n")
    parts = F.concat(let(F.split(norm, "\n"), windows), let(sentences, windows), F.transform(F.split(norm, "\n *\n"), joined), F.array(joined(norm)))
    return F.array_distinct(F.transform(parts, lambda u: F.trim(F.regexp_replace(u, " +", " "))))


def _bigrams(unit: Column) -> Column:
    w = F.split(unit, " ")
    n = F.size(w) - 1
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))


def _numbered(grams: Column) -> Column:
    """Bigrams made different by their number of occurrence, so that sets of them compare as multisets."""
    nth = lambda g: F.transform(g, lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice(g, 1, i + 1), lambda y: y == x))))
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.transform(g, lambda x: F.xxhash64(x, F.lit(1)))).otherwise(nth(g)))


def compiled(spark: SparkSession, templates=TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    """The templates' bigrams, from the same expressions as the texts' ones, and the sizes of units that can match."""
    if not templates:
        return []
    table = spark.createDataFrame(list(templates), "license string, text string")
    table = table.withColumn("unit", F.trim(F.regexp_replace(F.replace(normalised(F.col("text")), F.lit("\n"), F.lit(" ")), " +", " ")))
    rows = table.select("license", F.split("unit", " ").alias("words"), _numbered(_bigrams(F.col("unit"))).alias("grams")).collect()
    low = threshold / (2 - threshold)
    return [Template(r.license, tuple(r.words), tuple(r.grams), math.ceil(low * len(r.grams) - 1e-9), math.floor(len(r.grams) / low + 1e-9)) for r in rows if r.grams]


def telling_words(known: list[Template], threshold: float) -> list[str]:
    """Words of which every unit with a match has one: in each template they occur in more bigrams than a match can miss."""
    low, chosen = threshold / (2 - threshold), set()
    for t in sorted(known, key=lambda t: len(t.grams)):
        pairs = list(zip(t.words, t.words[1:]))
        missed = len(pairs) - math.ceil(low * len(pairs) - 1e-9)
        while sum(a in chosen or b in chosen for a, b in pairs) <= missed:
            gain = Counter(w for p in pairs if not chosen & set(p) for w in set(p))
            chosen.add(max(gain, key=lambda w: (w not in STOP_WORDS, len(w) > 4, gain[w], len(w), w)))
    return sorted(chosen)


def scan(df: DataFrame, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """df with n_matches, best_license, best_dice, licenses (names of all that match, by name, with commas) and matches (unit, license, dice)."""
    known = compiled(df.sparkSession, templates, threshold)
    units, grams = free_name(df, "units"), free_name(df, "grams")
    hits_type = "array<struct<unit:int,license:string,dice:double>>"
    hits = F.array().cast(hits_type)
    if known:
        least, most = min(t.least for t in known), max(t.most for t in known)
        spaces = lambda u: F.length(u) - F.length(F.replace(u, F.lit(" "), F.lit("")))
        text = text_or_empty(text_col)
        telling = telling_words(known, threshold)
        has = lambda words: F.arrays_overlap(words, F.lit(telling))
        may = has(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
        sized = F.filter(_units(text), lambda u: spaces(u).between(max(1, least), most) & has(F.split(u, " ")))
        df = df.withColumn(units, F.when(may, sized).otherwise(F.array().cast("array<string>")))
        df = df.withColumn(grams, F.transform(units, _bigrams))
        df = df.withColumn(grams, F.transform(grams, _numbered))
        table = F.array(*(F.struct(F.lit(t.license).alias("license"), F.lit(len(t.grams)).alias("n"), F.lit(t.least).alias("least"), F.lit(t.most).alias("most"), F.lit(list(t.grams)).alias("grams")) for t in known))
        dice = lambda g, t: 2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])
        near = lambda g, i: F.filter(F.transform(F.filter(table, lambda t: F.size(g).between(t["least"], t["most"])), lambda t: F.struct(i.alias("unit"), t["license"].alias("license"), dice(g, t).alias("dice"))), lambda s: s["dice"] >= threshold)
        nearest = lambda hits: F.filter(hits, lambda s: s["dice"] == F.array_max(F.transform(hits, lambda x: x["dice"])))
        hits = F.flatten(F.transform(grams, lambda g, i: let(near(g, i), nearest)))
    df = df.withColumn("matches", hits.cast(hits_type))
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["license"].alias("license"))))
    df = df.withColumns({
        "n_matches": F.size(F.array_distinct(F.transform("matches", lambda m: m["unit"]))).cast("bigint"),
        "best_license": best["license"],
        "best_dice": -best["d"],
        "licenses": F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ","),
    })
    return df.drop(units, grams)
