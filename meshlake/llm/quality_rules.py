r"""Quality rules: a table of thresholds compiled into one projection.

Every metric is an expression of built-in functions over one row, so Spark
evaluates all rules in the scan's stage, without user functions or shuffles.
Words are runs of `[^\x20\x09-\x0D]`; lines are split at \n.

Nulls and odd cases: a null text has no words, lines or symbols; ratios with an
empty denominator are 0. Such texts fail the base rules. Repeated rows get equal
rows. An empty table gives an empty result. Other columns are kept by `measure`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free_name, let, text_or_empty

SYMBOLS = "#*$%&|<>"
#: Fixed word list: frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for on was with as be by at this from or an are "
    "le la les de des du et un une en est que qui dans pour par sur pas au "
    "der die das und ist ein eine nicht mit von zu den im auf "
    "el los las y del se por con para su lo como una"
).split()


@dataclass(frozen=True)
class Rule:
    """A text is kept only if the metric lies within these bounds; None is no bound."""

    metric: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("n_words", 50, 100_000),
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("stop_word_ratio", 0.03, None),
    Rule("dup_line_ratio", None, 0.30),
    Rule("repeat_word_ratio", None, 0.20),
    Rule("upper_word_ratio", None, 0.30),
)


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """The number of words in windows of three that occur at least twice in the array, first occurrences included."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    by_gram = lambda g: F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    same = lambda p, i, j: F.coalesce(F.get(p, i)["g"] == F.get(p, j)["g"], F.lit(False))
    hits = lambda p: F.filter(p, lambda x, k: same(p, k, k - 1) | same(p, k, k + 1))
    covered = lambda p: F.size(F.array_distinct(F.flatten(F.transform(hits(p), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    found = let(windows, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), let(by_gram(g), covered)).otherwise(0))
    return F.when(F.size(w) > 3, found).otherwise(0)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def measure(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with one column for each metric; its own columns of these names are replaced."""
    of_words, of_lines = free_name(df, "of_words"), free_name(df, "of_lines")
    text = text_or_empty(text_col)
    count = lambda x, name: x.cast("bigint").alias(name)
    df = df.withColumns({
        of_words: let(words(text), lambda w: F.struct(
            count(F.size(w), "n_words"),
            count(repeated_words(w), "n_repeat_words"),
            count(F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))), "n_stop_words"),
            count(F.size(F.filter(w, lambda x: x.rlike("^[^a-z]*[A-Z]{2}[^a-z]*$"))), "n_upper_words"),
        )),
        of_lines: let(
            F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            lambda x: F.struct(count(F.size(x), "n_lines"), count(F.size(x) - F.size(F.array_distinct(x)), "n_dup_lines")),
        ),
        "word_chars": (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("bigint"),
    })
    counted = {k: F.col(of_words)[k] for k in ("n_words", "n_repeat_words", "n_stop_words", "n_upper_words")}
    counted |= {k: F.col(of_lines)[k] for k in ("n_lines", "n_dup_lines")}
    ratios = {
        "mean_word_chars": ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_ratio": ratio(F.col("n_symbols"), F.col("word_chars")),
        "stop_word_ratio": ratio(F.col("n_stop_words"), F.col("n_words")),
        "dup_line_ratio": ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_word_ratio": ratio(F.col("n_repeat_words"), F.col("n_words")),
        "upper_word_ratio": ratio(F.col("n_upper_words"), F.col("n_words")),
    }
    return df.withColumns(counted).withColumns(ratios).drop(of_words, of_lines)


def failed(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the metrics out of bounds, as an array."""
    broken = []
    for r in rules:
        if r.least is not None:
            broken.append(F.when(F.col(r.metric) < r.least, F.lit(r.metric)))
        if r.most is not None:
            broken.append(F.when(F.col(r.metric) > r.most, F.lit(r.metric)))
    return F.array_distinct(F.array_compact(F.array(*broken))) if broken else F.array().cast("array<string>")


def judge(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with its metrics, failed_rules, base_failed and kept."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measure(df, text_col).withColumns({"failed_rules": failed(rules), "base_failed": base})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
