"""Quality rules as a short-circuit cascade (operator 3); DataFrame functions only.

Each rule is a SQL condition that rejects a text. Its cost (seconds) and selectivity (share rejected) are measured
on a sample; the rules then form one CASE expression in the order of rejection per cost, so a row pays for a
later rule only when no earlier one rejected it. The order changes the time, never the verdict.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, saved

SYMBOLS = "[#*$%&|<>]"
#: Of the feature columns, so that they clash with no column of the input.
PREFIX = "_q_"


def words_of(text: Column) -> Column:
    """The words (runs without space or controls 9 to 13) of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), lambda w: w != "")


def base_features(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``_q_w`` (the words) and the longs _q_n_words, _q_word_chars, _q_n_symbols, _q_n_dup_lines, _q_n_repeat_words.

    Windows of five words are compared by their 64-bit hashes inside one text. A word counts once in
    n_repeat_words, however many repeated windows hold it.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(PREFIX + "w", words_of(F.col(text)))
    n = F.size(PREFIX + "w")
    window = lambda i: F.xxhash64(*[F.get(PREFIX + "w", i + j) for j in range(5)])
    df = df.withColumn(PREFIX + "h", F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window)).otherwise(F.array().cast("array<bigint>")))
    # windows by hash, then place; only texts with a repeated window are sorted
    repeats = F.size(F.array_distinct(PREFIX + "h")) < F.size(PREFIX + "h")
    df = df.withColumn(PREFIX + "s", F.when(repeats, F.sort_array(F.transform(PREFIX + "h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, k: (F.get(PREFIX + "s", k - 1)["h"] == x["h"]) | F.coalesce(F.get(PREFIX + "s", k + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn(PREFIX + "p", F.sort_array(F.transform(F.filter(PREFIX + "s", lambda x, k: F.coalesce(twin(x, k), F.get(PREFIX + "s", k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform(PREFIX + "p", lambda p, k: F.least(F.lit(5), F.coalesce(F.get(PREFIX + "p", k + 1) - p, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    # columns of their own, not one struct: a struct's fields would be inlined, and computed, wherever they are used
    features = {
        "n_words": n,
        "word_chars": F.length(F.array_join(PREFIX + "w", "")),
        "n_symbols": F.length(F.regexp_replace(t, SYMBOLS.replace("[", "[^") + "+", "")),
        "n_dup_lines": F.when(F.instr(t, "\n") > 0, F.size(lines) - F.size(F.array_distinct(lines))).otherwise(0),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    return df.withColumns({PREFIX + k: v.cast("long") for k, v in features.items()}).drop(PREFIX + "h", PREFIX + "s", PREFIX + "p")




def default_rules(text: str = "text") -> dict[str, Column]:
    """Conditions under which a text is junk, each far from what prose in any of the languages looks like."""
    t, w = F.coalesce(F.col(text), F.lit("")), F.col(PREFIX + "w")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(t, r"[^\p{Lu}]+", ""))
    return {
        "symbols": 10 * F.col(PREFIX + "n_symbols") > F.col(PREFIX + "word_chars"),
        "duplicate_lines": (F.col(PREFIX + "n_dup_lines") >= 3) & (10 * F.col(PREFIX + "n_dup_lines") > 3 * F.size(F.split(t, "\n"))),
        "word_length": (F.col(PREFIX + "word_chars") < 2 * F.col(PREFIX + "n_words")) | (F.col(PREFIX + "word_chars") > 20 * F.col(PREFIX + "n_words")),
        "few_letters": 10 * letters < 3 * F.col(PREFIX + "word_chars"),
        "capitals": 10 * capitals > 5 * letters,
        "stutter": 10 * F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))) > 3 * F.col(PREFIX + "n_words"),
        "bars": 4 * F.size(F.filter(w, lambda x: x == "|")) > F.col(PREFIX + "n_words"),
    }


def rule_sample(df: DataFrame, text: str = "text", rows: int = 2000, seed: int = 7) -> DataFrame:
    """About ``rows`` rows of ``df`` (a documented bound: only the order of evaluation depends on it; all, if there are
    fewer), drawn from the whole table by a hash of the text, so the same table gives the same sample. Equal texts go
    together, and may come as one row less or more."""
    n = df.count()
    return df if n <= rows else df.where(F.xxhash64(F.lit(seed), F.col(text)) < sample_bound(rows, n))


def sample_bound(rows: int, n: int) -> int:
    """The 64-bit hashes below it are ``rows`` of ``n``, whatever the size of ``n``."""
    return (rows << 64) // n - (1 << 63)


def ordered_rules(df: DataFrame, rules: dict[str, Column], text: str = "text", rows: int = 2000, repeat: int = 4) -> list[tuple[str, float, float]]:
    """(rule, cost, share rejected) on :func:`rule_sample`, by rejection per cost, then name. Cost: seconds for the sample
    read ``repeat`` times over, beyond those of a job that evaluates no rule, as a power of two (times that are close
    count as equal, so that chance does not change the order). Features that all rules share are computed before."""
    sample = saved(base_features(rule_sample(df.select(text), text, rows).dropDuplicates([text]), text), "rule-sample")
    sample = sample.withColumn(PREFIX + "again", F.explode(F.sequence(F.lit(1), F.lit(repeat))))

    def took(rule: Column) -> tuple[float, float]:
        began = time.perf_counter()
        row = sample.agg(F.avg(F.coalesce(rule, F.lit(False)).cast("int"))).first()
        return time.perf_counter() - began, row[0] or 0.0

    nothing = min(took(F.lit(False))[0] for _ in range(2))
    found = []
    for name, rule in rules.items():
        runs = [took(rule) for _ in range(2)]
        found.append((name, 2.0 ** round(math.log2(max(min(t for t, _ in runs) - nothing, 1 / 64))), runs[0][1]))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0]))


def cascade(rules: dict[str, Column], order: list[str]) -> Column:
    """The first rule in ``order`` that rejects, else null; later rules are not evaluated for a rejected row."""
    out = F.when(F.coalesce(rules[order[0]], F.lit(False)), F.lit(order[0]))
    for name in order[1:]:
        out = out.when(F.coalesce(rules[name], F.lit(False)), F.lit(name))
    return out


def judge(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the features of :func:`base_features`, base_failed and rejected_by (the rule, or null if kept).

    Base: fewer than 10 words, or over a fifth of the words in repeated windows of five. A null or empty text has
    no words and fails. Other columns pass through, but for those named rejected_by or base_failed, which are replaced, and
    ``_q_...``; an empty table stays empty.
    """
    full = base_features(df, text)
    rules = default_rules(text)
    base = (F.col(PREFIX + "n_words") < 10) | (100 * F.col(PREFIX + "n_repeat_words") > 20 * F.col(PREFIX + "n_words"))
    order = [name for name, _, _ in ordered_rules(df, rules, text)]
    return full.withColumn("base_failed", base).withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(rules, order))).drop(PREFIX + "w")


def filter_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: only the documents that no rule rejects."""
    # the row goes along as one column, so that no name of its clashes with the features'
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    # saved first: pushed down through the features, the filter would hold each of them many times over
    return saved(judge(rows).select("row", "rejected_by"), "judged").where(F.col("rejected_by").isNull()).select("row.*")
