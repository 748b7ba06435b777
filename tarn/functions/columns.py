"""Column functions: text, ids, hashes, tokens, numbers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_space(text: Column) -> Column:
    """Runs of white space become one space, ends trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def nfkc(text: Column) -> Column:
    """NFKC and lower case; Spark has no built-in normal forms."""

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda x: unicodedata.normalize("NFKC", x).lower(), na_action="ignore")

    return run(text)


def norm_name(text: Column) -> Column:
    """Lower case without white space and punctuation: the key of duplicate names."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+", "")


def content_id(prefix: str, *parts: Column, n: int = 24, separator: str = "|") -> Column:
    """``prefix`` and the first ``n`` hex digits of the SHA-256 of the parts, joined."""
    joined = F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, n))


def turn_fingerprint(question: Column, answer: Column, metrics: Column) -> Column:
    """SHA-256 of the normalised question, the first 2000 characters of the normalised answer, and the metrics' JSON."""
    return F.sha2(F.concat_ws("\n", norm_space(question), F.substring(norm_space(answer), 1, 2000), metrics), 256)


def hash_position(*parts: Column) -> list[Column]:
    """Three stable coordinates in [-1000, 1000] from 4-byte slices of the SHA-256 of the parts."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    unit = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") / F.lit(4294967295.0) for i in range(3)]
    return [F.round(u * 2000 - 1000, 6) for u in unit]


def estimate_tokens(text: Column) -> Column:
    """Ceiling of a third of the ASCII characters plus half of the other characters' UTF-8 bytes."""
    ascii_only = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.ceil(ascii_only / 3 + (F.octet_length(text) - ascii_only) / 2).cast("long")


def query_terms(text: Column) -> Column:
    """Distinct search terms: lower-case ASCII words of two or more letters or digits, Han runs and their bigrams."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9_]{2,})"), 1)
    runs = F.regexp_extract_all(text, F.lit(r"(\p{IsHan}+)"), 1)
    pairs = F.flatten(F.transform(F.filter(runs, lambda r: F.length(r) > 2), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, 2))))
    return F.array_distinct(F.concat(words, runs, pairs))


def relevance(text: Column, kind: Column, terms: list[str], boosts: dict[str, int]) -> Column:
    """20 for each term that the text holds, plus the kind's boost if there was a hit."""
    hits = sum((F.lower(text).contains(term).cast("int") for term in terms), F.lit(0))
    boost = F.coalesce(F.create_map(*[F.lit(x) for kv in boosts.items() for x in kv])[kind], F.lit(0)) if boosts else F.lit(0)
    return F.when(hits > 0, 20 * hits + boost).otherwise(0)


def label_status(vote: Column, outcome: Column) -> Column:
    """A rejection beats a confirmation, which beats silence."""
    no = (vote == "down") | (outcome == "failure")
    yes = (vote == "up") | (outcome == "success")
    return F.when(F.coalesce(no, F.lit(False)), "rejected").when(F.coalesce(yes, F.lit(False)), "confirmed").otherwise("unverified")


def quantize(value: Column, grid: float, origin: float = 0.0) -> Column:
    """Nearest grid number, half to even; not finite, or beyond a long, is null."""
    x = F.bround((value - F.lit(origin)) / F.lit(grid), 0)
    return F.when(~F.isnan(x) & (F.abs(x) < 9.2e18), x.cast("long"))


def parse_number_cell(cell: Column, kind: str = "int") -> Column:
    """A table cell as a number: plain or in round brackets; anything else is null."""
    pattern = r"^\s*[(（]?\s*([+-]?\d+)\s*[)）]?\s*$" if kind == "int" else r"^\s*[(（]?\s*([+-]?\d+(?:[.,]\d+)?)\s*[)）]?\s*$"
    found = F.regexp_replace(F.regexp_extract(cell, pattern, 1), ",", ".")
    to = "bigint" if kind == "int" else "decimal(38,6)"
    return F.when(found != "", found.try_cast(to))


def safe_counter(value: Column) -> Column:
    """A token counter: a long, at least 0; anything else is 0."""
    return F.greatest(F.coalesce(value.try_cast("bigint"), F.lit(0)), F.lit(0))


def one_by_one(array: Column | str) -> Column:
    """``array``, to explode a row at a time. Compiled explodes keep all rows that come of one row in memory, so those
    inside one another keep the product of their arrays; a lambda is not compiled, so the rows are made when they are read."""
    return F.transform(array, lambda x: x)
