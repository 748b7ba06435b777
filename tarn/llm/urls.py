"""URL filters by a bit-parallel wildcard automaton (operator 5).

All glob rules are packed into one multiword Shift-And automaton: a state bit per pattern position, a mask per
byte for steps, a mask per byte for the self-loops of wildcards. Every URL of a batch advances by one byte at once.

A rule is ``host/path``: it fits the host and all its subdomains when the path starts with the rule's. In a glob,
``*`` in the host stays in the host and ``*`` in the path matches anything. The canonical form that is matched
is ``.host NUL path``; hosts are lower-cased in A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUT = "\0"

#: The rules that any caller of the query gets: (verdict, host and path).
FIXED_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: The method's own verdict where no rule fits: hosts and paths that are blocked, as globs.
OWN_BLOCKS = ["*spam*/", "*casino*/", "*pills*/", "*/*/porn*", "*/*viagra*", "*/*.exe$"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; path: then up to ``?``, ``#`` or the end.
    Null and URLs without ``://`` have an empty host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def glob_of(rule: str) -> str:
    """``host/path`` as a glob over the canonical form; a host without ``*`` also fits its subdomains, a path that does not
    end in ``$`` also fits longer ones."""
    host, _, path = rule.partition("/")
    return ("*" if host.startswith("*") else "*.") + host.removeprefix("*") + CUT + "/" + (path[:-1] if path.endswith("$") else path + "**")


class ShiftAnd:
    """The automaton of several globs: ``*`` matches bytes but NUL, ``**`` any bytes, ``?`` one byte but NUL."""

    def __init__(self, globs: list[str]):
        steps: list[tuple[np.ndarray, np.ndarray]] = []  # for each bit: bytes that lead into it, bytes that keep it
        self.start, self.accept = [], []
        other = np.ones(256, bool)
        other[0] = False
        for glob in globs:
            self.start.append(len(steps))
            steps.append((np.zeros(256, bool), np.zeros(256, bool)))
            data, i = glob.encode(), 0
            while i < len(data):
                if data[i] == 42:
                    double = data[i : i + 2] == b"**"
                    steps[-1][1][:] |= True if double else other
                    i += 1 + double
                    continue
                into = other.copy() if data[i] == 63 else np.arange(256) == data[i]
                steps.append((into, np.zeros(256, bool)))
                i += 1
            self.accept.append(len(steps) - 1)
        self.words = max(1, -(-len(steps) // 64))
        self.into = np.zeros((256, self.words), np.uint64)
        self.keep = np.zeros((256, self.words), np.uint64)
        for bit, (into, keep) in enumerate(steps):
            self.into[into, bit // 64] |= np.uint64(1 << bit % 64)
            self.keep[keep, bit // 64] |= np.uint64(1 << bit % 64)
        self.first = np.zeros(self.words, np.uint64)
        for bit in self.start:
            self.first[bit // 64] |= np.uint64(1 << bit % 64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """A row per text, a column per glob: whether the glob matches the whole text."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        sizes = np.array([len(texts[i]) for i in order], np.int64)
        state = np.repeat(self.first[None, :], len(texts), axis=0)
        data = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
        live = len(texts)
        for at in range(int(sizes[0]) if len(sizes) else 0):
            while sizes[live - 1] <= at:  # shorter texts are done
                live -= 1
            now, byte = state[:live], data[begin[:live] + at]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.into[byte]) | (now & self.keep[byte])
        out = np.zeros((len(texts), len(self.accept)), bool)
        for j, bit in enumerate(self.accept):
            out[order, j] = state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1) == 1
        return out


def judge_urls(df: DataFrame, url: str = "url", rules: list[tuple[str, str]] | None = None, blocks: list[str] | None = None) -> DataFrame:
    """``df`` with _host, _path, _rule (the longest that fits, or null) and _verdict (allow or block).

    Columns of these names, and one named _v, are replaced. Rules of the same length: the first in the list. Where no rule fits, the verdict is block if one of ``blocks``
    does, else allow. Null, empty, very long and repeated URLs are judged like any other; an empty table stays empty.
    """
    rules = FIXED_RULES if rules is None else rules
    blocks = OWN_BLOCKS if blocks is None else blocks
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    globs = [glob_of(r) for _, r in ranked] + [glob_of(b) for b in blocks]

    @F.pandas_udf("rule string, verdict string")
    def verdict(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton, n = ShiftAnd(globs), len(ranked)
        names = np.array([r for _, r in ranked] + [None], dtype=object)
        verdicts = np.array([v for v, _ in ranked] + [""], dtype=object)
        for host, path in frames:
            hit = automaton.match([f".{h}{CUT}{p}".encode("utf-8", "surrogatepass") for h, p in zip(host, path, strict=True)])
            best = np.where(hit[:, :n].any(axis=1), hit[:, :n].argmax(axis=1), n)
            own = np.where(hit[:, n:].any(axis=1), "block", "allow")
            yield pd.DataFrame({"rule": names[best], "verdict": np.where(best < n, verdicts[best], own)})

    host, path = host_and_path(F.col(url).cast("string"))
    out = df.withColumn("_host", host).withColumn("_path", path).withColumn("_v", verdict("_host", "_path"))
    return out.withColumn("_rule", F.col("_v.rule")).withColumn("_verdict", F.col("_v.verdict")).drop("_v")
