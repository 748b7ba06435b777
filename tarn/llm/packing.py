"""Best-fit packing of token sequences (operator 1).

The number of pieces of each length (at most ``capacity`` counts) is all that the driver sees. From it,
:func:`plan_packing` makes bins for whole runs of equal pieces: pieces longer than a third of the capacity
are paired at most twice per bin by greedy matching (the longest with the longest that still fits), then each
smaller length, longest first, goes to the bins with the smallest gap that holds it. A piece finds its place
by its rank among the pieces of its length, which Spark counts in salted parts, so one common length is no hot key.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ByteBpe:
    """Token ids of a byte-level BPE vocabulary, equal to those of ``tokenizers`` without special tokens.

    Pre-tokens begin before a space that a non-space follows, so each space-separated chunk is encoded once
    and kept as bytes (little-endian unsigned 32-bit ids); chunks that are new in a batch are encoded together.
    Texts with other white space go to the ``tokenizers`` library whole.
    """

    KEPT = 400_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")  # texts with one of them go to the library
        self.kept: dict[str, bytes | None] = {}
        newline = self.whole.encode("\n", add_special_tokens=False).ids
        self.newline = newline[0] if len(newline) == 1 else -1
        self.many = self._ranks(path)

    def _ranks(self, path: str):
        """The same vocabulary for tiktoken, which encodes faster, where its file lies beside ``path``."""
        import base64
        import os

        try:
            import public_tokenizers
            import tiktoken
        except ImportError:
            return None
        beside = path.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(beside):
            return None
        with open(beside, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        same = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda text: same.encode_to_numpy(text).astype("<u4")

    def _learn(self, chunks: list[str], before: str) -> list[bytes]:
        """The ids of chunks, encoded in one text with a line end after each; a line end is a token of its own there."""
        ids = self.many("\n".join(before + x for x in chunks) + "\n")
        ends = np.flatnonzero(ids == self.newline)
        data, begin = ids.tobytes(), [0, *(4 * (ends[:-1] + 1)).tolist()]
        return [data[i:j] for i, j in zip(begin, (4 * ends).tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.many is None or self.newline < 0:
            return [self._whole(t or "") for t in texts]
        odd = {i: self._whole(t) for i, t in enumerate(texts) if t and self.added.search(t)}
        split = [("" if i in odd else t or "").replace("\n", " \n").split(" ") for i, t in enumerate(texts)]
        for parts in split:  # nothing comes before the first chunk, as after a line end
            parts[0] = "\n" + parts[0]
        new = set().union(*split) - self.kept.keys()
        if len(self.kept) + len(new) > self.KEPT:
            self.kept.clear()
            new = set().union(*split)
        plain, after = [], []
        for x in new:
            if x[:1] == "\n" and len(x.split()) == 1 and not x[1].isspace() and not x[-1].isspace():
                after.append(x)
            elif len(x.split()) == 1 and not x[0].isspace() and not x[-1].isspace():
                plain.append(x)
            else:
                self.kept[x] = None
        if plain:
            self.kept.update(zip(plain, self._learn(plain, " "), strict=True))
        if after:
            line = np.array([self.newline], "<u4").tobytes()
            self.kept.update((x, line + ids) for x, ids in zip(after, self._learn([x[1:] for x in after], ""), strict=True))
        out, get = [], self.kept.__getitem__
        for text, parts in zip(texts, split, strict=True):
            try:
                out.append(b"".join(map(get, parts))[4:])
            except TypeError:  # white space of another kind
                out.append(self._whole(text))
        for i, ids in odd.items():
            out[i] = ids
        return out

    def _whole(self, text: str) -> bytes:
        if not text:
            return b""
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def encode_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids: its text's, then ``end_id``. Longer documents are cut into pieces of
    ``capacity``; the first piece is the shorter one. A null text counts as empty; rows with a null or repeated
    doc_id are packed like any other; other columns are left out. ``with_ids`` adds the ids (little-endian bytes)."""

    def run(batches):
        bpe, end = ByteBpe(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                rows: list[list] = [[], [], [], [], [], []]
                for doc, data in zip(ids[at : at + 256], bpe.encode(texts.slice(at, 256).to_pylist()), strict=True):
                    data += end
                    total, begin, piece = len(data) // 4, 0, 0
                    size = total % capacity or capacity
                    while begin < total:
                        part = data[4 * begin : 4 * (begin + size)]
                        for column, value in zip(rows, (doc, piece, begin, size, zlib.crc32(part), part), strict=True):
                            column.append(value)
                        begin, size, piece = begin + size, capacity, piece + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays(columns[:n], names[:n])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def plan_packing(counts: dict[int, int], capacity: int = 1024) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """For each length, runs (first rank, first sequence, pieces of this length in a sequence, offset), and the
    number of sequences. A piece of rank r in a run lies in sequence ``first + (r - first_rank) // per``, at
    ``offset + (r - first_rank) % per * length``. There are at most a few runs for each length and gap."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}
    used = dict.fromkeys(counts, 0)
    left = {n: c for n, c in counts.items() if c > 0}
    gaps: dict[int, list[tuple[int, int, int]]] = {}  # gap: (first sequence, sequences, offset)
    sizes: list[int] = []  # gaps in use, ascending
    total = 0

    def put(length: int, sequence: int, bins: int, per: int, offset: int) -> None:
        runs[length].append((used[length], sequence, per, offset))
        used[length] += bins * per
        left[length] -= bins * per

    def gap(size: int, sequence: int, bins: int, offset: int) -> None:
        if size and bins:
            if size not in gaps:
                gaps[size] = []
                insort(sizes, size)
            gaps[size].append((sequence, bins, offset))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        fit = bisect_left(large, capacity - n + 1) - 1  # the longest that fits beside it
        m = large[fit] if fit >= 0 else 0
        if m == n:
            bins = left[n] // 2
            if bins:
                put(n, total, bins, 2, 0)
                gap(capacity - 2 * n, total, bins, 2 * n)
            else:
                bins = left[n]
                others = [x for x in large[: fit + 1] if x != n]
                put(n, total, 1, 1, 0)
                if others:
                    put(others[-1], total, 1, 1, n)
                gap(capacity - n - (others[-1] if others else 0), total, 1, n + (others[-1] if others else 0))
                bins = 1
        elif m:
            bins = min(left[n], left[m])
            put(n, total, bins, 1, 0)
            put(m, total, bins, 1, n)
            gap(capacity - n - m, total, bins, n + m)
        else:
            bins = left[n]
            put(n, total, bins, 1, 0)
            gap(capacity - n, total, bins, n)
        total += bins
        large = [x for x in large if left[x]]
    for n in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(sizes, n)
            if at == len(sizes):  # no gap holds it
                per = min(capacity // n, left[n])
                bins = max(1, left[n] // per)
                put(n, total, bins, per, 0)
                gap(capacity - per * n, total, bins, per * n)
                total += bins
                continue
            size = sizes[at]
            sequence, bins, offset = gaps[size].pop()
            if not gaps[size]:
                del gaps[size]
                sizes.pop(at)
            per = min(size // n, left[n])
            take = min(bins, left[n] // per)
            put(n, sequence, take, per, offset)
            gap(size - per * n, sequence, take, offset + per * n)
            gap(size, sequence + take, bins - take, offset)
    return runs, total


def place_pieces(pieces: DataFrame, capacity: int = 1024, parts: int = 256) -> DataFrame:
    """``pieces`` (saved: read three times) with sequence_id and offset. ``parts``: into how many a length is
    split to count ranks; the part comes from a hash of the piece, so its ranks do not depend on the partitions.
    An empty table gives an empty table. Every piece has 1 to ``capacity`` tokens."""
    part = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = part.groupBy("length", "part").agg(F.count("*").alias("n"))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = plan_packing(lengths, capacity)
    plan = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for n, r in runs.items() if r}
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32"))
    ranked = part.withColumn("inside", inside).join(before, ["length", "part"]).select(*pieces.columns, (F.col("before") + F.col("inside") - 1).alias("rank"))

    def run(frames):
        for f in frames:
            length, rank = f["length"].to_numpy(), f.pop("rank").to_numpy()
            sequence, offset = np.zeros(len(f), np.int64), np.zeros(len(f), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                low, first, per, begin = plan[int(n)]
                at = np.searchsorted(low, rank[mine], side="right") - 1
                past = rank[mine] - low[at]
                sequence[mine], offset[mine] = first[at] + past // per[at], begin[at] + past % per[at] * n
            yield f.assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(run, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; see :func:`encode_documents`."""
    return place_pieces(saved(encode_documents(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The packed sequences themselves: sequence_id, input_ids array<int>, document of each token array<long>.
    A group holds at most ``capacity`` tokens. The ids of doc_id, start and crc join once for repeated rows."""
    kept = saved(encode_documents(docs, tokenizer, capacity, end_id, with_ids=True), "ids")
    keys = ["doc_id", "start", "length", "ids_crc32"]
    same = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(1)))
    texts = kept.withColumn("copy", same).select(*[F.col(c).alias(f"_{c}") for c in [*keys, "copy"]], F.col("ids").alias("_ids"))
    placed = place_pieces(kept.drop("ids"), capacity).withColumn("copy", same)
    both = placed.join(texts, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*keys, "copy"]]).select("sequence_id", "offset", "doc_id", F.col("_ids").alias("ids"))

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("offset")
        parts = [np.frombuffer(x, "<u4").astype(np.int32) for x in f["ids"]]
        docs_of = np.repeat(f["doc_id"].to_numpy(dtype=object), [len(x) for x in parts])
        return pd.DataFrame({"sequence_id": [f["sequence_id"].iloc[0]], "input_ids": [np.concatenate(parts).tolist()], "document_ids": [docs_of.tolist()]})

    return both.groupBy("sequence_id").applyInPandas(join, "sequence_id long, input_ids array<int>, document_ids array<long>")
