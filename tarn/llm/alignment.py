"""Two tokenizers' tokens aligned by bytes, in Arrow (operator 13).

A task encodes its documents in blocks of bounded size. Token ids lie in list arrays: flattened, with the document of each
token as parent index, and token ends as cumulative sums of token bytes, less what came before the document. A full outer
hash join of both sides' ends on (document, end), sorted and filled backwards, has one row per link: the bytes up to
an end that either side has, since the end before, lie in one token of each. Rows that both sides have end the groups.
Table.group_by counts the documents of each id pair in the block; Spark merges these partial counts, finds the highest of
each A id, and hands every block the counts of its own pairs, so that no table of all pairs is ever in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .packing import ByteBpe

#: Bytes of text of a block (its pairs are counted together, its links are one row) and of a step inside it.
BLOCK, STEP = 8 << 20, 1 << 20
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_BLOCK_ROW = (
    "block long, doc_id array<long>, " + "".join(f"{c} array<long>, " for c in COUNTS) + "groups array<string>, groups_sha256 array<string>, n_pairs array<int>, places binary, times binary, pair array<long>, n_docs array<int>"
)
#: A pair of ids as one number: A's id times SIDE, plus B's.
SIDE = 1 << 32


class ByteSide:
    """Ids of space + text by a byte-level BPE vocabulary (``tokenizers`` JSON), strings of special tokens being plain
    text, and the bytes of every id."""

    def __init__(self, path: str):
        self.bpe = ByteBpe(path)
        self.bpe.whole.encode_special_tokens = True
        self.bpe.added = re.compile(r"(?!)")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        codes = {c: c for c in plain} | {256 + i: c for i, c in enumerate(c for c in range(256) if c not in plain)}
        special = self.bpe.whole.get_added_tokens_decoder().keys()
        names = [self.bpe.whole.id_to_token(i) or "" for i in range(self.bpe.whole.get_vocab_size())]
        self.bytes = [x.encode() if i in special else bytes(codes[ord(c)] for c in x) for i, x in enumerate(names)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        # a letter before the space is a token of its own, whatever follows
        return [np.frombuffer(x, "<u4")[1:] for x in self.bpe.encode(["a " + t for t in texts])]


class PieceSide:
    """Ids of a text by a piece model (``sentencepiece``), which adds the space itself, and the bytes of every id.

    No piece has a space after another character or crosses a line end, so a chunk between single spaces is encoded once;
    texts with other runs of spaces are encoded whole."""

    KEPT = 400_000

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(x[3:-1], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        inner = any("▁" in x.lstrip("▁") or x.startswith("▁▁") and x.strip("▁") or "\n" in x for x in names)
        alone = self.model.encode("\n")
        self.space = self.model.piece_to_id("▁")
        self.chunks = not inner and len(alone) > 1 and alone[0] == self.space
        self.kept: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.replace("\n", " \n").split(" ") for t in texts]
        whole = [i for i, (t, parts) in enumerate(zip(texts, split, strict=True)) if not self.chunks or "" in parts or parts[0][0] == "\n"]
        for i in whole:
            split[i] = []
        new = set().union(*split) - self.kept.keys()
        if len(self.kept) + len(new) > self.KEPT:
            self.kept.clear()
            new = set().union(*split)
        fresh = list(new)
        for x, ids in zip(fresh, self.model.encode(fresh, num_threads=1) if fresh else [], strict=True):
            self.kept[x] = np.array(ids[1:] if x[0] == "\n" else ids, "<u4").tobytes()  # no space before a line end
        get = self.kept.__getitem__
        out = [np.frombuffer(b"".join(map(get, parts)), "<u4") for parts in split]
        for i in whole:
            out[i] = np.array(self.model.encode(texts[i], num_threads=1), "<u4")
        return out


class _Vocabulary:
    def __init__(self, side: ByteSide | PieceSide):
        self.side = side
        self.bytes = pa.array(side.bytes, pa.binary())
        self.sizes = pa.array([len(x) for x in side.bytes], pa.int64())

    def tokens(self, texts: list[str], raw: list[bytes]) -> tuple[pa.ListArray, np.ndarray]:
        """Ids of each text as a list array, and which texts' token bytes, joined, are not ``raw``."""
        ids = self.side.encode(texts)
        ends = np.cumsum([0, *map(len, ids)])
        flat = pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32))
        parts = self.bytes.take(flat)
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[ends] if len(flat) else np.zeros(len(ends), np.int64)
        joined = parts.buffers()[2].to_pybytes() if len(flat) else b""
        wrong = [joined[i:j] != x for i, j, x in zip(offsets[:-1], offsets[1:], raw, strict=True)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), np.array(wrong, bool)


def _ends(tokens: pa.ListArray, sizes: pa.Array, name: str) -> pa.Table:
    """(doc, end, name: id) for each token; end in bytes of its document."""
    ids, doc = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    running = pc.cumulative_sum(sizes.take(ids))
    first = tokens.offsets.to_numpy()
    before = pa.array(np.concatenate(([0], running.to_numpy()))[first[:-1]])
    return pa.table({"doc": doc, "end": pc.subtract(running, before.take(doc)), name: ids})


class _Step:
    """The links of a few documents."""

    def __init__(self, a: pa.ListArray, b: pa.ListArray, sizes: tuple[pa.Array, pa.Array], decimals: pa.Array):
        n = len(a)
        both = _ends(a, sizes[0], "a").join(_ends(b, sizes[1], "b"), ["doc", "end"], join_type="full outer", use_threads=False)
        both = both.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
        has_a, has_b = (pc.is_valid(both[c]).to_numpy() for c in "ab")
        ends_group, doc = has_a & has_b, both["doc"].to_numpy()
        pair = pc.add(pc.multiply(pc.fill_null_backward(both["a"]).cast(pa.int64()), SIDE), pc.fill_null_backward(both["b"]).cast(pa.int64()))
        self.pairs = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["doc", "pair", "times"])
        n_a, n_b = np.diff(a.offsets.to_numpy()), np.diff(b.offsets.to_numpy())
        self.counts = [n_a, n_b, np.bincount(doc[ends_group], minlength=n), np.bincount(doc, minlength=n)]
        self.groups = self._groups(both, has_a, has_b, ends_group, n_a + n_b, decimals)

    @staticmethod
    def _groups(both: pa.Table, has_a: np.ndarray, has_b: np.ndarray, ends_group: np.ndarray, size: np.ndarray, decimals: pa.Array) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` for each document. decimals: of each id, with each of , | ; after it."""
        group = np.cumsum(ends_group) - ends_group
        at_a, at_b, n = np.flatnonzero(has_a), np.flatnonzero(has_b), int(ends_group.sum())
        # a group's A tokens go before its B tokens
        past_a, past_b = (np.cumsum(np.bincount(group[x], minlength=n)) for x in (at_a, at_b))
        out = np.empty(len(at_a) + len(at_b), np.int64)
        out[np.arange(len(at_a)) + np.concatenate(([0], past_b))[group[at_a]]] = 3 * both["a"].drop_null().to_numpy() + ends_group[at_a]
        out[np.arange(len(at_b)) + past_a[group[at_b]]] = 3 * both["b"].drop_null().to_numpy() + 2 * ends_group[at_b]
        parts = decimals.take(pa.array(out))
        ends = np.cumsum([0, *size])
        offsets = np.frombuffer(parts.buffers()[1], np.int32)[ends] if len(out) else np.zeros(len(ends), np.int64)
        text = parts.buffers()[2].to_pybytes() if len(out) else b""
        return [text[i : max(i, j - 1)] for i, j in zip(offsets[:-1], offsets[1:], strict=True)]


class _Block:
    """Documents whose links become one row."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.docs: list = []
        self.counts: list[list[np.ndarray]] = [[] for _ in COUNTS]
        self.groups: list[bytes] = []
        self.pairs: list[pa.Table] = []

    def add(self, docs: list, step: _Step, size: int) -> None:
        shifted = pc.add(step.pairs["doc"].cast(pa.int64()), len(self.docs))
        self.pairs.append(step.pairs.set_column(0, "doc", shifted))
        self.docs += docs
        for mine, more in zip(self.counts, step.counts, strict=True):
            mine.append(more)
        self.groups += step.groups
        self.bytes += size

    def row(self, with_groups: bool) -> pa.RecordBatch:
        links = pa.concat_tables(self.pairs)
        partial = links.group_by("pair", use_threads=False).aggregate([([], "count_all")]).sort_by("pair")
        pair = partial["pair"].to_numpy()
        doc, place = links["doc"].to_numpy(), np.searchsorted(pair, links["pair"].to_numpy())
        order = np.argsort(doc * len(pair) + place)
        doc, place, times = doc[order], place[order].astype(np.int32), links["times"].to_numpy()[order].astype(np.int32)
        steps = np.diff(place, prepend=np.int32(0))
        new = np.diff(doc, prepend=-1) > 0
        steps[new] = place[new]
        one = lambda x, kind: pa.array([x], kind)
        many = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
        columns = [one(self.number, pa.int64()), many(self.docs, pa.int64())]
        columns += [many(np.concatenate(c), pa.int64()) for c in self.counts]
        columns.append(many([x.decode() for x in self.groups], pa.string()) if with_groups else pa.array([None], pa.list_(pa.string())))
        columns.append(many([hashlib.sha256(x).hexdigest() if x else "" for x in self.groups], pa.string()))
        columns.append(many(np.bincount(doc, minlength=len(self.docs)), pa.int32()))
        columns += [one(pa.compress(x.tobytes(), codec="zstd", asbytes=True), pa.binary()) for x in (steps, times)]
        columns += [many(pair, pa.int64()), many(partial["count_all"].to_numpy(), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _BLOCK_ROW.split(", ")])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    docs, texts, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            docs.append(doc)
            texts.append(text)
            size += len(text)
            if size >= STEP or len(docs) >= 2048:
                yield docs, texts
                docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def link_blocks(docs: DataFrame, byte_path: str, piece_path: str, with_groups: bool = False) -> DataFrame:
    """Rows of blocks of documents: their counts, their groups, the distinct pairs of the block with the number of its
    documents that hold them linked, and the links of every document as places among these pairs."""

    def run(batches):
        a, b = _Vocabulary(ByteSide(byte_path)), _Vocabulary(PieceSide(piece_path))
        most = max(len(a.sizes), len(b.sizes))
        decimals = pa.array([f"{i}{end}" for i in range(most) for end in ",|;"])
        first, n = TaskContext.get().partitionId() << 33, 0
        block = _Block(first)
        for ids, texts in _steps(batches):
            raw = [(" " + t).encode() if t else b"" for t in texts]
            (ta, wrong_a), (tb, wrong_b) = _aligned(a, texts, raw), _aligned(b, texts, raw)
            wrong = wrong_a | wrong_b
            if wrong.any():
                keep = pa.array(np.where(wrong, None, np.arange(len(texts))), pa.int64())
                ta, tb = (pc.fill_null(x.take(keep), pa.scalar([], x.type)) for x in (ta, tb))
                ta, tb = (pa.ListArray.from_arrays(_offsets(x), x.flatten()) for x in (ta, tb))
            block.add(ids, _Step(ta, tb, (a.sizes, b.sizes), decimals), sum(map(len, raw)))
            if block.bytes >= BLOCK:
                yield block.row(with_groups)
                n += 1
                block = _Block(first + n)
        if block.docs:
            yield block.row(with_groups)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _BLOCK_ROW)


def _offsets(lists: pa.ListArray) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))), pa.int32())


def _aligned(v: _Vocabulary, texts: list[str], raw: list[bytes]) -> tuple[pa.ListArray, np.ndarray]:
    """Tokens of the texts that have any; empty texts have none."""
    live = [i for i, t in enumerate(texts) if t]
    some, wrong = v.tokens([texts[i] for i in live], [raw[i] for i in live])
    if len(live) == len(texts):
        return some, wrong
    sizes, bad = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    sizes[live], bad[live] = np.diff(some.offsets.to_numpy()), wrong
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), some.values), bad


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best): how many documents hold an id pair linked, and whether that is the highest of its A id (ties: all).

    The highest counts have one row per id of A's vocabulary at most, so they are broadcast."""
    partial = blocks.select(F.explode(F.arrays_zip("pair", "n_docs")).alias("p")).select("p.pair", "p.n_docs")
    counts = saved(partial.groupBy("pair").agg(F.sum("n_docs").alias("n")).withColumn("a", F.expr(f"pair div {SIDE}")), "pairs")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, with_groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and groups if asked.

    A: space + text by the byte-level vocabulary; B: text by the piece model. A null or empty text, and one that either
    side's tokens don't give back byte for byte (a text with U+2581), has zeros and ''. Rows with a null or repeated doc_id
    are documents like any other; columns other than doc_id and text are left out; an empty table gives an empty table.
    A text must fit in a task's memory with its tokens, about sixty bytes for each byte of text.
    """
    blocks = saved(link_blocks(docs, byte_path, piece_path, with_groups), "blocks")
    counts = saved(pair_counts(blocks), "counts")
    mine = blocks.select(F.col("block").alias("of_block"), F.explode("pair").alias("pair")).join(counts, "pair").select("of_block", "pair", "n", "best")
    rest = blocks.select("block", "doc_id", *COUNTS, "groups", "groups_sha256", "n_pairs", "places", "times")

    def finish(block: pa.Table, counts: pa.Table) -> pa.Table:
        row = block.slice(0, 1)
        values = lambda c: row[c].combine_chunks().flatten()
        n_pairs = values("n_pairs").to_numpy()
        total = int(n_pairs.sum())
        steps, times = (np.frombuffer(pa.decompress(row[c][0].as_buffer(), 4 * total, codec="zstd"), np.int32).astype(np.int64) for c in ("places", "times"))
        first = np.concatenate(([0], np.cumsum(n_pairs)))
        running = np.concatenate(([0], np.cumsum(steps)))
        place = running[1:] - np.repeat(running[first[:-1]], n_pairs)
        counts = counts.sort_by("pair")
        per_doc = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[place] * times)))[first])
        sums = [per_doc(counts[c].to_numpy().astype(np.int64)) for c in ("best", "n")]
        out = {"doc_id": values("doc_id"), **{c: values(c) for c in COUNTS}, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": values("groups_sha256")}
        return pa.table(out | ({"groups": values("groups")} if with_groups else {}))

    kinds = "doc_id long, " + "".join(f"{c} long, " for c in COUNTS) + "n_best long, count_sum long, groups_sha256 string" + ", groups string" * with_groups
    return rest.groupBy("block").cogroup(mine.groupBy("of_block")).applyInArrow(finish, kinds)
