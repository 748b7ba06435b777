"""Near-duplicate documents by Order MinHash (operator 10).

A document's k-mers are its runs of two words, each labelled with its number of occurrence. Every sketch picks
the three k-mers with the smallest hashes and keeps them in text order, so it follows edit similarity, not just
the set of k-mers. Documents that agree in one of the sketches are candidates; an alignment over a band of
diagonals, as wide as the allowed edits, verifies that at most a fifth of the words differ. Where every fifth word
differs no run of five words is left, and three sevenths of the runs of two are: so k is two, and 32 sketches of three
bring 93 % of such pairs together. Texts of few words have sketches of one k-mer besides.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mix, saved, scratch_count, scratch_removed, settled, windows
from .links import bucket_classes, shared_buckets

SKETCHES, PICKED, K = 32, 3, 2
#: Texts of up to so many words have as many sketches more, of a single k-mer.
SHORT, SINGLE = 40, 12
_SEEDS = np.random.default_rng(5).integers(1, 2**63, (SKETCHES + SINGLE, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64(2**64 - 1)


def label_occurrences(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """k-mer hashes in which the n-th occurrence of a k-mer in its text differs from the others."""
    order = np.argsort(h, kind="stable")
    hs, ts = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
    begin = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
    out = np.empty_like(h)
    out[order] = mix(hs + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def order_minhash(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of SKETCHES + SINGLE sketch values for each text with words; first: as in Words. A text of fewer than K words
    has one k-mer, all its words. The SINGLE last ones hold for texts of up to SHORT words alone, and are 0 for others."""
    n = np.diff(first)
    live = np.flatnonzero(n > 0)
    grams, at = windows(words, first, K)
    text = np.searchsorted(first, at, side="right") - 1
    short = live[n[live] < K]
    if len(short):
        own = np.array([mix(np.array([words[first[i] : first[i + 1]].sum() + np.uint64(n[i])], np.uint64))[0] for i in short], np.uint64)
        grams, text = np.concatenate((grams, own)), np.concatenate((text, short))
        order = np.argsort(text, kind="stable")
        grams, text = grams[order], text[order]
    out = np.zeros((len(live), SKETCHES + SINGLE), np.uint64)
    if not len(live):
        return out
    h = label_occurrences(grams, text)
    begin = np.searchsorted(text, live)
    size = np.diff(np.append(begin, len(text)))
    few = np.flatnonzero(n[live] <= SHORT)
    whole = h, begin, size
    for j, (a, b) in enumerate(_SEEDS):
        rows = slice(None)
        if j == SKETCHES:  # the k-mers of short texts alone
            mine = np.repeat(n[live] <= SHORT, whole[2])
            h, size = whole[0][mine], whole[2][few]
            begin = np.cumsum(size) - size
        if j >= SKETCHES:
            if not len(few):
                break
            rows = few
        v = (h ^ b) * a
        v ^= v >> np.uint64(32)
        picked = []
        for _ in range(PICKED if j < SKETCHES else 1):
            low = np.minimum.reduceat(v, begin)
            where = np.flatnonzero(v == np.repeat(low, size))
            where = where[::-1]  # the first place wins
            spot = np.zeros(len(begin), np.int64)
            spot[np.searchsorted(begin, where, side="right") - 1] = where
            picked.append(spot)
            v[spot] = _TOP
        picked = np.sort(np.array(picked), axis=0)
        for p in picked:
            out[rows, j] = mix(out[rows, j] * np.uint64(31) + h[p] + np.uint64(j + 1))
    return out


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether the edit distance of two arrays is at most ``most``: furthest-reaching points along a band of
    diagonals that widens by one with each further edit, all diagonals at once; a wide band goes by columns instead."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    la, lb = len(a), len(b)
    if not la or not lb:
        return max(la, lb) <= most
    if most > 16:
        return _columns(a.tolist(), b.tolist(), most)
    ends = np.append(a, np.uint32(0)), np.append(b, np.uint32(0))
    reach = np.full(2 * most + 5, -2, np.int64)  # rows of a used, by diagonal; index most + 2 is the main one
    diagonal = np.arange(2 * most + 5) - most - 2  # columns of b less rows of a
    goal = lb - la + most + 2

    def slide(r: np.ndarray, d: np.ndarray) -> np.ndarray:
        moving = np.flatnonzero((r >= 0) & (r < la) & (r + d >= 0) & (r + d < lb))
        while len(moving):
            moving = moving[ends[0][r[moving]] == ends[1][r[moving] + d[moving]]]
            r[moving] += 1
            moving = moving[(r[moving] < la) & (r[moving] + d[moving] < lb)]
        return r

    mid = most + 2
    reach[mid] = slide(np.zeros(1, np.int64), np.zeros(1, np.int64))[0]
    for e in range(1, most + 1):
        if reach[goal] >= la:
            return True
        low, high = max(mid - e, 1), min(mid + e, 2 * most + 3)
        old = reach[low - 1 : high + 2]
        d = diagonal[low : high + 1]
        r = np.maximum(np.maximum(old[1:-1] + 1, old[2:] + 1), old[:-2])
        r = np.minimum(np.minimum(r, la), lb - d)
        reach[low : high + 1] = slide(r, d)
    return bool(reach[goal] >= la)


def _columns(a: list[int], b: list[int], most: int) -> bool:
    """As :func:`within`: the alignment's columns as bit vectors of their vertical steps, one big number for each sign.
    Ends as soon as what is left can't bring the distance down to ``most``."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, len(a) - 1
    up, down, distance = full, 0, len(a)
    for left, x in zip(range(len(b) - 1, -1, -1), b, strict=True):
        match = places.get(x, 0) | down
        diagonal = ((up + (match & up)) ^ up) | match
        fall, rise = up & diagonal, down | (full & ~(up | diagonal))
        distance += (rise >> top & 1) - (fall >> top & 1)
        if distance - left > most:
            return False
        rise = rise << 1 | 1
        down, up = rise & diagonal & full, full & (fall << 1 | ~(rise | diagonal))
    return distance <= most


def _rising(p: np.ndarray) -> np.ndarray:
    """Places of a longest rising subsequence."""
    if (np.diff(p) > 0).all():
        return np.arange(len(p))
    tails, ends, before = [], [], []
    for i, x in enumerate(p.tolist()):
        at = bisect_left(tails, x)
        before.append(ends[at - 1] if at else -1)
        if at == len(tails):
            tails.append(x)
            ends.append(i)
        else:
            tails[at], ends[at] = x, i
    out, i = [], ends[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1])


def similar(x: bytes, y: bytes, share: float = 0.8) -> bool:
    """Whether two word sequences (32-bit word hashes) have edit similarity ``share`` or more.

    The words that the two have in common, counted, bound the distance from below; an alignment through the words
    that occur once in either bounds it from above. Only pairs between the bounds need the banded alignment."""
    a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
    n = max(len(a), len(b))
    most = int((1 - share) * n + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    va, ia, ca = np.unique(a, return_index=True, return_counts=True)
    vb, ib, cb = np.unique(b, return_index=True, return_counts=True)
    _, p, q = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if n - np.minimum(ca[p], cb[q]).sum() > most:
        return False
    once = (ca[p] == 1) & (cb[q] == 1)
    pa, pb = ia[p[once]], ib[q[once]]
    if len(pa):
        order = np.argsort(pa)
        pa, pb = pa[order], pb[order]
        keep = _rising(pb)
        pa, pb = np.concatenate(([-1], pa[keep], [len(a)])), np.concatenate(([-1], pb[keep], [len(b)]))
        ga, gb = np.diff(pa) - 1, np.diff(pb) - 1
        even = ga == gb
        gap = np.repeat(np.arange(len(ga)), ga)
        at = np.delete(np.arange(len(a)), pa[1:-1])
        at, gap = at[even[gap]], gap[even[gap]]
        if np.maximum(ga, gb)[~even].sum() + (a[at] != b[at + (pb - pa)[gap]]).sum() <= most:
            return True
    return within(a, b, most)


#: Share of either's word tokens that similar texts have in common: an edit changes one of them at most.
SHARE = 0.8


def word_tokens(x: bytes) -> np.ndarray:
    """A token for each word of a text, numbered by occurrence."""
    w = np.frombuffer(x, np.uint32).astype(np.uint64)
    return label_occurrences(mix(w), np.zeros(len(w), np.int64))


def _each(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part, Words(part.column("text").to_pylist())


def _sketch(batches):
    for part, words in _each(batches):
        out = order_minhash(words.hashes(), words.first)
        size = np.where(words.n > SHORT, SKETCHES, SKETCHES + SINGLE)
        size[words.n == 0] = 0
        kept = np.arange(SKETCHES + SINGLE) < size[words.n > 0][:, None]
        ends = pa.array(np.concatenate(([0], size.cumsum())), pa.int32())
        sketch = pa.ListArray.from_arrays(ends, pa.array(out[kept].view(np.int64)))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("id"), sketch], ["doc_id", "id", "sketch"])


def _blob(batches):
    for part, words in _each(batches):
        h = (words.hashes() >> np.uint64(32)).astype(np.uint32)
        blobs = [h[i:j].tobytes() for i, j in zip(words.first[:-1], words.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(blobs, pa.binary())], ["id", "blob"])


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node, root): the class of each distinct text that has similar ones; (id, low, n): the smallest doc_id and the
    number of rows of each distinct text; the rows (doc_id, id). A text's id is the MD5 of its bytes. Only sketches are
    kept of all texts; the words of those that share a bucket are read again, from one document each."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("id", text_id(F.col("text")))
    spark, made = docs.sparkSession, scratch_count()
    rows = saved(keyed.mapInArrow(_sketch, "doc_id long, id binary, sketch array<long>"), "sketches")
    one = saved(rows.groupBy("id").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.first("sketch").alias("sketch")), "sketches-of-texts")
    rows = saved(rows.select("doc_id", "id"), "rows")
    scratch_removed(spark, made, one.select("id").union(rows.select("id")))  # copies of a text need no sketch
    settled(spark)
    keys = one.where(F.size("sketch") > 0).select("id", F.posexplode("sketch").alias("band", "key"))
    keys = shared_buckets(keys)
    one = saved(one.select("id", "low", "n"), "texts")
    scratch_removed(spark, made, one.select("id").union(rows.select("id")).union(keys.select("id")))  # sketches are done with
    wanted = one.select("id", F.col("low").alias("doc_id")).join(keys.select("id").distinct(), "id", "left_semi")
    texts = keyed.join(wanted, (keyed["id"] == wanted["id"]) & keyed["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
    items = saved(texts.select("id", "text").mapInArrow(_blob, "id binary, blob binary").dropDuplicates(["id"]), "words")
    settled(spark)
    return bucket_classes(keys, items, similar, word_tokens, lambda c, a, b: c >= SHARE * np.maximum(a, b) - 1e-3), one, rows


def with_classes(docs: DataFrame) -> DataFrame:
    """doc_id, id (of the text), class_id and class_text (doc_id and text id of the group's first document: the smallest
    doc_id, a null one last), n_class, for every row."""
    roots, texts, rows = near_classes(docs)
    grouped = texts.join(roots, texts["id"] == roots["node"], "left").select("id", "low", "n", F.coalesce("root", "id").alias("root"))
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "id")).alias("first")
    classes = grouped.groupBy("root").agg(first, F.sum("n").alias("n_class"))
    of_text = grouped.select("id", "root").join(classes, "root")
    return rows.join(of_text.select("id", F.col("first.low").alias("class_id"), F.col("first.id").alias("class_text"), "n_class"), "id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its group), n_class (documents of the group).

    Groups are the connected components of all verified pairs that share a sketch; equal texts are one text, and a null
    text is an empty one; a text without words is like no other. Repeated rows, and null doc_ids, keep their rows; a
    group of null doc_ids alone has a null class. Other columns are left out. An empty table stays empty.
    """
    return with_classes(docs).select("doc_id", "class_id", "n_class")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, the one with the smallest doc_id (null last; of rows with the
    same doc_id and text: one)."""
    # one key for the row's doc_id and text, by which the rows move once
    key = lambda doc: F.unhex(F.md5(F.concat(F.coalesce(doc.cast("long").cast("string"), F.lit("none")).cast("binary"), F.lit(" ").cast("binary"), F.col("id"))))
    made = scratch_count()
    c = with_classes(docs).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("id") == F.col("class_text")))
    kept = saved(c.select(key(F.col("doc_id")).alias("key")).distinct(), "kept")
    scratch_removed(spark, made, kept)  # sketches, words and links are no longer read when the rows move
    settled(spark)
    mine = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), text_id(F.col("text")).alias("id"))
    mine = mine.select("row", key(F.col("row")["doc_id"]).alias("key"))
    return mine.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
