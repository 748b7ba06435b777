"""Substring deduplication: paragraph MinHash banding (operator 6).

A text is cut into paragraphs in two ways, since a passage that repeats need not keep to line ends:

- lines of at least ``min_words`` words. They get MinHash values of their five-word shingles, in bands tuned for high
  recall at the threshold; lines that collide in a band are verified by the exact Jaccard similarity of their shingle
  sets, and the components of similar lines are classes;
- windows of half that length at places that the content chooses: of any ``min_words`` words in a row, the window whose
  first three words have the least hash. Wherever a passage of ``min_words`` words or more stands, inside a longer line
  or over several, one of the windows inside it is the same in every copy. Windows get a single band, which equal ones
  share for certain. Windows that collide across texts are verified exactly: every run of ``min_words`` words around
  them is compared with those of the other texts, and neighbouring runs that repeat are joined to one passage.

Of each class every occurrence but the first is removed. Texts that are equal as a whole are one text until the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, mix, removed, saved, scratch_path, settled, windows
from .links import bucket_classes, shared_buckets

K = 5
#: Values of the one band of a window, and the words whose hash chooses its place.
WINDOW_ROWS, ANCHOR = 4, 3
_SEEDS = np.random.default_rng(11).integers(1, 2**63, (80, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TOP = np.uint64(2**64 - 1)
LINE, WINDOW, TEXT = 0, 1, 2


def tuned_bands(threshold: float, recall: float = 0.9995, most: int = 16) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``most`` values that finds a pair at the threshold with
    probability ``recall``."""
    best = (most, 1)
    for rows in range(1, 9):
        bands = next((b for b in range(1, most // rows + 1) if 1 - (1 - threshold**rows) ** b >= recall), 0)
        if bands:
            best = (bands, rows)
    return best


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    v = (values ^ _SEEDS[seed, 1]) * _SEEDS[seed, 0]
    return v ^ (v >> np.uint64(32))


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of the ranges of ``sizes`` from ``starts``, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _line_ranges(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of words of the lines of at least ``least`` words."""
    line = np.searchsorted(np.flatnonzero(words.buf == 10), words.start)
    begin = np.flatnonzero(np.diff(line, prepend=-1))
    size = np.diff(np.append(begin, len(line)))
    return begin[size >= least], size[size >= least]


def window_places(h: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Where the windows of ``least // 2`` words begin, as indices of words (hashes ``h``; first: as in Words): the least
    of any ``least - least // 2 + 1`` places in a row, by the hash of the three words there, the first of equals. Of a
    streak of places that all begin with the same words, as in one word said again and again, each window's length one."""
    size = least // 2
    span = least - size + 1
    if len(h) < least:
        return np.zeros(0, np.int64)
    grams = np.full(len(h), _TOP)
    for at in range(ANCHOR):
        part = h[at : len(h) - ANCHOR + 1 + at]
        grams[: len(part)] = part if at == 0 else grams[: len(part)] * np.uint64(0x9E3779B97F4A7C15) + part
    low = np.uint64(0xFFFFFFFF)
    score = (mix(grams) & ~low) | (np.arange(len(h), dtype=np.uint64) & low)
    best, width = score, 1
    while 2 * width <= span:
        best = np.minimum(best[: len(best) - width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: len(best) - (span - width)], best[span - width :])
    text = np.searchsorted(first, np.arange(len(best)), side="right") - 1
    whole = np.flatnonzero(np.arange(len(best)) + least <= first[text + 1])
    chosen = np.zeros(len(h), bool)
    chosen[(best[whole] & low).astype(np.int64)] = True
    chosen = np.flatnonzero(chosen)
    # streaks
    again = np.zeros(len(chosen), bool)
    again[1:] = (np.diff(chosen) == 1) & (grams[chosen[1:]] == grams[chosen[:-1]])
    begin = np.maximum.accumulate(np.where(again, 0, np.arange(len(chosen))))
    return chosen[(np.arange(len(chosen)) - begin) % size == 0]


def _units(bands: int, rows: int, least: int):
    """Per text of ``least`` words or more: its lines (with an id of their words and a sketch), its windows (with their
    one band), and a row for the text itself."""
    size = least // 2
    names = ["doc_id", "tid", "t", "kind", "start", "n", "id", "keys"]

    def rows_of(part: pa.RecordBatch, text: np.ndarray, kind: int, start: np.ndarray, n: np.ndarray, ids: list | None, keys: np.ndarray) -> pa.RecordBatch:
        at = pa.array(text)
        whole = [part.column(c).take(at) for c in ("doc_id", "tid")] if kind == TEXT else [pa.nulls(len(text), k) for k in (pa.int64(), pa.binary())]
        ends = pa.array(np.arange(len(text) + 1) * keys.shape[1], pa.int32())
        columns = [*whole, part.column("t").take(at), pa.array(np.full(len(text), kind, np.int32)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))]
        columns += [pa.array(ids, pa.binary()) if ids is not None else pa.nulls(len(text), pa.binary()), pa.ListArray.from_arrays(ends, pa.array(keys.view(np.int64).ravel(), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = Words(part.column("text").to_pylist())
                h = words.hashes()
                long = np.flatnonzero(words.n >= least)
                if not len(long):
                    continue
                yield rows_of(part, long, TEXT, np.zeros(len(long), np.int64), words.n[long], None, np.zeros((len(long), 0), np.uint64))
                grams = np.zeros(len(h), np.uint64)
                for i in range(K):
                    grams[: len(h) - K + 1] = grams[: len(h) - K + 1] * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - K + 1 + i]
                grams = mix(grams)
                text_of = lambda x: np.searchsorted(words.first, x, side="right") - 1
                begin, n = _line_ranges(words, least)
                if len(begin):
                    flat, starts = grams[_flat(begin, n - K + 1)], np.cumsum(n - K + 1) - (n - K + 1)
                    keys = np.zeros((len(begin), bands), np.uint64)
                    for j in range(bands * rows):
                        keys[:, j // rows] = mix(keys[:, j // rows] * np.uint64(31) + np.minimum.reduceat(_mixed(flat, j), starts) + np.uint64(j + 1))
                    data = memoryview(h.tobytes())
                    ids = [hashlib.md5(data[8 * i : 8 * (i + m)]).digest() for i, m in zip(begin.tolist(), n.tolist(), strict=True)]
                    text = text_of(begin)
                    yield rows_of(part, text, LINE, begin - words.first[text], n, ids, keys)
                begin = window_places(h, words.first, least)
                for i in range(0, len(begin), 50_000):
                    some = begin[i : i + 50_000]
                    flat, key = grams[some[:, None] + np.arange(size - K + 1)], np.zeros(len(some), np.uint64)
                    for j in range(WINDOW_ROWS):
                        key = mix(key * np.uint64(31) + _mixed(flat, j).min(axis=1) + np.uint64(j + 1))
                    text = text_of(some)
                    yield rows_of(part, text, WINDOW, some - words.first[text], np.full(len(some), size), None, key[:, None])

    return run, "doc_id long, tid binary, t long, kind int, start int, n int, id binary, keys array<long>"


def _looked_up(least: int):
    """Of each text (t, low, text, starts of windows, lines as id, start, n): the shingle sets of the lines, and the hashes
    of all runs of ``least`` words that reach over one of the windows."""
    size = least // 2

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                words = Words(part.column("text").to_pylist())
                h = words.hashes()
                grams, place = windows(h, words.first, K)
                run_hash, run_at = windows(h, words.first, least)
                lines, runs = [], []
                for i, (starts, asked) in enumerate(zip(part.column("starts").to_pylist(), part.column("lines").to_pylist(), strict=True)):
                    base = int(words.first[i])
                    for x in asked or ():
                        low, high = np.searchsorted(place, [base + x["start"], base + x["start"] + x["n"] - K + 1])
                        lines.append((x["id"], np.unique(grams[low:high]).tobytes()))
                    if starts:
                        spots = np.unique((base + np.array(starts)[:, None] - np.arange(least - size + 1)).ravel())
                        low = np.searchsorted(run_at, spots)
                        low = low[low < len(run_at)]
                        low = np.unique(low[(run_at[low] >= base) & (run_at[low] < words.first[i + 1])])
                        runs.append((i, low, run_at[low] - base))
                if lines:
                    ids, blobs = zip(*lines, strict=True)
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, LINE, np.int32)), pa.array(ids, pa.binary()), pa.array(blobs, pa.binary()), *[pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int64())]], names)
                if runs:
                    text = pa.array(np.repeat([i for i, _, _ in runs], [len(low) for _, low, _ in runs]))
                    low, pos = np.concatenate([x[1] for x in runs]), np.concatenate([x[2] for x in runs])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(low), WINDOW, np.int32)), *[pa.nulls(len(low), pa.binary())] * 2, part.column("t").take(text), part.column("low").take(text), pa.array(pos.astype(np.int32)), pa.array(run_hash[low].view(np.int64))], names)

    names = ["kind", "id", "blob", "t", "low", "pos", "h"]
    return run, "kind int, id binary, blob binary, t long, low long, pos int, h long"


def jaccard(x: bytes, y: bytes) -> float:
    """Of two sorted sets of 64-bit hashes."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _kinds(df: DataFrame, name: str, *kinds: int) -> tuple[str, list[DataFrame]]:
    """``df``, saved by its column ``kind``: the folder, the rows of each of ``kinds``."""
    path, spark = scratch_path(df.sparkSession, name), df.sparkSession
    df.write.partitionBy("kind").parquet(path)
    both = spark.read.schema(df.schema).parquet(path)
    return path, [both.where(F.col("kind") == k).drop("kind") for k in kinds]


def text_id(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def _place(start: str) -> Column:
    """An occurrence, in the order that decides which is the first: doc_id (null last), text, word."""
    return F.struct(F.col("low").isNull().alias("none"), "low", "t", F.col(start).alias("start"))


def repeats(docs: DataFrame, threshold: float = 0.8, min_words: int = 50) -> DataFrame:
    """doc_id, tid (of the text: its MD5), kind ("line", "passage" or "text"), start, n_words (in words from 0),
    first_doc_id, first_start, n_occurrences, removed. See :func:`repeated_paragraphs`. Saved.

    On the way texts go by ``t``, a 64-bit hash of their MD5, with the smallest doc_id of their rows (``low``)."""
    spark = docs.sparkSession
    bands, rows = tuned_bands(threshold)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tid", text_id(F.col("text"))).withColumn("t", F.xxhash64("tid"))
    units, schema = _units(bands, rows, min_words)
    path, (lines, spots, whole) = _kinds(keyed.mapInArrow(units, schema), "units", LINE, WINDOW, TEXT)
    texts = saved(whole.groupBy("tid").agg(F.min("doc_id").alias("low"), F.first("t").alias("t"), F.count("*").alias("copies"), F.first("n").alias("n_words")), "texts")

    # windows that stand in two different texts
    spots = spots.select("t", "start", F.col("keys")[0].alias("key"))
    common = spots.groupBy("key").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("key")
    common = saved(common, "common-windows")  # apart, so that Spark can split the windows of a hot passage in the join
    starts = spots.join(common, "key", "left_semi").groupBy("t").agg(F.collect_set("start").alias("starts"))

    # lines that share a band with another
    lines = lines.select("t", "start", "n", "id", "keys")
    one = saved(lines.groupBy("id").agg(F.min(F.struct("t", "start", "n")).alias("at"), F.first("keys").alias("keys")), "line-sketches")
    buckets = shared_buckets(one.select("id", F.posexplode("keys").alias("band", "key")))
    of_text = one.join(buckets.select("id").distinct(), "id", "left_semi").groupBy("at.t").agg(F.collect_list(F.struct("id", "at.start", "at.n")).alias("lines"))

    asked = saved(starts.join(of_text, "t", "full").join(texts.select("t", F.col("tid").alias("want"), "low"), "t"), "asked")
    removed(spark, f"{path}/kind={WINDOW}")
    settled(spark)
    found, schema = _looked_up(min_words)
    reread = keyed.drop("t").join(asked, (F.col("tid") == F.col("want")) & F.col("doc_id").eqNullSafe(F.col("low")))
    _, (sets, runs) = _kinds(reread.select("t", "low", "text", "starts", "lines").mapInArrow(found, schema), "looked-up", LINE, WINDOW)
    settled(spark)

    # lines: the components of similar ones; a line that only equal ones repeat in other texts is left to the passages
    sets = saved(sets.select("id", "blob").dropDuplicates(["id"]), "shingles")
    roots = bucket_classes(buckets, sets, lambda x, y: jaccard(x, y) >= threshold, lambda x: np.frombuffer(x, np.uint64), lambda c, a, b: c >= threshold * (a + b - c) - 1e-3)
    placed = lines.select("t", "start", "n", "id").dropDuplicates(["t", "start"]).join(texts.select("t", "low"), "t")
    counts = placed.groupBy("id").agg(F.min(_place("start")).alias("first"), F.min("t").alias("a"), F.max("t").alias("b"), F.count("*").alias("n"))
    counts = counts.join(roots, counts["id"] == roots["node"], "left").select("id", "n", "first", "a", "b", F.coalesce("root", "id").alias("root"))
    classes = counts.groupBy("root").agg(F.sum("n").alias("n_occurrences"), F.min("first").alias("first"), F.count("*").alias("m"), F.min("a").alias("a"), F.max("b").alias("b"))
    classes = classes.where("m > 1 or a = b and n_occurrences > 1").select("root", "n_occurrences", "first")
    of_id = counts.select("id", "root").join(classes, "root").select("id", "n_occurrences", "first")
    line_rows = placed.join(of_id, "id").select("t", "low", F.lit("line").alias("kind"), "start", F.col("n").alias("n_words"), F.col("first.t").alias("ft"), F.col("first.low").alias("fl"), F.col("first.start").alias("fs"), "n_occurrences")
    line_rows = saved(line_rows, "line-rows")
    settled(spark)

    # passages: neighbouring runs whose first occurrences are neighbours as well
    runs = runs.select("t", "low", "pos", "h")
    twice = runs.groupBy("h").agg(F.min(_place("pos")).alias("first"), F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b")
    twice = saved(twice.select("h", F.col("first.low").alias("fl"), F.col("first.t").alias("ft"), F.col("first.start").alias("fs"), "n"), "repeated-runs")
    settled(spark)
    hit = runs.join(twice, "h")
    hit = hit.select("t", "low", "pos", "n", "fl", "ft", (F.col("fs") - F.col("pos")).alias("shift"))
    island = F.col("pos") - F.row_number().over(Window.partitionBy("t", "low", "ft", "fl", "shift").orderBy("pos"))
    hit = hit.withColumn("island", island).groupBy("t", "low", "ft", "fl", "shift", "island").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + min_words).alias("n_words"), F.max("n").alias("n_occurrences"))
    passage_rows = hit.select("t", "low", F.lit("passage").alias("kind"), "start", "n_words", "ft", "fl", (F.col("start") + F.col("shift")).cast("int").alias("fs"), "n_occurrences")

    same = (F.col("ft") == F.col("t")) & F.col("fl").eqNullSafe(F.col("low")) & (F.col("fs") == F.col("start"))
    columns = ["doc_id", "tid", "kind", "start", "n_words", "first_doc_id", "first_start", "n_occurrences", "removed"]
    of_t = texts.select(F.col("t").alias("_t"), F.col("low").alias("_low"), "tid")
    parts = line_rows.unionByName(passage_rows).join(of_t, (F.col("t") == F.col("_t")) & F.col("low").eqNullSafe(F.col("_low")))
    parts = parts.select(F.col("low").alias("doc_id"), "tid", "kind", "start", "n_words", F.col("fl").alias("first_doc_id"), F.col("fs").alias("first_start"), "n_occurrences", (~same).alias("removed"))
    copied = whole.select("doc_id", "tid").join(texts.where("copies > 1"), "tid")
    copied = copied.select("doc_id", "tid", F.lit("text").alias("kind"), F.lit(0).alias("start"), "n_words", F.col("low").alias("first_doc_id"), F.lit(0).alias("first_start"), F.col("copies").alias("n_occurrences"), (~F.col("doc_id").eqNullSafe(F.col("low"))).alias("removed"))
    return saved(parts.select(*columns).unionByName(copied), "repeats")


def repeated_paragraphs(docs: DataFrame, threshold: float = 0.8, min_words: int = 50) -> DataFrame:
    """One row per stretch of a document that repeats: doc_id, kind, start, n_words (words from 0), first_doc_id,
    first_start (of its class's first occurrence, by doc_id and place), n_occurrences, removed (all but the first).

    kind "text": the document's whole text of ``min_words`` words or more stands in other rows too; only the first row's
    document has the other kinds. kind "passage": ``min_words`` words or more in a row stand word for word in another
    text, all with the same first occurrence (n_occurrences: of its most frequent run). kind "line": a line of ``min_words``
    words or more that is similar to another one, or repeats inside the text. n_occurrences counts equal texts once, but for
    kind "text". Null and short texts have no rows. A row
    that equals the first occurrence's in doc_id and text is not removed. Null doc_ids come last. Other columns are left
    out; an empty table gives an empty result."""
    return repeats(docs, threshold, min_words).drop("tid")


def _cut(text: str, ranges: list[int]) -> str:
    """``text`` without the words of the ranges (start, end, start, end ...), each with the white space after it."""
    words = Words([text])
    n, data = len(words.start), text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    for start, end in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        low, high = int(words.start[start]), int(words.start[end]) if end < n else len(data)
        if low > at:
            out.append(data[at:low])
        at = max(at, high)
    kept = b"".join(out) + data[at:]
    return (kept.rstrip(b" \t\n\v\f\r") if at >= len(data) else kept).decode("utf-8", "surrogatepass")


def cut_paragraphs(docs: DataFrame, threshold: float = 0.8, min_words: int = 50) -> DataFrame:
    """``docs`` without the removed stretches (all columns; a changed text's n_chars is counted anew where there is such
    a column). A document that had words and has none left goes."""
    gone = repeats(docs, threshold, min_words).where("removed")
    names = {c.lower() for c in docs.columns}
    own = lambda name: name if name not in names else own(name + "_")
    doc, tid, cut, mine = own("_doc"), own("_tid"), own("_gone"), own("_mine")
    gone = gone.groupBy(F.col("doc_id").alias(doc), F.col("tid").alias(tid)).agg(F.flatten(F.collect_list(F.array("start", F.col("start") + F.col("n_words")))).alias(cut))

    @F.pandas_udf("string")
    def left(text: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([None if r is None else _cut(t, list(r)) for t, r in zip(text, ranges, strict=True)], dtype=object)

    keyed = docs.withColumn(mine, text_id(F.col("text")))
    out = keyed.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(mine) == F.col(tid)), "left")
    changed = F.col(cut).isNotNull()
    # texts that stay as they are do not go through Python
    out = out.withColumn(mine, left(F.when(changed, F.col("text").cast("string")), cut))
    out = out.where(~changed | F.col(mine).rlike(r"[^\x20\x09-\x0D]")).withColumn("text", F.when(changed, F.col(mine)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def cut_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: passages that repeat stay in one document only."""
    return cut_paragraphs(docs)


__all__ = ["cut_paragraphs", "cut_stage", "jaccard", "repeated_paragraphs", "repeats", "tuned_bands", "window_places"]
