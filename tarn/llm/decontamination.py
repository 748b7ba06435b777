"""Benchmark decontamination by template canonicalisation (operator 9).

Numbers, names and units become typed placeholders; runs of eight template words are hashed and joined with those
of the benchmark. Slots say what stood at each placeholder: along one chain of windows of a document and an item, which words put in or left out do not end, every
value of the item must always stand for the same value of the document and the other way round, so a
re-parameterised question is caught and a chance meeting of templates is not.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, saved, table, windows

W = 8
#: Template windows with fewer literal words than this say nothing; they are compared by their exact values.
LITERALS = 3
#: Bits of the sieve of benchmark windows that all tasks get: of fixed size (2 MB), whatever the size of the benchmark. It
#: only spares windows the shuffle; the join decides.
SIEVE_BITS = 24
NUMBER, NAME, UNIT = np.uint64(0xA11), np.uint64(0xB22), np.uint64(0xC33)
UNITS = "mm cm dm m km in ft yd mi mg g kg t oz lb lbs ml cl l gal s sec min h hr hrs day days week weeks month months year years hz khz mhz ghz b kb mb gb tb w kw mw v kv a ma j kj cal kcal k c f pa kpa mpa bar usd eur gbp dollar dollars euro euros cent cents percent degrees".split()
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 58, 63]] = True


class Template(Words):
    """Words without punctuation at their ends, in lower case, with placeholders: ``template`` and ``value`` hashes."""

    def __init__(self, texts):
        super().__init__(texts)
        buf = self.buf.copy()
        last = buf[self.end - 1] if len(self.end) else np.zeros(0, np.uint8)
        line = np.zeros(len(self.start), bool)
        inside = self.start > 0
        line[inside] = buf[self.start[inside] - 1] == 10
        opens = line.copy()
        opens[1:] |= _ENDS[last[:-1]]
        opens[self.first[:-1][self.n > 0]] = True
        # all punctuation at either end goes; a word of nothing else is none
        inner = np.append(np.flatnonzero(~_PUNCT[buf]), len(buf))
        self.start, self.end = np.minimum(inner[np.searchsorted(inner, self.start)], self.end), inner[np.maximum(np.searchsorted(inner, self.end) - 1, 0)] + 1
        full = self.start < self.end
        first_text = np.searchsorted(self.first, np.arange(len(full)), side="right") - 1
        self.start, self.end, opens = self.start[full], self.end[full], opens[full]
        self.first = np.searchsorted(first_text[full], np.arange(len(self.n) + 1))
        self.n = np.diff(self.first)
        one = buf[self.start]
        two = buf[np.minimum(self.start + 1, len(buf) - 1)]
        capital = (one >= 65) & (one <= 90) | (one == 0xC3) & (two >= 0x80) & (two <= 0x9E)
        digits = np.concatenate(([0], np.cumsum(_DIGIT[buf])))
        number = digits[self.end] > digits[self.start]
        wide = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)) + 1
        buf[wide] += 32
        self.buf = LOWER[buf]
        self.value = self.hashes()
        # a unit follows a number: "3 a" is ampere, "a box" is not
        unit = np.isin(self.value, _unit_hashes())
        unit[1:] &= number[:-1]
        unit[:1] = False
        unit[self.first[:-1][self.n > 0]] = False
        self.template = np.where(number, NUMBER, np.where(capital & ~opens, NAME, np.where(unit, UNIT, self.value)))
        self.slot = number | (capital & ~opens) | unit
        self.opening = capital & opens & ~number  # may be a name as well


def _unit_hashes() -> np.ndarray:
    return Words([" ".join(UNITS)]).hashes()


def _windows_of(size: int, key: str, wanted: np.ndarray | None):
    """Template windows of ``size`` words: key, at, hash, slots (values at placeholders, in order)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                t = Template(part.column("text").to_pylist())
                full, begin = windows(t.template, t.first, size)
                count = lambda x: np.concatenate(([0], np.cumsum(x)))
                within = lambda c, b: c[b + size] - c[b]
                kept = within(count(~t.slot), begin) >= min(LITERALS, size)
                n_kept = np.bincount(np.searchsorted(t.first, begin[kept], side="right") - 1, minlength=len(t.n))
                # as templates; with sentence-opening words as names; windows of few literal words by their exact values
                also = t.slot | t.opening
                named = (within(count(t.opening), begin) > 0) & (within(count(~also), begin) >= min(LITERALS, size))
                ways = [
                    (0, full, kept, t.slot),
                    (1, windows(np.where(t.opening, NAME, t.template), t.first, size)[0], named, also),
                    (2, ~windows(t.value, t.first, size)[0], ~kept, np.ones_like(t.slot)),  # never the hash of a template
                ]
                for way, h, keep, slots in ways:
                    if wanted is not None:
                        spot = h >> np.uint64(64 - SIEVE_BITS)
                        keep = keep & (wanted[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1) == 1)
                    h, at_ = h[keep], begin[keep]
                    if not len(h):
                        continue
                    text = np.searchsorted(t.first, at_, side="right") - 1
                    places = at_[:, None] + np.arange(size)
                    slot = slots[places]
                    ends = pa.array(np.concatenate(([0], slot.sum(axis=1).cumsum())), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key").take(pa.array(text)), pa.array(at_ - t.first[text], pa.int64()), pa.array(h.view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(t.value[places][slot].view(np.int64))), pa.array(t.n[text], pa.int64()), pa.array(n_kept[text], pa.int64()), pa.array(np.full(len(h), way), pa.int64())],
                        ["key", "at", "hash", "slots", "n_words", "n_kept", "way"],
                    )

    return run, f"{key} long, at long, hash long, slots array<long>, n_words long, n_kept long, way long"


def chain(hits: list, gap: int) -> tuple[int, int, bool]:
    """(windows, those of them that are kept as templates, verbatim) of the best chain of hits (item_at, at, item_slots,
    slots, way): rising in both places, no shift
    further than ``gap`` from the chain's main one, every value standing for one value throughout. The windows of the
    main shift come first and must all agree, but for those by another way; the others follow by their distance from it, if they agree with the chain."""
    shifts: dict = {}
    for h in sorted(hits, key=lambda h: (h[4], h[0])):
        shifts.setdefault(h[1] - h[0], []).append(h)
    best = (0, 0, False)
    most = len({h[0] for h in hits}), len({h[0] for h in hits if h[4] < 2}), True
    for main in sorted(shifts, key=lambda s: (-len(shifts[s]), s)):
        there, back, places, ats, torn, kept = {}, {}, [], [], False, 0
        for shift in sorted((s for s in range(main - gap, main + gap + 1) if s in shifts), key=lambda s: (abs(s - main), s)):
            for item_at, at, theirs, mine, way in shifts[shift]:
                i = bisect_left(places, item_at)
                if i < len(places) and (places[i] == item_at or ats[i] <= at) or i and ats[i - 1] >= at:
                    continue
                new, old = dict(zip(theirs, mine, strict=True)), dict(zip(mine, theirs, strict=True))
                if any(there.get(x, y) != y or back.get(y, x) != x or new[x] != y or old[y] != x for x, y in zip(theirs, mine, strict=True)):
                    torn |= shift == main and way == 0
                    continue
                there |= new
                back |= old
                places.insert(i, item_at)
                ats.insert(i, at)
                kept += way < 2
        if not torn:
            best = max(best, (len(places), kept, all(x == y for x, y in there.items())))
            if best >= most:
                break
    return best


def _chains(frames):
    for f in frames:
        found = [chain([(h["item_at"], h["at"], list(h["item_slots"]), list(h["slots"]), h["way"]) for h in hits], max(2, int(w) // 8)) for hits, w in zip(f["hits"], f["w"], strict=True)]
        yield f[["doc_id", "item_id", "w"]].assign(n_windows=[x[0] for x in found], n_kept=[x[1] for x in found], verbatim=[x[2] for x in found])


def _table(df: DataFrame, key: str, size: int, wanted: np.ndarray | None = None) -> DataFrame:
    run, schema = _windows_of(size, "key", wanted)
    return df.select(F.col(key).cast("long").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _sieve(windows_of_items: DataFrame) -> np.ndarray:
    """A bit for each value of the first SIEVE_BITS bits of the windows' hashes: at most 2 ** (SIEVE_BITS - 6) numbers."""
    spot = F.shiftrightunsigned("hash", 64 - SIEVE_BITS)
    words = windows_of_items.select(F.shiftright(spot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - SIEVE_BITS}) & 63 as int))").alias("bit"))
    out = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
    for r in words.groupBy("at").agg(F.expr("bit_or(bit)").alias("bits")).collect():
        out[r["at"]] = r["bits"]
    return out.view(np.uint64)


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.5) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, n_windows (of the item's that were
    found along its best chain), share (of the item's distinct windows, or of
    those with three literal words if that is more), verbatim (all slots equal).

    A document holds an item if at least ``share`` of its windows lie on one chain with consistent slots; each word put in or
    left out costs up to seven windows, so an item of under 21 words can still be lost by one in its middle. Items
    of fewer than eight words are compared as a whole, if they have three words (fewer are found by chance in any text). Items with the same text are
    looked for once; each has its row. Null texts have no words; rows with the same doc_id count as one document; null
    doc_ids as well. Empty tables give an empty result. Other columns are left out.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    twins = items
    items = saved(items.groupBy("text").agg(F.min("item_id").alias("item_id")), "items")
    twins = twins.join(items.withColumnRenamed("item_id", "one"), "text").select("one", "item_id").distinct()
    sizes = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w.rlike("[^!-/:-@\\[-`{-~]")))
    short = sorted(r[0] for r in items.select(sizes.alias("n")).where(f"n < {W} and n >= {LITERALS}").distinct().collect())  # at most W sizes
    found = []
    for size in [W, *short]:
        theirs = _table(items, "item_id", size).where(F.col("n_words") == size if size < W else F.lit(True))
        # a window that an item repeats counts once, where it stands first: so a document has no more hits than windows
        theirs = theirs.groupBy(F.col("key").alias("item_id"), "hash", "way").agg(F.min(F.struct("at", "slots")).alias("m"), F.max("n_words").alias("item_words"))
        theirs = saved(theirs.select("item_id", F.col("m.at").alias("item_at"), "hash", F.col("m.slots").alias("item_slots"), "item_words", "way"), "item-windows")
        totals = theirs.groupBy("item_id").agg(F.count_if(F.col("way") != 1).alias("every"), F.count_if(F.col("way") == 0).alias("k"))
        wanted = _sieve(theirs)
        mine = _table(docs, "doc_id", size, wanted).select(F.col("key").alias("doc_id"), "at", "hash", "slots")
        met = mine.join(theirs, "hash")
        hit = F.struct("item_at", "at", "item_slots", "slots", "way").alias("hit")
        pairs = met.groupBy("doc_id", "item_id").agg(F.max("item_words").alias("w"), F.collect_set(hit).alias("hits"))
        lined = pairs.mapInPandas(_chains, "doc_id long, item_id long, w long, n_windows long, n_kept long, verbatim boolean").join(totals, "item_id")
        # of all windows, or of those kept as templates (of four at least, as far as there are)
        part = F.least(F.lit(1.0), F.greatest(F.col("n_windows") / F.col("every"), F.col("n_kept") / F.greatest("k", F.least("every", F.lit(4)))))
        found.append(lined.withColumn("share", part).where(F.col("share") >= share))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "share", "verbatim")).alias("m"))
    best = best.withColumnRenamed("item_id", "one").join(twins, "one")
    return best.select("doc_id", "item_id", "m.n_windows", F.round("m.share", 6).alias("share"), "m.verbatim")


def decontaminate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go."""
    bad = contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti").select(*docs.columns)


__all__ = ["Template", "contaminated", "decontaminate_stage"]
