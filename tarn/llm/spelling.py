"""Spelling variants by pivotal grams (operator 12).

Words are near if one code point inserted, deleted or replaced makes one the other. All bigrams of a word are ordered by
how many words hold them, rarest first; the first three are its prefix, and dynamic programming picks two disjoint ones of
the prefix with the smallest sum of frequencies, its pivots. One edit spoils one pivot at most, and the word whose prefix
ends earlier in the order has both its pivots' places in the other's prefix: so of every near pair one word's pivot is in
the other's prefix. The edit lies before the pivot or after it, so one side of the word is left as it is, and the place
moves by the difference of the lengths at most: pivots meet prefixes on that untouched side and the length. A
Levenshtein distance of one verifies the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, saved_with_mark

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that are compared have so many code points and occurrences; a form has so many times the word's occurrences.
LEAST_CHARS, LEAST_COUNT, TIMES = 6, 5, 5
#: After an edit the gram's place may move by one; a prefix holds one gram more than an edit can spoil (two).
EDITS, PREFIX = 1, 3


def slipped(doc_id: Column, word: Column, every: int = 199) -> Column:
    """``word``, less one code point in about one of ``every`` documents that hold it: with h = crc32("<doc_id>:<word>"),
    where ``every`` divides h, the code point at h % length is left out. A null doc_id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def count_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): letter runs of whole texts, A-Z lowered, slipped, with at least so many code points and occurrences.
    A null or empty text has none; repeated rows count each time; columns other than doc_id and text are left out."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(LETTERS), 0)).alias("run"))
    words = runs.select(slipped(F.col("doc_id"), F.translate("run", UPPER, LOWER)).alias("word"))
    return words.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _grams(word: str = "word") -> Column:
    """Array of (gram, pos) of a word, pos from 0."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    pairs = F.transform(chars, lambda c, i: F.struct(F.concat(c, F.coalesce(F.get(chars, i + 1), F.lit(""))).alias("gram"), i.alias("pos")))
    return F.slice(pairs, 1, F.greatest(F.size(pairs) - 1, F.lit(0)))


def _pivots(prefix: str) -> Column:
    """The two disjoint grams of smallest summed frequency. By place, from the left: the cheapest gram so far (one), the
    cheapest that doesn't touch the gram in hand (clear), the cheapest two disjoint ones (both)."""
    gram = "struct<n: bigint, pos: int>"
    start = f"named_struct('last', -9, 'one', cast(null as {gram}), 'clear', cast(null as {gram}), 'both', cast(null as struct<n: bigint, first: int, second: int>))"
    partner = "if(x.pos - acc.last >= 2, acc.one, acc.clear)"
    step = f"""named_struct('last', x.pos, 'one', least(acc.one, named_struct('n', x.n, 'pos', x.pos)), 'clear', acc.one,
        'both', least(acc.both, if({partner} is null, null, named_struct('n', x.n + {partner}.n, 'first', {partner}.pos, 'second', x.pos))))"""
    by_place = f"array_sort({prefix}, (p, q) -> p.pos - q.pos)"
    return F.expr(f"aggregate({by_place}, {start}, (acc, x) -> {step}, acc -> array(acc.both.first, acc.both.second))")


def pivots_and_prefixes(words: DataFrame) -> DataFrame:
    """(word, pivots: array of places, prefix: array of (n, gram, pos)), for words of four code points or more.

    Grams equal to the last of the prefix belong to it too, so the order of equal grams does not matter. The table of
    grams has at most 90 x 90 rows, as words are made of 90 letters: it is broadcast.
    """
    grams = words.select("word", F.explode(_grams()).alias("g")).select("word", "g.gram", "g.pos")
    counts = grams.select("word", "gram").distinct().groupBy("gram").agg(F.count("*").alias("n"))
    of = grams.join(F.broadcast(counts), "gram").groupBy("word").agg(F.sort_array(F.collect_list(F.struct("n", "gram", "pos"))).alias("all"))
    last = F.get("all", F.lit(PREFIX - 1))
    of = of.select("word", F.filter("all", lambda x: F.struct(x["n"], x["gram"]) <= F.struct(last["n"], last["gram"])).alias("prefix"))
    return of.select("word", "prefix", _pivots("prefix").alias("pivots"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of ``words`` (word, distinct, four code points or more) with one edit between them."""
    of = saved(pivots_and_prefixes(words), "pivots").withColumn("size", F.length("word"))
    # the side that an edit leaves as it is: up to and with the gram, or from the gram on
    sides = lambda p: F.array(F.struct(F.lit(0).alias("side"), F.substr("word", F.lit(1), p + 2).alias("same")), F.struct(F.lit(1).alias("side"), F.substr("word", p + 1).alias("same")))
    mine = of.select("word", "size", F.explode("pivots").alias("pos")).select("word", "size", F.explode(sides(F.col("pos"))).alias("s"))
    mine = mine.select(F.col("word").alias("v"), "s.side", "s.same", F.explode(F.sequence(F.col("size") - EDITS, F.col("size") + EDITS)).alias("size"))
    theirs = of.select("word", "size", F.explode(F.array_distinct(F.transform("prefix", lambda x: x["pos"]))).alias("pos"))
    theirs = theirs.select(F.col("word").alias("w"), "size", F.explode(sides(F.col("pos"))).alias("s")).select("w", "size", "s.side", "s.same")
    met = mine.join(theirs, ["side", "same", "size"]).where((F.col("v") != F.col("w")) & (F.levenshtein("v", "w", EDITS) == EDITS))
    return met.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): follow forms to the last. Every round doubles the steps taken; as a form
    is TIMES as frequent as its word, there are few."""
    at, n, mark = saved_with_mark(forms.select("word", F.col("form").alias("root")), "forms")
    while n:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at, n, now = saved_with_mark(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
        if now == mark:
            break
        mark = now
    return at


def spelling_variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row per word of the documents (see :func:`count_words`): word, form, root, n, n_near, form_n.

    form: the near word of largest n (ties: smallest in code-point order), if it has TIMES as many occurrences as the
    word, else null; form_n is its n. root: the last of the chain of forms, the word itself if it has no form. n_near is
    the number of near words, 0 if none. Empty tables, and texts without letters, give no rows.
    """
    words = saved(count_words(docs, least_chars, least_count), "words")
    pairs = saved(near_pairs(words.select("word")), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("form_n")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "other")).alias("best"))
    of = words.join(best, "word", "left").withColumn("found", -F.col("best.less") >= TIMES * F.col("n"))
    of = saved(of.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.expr("if(found, best.other, null)").alias("form"), F.expr("if(found, -best.less, null)").alias("form_n")), "variants")
    roots = last_forms(of.where("form is not null"))
    return of.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
