"""Ranked search over an inverted index of several fields.

The index is a folder of tables: ``postings`` (term, field, hits: id, size and positions in some rows), partitioned by a hash of the term and
sorted by term, so a search reads the partitions, and of these the row groups, of its own terms; ``rows`` (id and the
structural columns); ``stats`` (one row). It is built once and serves any number of searches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters without their marks, as the tokenizer sees them.
MARKED, BARE = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, without diacritics of Latin letters."""
    folded = F.translate(F.lower(F.coalesce(text.cast("string"), F.lit(""))), MARKED, BARE)
    return F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: w != "")


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame
    rows: DataFrame
    docs: int
    mean: float
    buckets: int
    fields: tuple[str, ...]


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build_index(df: DataFrame, ident: str, fields: dict[str, Column], path: str, structural: dict[str, Column] | None = None, buckets: int = 64) -> TextIndex:
    """Writes the index of ``fields`` (name: text column) of ``df`` to ``path``, which must not exist, and opens it.

    A null field is empty; ``ident`` must be unique. The hits of a term in a batch of rows are one row from where the text is
    read, so a term moves once a batch. The postings of one frequent term are dealt over several tasks, as a term may be in every row.
    """
    of = df.select(F.col(ident).alias("id"), F.array(*[F.struct(F.lit(n).alias("field"), tokens(c).alias("w")) for n, c in fields.items()]).alias("f"))
    of = of.withColumn("size", F.aggregate("f", F.lit(0), lambda s, x: s + F.size(x["w"])))
    kind = dict(of.dtypes)["id"]
    words = of.select("id", "size", F.explode("f").alias("f")).select("id", "size", "f.field", "f.w")
    postings = words.mapInArrow(_postings, f"term string, field string, hits array<struct<id: {kind}, size: int, positions: array<int>>>")
    postings = postings.withColumn("bucket", _bucket(F.col("term"), buckets))
    deal = F.pmod(F.xxhash64(F.get("hits", F.lit(0))["id"]), F.lit(8))
    postings.repartition("bucket", deal).sortWithinPartitions("bucket", "term", "field").write.partitionBy("bucket").parquet(f"{path}/postings")
    df.select(F.col(ident).alias("id"), *[c.alias(n) for n, c in (structural or {}).items()]).write.parquet(f"{path}/rows")
    facts = of.agg(F.count("*").alias("docs"), F.avg("size").alias("mean"), F.lit(buckets).alias("buckets"), F.lit(",".join(fields)).alias("fields"))
    facts.coalesce(1).write.parquet(f"{path}/stats")  # last, so it marks a complete index
    return open_index(df.sparkSession, path)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (id, size, field, w: the field's terms) to a row for each term and field of a batch, with its hits."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            words = part.column("w")
            n = words.value_lengths().to_numpy()
            row = np.repeat(np.arange(part.num_rows), n)
            place = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            terms, fields = words.flatten().dictionary_encode(), part.column("field").dictionary_encode()
            key = terms.indices.to_numpy().astype(np.int64) * len(fields.dictionary) + fields.indices.to_numpy()[row]
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            hit = new.copy()
            hit[1:] |= row[1:] != row[:-1]
            hits = np.flatnonzero(hit)
            first = np.flatnonzero(new)
            ends = lambda starts, size: pa.array(np.append(starts, size), pa.int32())
            positions = pa.ListArray.from_arrays(ends(hits, len(key)), pa.array(place[order], pa.int32()))
            of = pa.array(row[hits])
            struct = pa.StructArray.from_arrays([part.column("id").take(of), part.column("size").take(of), positions], ["id", "size", "positions"])
            lists = pa.ListArray.from_arrays(ends(np.searchsorted(hits, first), len(hits)), struct)
            of_term, of_field = np.divmod(key[first], max(len(fields.dictionary), 1))
            yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(of_term)), fields.dictionary.take(pa.array(of_field)), lists], ["term", "field", "hits"])


def open_index(spark: SparkSession, path: str) -> TextIndex:
    facts = spark.read.parquet(f"{path}/stats").first()  # one row
    postings = spark.read.parquet(f"{path}/postings").select("bucket", "term", "field", F.inline("hits"))
    return TextIndex(postings, spark.read.parquet(f"{path}/rows"), facts["docs"], facts["mean"] or 1.0, facts["buckets"], tuple(facts["fields"].split(",")))


def query_phrases(spark: SparkSession, query: str) -> list[list[str]]:
    """The words of a query, each as its tokens: a word of several is a phrase, its tokens in a row."""
    row = spark.range(1).select(F.transform(F.filter(F.split(F.lit(query), r"\s+"), lambda x: x != ""), tokens).alias("p")).first()
    return [p for p in row["p"] if p]


def search(index: TextIndex, query: str, k: int = 50, fields: list[str] | None = None, where: Column | str | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The ``k`` best rows that hold every word of ``query`` in any of ``fields`` (default: all): id, score (BM25 of the
    hits in all fields together, the rarity of a word being that of its phrase in these fields), matched_fields (sorted),
    in order of score, then id. ``where`` on structural columns holds before the limit, and doesn't change the rarities."""
    spark = index.postings.sparkSession
    unknown = set(fields or ()) - set(index.fields)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    phrases = query_phrases(spark, query)
    if not phrases:
        raise ValueError("a query needs a word")
    terms = sorted({w for p in phrases for w in p})
    # the partitions of the terms' hashes, known before the scan
    buckets = [r[0] for r in spark.createDataFrame([(w,) for w in terms], "w string").select(_bucket(F.col("w"), index.buckets)).distinct().collect()]
    found = index.postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    if fields:
        found = found.where(F.col("field").isin(list(fields)))
    place = {w: f"_t{i}" for i, w in enumerate(terms)}
    # dealt by id once: both groupings follow
    each = found.repartition("id").groupBy("id", "field").agg(F.first("size").alias("size"), *[F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(c) for w, c in place.items()])
    hits = [_hits([F.coalesce(place[w], F.array().cast("array<int>")) for w in p]).alias(f"_h{i}") for i, p in enumerate(phrases)]
    each = each.select("id", "field", "size", *hits)
    names = [f"_h{i}" for i in range(len(phrases))]
    some = reduce(lambda x, y: x | y, [F.col(h) > 0 for h in names])
    per = each.where(some).groupBy("id").agg(F.first("size").alias("size"), F.array_sort(F.collect_list("field")).alias("matched_fields"), *[F.sum(h).alias(h) for h in names])
    rarity = per.agg(*[F.count_if(F.col(h) > 0).alias(h) for h in names])
    score = F.lit(0.0)
    for h in names:
        idf = F.greatest(F.log((F.lit(index.docs) - F.col(f"n{h}") + 0.5) / (F.col(f"n{h}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(h) * (k1 + 1) / (F.col(h) + k1 * (1 - b + b * F.col("size") / F.lit(index.mean)))
    whole = per.where(reduce(lambda x, y: x & y, [F.col(h) > 0 for h in names]))
    if where is not None:
        whole = whole.join(index.rows.where(where).select("id"), "id", "left_semi")
    scored = whole.crossJoin(rarity.toDF(*[f"n{h}" for h in names]))  # one row
    return scored.select("id", F.round(score, 6).alias("score"), "matched_fields").orderBy(F.desc("score"), "id").limit(k)


def _hits(positions: list[Column]) -> Column:
    """How often the tokens stand in a row, from the positions of each."""

    def back(p: Column, by: int) -> Column:
        return F.transform(p, lambda x: x - by)

    return F.size(reduce(F.array_intersect, [back(p, i) for i, p in enumerate(positions)]))
