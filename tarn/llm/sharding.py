"""Two-pass external shuffle into shards (operator 4); DataFrame functions only.

Pass one scatters the records by seeded hashes into buckets that fit a task's memory, each inside one shard.
Pass two shuffles each bucket: the draws of a Fisher-Yates shuffle come as a seeded hash of each record, and sorting by
them gives the permutation, so it depends on the seed alone, not on Spark's partitions. The law is ``key``:
the key and the number of shards alone decide the shard, by the highest of one hash per shard, so one more shard
takes rows only into itself. A slot is the bucket's first slot plus the place in the shuffled bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _hash(key: Column, shard: int, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(shard), key)


def shard_of(key: Column, shards: int, seed: int = 0) -> Column:
    """The shard whose hash with ``key`` is highest (ties: the lower number); null is a key like any other."""
    return (-F.greatest(*[F.struct(_hash(key, s, seed).alias("h"), F.lit(-s).alias("s")) for s in range(shards)])["s"]).cast("int")


def two_pass_shuffle(df: DataFrame, key: str, size: Column, shards: int, seed: int = 0, bucket_bytes: int = 8 << 20) -> DataFrame:
    """Every row once, as (record struct<all columns of df>, shard int, grown_shard int, slot long).

    ``size`` is a row's bytes. There are so many buckets per shard that one holds about ``bucket_bytes``, however
    large the input; which bucket of its shard a record goes to depends on a hash of all its columns, so a hot
    key, source or text is spread over all of them. Nulls, very long texts and repeated rows are rows like any
    other (rows equal in every column share a bucket); columns may have any names; an empty table stays empty.
    The order in a bucket depends on the seed and the number of buckets alone; rows equal in every column are neighbours.
    """
    total = df.agg(F.sum(size)).first()[0] or 0
    per_shard = max(1, math.ceil(total / shards / bucket_bytes))
    hashed = [F.to_json(F.col(f"`{c}`")) if kind.startswith("map") else F.col(f"`{c}`") for c, kind in df.dtypes]
    record = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("record")
    base = df.select(record, F.xxhash64(F.lit(seed + 1), *hashed).alias("fine"), shard_of(F.col(f"`{key}`"), shards, seed).alias("shard"))
    base = base.withColumn("bucket", F.pmod("fine", F.lit(per_shard)).cast("int"))
    counts = base.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    buckets = base.groupBy("shard", "bucket").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 2), "fine").alias("draw"), "fine", "record"))).alias("records"))
    placed = buckets.join(first, ["shard", "bucket"]).select("shard", "first", F.posexplode("records").alias("at", "row"))
    mine, new = F.col(f"row.record.`{key}`"), F.col("shard")
    kept = _hash(mine, shards, seed) <= F.greatest(*[_hash(mine, s, seed) for s in range(shards)])
    return placed.select(F.col("row.record").alias("record"), "shard", F.when(kept, new).otherwise(F.lit(shards)).cast("int").alias("grown_shard"), (F.col("first") + F.col("at")).alias("slot"))


def write_shards(df: DataFrame, path: str, key: str, size: Column, shards: int, seed: int = 0) -> None:
    """The shuffled records as Parquet, a folder ``shard=N`` for each shard, rows with their slot."""
    two_pass_shuffle(df, key, size, shards, seed).select("record.*", F.col("slot").alias("_slot"), F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)
