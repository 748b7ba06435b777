"""Structured Streaming jobs over metered calls. Watermarks are ours: they bound the state that a unique key would need."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def dedup_charges(stream: DataFrame, keys: list[str], at: str, credits: str, delay: str) -> DataFrame:
    """One charge per key within the watermark; charges of nothing are left out. Later copies need a unique sink key."""
    return stream.where(F.col(credits) > 0).withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def daily_burn(stream: DataFrame, org: str, at: str, credits: str, delay: str) -> DataFrame:
    """org, day, credits, calls; a day is final once the watermark has passed its end."""
    w = stream.withWatermark(at, delay).groupBy(org, F.window(at, "1 day")).agg(F.sum(credits).alias("credits"), F.count("*").alias("calls"))
    return w.select(org, F.col("window.start").alias("day"), "credits", "calls")


def pair_calls(stream: DataFrame, delay: str) -> DataFrame:
    """call, started, finished, status, ms: the first finish after a call's start; later finishes are ignored, an unknown
    status is a failure, a negative duration is 0. stream: call, at, kind (start or finish), status. A call that has not
    finished by ``delay`` after its start is dropped from the state and comes out as lost."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, done = state.get if state.exists else (None, False)
        rows = []
        if state.hasTimedOut:
            if started is not None and not done:
                rows.append((key[0], pd.Timestamp(started, unit="us"), None, "lost", None))
            state.remove()
        else:
            f = pd.concat(list(frames)).sort_values(["at", "kind"], ascending=[True, False])
            for x in f.itertuples():
                us = x.at.value // 1000
                if x.kind == "start" and started is None:
                    started = us
                elif x.kind == "finish" and started is not None and not done:
                    done = True
                    status = x.status if x.status in ("finished", "failed", "stopped") else "failed"
                    rows.append((key[0], pd.Timestamp(started, unit="us"), x.at, status, max(0, (us - started) // 1000)))
            state.update((started, done))
            if started is not None:
                state.setTimeoutTimestamp(max(started // 1000, state.getCurrentWatermarkMs() + 1) + wait)
        yield pd.DataFrame(rows, columns=["call", "started", "finished", "status", "ms"]).astype({"call": "int64", "started": "datetime64[us]", "finished": "datetime64[us]", "ms": "Int64"})

    wait = int(pd.Timedelta(delay).total_seconds() * 1000)
    out = "call long, started timestamp, finished timestamp, status string, ms long"
    return stream.withWatermark("at", delay).groupBy("call").applyInPandasWithState(run, out, "started long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)


def apply_batches(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str):
    """Keeps the newest row of each key under ``path``/v=N, a folder for each micro-batch that is complete before it is
    read, so a repeated batch writes the same again."""
    from ..operators.turns import latest_per_key

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        new = batch
        if n > 0:
            new = spark.read.schema(batch.schema).parquet(f"{path}/v={n - 1}").unionByName(batch)
        latest_per_key(new, keys, F.desc(order)).write.mode("overwrite").parquet(f"{path}/v={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The rows that :func:`apply_batches` left after its last complete micro-batch."""
    every = spark.read.parquet(path)
    last = every.agg(F.max("v")).first()[0]
    return every.where(F.col("v") == last).drop("v")


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an append-mode stream over what is there, to Parquet files under ``path``, and reads these."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(path)
