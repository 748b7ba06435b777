"""Queries that run a stream over the events once, and that write and read files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as X
from ..streaming import ledger as L
from .registry import query, t


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = t(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    return L.run_once(stream, X.shared_path(spark, name), X.shared_path(spark, f"{name}-state"))


@query("SELECT DISTINCT user_id, props FROM events WHERE value > 5")
def streamed_charges(spark, d):
    return _run(L.dedup_charges(_stream(spark, d).where("value > 5"), ["user_id", "props"], "ts", "value", "60 days").select("user_id", "props"), "charges")


@query("""WITH m AS (SELECT max(ts) AS m FROM events) SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS credits, count(*) AS calls FROM events, m
          GROUP BY 1, 2, m HAVING date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY <= m - INTERVAL 1 HOUR""")
def streamed_burn(spark, d):
    s = _stream(spark, d).withColumn("credits", F.round(F.col("value") * 100).cast("long"))
    return _run(L.daily_burn(s, "user_id", "ts", "credits", "1 hour"), "burn").withColumn("day", F.col("day").cast("timestamp_ntz"))


_CALLS = """WITH e AS (SELECT user_id AS call, ts AS moment, CASE WHEN event_type = 'view' THEN 'start' ELSE 'finish' END AS kind, CASE event_type WHEN 'purchase' THEN 'finished' WHEN 'click' THEN 'stopped' ELSE 'failed' END AS status FROM events),
s AS (SELECT call, min(moment) AS started FROM e WHERE kind = 'start' GROUP BY 1)
SELECT s.call, started, arg_min(status, moment) AS status, min(moment) AS finished FROM s JOIN e ON e.call = s.call AND kind = 'finish' AND moment > started GROUP BY 1, 2"""


@query(_CALLS)
def streamed_calls(spark, d):
    e = _stream(spark, d)
    kind = F.when(F.col("event_type") == "view", "start").otherwise("finish")
    status = F.when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "click", "stopped").otherwise(F.col("event_type"))
    calls = e.select(F.col("user_id").alias("call"), F.col("ts").alias("at"), kind.alias("kind"), status.alias("status"))
    return _run(L.pair_calls(calls, "90 days"), "calls").where("status <> 'lost'").select("call", F.col("started").cast("timestamp_ntz").alias("started"), "status", F.col("finished").cast("timestamp_ntz").alias("finished"))


@query("SELECT user_id, event_type, arg_max(value, ts) AS value FROM events GROUP BY 1, 2")
def streamed_snapshot(spark, d):
    path = X.shared_path(spark, "snapshot")
    s = _stream(spark, d).select("user_id", "event_type", "ts", "value")
    L.apply_batches(s, path, ["user_id", "event_type"], "ts", X.shared_path(spark, "snapshot-state")).awaitTermination()
    return L.newest_version(spark, path).select("user_id", "event_type", "value")


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, d):
    c, path = t(spark, d, "conversations"), X.shared_path(spark, "samples")
    X.write_samples(c, path, ["conv_id", "turn"])
    return X.read_jsonl(spark, path, c.schema)


@query("SELECT conv_id, turn FROM conversations WHERE turn % 2 = 0")
def jsonl_tolerant(spark, d):
    """Every odd turn's row is broken on the way."""
    c, path = t(spark, d, "conversations").select("conv_id", "turn"), X.shared_path(spark, "broken")
    c.select(F.when(F.col("turn") % 2 == 0, F.to_json(F.struct("conv_id", "turn"))).otherwise(F.concat(F.lit('{"conv_id": '), F.col("conv_id").cast("string"))).alias("value")).write.text(path)
    return X.read_jsonl_tolerant(spark, path, c.schema)[0]


@query("SELECT conv_id, turn, text FROM conversations")
def jsonl_repair(spark, d):
    """Records broken at the line ends of their texts, put together again; a conversation is a file."""
    c = t(spark, d, "conversations")
    raw = F.replace(F.to_json(F.struct("conv_id", "turn", "text")), F.lit("\\n"), F.lit("\n"))
    lines = c.select(F.col("conv_id").cast("string").alias("file"), "turn", F.posexplode(F.split(raw, "\n")).alias("i", "value"))
    records = X.repair_jsonl(lines.select("file", (F.col("turn") * 1_000_000 + F.col("i")).alias("line_no"), "value"))
    return records.select(F.from_json("record", "conv_id long, turn long, text string").alias("r")).select("r.*")


@query("SELECT p_partkey, p_type AS dataset_id FROM part WHERE p_type IN ('PROMO', 'SMALL')")
def published_datasets(spark, d):
    """Two datasets published in turn, the first one twice."""
    p, path = t(spark, d, "part").select("p_partkey", F.col("p_type").alias("dataset_id")), X.shared_path(spark, "datasets")
    for name in ("PROMO", "SMALL", "PROMO"):
        X.publish_dataset(p.where(F.col("dataset_id") == name), path, name)
    return spark.read.parquet(path).select("p_partkey", "dataset_id")
