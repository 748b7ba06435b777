"""Sources and sinks: JSONL of three kinds of strictness, publishing, exports, and where shared files go."""

from __future__ import annotations

import json
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir; local sessions may go without)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-tarn-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Strict: blank lines are skipped, a malformed row fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows as file and line)."""
    full = StructType([*schema.fields, StructField("_bad", StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    rows = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    return rows.where("r._bad is null").select("r.*").drop("_bad"), rows.where("r._bad is not null").select("file", F.col("value").alias("line"))


def repair_jsonl(lines: DataFrame, file: str = "file", order: str = "line_no", value: str = "value") -> DataFrame:
    """(file, line_no, record): physical lines that do not parse are joined to the next with an escaped line end, until
    they do; a file is one group, as a record may start on any of its lines. What never parses comes out as it is."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        rows, held, at = [], "", None
        for n, text in f.sort_values(order)[[order, value]].itertuples(index=False):
            if not held and not (text or "").strip():
                continue
            at = n if not held else at
            held = f"{held}\\n{text or ''}" if held else text
            try:
                json.loads(held)
            except ValueError:
                continue
            rows.append((at, held))
            held = ""
        if held:
            rows.append((at, held))
        out = pd.DataFrame(rows, columns=["line_no", "record"])
        out.insert(0, "file", f[file].iloc[0])
        return out

    return lines.groupBy(file).applyInPandas(run, "file string, line_no long, record string")


def publish_dataset(df: DataFrame, path: str, dataset: str, known: DataFrame | None = None) -> None:
    """Replaces the partition of one dataset_id; refuses rows of any other, and a dataset that is not in ``known``
    (dataset_id), if given."""
    if known is not None and known.where(F.col("dataset_id") == dataset).isEmpty():
        raise ValueError(f"{dataset!r} is no known dataset")
    if not df.where(~F.col("dataset_id").eqNullSafe(F.lit(dataset))).isEmpty():
        raise ValueError(f"rows of another dataset than {dataset!r}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(path)


def write_samples(df: DataFrame, path: str, order: list[str]) -> None:
    """Nested rows as JSONL in a fixed order (a range shuffle; files in order)."""
    df.orderBy(*order).select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value")).write.text(path)
