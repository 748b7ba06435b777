"""Shared helpers of the training-data operators: the shared scratch folder, numpy tokenising, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce, wraps

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: The white space between words in every contract here: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only local sessions get one of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-tarn-"))
    return spark.sparkContext.getCheckpointDir()


#: Scratch folders made so far in this process, in order.
_MADE: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/tarn/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def scratch_count() -> int:
    """How many scratch folders were made so far."""
    return len(_MADE)


def scratch_removed(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Deletes the scratch folders made after the first ``since`` ones, but for those that ``keep`` reads."""
    used = {f.split("/")[-2] for f in keep.inputFiles()}
    gone = [x for x in _MADE[since:] if x.rsplit("/", 1)[-1] not in used]
    _MADE[since:] = [x for x in _MADE[since:] if x not in gone]
    for folder in gone:
        removed(spark, folder)


class Leftovers:
    """Scratch folders of the stages of a pipeline: what a stage leaves is deleted when the next one begins, as its result
    has been written by then. A folder that the next stage's input reads (a result that was not written) stays."""

    def __init__(self) -> None:
        self.folders: list[str] = []

    def collected(self, stage: Callable[..., DataFrame], remember: bool = True) -> Callable[..., DataFrame]:
        """``stage``, deleting what earlier ones left and remembering what it leaves itself (but for a last stage)."""

        @wraps(stage)
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if self.folders:
                used = {f.split("/")[-2] for f in docs.inputFiles()}
                gone = [x for x in self.folders if x.rsplit("/", 1)[-1] not in used]
                self.folders = [x for x in self.folders if x not in gone]
                for folder in gone:
                    removed(spark, folder)
                settled(spark)
            n = len(_MADE)
            out = stage(spark, docs, sf_dir)
            self.folders += _MADE[n:] if remember else []
            return out

        return run


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_with_mark(df: DataFrame, name: str, *columns: str) -> tuple[DataFrame, int, object]:
    """As :func:`saved`, with the number of rows and a sum of the rows' hashes, both observed while writing."""
    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*(columns or df.columns)).cast("decimal(38,0)")).alias("mark"))
    out = saved(watched, name)
    return out, seen.get["n"], seen.get["mark"]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of scratch files that is no longer needed."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def settled(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of finished jobs, which else stay until the driver happens to collect
    its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links as (node, root), root the smallest node of each component.

    Alternating large-star and small-star rounds, each saved to the shared folder; a star's hub carries only
    the edges it keeps, and every edge is deduplicated before the next round, so the number of rows never
    exceeds the number of distinct links plus nodes. Null ends are ignored; an empty table gives an empty table.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges, n, _ = saved_with_mark(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while n:
        # done when no node points to two others, nor to one that points on
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("to")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("to").alias("to")).where("out > 1 or out = 1 and to = 1").isEmpty():
            break
        # large star: every larger neighbour of u goes to u's smallest neighbour (or u itself)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: every smaller neighbour of u, and u, go to u's smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges, n, _ = saved_with_mark(small, "edges")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(edges.select("v", "v").distinct())


def union_all(dfs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


# ---------------------------------------------------------------- numpy tokenising

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of several texts, found at once: byte buffer, start and end of each word, words per text."""

    def __init__(self, texts: list[str | None], lower: np.ndarray | None = None):
        raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        self.sizes = np.array([len(x) + 1 for x in raw], dtype=np.int64)
        self.buf = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
        if lower is not None:
            self.buf = lower[self.buf]
        gap = _IS_SPACE[self.buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        self.base = np.concatenate(([0], np.cumsum(self.sizes)))
        self.first = np.searchsorted(self.start, self.base)  # of each text, and one past the last
        self.n = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; every byte of a word counts, at its place in the word."""
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        at = np.arange(len(self.buf)) - np.repeat(np.concatenate(([0], self.start)), np.diff(np.concatenate(([0], self.start, [len(self.buf)]))))
        values = _BYTE[self.buf] * (_PLACE[at % len(_PLACE)] + (at // len(_PLACE)).astype(np.uint64))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
        return mix(total[self.end] - total[self.start] + size.astype(np.uint64))


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of k words inside one text, and the index of its first word. first: as in Words."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    text = np.searchsorted(first, np.arange(len(h)), side="right")
    inside = np.flatnonzero(text[: len(out)] == text[k - 1 :])
    return mix(out[inside]), inside


def salted_join_sizes(pairs: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, n_salts): how many parts a key's group is split into so that each part has about ``rows`` rows."""
    return pairs.groupBy(key).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias("n_salts"))


__all__ = ["Leftovers", "LOWER", "NOT_SPACE", "SPACE", "Window", "Words", "components", "mix", "removed", "salted_join_sizes", "saved", "saved_with_mark", "scratch_count", "scratch_path", "scratch_removed", "settled", "shared_dir", "table", "union_all", "windows"]
