"""What the training-data operators share: reading, materialising, hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than one row in this many; so there are fewer hot keys than that.
HOT_SHARE = 1000
HOT_ROWS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only a session on one machine that names none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Cuts lineage: writes a Parquet table to the shared folder once, and reads it again. discard() deletes it."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that no later result reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            if path.startswith(("file:", "hdfs:", "s3", "gs:", "abfs", "viewfs:", "/")) and "/part-" not in path:
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def join_classes(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of many rows to their class (one per key), safe for hot keys.

    Classes with over total / HOT_SHARE rows number under HOT_SHARE: they are broadcast. The rest is a sort-merge join in
    which a key holds at most that share of the rows; adaptive execution splits partitions that it makes too large.
    Neither input should be costly to read twice.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot, cold = classes.where(F.col(size) > limit), classes.where(F.col(size) <= limit)
    of_hot = rows.join(F.broadcast(hot), key)
    of_cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.hint("merge"), key)
    return of_hot.unionByName(of_cold)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "16m") -> None:
    """Python workers get whole texts in batches of so many rows and bytes: their memory is bounded by this, not by the partition.

    Settings that the caller has changed from Spark's defaults stay as they are.
    """
    for name, default, ours in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", size)):
        key = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


class Memo(dict):
    """A bounded cache of a pure function; it starts anew when full."""

    def __init__(self, f, bound: int = 150_000):
        self.f, self.bound = f, bound

    def __missing__(self, key):
        if len(self) >= self.bound:
            self.clear()
        self[key] = value = self.f(key)
        return value


def word_hashes() -> Memo:
    return Memo(xxhash.xxh64_intdigest)


def utf8(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
