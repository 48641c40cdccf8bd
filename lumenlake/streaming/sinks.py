"""Running streams over what is there, and a sink that a repeated micro-batch does not change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def batch_sink(path: str):
    """For foreachBatch: each micro-batch is one folder, named by its number and written over if it comes again."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return put


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", put=None) -> None:
    """Runs the stream over all that its sources hold now, into path by batch_sink (or put). The same checkpoint goes on where it ended or broke off.

    State stores that several variables and timers need are RocksDB's; the caller's setting is put back.
    """
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        stream.writeStream.foreachBatch(put or batch_sink(path)).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def written(spark: SparkSession, path: str, schema) -> DataFrame:
    """All rows of the sink, with their batch."""
    return spark.read.schema(schema).parquet(path)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each key of a sink in update mode: a batch has one row for a key, and later batches replace it."""
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max(F.struct("batch", *values)).alias("last"))
    return last.select(*keys, *[f"last.{c}" for c in values])
