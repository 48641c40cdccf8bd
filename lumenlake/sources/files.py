"""CSV, JSON lines and the registry of runs, as Spark reads and writes them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir. Only a session on one machine that names none gets a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lumenlake-')}"
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, compression: str | None = None, **options) -> DataFrame:
    """df as a Parquet table under the shared folder, for what is read more than once."""
    path = shared_path(df.sparkSession, tag)
    df.write.options(**options).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _nested(field) -> bool:
    return isinstance(field.dataType, (ArrayType, MapType, StructType))


def write_csv(df: DataFrame, path: str) -> None:
    """Cells with arrays, maps and structs become JSON; quotes are doubled and line ends kept."""
    cells = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if _nested(f) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*cells).write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", '""').option("nullValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The inverse, with given types: empty cells are null, a cell that does not parse is null."""
    text = ", ".join(f"`{f.name}` string" for f in schema)
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(text).csv(path)

    def typed(f) -> Column:
        cell = F.nullif(F.col(f"`{f.name}`"), F.lit(""))
        return (F.from_json(cell, f.dataType) if _nested(f) else cell.try_cast(f.dataType)).alias(f.name)

    return rows.select(*[typed(f) for f in schema])


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replay_jsonl(spark: SparkSession, path: str, schema: str, kind: str, known: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records of known kinds, counts per kind): broken lines are skipped, unknown kinds counted but not returned."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(F.col(kind).isin(known)), rows.groupBy(kind).agg(F.count("*").alias("n"))


def register_run(spark: SparkSession, table: DataFrame, run: str, path: str) -> None:
    """Appends run, n_rows and an order-free digest of the table's rows to the registry at path."""
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])), 256)
    digest = table.select(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("decimal(38,0)").alias("digest"))
    digest.select(F.lit(run).alias("run"), "n_rows", "digest", F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def date_windows(start: Column, end: Column, days: int) -> Column:
    """Inclusive windows of so many days that do not overlap: rows of (from, to) by explode."""
    return F.explode(F.transform(F.sequence(start, end, F.make_interval(days=F.lit(days))), lambda a: F.struct(a.cast("date").alias("from_day"), F.least(F.date_add(a.cast("date"), days - 1), end).alias("to_day"))))
