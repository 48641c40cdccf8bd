"""Time: as-of joins, first occurrences, chronological splits and folds, day buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """Backward, inclusive as-of join: the latest value of right at or before each left row. One shuffle by key, no pair explosion."""
    both = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(key, at, F.col(value).alias("_v")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    before = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(out, F.last("_v", ignorenulls=True).over(before)).where("_side = 1").drop("_side", "_v")


def first_flag(df: DataFrame, keys: list[str], order: list[str], out: str = "is_first") -> DataFrame:
    """1 in the first row of each key."""
    rows = ranked(df.withColumn("_key", F.struct(*keys)), "_key", order, "_place", "_size")
    return rows.select(*df.columns, (F.col("_place") == 1).cast("int").alias(out))


def ranked(df: DataFrame, group: str, order: list[str], rank: str = "_k", total: str = "_n") -> DataFrame:
    """Adds each row's place in its group (from 1) and the group's size.

    Places come from counts per group and bucket of the first order column (a day, or 65,536 numbers), so that no
    task gets a whole group. Groups and order columns of null are kept: nulls come first.
    """
    kind = df.schema[order[0]].dataType
    first = F.col(order[0])
    bucket = F.to_date(first) if isinstance(kind, (TimestampType, TimestampNTZType, DateType)) else F.floor(first / 65536) if isinstance(kind, NumericType) else F.substring(first.cast("string"), 1, 2)
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(group, "_bucket").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(group)
    counts = counts.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), (F.sum("_c").over(whole.orderBy("_bucket")) - F.col("_c")).alias("_before"), F.sum("_c").over(whole).alias(total))
    local = df.withColumn(rank, F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)))
    both = local.join(counts, local[group].eqNullSafe(counts["_g"]) & local["_bucket"].eqNullSafe(counts["_b"]))
    return both.withColumn(rank, F.col(rank) + F.col("_before")).drop("_bucket", "_g", "_b", "_before")


def chronological_split(df: DataFrame, group: str, order: list[str], test_fraction: float = 0.2) -> DataFrame:
    """part: train for the first round(n * (1 - f)) rows of each group (half to even), at least one and at most n - 1 of them, but a row alone; else test."""
    n = F.col("_n")
    cut = F.when(n > 1, F.least(F.greatest(F.bround(n * F.lit(1 - test_fraction)), F.lit(1)), n - 1)).otherwise(n)
    return ranked(df, group, order).withColumn("part", F.when(F.col("_k") <= cut, "train").otherwise("test")).drop("_k", "_n")


def fold_bounds(folds: int, fraction: float) -> list[tuple[float, float]]:
    """Shares of a group at which each fold's validation window starts and ends: the last windows of so large a fraction."""
    uppers = [1.0 - fraction * (folds - 1 - i) for i in range(folds)]
    return [(upper - fraction, upper) for upper in uppers]


def walk_forward(df: DataFrame, group: str, order: list[str], folds: int, fraction: float) -> DataFrame:
    """fold, part: expanding training windows, each followed by a validation window. Both ends are shares of n, rounded half to even."""
    bounds = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(fold_bounds(folds, fraction))])
    df = ranked(df, group, order).withColumn("_f", F.explode(bounds))
    part = F.when(F.col("_k") <= F.bround(F.col("_n") * F.col("_f.lo")), "train").when(F.col("_k") <= F.bround(F.col("_n") * F.col("_f.hi")), "validation")
    return df.withColumns({"fold": F.col("_f.fold"), "part": part}).where("part is not null").drop("_k", "_n", "_f")


def elapsed_days(later: Column, earlier: Column) -> Column:
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / 86_400_000_000


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed whole days, floored: not a count of calendar days."""
    return F.floor(elapsed_days(later, earlier))


def day_bucket(days: Column) -> Column:
    return F.when(days <= 3, "days").when(days <= 21, "weeks").when(days <= 90, "months").when(days.isNotNull(), "longer")


def cyclical(value: Column, period: int) -> tuple[Column, Column]:
    turn = F.lit(2) * F.pi() * value / period
    return F.sin(turn), F.cos(turn)
