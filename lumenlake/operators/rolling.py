"""Frames of the last rows of a group, one for each row, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .temporal import ranked


def last_rows(df: DataFrame, group: str, order: list[str], last: int, aggregates: dict[str, Column], least_block: int = 4096) -> DataFrame:
    """df with, for each name, an aggregate over the group's last rows up to and with this one: at most `last`, in order.

    Each group is cut by place into blocks of least_block rows, or of last where that is more. A block gets the last - 1 rows before it once
    more, so its frames are whole: at most every row is read twice. Groups of null are kept; order must tell the rows of a group apart.
    """
    if last < 1:
        raise ValueError("a frame holds one row at least")
    size = max(last, least_block)
    rows = ranked(df, group, order, "_at", "_size").withColumn("_block", F.floor((F.col("_at") - 1) / size)).withColumn("_own", F.lit(True))
    ahead = rows.where((F.col("_at") > (F.col("_block") + 1) * size - (last - 1)) & (F.col("_size") > (F.col("_block") + 1) * size))
    both = rows.unionByName(ahead.withColumns({"_block": F.col("_block") + 1, "_own": F.lit(False)}))
    frame = Window.partitionBy(group, "_block").orderBy("_at").rowsBetween(1 - last, 0)
    return both.withColumns({name: a.over(frame) for name, a in aggregates.items()}).where("_own").drop("_at", "_size", "_block", "_own")


def rolling_percentiles(df: DataFrame, group: str, order: list[str], value: str, last: int, shares: dict[str, float]) -> DataFrame:
    """df with n, the number of known values in each row's frame of last rows, and for each name of shares the value at place min(n - 1, floor(n * share)) of them, sorted.

    A frame is sorted for each row, so the work is rows times last; a frame without known values has n 0 and nulls.
    """
    rows = last_rows(df, group, order, last, {"_values": F.collect_list(value)}).withColumn("_values", F.sort_array("_values")).withColumn("n", F.size("_values").cast("long"))
    at = lambda share: F.try_element_at("_values", (F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(share))) + 1).cast("int"))
    return rows.withColumns({name: F.when(F.col("n") > 0, at(share)) for name, share in shares.items()}).drop("_values")
