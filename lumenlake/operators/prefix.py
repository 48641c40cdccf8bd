"""Running sums over ordered values without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored

#: A group's values are dealt to about so many ranges.
RANGES = 100


def ranged(df: DataFrame, group: str, by: str, ranges: int = RANGES) -> DataFrame:
    """Adds _range: how many of the group's approximate quantiles lie below the value. Equal values share a range; groups of null are kept."""
    shares = [k / ranges for k in range(1, ranges)]
    edges = stored(df.groupBy(F.col(group).alias("_g")).agg(F.percentile_approx(by, shares, 20 * ranges).alias("_edges")), "edges")  # approximate quantiles differ from run to run: all readers need the same
    return df.join(edges, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_range", F.size(F.filter("_edges", lambda e: e < F.col(by)))).drop("_g", "_edges")


def running_sums(df: DataFrame, group: str, by: str, sums: dict[str, str], descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """Adds, for each out: column of sums, the sum of the column over the group's rows up to this one in the order of by.

    df has one row for each group and value (count equal values together first). The rows of a range are summed in one window, the
    ranges of a group in another, and what lies before a range is joined to it.
    """
    order = F.col(by).desc() if descending else F.col(by).asc()
    rows = ranged(df, group, by, ranges)
    totals = rows.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(*[F.sum(c).alias(f"_{out}") for out, c in sums.items()])
    across = Window.partitionBy("_g").orderBy(F.col("_r").desc() if descending else F.col("_r").asc())
    totals = totals.select("_g", "_r", *[(F.sum(f"_{out}").over(across) - F.col(f"_{out}")).alias(f"_{out}") for out in sums])
    within = Window.partitionBy(group, "_range").orderBy(order)
    rows = rows.withColumns({out: F.sum(c).over(within) for out, c in sums.items()})
    both = rows.join(totals, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return both.select(*df.columns, *[(F.col(out) + F.col(f"_{out}")).alias(out) for out in sums])
