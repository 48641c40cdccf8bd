"""Metrics of scored rows, overall and by group in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_sums


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5, group: str | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, accuracy, brier; with group, a grouping set gives all groups and the total (null)."""
    y, p = F.col(label) == 1, F.col(score) >= threshold
    aggs = [
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
        F.avg(F.pow(F.col(score) - F.col(label), F.lit(2))).alias("brier"),
    ]
    base = (df.rollup(group) if group else df.groupBy()).agg(*aggs)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    precision, recall = zero(F.try_divide("tp", F.col("tp") + F.col("fp"))), zero(F.try_divide("tp", F.col("tp") + F.col("fn")))
    out = base.withColumns({"precision": precision, "recall": recall, "accuracy": F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))})
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def by_score(df: DataFrame, label: str, score: str, group: str) -> DataFrame:
    """Counts per distinct score, and their running sums from the top: what curves need, pre-aggregated and summed by ranges of the score."""
    per = df.groupBy(group, score).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    return running_sums(per, group, score, {"tp": "pos", "seen": "n"}, descending=True)


def auc(df: DataFrame, label: str, score: str, group: str) -> DataFrame:
    """group, roc_auc (ties count half) and average precision; null where one class is missing."""
    s = by_score(df, label, score, group).withColumn("neg", F.col("n") - F.col("pos"))
    pairs = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return s.groupBy(group).agg(
        F.try_divide(pairs, F.sum("pos") * F.sum("neg")).alias("roc_auc"), F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("average_precision")
    )
