"""Ordered labelling rules: the first that holds names the row; rules map to a class or to a drop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_rule(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The id of the first rule whose condition is true; null conditions do not hold."""
    return reduce(lambda acc, r: acc.when(r[1], F.lit(r[0])), rules[1:], F.when(rules[0][1], F.lit(rules[0][0]))).otherwise(F.lit(otherwise))


def label(df: DataFrame, rules: list[tuple[str, Column]], classes: dict[str, int], otherwise: str) -> DataFrame:
    """Adds label_rule and label (null: the rule drops the row)."""
    ruled = df.withColumn("label_rule", first_rule(rules, otherwise))
    pick = reduce(lambda acc, kv: acc.when(F.col("label_rule") == kv[0], F.lit(kv[1])), classes.items(), F.when(F.lit(False), F.lit(0)))
    return ruled.withColumn("label", pick)


def audit(df: DataFrame, names: list[str]) -> DataFrame:
    """label_rule, n for every known rule, zero-filled."""
    known = df.sparkSession.createDataFrame([(x,) for x in names], "label_rule string")
    return known.join(df.groupBy("label_rule").agg(F.count("*").alias("n")), "label_rule", "left").fillna(0, ["n"])
