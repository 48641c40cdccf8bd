"""Evaluation beyond two classes and one threshold: searches, curves, rank correlation, leaderboards.

All of it works on counts per distinct score or class, so nothing but a histogram passes a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored
from .prefix import running_sums
from .temporal import ranked

#: Thresholds 0.10, 0.12 .. 0.90.
GRID = [round(0.10 + 0.02 * k, 2) for k in range(41)]


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0))


def best_threshold(df: DataFrame, label: str, score: str, group: str) -> DataFrame:
    """group, threshold, f1: the lowest threshold of the grid with the best F1; 0.5 where one class is missing.

    Rows shrink to counts per (group, number of thresholds reached) before they meet the grid.
    """
    reached = F.size(F.filter(F.array(*map(F.lit, GRID)), lambda t: t <= F.col(score)))
    counts = df.groupBy(group, reached.alias("reached")).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    grid = F.explode(F.arrays_zip(F.array(*map(F.lit, GRID)).alias("t"), F.sequence(F.lit(0), F.lit(len(GRID) - 1)).alias("k")))
    per = counts.withColumn("_at", grid).groupBy(group, F.col("_at.t").alias("t")).agg(
        F.sum(F.when(F.col("reached") > F.col("_at.k"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("reached") > F.col("_at.k"), F.col("n") - F.col("pos")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("all_pos"), F.sum("n").alias("all"),
    )
    best = per.groupBy(group).agg(F.min(F.struct((-f1_of(F.col("tp"), F.col("fp"), F.col("all_pos") - F.col("tp"))).alias("less"), F.col("t"))).alias("b"), F.max("all_pos").alias("p"), F.max("all").alias("n"))
    both = (F.col("p") > 0) & (F.col("p") < F.col("n"))
    return best.select(group, F.when(both, F.col("b.t")).otherwise(0.5).alias("threshold"), F.when(both, -F.col("b.less")).alias("f1"))


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """class, tp, fp, fn, support, precision, recall, f1 and macro_f1 (the mean over the classes that occur), from the counts per pair of classes."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = pairs.select("n", F.explode(F.array_distinct(F.array("t", "p"))).alias("class"), "t", "p")
    is_t, is_p = F.col("t") == F.col("class"), F.col("p") == F.col("class")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = sides.groupBy("class").agg(total(is_t & is_p).alias("tp"), total(~is_t & is_p).alias("fp"), total(is_t & ~is_p).alias("fn"), total(is_t).alias("support"))
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = out.withColumns({"precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn), "f1": f1_of(tp, fp, fn)})
    return out.withColumn("macro_f1", F.avg("f1").over(Window.partitionBy()))  # one row per class


def macro_f1(df: DataFrame, truth: str, predicted: str, group: str) -> DataFrame:
    """group, macro_f1: the mean F1 over the classes that occur in the group, as truth or as prediction."""
    pairs = df.groupBy(group, F.col(truth).alias("_t"), F.col(predicted).alias("_p")).agg(F.count("*").alias("_n"))
    sides = pairs.withColumn("_class", F.explode(F.array_distinct(F.array("_t", "_p"))))
    total = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0))
    is_t, is_p = F.col("_t") == F.col("_class"), F.col("_p") == F.col("_class")
    return sides.groupBy(group, "_class").agg(f1_of(total(is_t & is_p), total(~is_t & is_p), total(is_t & ~is_p)).alias("_f1")).groupBy(group).agg(F.avg("_f1").alias("macro_f1"))


def reliability(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """bin, n, mean_score, rate: bins between exact quantiles of the score; a score on an edge is in the lower bin."""
    per = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    places = {f"{side}{k}": lambda n, k=k, end=end: end((n - 1) * F.lit(k / bins)) for k in range(1, bins) for side, end in (("lo", F.floor), ("hi", F.ceil))}
    found = order_statistics(df.select(F.lit(0).alias("g"), F.col(score).alias("v")), "v", "g", places).crossJoin(F.broadcast(df.agg(F.count(score).alias("n"))))  # one row each

    def edge(k: int) -> Column:
        lo, hi, at = F.col(f"lo{k}"), F.col(f"hi{k}"), (F.col("n") - 1) * F.lit(k / bins)
        return F.when(lo == hi, lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    edges = found.select(F.array(*map(edge, range(1, bins))).alias("edges"))
    binned = per.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("s"))))  # edges: one row
    return binned.groupBy("bin").agg(F.sum("n").alias("n"), (F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("mean_score"), (F.sum("pos") / F.sum("n")).alias("rate"))


def spearman(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """group, spearman: correlation of average ranks; 0 where it is not defined."""
    joint = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(group, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))

    def ranked_by(c: str) -> DataFrame:
        """group, the value, and its average rank."""
        counts = joint.groupBy(group, c).agg(F.sum("n").alias("n"))
        upto = running_sums(counts, group, c, {"upto": "n"})
        return upto.select(F.col(group).alias(f"_g{c}"), F.col(c).alias(f"_{c}"), (F.col("upto") - (F.col("n") - 1) / 2).alias(f"r{c}"))

    for c in ("x", "y"):
        joint = joint.join(ranks := ranked_by(c), F.col(group).eqNullSafe(ranks[f"_g{c}"]) & (F.col(c) == ranks[f"_{c}"])).drop(f"_g{c}", f"_{c}")

    n, a, b = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    s = joint.groupBy(group).agg(
        F.sum(n).alias("n"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"), F.sum(n * a * b).alias("ab")
    )
    spread = lambda sq, t: F.greatest(F.col("n") * F.col(sq) - F.col(t) * F.col(t), F.lit(0.0))
    r = F.try_divide(F.col("n") * F.col("ab") - F.col("a") * F.col("b"), F.sqrt(spread("aa", "a")) * F.sqrt(spread("bb", "b")))
    return s.select(group, F.coalesce(r, F.lit(0.0)).alias("spearman"))


def order_statistics(df: DataFrame, value: str, group: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """group and, for each name, the value at place places[name](n) (from 0) of the group's sorted values; nulls do not count.

    Rows are first counted in about a hundred ranges between approximate quantiles of the group; only the ranges
    that hold a wanted place are then sorted, so the result is exact and no task sorts a whole group.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    edges = rows.groupBy("g").agg(F.percentile_approx("v", [k / 100 for k in range(1, 100)], 1000).alias("edges"), F.count("*").alias("n"))
    edges = stored(edges, "edges")  # approximate quantiles differ from run to run: counts and rows need the same
    ranged = rows.join(edges.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).select("g", "v", "n", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("range"))
    counts = ranged.groupBy("g", "n", "range").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.partitionBy("g").orderBy("range")) - F.col("c"))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), at(F.col("n")).cast("long").alias("place")) for name, at in places.items()]))
    wanted = counts.select("g", "range", "before", "c", wanted.alias("w")).where("w.place >= before and w.place < before + c").select(F.col("g").alias("_g"), F.col("range").alias("_range"), "before", "w.name", "w.place")
    near = ranged.join(wanted, F.col("g").eqNullSafe(F.col("_g")) & (F.col("range") == F.col("_range"))).groupBy("g", "range", "name", "place", "before", "v").agg(F.count("*").alias("c"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("g", "range", "name").orderBy("v"))
    found = near.withColumn("upto", upto).where("upto > place").groupBy("g").agg(*[F.min(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places])
    return found.withColumnRenamed("g", group)


def nearest_rank(df: DataFrame, value: str, group: str, shares: dict[str, float]) -> DataFrame:
    """group and, for each name, the value at place min(n - 1, floor(n * share)) of the sorted ones."""
    return order_statistics(df, value, group, {name: lambda n, q=q: F.least(n - 1, F.floor(n * F.lit(q))) for name, q in shares.items()})


def prior_counts(df: DataFrame, keys: list[str], order: list[str], out: str = "prior") -> DataFrame:
    """How many earlier rows have the same keys; the row itself is not counted."""
    rows = ranked(df.withColumn("_key", F.struct(*keys)), "_key", order, "_place", "_size")
    return rows.select(*df.columns, (F.col("_place") - 1).cast("long").alias(out))


def running_leaderboard(df: DataFrame, group: str, item: str, order: list[str], ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """group, n, hit_k over the rows with test = 1: how often the row's item is among the k most frequent of all earlier rows of its group.

    The leaderboard runs along with the rows: only rows before the current one count. Ties go to the smaller item. Rates are rounded to 4 places
    by group; the row with null group weights these by n. Of the other items, those that were ahead by count are
    the rows with the same number of earlier occurrences, so a place in that list counts them; ties are looked up for rows near the top alone.
    """
    rows = ranked(df, group, order, "_at", "_all")
    by = Window.partitionBy(group, item).orderBy("_at")
    rows = rows.select(group, item, "test", "_at", (F.row_number().over(by) - 1).alias("_prior"), F.lead("_at").over(by).alias("_next"))
    rows = ranked(rows.withColumn("_tie", F.struct(group, "_prior")), "_tie", ["_at"], "_more", "_size").withColumn("_more", F.col("_more") - 1).drop("_tie", "_size")
    asked = rows.where("test = 1")
    near = asked.where((F.col("_prior") > 0) & (F.col("_more") < max(ks)))
    tied = rows.select(F.col(group).alias("_g"), F.col(item).alias("_item"), (F.col("_prior") + 1).alias("_count"), F.col("_at").alias("_since"), F.col("_next").alias("_until"))
    same = near.join(tied, (F.col(group) == F.col("_g")) & (F.col("_prior") == F.col("_count")) & (F.col("_since") < F.col("_at")) & (F.coalesce("_until", F.col("_at")) >= F.col("_at")) & (F.col("_item") < F.col(item)), "left")
    ranks = same.groupBy(group, "_at", "_more").agg((F.count("_item") + F.col("_more") + 1).alias("rank")).select(group, "rank")
    hits = ranks.groupBy(group).agg(*[F.count_if(F.col("rank") <= k).alias(f"_h{k}") for k in ks])
    rates = asked.groupBy(group).agg(F.count("*").alias("n")).join(hits, group, "left").select(group, "n", *[F.round(F.coalesce(f"_h{k}", F.lit(0)) / F.col("n"), 4).alias(f"hit_{k}") for k in ks])
    total = rates.agg(F.sum("n").alias("n"), *[F.round(F.sum(F.col(f"hit_{k}") * F.col("n")) / F.sum("n"), 4).alias(f"hit_{k}") for k in ks])
    return rates.unionByName(total.withColumn(group, F.lit(None).cast(df.schema[group].dataType)))


def hit_rates(train: DataFrame, test: DataFrame, group: str, item: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """group, n, hit_k: how often a test row's item is among the k most frequent of its group in train. Ties go to the smaller item.

    Rates are rounded to 4 places by group. The row with null group weights these rounded rates by n.
    """
    counts = train.groupBy(group, item).agg(F.count("*").alias("c"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("c"), item))).where(F.col("rank") <= max(ks)).select(group, item, "rank")
    asked = test.groupBy(group, item).agg(F.count("*").alias("n"))
    rates = asked.join(top, [group, item], "left").groupBy(group).agg(
        F.sum("n").alias("n"), *[F.round(F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias(f"hit_{k}") for k in ks]
    )
    total = rates.agg(F.sum("n").alias("n"), *[F.round(F.sum(F.col(f"hit_{k}") * F.col("n")) / F.sum("n"), 4).alias(f"hit_{k}") for k in ks])
    return rates.unionByName(total.withColumn(group, F.lit(None).cast(train.schema[group].dataType)))
