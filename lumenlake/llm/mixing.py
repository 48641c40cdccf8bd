"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's target divided by its size is the number of copies that each of its rows is to have: a whole part, which all
rows get, and a fraction. Fractions are paired. Of a pair, words move from one to the other, as many as it takes to make one of the
two fractions 0 or 1; in which direction is drawn so that the expected fractions stay. The words of both together stay
exactly, so a source's taken words stay at its target, but for the last fraction that no partner is left for.

Pairs form a tree. At its leaves the rows of a source are dealt to blocks of about BLOCK by a hash. There all fractions are equal, so
a row, the largest first, is paired with the rest of its block as one. At most one row of a block stays fractional, one of the smallest as a
rule. What is left of all blocks is dealt to blocks again, in which each meets the next smaller one, until a source has one block.

Rows that agree in source, doc_id and size cannot be told apart: they are counted before anything is shuffled and numbered
afterwards, so a row that is repeated without end is spread like others. All draws are hashes of the seed, the row
and the level: a rerun, and any other partitioning, gives the same mix.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BLOCK = 64
UNIT = 1024
WORDS = "[^\\x20\\x09-\\x0D]+"


def sized_columns() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size")]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the words of the text (null: 0)."""
    return docs.select(*sized_columns())


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, n_rows, source_size, target of the sources of rows (source, size, n: how often).

    Sources by code point, null last, take the weights in turn. share times all sizes is dealt by weight. A target stops at cap times its source's
    size; each round caps the sources that are above, and deals what they leave to the others, until none is above.
    There is one row for each source, in one window for its place; a round brings one row to the driver.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    nth = F.row_number().over(order) - 1
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_rows"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth % len(weights) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", weight), "sources")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, F.col("source_size") * F.lit(cap)
    while True:
        over = F.col("weight") * F.lit(level) >= full
        kept, rest = sources.agg(F.sum(F.when(over, full)), F.sum(F.when(~over, F.col("weight")))).first()
        raised = (total - (kept or 0.0)) / rest if rest else level
        if raised <= level:  # no source was capped by the last rise
            break
        level = raised
    return sources.withColumn("level", F.lit(level)).select("source", "n_rows", "source_size", F.least(F.col("weight") * F.col("level"), full).alias("target"))


def uniform(*parts) -> Column:
    """A number from 0 up to 1 that is a function of its arguments."""
    return F.pmod(F.xxhash64(*[F.lit(p) if isinstance(p, (int, str)) else p for p in parts]), F.lit(1 << 53)) / F.lit(float(1 << 53))


ROW = "struct<size:bigint,u:double,p:double,doc_id:bigint,k:bigint>"
SETTLED = "array<struct<doc_id:bigint,size:bigint,k:bigint,more:int>>"


def settled(row: Column, more: Column) -> Column:
    return F.array(F.struct(row["doc_id"].alias("doc_id"), row["size"].alias("size"), row["k"].alias("k"), more.cast("int").alias("more")))


def fraction(row: Column, p: Column) -> Column:
    return F.struct(row["size"].alias("size"), row["u"].alias("u"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), row["doc_id"].alias("doc_id"), row["k"].alias("k"))


def met_rest(state: Column, row: Column) -> Column:
    """A leaf: row meets the rest of its block. mass: words to be taken of row and rest; size: their words; rest: 0 or 1 once the rest is settled."""
    s, mass, q = row["size"], state["mass"], state["mass"] / state["size"]
    others = state["size"] - s
    up, down = F.least((1 - q) * s, q * others), F.least(q * s, (1 - q) * others)
    rises = row["u"] * (up + down) < down  # fractions stay in the mean: up * down == down * up
    row_settles = F.when(rises, s <= mass).otherwise(mass <= others)
    over = state["rest"].isNotNull()
    return F.struct(
        F.when(rises & row_settles, mass - s).otherwise(mass).alias("mass"),
        F.when(over, state["size"]).otherwise(others).alias("size"),
        F.when(over, state["rest"]).when(row_settles, F.lit(None).cast("int")).otherwise((~rises).cast("int")).alias("rest"),
        F.when(over | row_settles, state["carry"]).otherwise(fraction(row, F.when(rises, mass / s).otherwise((mass - others) / s))).alias("carry"),
        F.concat(state["done"], F.when(over, settled(row, state["rest"])).when(row_settles, settled(row, rises)).otherwise(F.array().cast(SETTLED))).alias("done"),
    )


def met_next(state: Column, row: Column) -> Column:
    """Further up: what is left so far meets the next smaller row."""
    carry = state["carry"]
    s, p, t, q = carry["size"], carry["p"], row["size"], row["p"]
    up, down = F.least((1 - p) * s, q * t), F.least(p * s, (1 - q) * t)  # words that carry can take from row, and give to it
    rises = row["u"] * (up + down) < down
    carry_settles = F.when(rises, (1 - p) * s <= q * t).otherwise(p * s <= (1 - q) * t)
    moved = F.when(rises, up).otherwise(-down)
    now = F.when(carry_settles, fraction(row, q - moved / t)).otherwise(fraction(carry, p + moved / s))
    done = F.when(carry_settles, settled(carry, rises)).otherwise(settled(row, ~rises))
    return F.struct(now.alias("carry"), F.concat(state["done"], done).alias("done"))


def folded(rows: DataFrame, level: int, seed: int) -> DataFrame:
    """source, carry, done of each block of rows (source, doc_id, size, k, p, blocks). At level 0, rows of one source have one p."""
    row = F.struct("doc_id", "size", "k")
    block = F.pmod(F.xxhash64(row, F.lit(seed), F.lit(level)), F.col("blocks"))
    fields = F.struct("size", uniform(row, seed, level, "draw").alias("u"), "p", "doc_id", "k").cast(ROW)
    blocks = rows.groupBy("source", block.alias("block")).agg(F.sort_array(F.collect_list(fields), asc=False).alias("rows"), (F.max("p") * F.sum("size")).alias("mass"), F.sum("size").alias("size"))
    nothing = F.array().cast(SETTLED).alias("done")
    if level:
        state = F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1))), F.struct(F.element_at("rows", 1).alias("carry"), nothing), met_next)
    else:
        start = F.struct(F.least("mass", "size").cast("double").alias("mass"), "size", F.lit(None).cast("int").alias("rest"), F.lit(None).cast(ROW).alias("carry"), nothing)
        state = F.aggregate("rows", start, met_rest)
    return blocks.select("source", state.alias("state")).select("source", "state.carry", "state.done")


def rounded(rows: DataFrame, seed: int) -> DataFrame:
    """source, doc_id, size, k, more: 0 or 1 for each of rows (source, doc_id, size > 0, k, p, blocks), by the reduction tree."""
    out, level = [], 0
    while True:
        state = materialize(folded(rows, level, seed), "folded")
        out.append(state.select("source", F.explode("done").alias("d")).select("source", "d.*"))
        left = state.where("carry is not null").select("source", "carry.doc_id", "carry.size", "carry.k", "carry.p")
        counts = materialize(left.groupBy("source").agg(F.count("*").alias("n")), "left")
        if counts.where("n > 1").isEmpty():
            last = uniform(F.struct("doc_id", "size", "k"), seed, "last") < F.col("p")
            out.append(left.select("source", "doc_id", "size", "k", last.cast("int").alias("more")))
            return reduce(DataFrame.unionByName, out)
        counts = counts.select(F.col("source").alias("of"), F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks"))
        rows, level = left.join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of"), level + 1


def numbered(equal: DataFrame) -> DataFrame:
    """A row for each of n equal rows, k from 0. Of more than UNIT, the numbers are dealt to many tasks."""
    small, large = equal.where(F.col("n") <= UNIT), equal.where(F.col("n") > UNIT)
    first = F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("n") - 1) / UNIT).cast("long")))
    parts = large.withColumn("part", first).withColumn("first", F.col("part") * UNIT).drop("part").repartition("doc_id", "first")
    parts = parts.withColumn("n", F.least(F.lit(UNIT), F.col("n") - F.col("first")))
    both = small.withColumn("first", F.lit(0).cast("long")).unionByName(parts)
    return both.withColumn("k", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1))).drop("first", "n")


def mix(spark: SparkSession, rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0) -> DataFrame:
    """source, doc_id, size, k, source_size, target, copies: a row for each of rows (doc_id, source, size); k numbers equal rows from 0.

    Rows of size 0 are drawn alone. Null sources are one source, the last; null ids are rows like others. Other columns are not
    read. An empty table gives no rows, and sizes that are all 0 give targets of 0.
    """
    equal = materialize(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")), "equal")
    of = targets(equal, weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    of = of.withColumns({"whole": F.floor(rate), "p": rate - F.floor(rate), "blocks": F.ceil(F.col("n_rows") / BLOCK).cast("long")}).withColumnRenamed("source", "of")
    of = materialize(of, "targets")
    same = F.col("source").eqNullSafe(F.col("of"))
    met = numbered(equal).join(of.select("of", "p", "blocks"), same).drop("of")
    open_ = (F.col("p") > 0) & (F.col("size") > 0)
    alone = met.where(~open_).withColumn("more", (uniform(F.struct("doc_id", "size", "k"), seed, "alone") < F.col("p")).cast("int"))
    found = rounded(met.where(open_), seed).unionByName(alone.drop("p", "blocks"))
    return found.join(of, same).select("source", "doc_id", "size", "k", "source_size", "target", (F.col("whole") + F.col("more")).alias("copies"))


def mixture(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 0) -> DataFrame:
    """The mixed corpus: each row of docs as often as it has copies, with all its columns, whatever their names.

    Equal rows are numbered within (row, partition); the counts of all partitions give them their places.
    """
    keys = sized(docs.select("doc_id", "source", "text")).columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    rows = materialize(row.select("row", *sized_columns()), "rows")
    rows = materialize(rows.withColumn("pid", F.spark_partition_id()), "rows")
    counts = rows.groupBy(*keys, "pid").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.struct(*keys).alias("key"), F.col("pid").alias("p"), F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy(*keys, "pid").orderBy("pid")) - 1
    placed = rows.withColumn("nth", nth).join(counts, F.struct(*keys).eqNullSafe(F.col("key")) & (F.col("pid") == F.col("p")))
    placed = placed.select("row", F.struct(*keys, (F.col("nth") + F.col("before")).alias("k")).alias("place"))
    mixed = mix(spark, rows.select(*keys), weights, share, cap, seed).where("copies > 0").select(F.struct(*keys, "k").alias("of"), "copies")
    out = placed.join(mixed, F.col("place").eqNullSafe(F.col("of"))).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark, sized(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
