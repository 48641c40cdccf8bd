"""Approximate nearest neighbours by a permutation index.

Pivots come from a bounded sample (at most MAX_SAMPLE rows, those with the smallest hash of their id). Every vector
is represented by its PREFIX nearest pivots in order, and posted, with its rank, in the inverted file of each. The index is a table that is
written once: for each segment of about SEGMENT_ROWS distinct vectors and each pivot one inverted file, and the segment's vectors beside them.
A block of queries reads the files of its pivots, which adds up the footrule distance to the rows of a segment; the best share SHARE
of them are then ranked by exact cosine. The share, not a number, is fixed: so recall does not depend on the corpus size, and
the work is queries times rows, as vectors without structure (any two nearly orthogonal) leave nothing to skip. Equal vectors are one class.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

PIVOTS = 256
PREFIX = 64
MAX_SAMPLE = 4096
SHARE = 0.06
#: Rows of a segment that are ranked by cosine at the least: among few rows neighbours are farther, and their orders less alike.
LEAST = 256
K = 5
SEGMENT_ROWS = 4096
BLOCK_QUERIES = 1024


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of vectors that are not null, empty or zero and hold only finite numbers."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where("vec_id is not null").where(fine)


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """v and its `keep` smallest ids, one row per distinct vector, with first. Two rounds, so that one vector may have any share of rows."""
    key = rows.withColumn("h", F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0)))).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    small = key.withColumn("k", F.dense_rank().over(Window.partitionBy("h", "v", "salt").orderBy("vec_id"))).where(F.col("k") <= keep).dropDuplicates(["h", "v", "salt", "vec_id"])
    small = small.withColumn("k", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("k") <= keep)
    return small.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.element_at("ids", 1).alias("first"), "ids", "v")


def unit(rows) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in rows])
    return x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)


def ranks(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ pivots.T
    return np.argsort(-near, axis=1, kind="stable")[:, : min(PREFIX, len(pivots))]


FILES = "segment int, width int, pivot int, rows binary, ranks binary, vectors binary, ids array<array<long>>"


def posted(pivots: dict[int, np.ndarray]):
    """Of the vectors of a segment: one inverted file per pivot (rows and the ranks at which they have it), and pivot -1 with the vectors and their ids."""

    def post(key, part: pd.DataFrame) -> pd.DataFrame:
        segment, width = key
        x = np.array(part.v.tolist(), np.float64)
        out = [(segment, width, -1, None, None, x.tobytes(), [list(i) for i in part.ids])]
        p = pivots.get(width)
        if p is not None:
            orders = ranks(unit(x), p)
            depth = orders.shape[1]
            flat = orders.ravel()
            by = np.argsort(flat, kind="stable")
            bounds = np.searchsorted(flat[by], np.arange(len(p) + 1))
            for k in range(len(p)):
                at = by[bounds[k] : bounds[k + 1]]
                out.append((segment, width, k, (at // depth).astype(np.int32).tobytes(), (at % depth).astype(np.int16).tobytes(), None, None))
        return pd.DataFrame(out, columns=["segment", "width", "pivot", "rows", "ranks", "vectors", "ids"])

    return post


def footrule(files: dict[int, tuple[np.ndarray, np.ndarray]], order: np.ndarray, n: int) -> np.ndarray:
    """Distance of each row to a query's order; a pivot that is missing in one counts as at rank `depth`."""
    depth = len(order)
    out = np.full(n, depth * (depth + 1), np.int32)
    for rank, pivot in enumerate(order):
        rows, there = files[pivot]
        out[rows] -= 2 * (depth - np.maximum(there, rank))
    return out


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that their largest component is near 1: squares neither overflow nor vanish, and cosines keep their bits."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    x, q = scaled(x), scaled(q)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def search(spark: SparkSession, vectors: DataFrame, every: int = 50, k: int = K, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest other rows found.

    Ties go to the smaller vec_id. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids; vectors
    of another width than the query's have nothing to compare and aren't found. An id is found once: of rows with one vec_id the
    nearest counts, and as a query its rows ask together. An empty table gives no rows; other columns are not read.
    Segments with at most LEAST rows, and widths that the sample has not shown, are compared exactly.
    """
    rows = materialize(valid(vectors), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MAX_SAMPLE).select("v").collect()
    kind = "query_id long, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots: dict[int, np.ndarray] = {}
    for width in {len(r.v) for r in sample}:
        distinct = list({tuple(r.v): None for r in sample if len(r.v) == width})[:PIVOTS]
        x = unit(distinct)
        pivots[width] = x / np.linalg.norm(x, axis=1, keepdims=True)
    queries = rows.where(F.col("vec_id") % every == 0).withColumn("width", F.size("v"))
    n_rows, n_queries = rows.count(), queries.count()
    segments, query_blocks = -(-n_rows // SEGMENT_ROWS), max(1, -(-n_queries // BLOCK_QUERIES))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(max(1, n))).cast("int")
    index = classes(rows, k + 1).select(block("first", segments).alias("segment"), F.size("v").alias("width"), "v", "ids")
    index = materialize(index.groupBy("segment", "width").applyInPandas(posted(pivots), FILES), "index")
    left = index.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("qb", block("vec_id", query_blocks)).withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(max(1, segments) - 1))))

    def compare(key, part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if part.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        width = key[2]
        held = part[part["pivot"] == -1].iloc[0]
        x = scaled(np.frombuffer(held.vectors, np.float64).reshape(-1, width))
        lengths, ids = np.sqrt((x * x).sum(axis=1)), held.ids
        q = scaled(np.array(asked.v.tolist(), np.float64))
        keep = max(LEAST, int(np.ceil(share * len(x))))
        p = pivots.get(width)
        near = p is not None and len(x) > keep
        if near:
            posts = part[part["pivot"] >= 0]
            files = {i: (np.frombuffer(r, np.int32), np.frombuffer(t, np.int16)) for i, r, t in zip(posts["pivot"], posts["rows"], posts["ranks"])}
            orders = ranks(unit(q), p)
        out = []
        for i, query in enumerate(asked.vec_id):
            at = np.arange(len(x))
            if near:
                far = footrule(files, orders[i], len(x))
                at = np.flatnonzero(far <= np.partition(far, keep - 1)[keep - 1])
            score = (x[at] * q[i]).sum(axis=1) / (lengths[at] * np.sqrt((q[i] * q[i]).sum()))
            found: dict[int, float] = {}
            for j in np.argsort(-score, kind="stable"):
                if len(found) >= k and score[j] < last:
                    break
                for v in ids[at[j]]:
                    if v != query:
                        found.setdefault(v, score[j])
                last = score[j]
            out += [(query, v, s) for s, v in sorted((-s, v) for v, s in found.items())[:k]]
        return pd.DataFrame([(a, b, -s) for a, b, s in out], columns=["query_id", "vec_id", "score"])

    keys = ["qb", "segment", "width"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, kind).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "embeddings"))
