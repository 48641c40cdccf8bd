"""SimHash near-duplicates, found with anchor points of a covering code.

The 64 bits are two halves; of two fingerprints that differ in at most three bits, one half differs in at most
one. Anchors of a half are the words of the perfect [31, 26] Hamming code with the 32nd bit as it is: covering
radius 1 (threshold of a half: 1). A fingerprint is at home at the one anchor within the radius, and is replicated
to every anchor within radius + 1; so a pair meets where the smaller one is at home. Only distinct
fingerprints are compared, and only real links leave the join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_classes, materialize, small_batches, table, utf8

SHINGLE = 3
THRESHOLD = 3
SEED = 42


def fingerprint(text: str | None) -> int:
    words = utf8(text).lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    h = np.fromiter((digest(join(words[i : i + SHINGLE]), SEED) for i in range(n)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = h[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def of(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.text], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "fp": fp})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(of, "doc_id long, fp long")


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Of the lower 31 bits: the exclusive or of the places (1 to 31) that are set."""
    out = np.zeros(len(half), np.uint64)
    for place in range(1, 32):
        out ^= ((half >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
    return out


def _flip(half: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Flips the bit at place (1 to 31); 0 flips none."""
    return half ^ np.where(place > 0, np.uint64(1) << (np.maximum(place, np.uint64(1)) - np.uint64(1)), np.uint64(0))


def anchors(half: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The home anchor of each half, and all anchors within radius + 1 (the home first)."""
    s = _syndrome(half)
    home = _flip(half, s)
    near = [home, home ^ np.uint64(1 << 31)]
    for i in range(1, 32):  # code words at distance 2: flip i and j with i xor j = syndrome
        j = s ^ np.uint64(i)
        word = _flip(_flip(half, np.full(len(half), i, np.uint64)), j)
        near.append(np.where((s > 0) & (j > i), word, home))
    return home, near


def posts(fps: DataFrame, home_only: bool = False) -> DataFrame:
    """Rows (anchor, fp) for each half: the home alone, or all anchors within radius + 1. Bit 32 of the anchor is the half."""

    def of(batches):
        for b in batches:
            fp = b.fp.to_numpy(np.int64).view(np.uint64)
            for k in (0, 1):
                half = (fp >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF)
                home, near = anchors(half)
                tag = np.uint64(k << 32)
                for i, word in enumerate(near[:1] if home_only else near):
                    keep = np.ones(len(fp), bool) if i < 2 else word != home
                    yield pd.DataFrame({"anchor": (word | tag)[keep].view(np.int64), "fp": b.fp.to_numpy()[keep]})

    return fps.select("fp").mapInPandas(of, "anchor long, fp long")


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs a < b of distinct fingerprints with at most `threshold` (3 or fewer) differing bits."""
    if threshold > 3:
        raise ValueError("two halves cover at most three differing bits")
    home = posts(fps, home_only=True).withColumnRenamed("fp", "a")
    all_ = posts(fps).withColumnRenamed("fp", "b")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return home.join(all_.hint("merge"), (home.anchor == all_.anchor) & close).select("a", "b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node of an edge, by alternating large and small stars.

    Each round pre-aggregates minima before the shuffle and is written to the shared folder; what the round before wrote goes.
    Joins are merges: below Spark's threshold each round would broadcast its minima through the driver, which keeps them for long.
    """
    edges = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        previous, edges = edges, materialize(small, "edges")
        discard(previous)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable by links, itself included.

    Texts without words (null, empty) have fingerprint zero and are linked like any other. Repeated rows stay; a
    null doc_id takes part and never is the smallest unless alone. An empty table gives no rows. Other columns are not read.
    """
    small_batches(spark)
    rows = materialize(fingerprints(docs), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    roots = components(links(fps))
    grouped = materialize(fps.join(roots.hint("merge"), fps.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "roots")
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("m"))
    classes = materialize(join_classes(grouped, least, "root", "m", fps.count()).select("fp", "n", "component_id"), "classes")
    return join_classes(rows, classes, "fp", "n", rows.count()).select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
