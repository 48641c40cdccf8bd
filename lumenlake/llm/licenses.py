"""License scans by diagonal voting.

All rolling word 2-gram hashes of all documents are joined to the positions of 2-grams in license templates; a match
votes for the diagonal (its place in the document less its place in the template). Votes are collected by diagonal, each template
place once. Neighbouring diagonals, at most DRIFT apart in all, are merged (a word more or less moves the rest by one), and a span is verified when it
has the votes that missing words leave: its matches are aligned with the template in order, and the words that align
are counted. A base phrase needs all of its grams on one diagonal; a notice may miss one word in MISSING. A second,
independent hash of each gram is compared in the join, so that matches are equal word by word.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, small_batches, table, utf8

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices of public licenses, and the labels they add.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this work is licensed under the gnu general public license version": "gnu-gpl",
    "licensed under cc by nc": "cc-by-nc",
    "this work is licensed under a creative commons attribution": "creative-commons",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu": "gnu-gpl",
}
#: A notice of n words may miss n // MISSING of them.
MISSING = 8
DRIFT = 3

#: A-Z to lower case; all other ASCII but digits and a-z to a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(WORDS).split()


def gram_hashes(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rolling hash of the 2-gram at each place, and the check value."""
    h = first[:-1] * np.uint64(0x9E3779B97F4A7C15) + first[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    c = second[:-1] * np.uint64(0x165667B19E3779F9) + second[1:] * np.uint64(0x27D4EB2F165667C5)
    return h.view(np.int64), c.view(np.int64)


def _pair(word: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(word, 1), xxhash.xxh64_intdigest(word, 2)


def grams(docs: DataFrame) -> DataFrame:
    """doc_id, row (tells repeated ids apart), pos, gram, proof; and for each row of docs pos -1 with the number of words in gram."""

    def of(batches):
        first, second = Memo(lambda w: xxhash.xxh64_intdigest(w, 1)), Memo(lambda w: xxhash.xxh64_intdigest(w, 2))
        for b in batches:
            for at in range(0, len(b), 64):
                rows = [words_of(t) for t in b.text.iloc[at : at + 64]]
                sizes = np.array([len(w) for w in rows])
                every = [w for words in rows for w in words]
                n = len(every)
                a = np.fromiter(map(first.__getitem__, every), np.uint64, n)
                c = np.fromiter(map(second.__getitem__, every), np.uint64, n)
                which = np.repeat(np.arange(len(rows)), sizes)
                pos = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = which[:-1] == which[1:] if n else np.zeros(0, bool)
                gram, proof = gram_hashes(a, c) if n else (np.zeros(0, np.int64),) * 2
                which = np.concatenate([which[:-1][keep], np.arange(len(rows))])
                ids, row = b.doc_id.iloc[at : at + 64].astype("Int64"), b.row.to_numpy()[at : at + 64]
                none = np.zeros(len(rows), np.int64)
                yield pd.DataFrame({"doc_id": ids.iloc[which].reset_index(drop=True), "row": row[which], "pos": np.concatenate([pos[:-1][keep], none - 1]), "gram": np.concatenate([gram[keep], sizes]), "proof": np.concatenate([proof[keep], none])})

    source = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text")
    return source.mapInPandas(of, "doc_id long, row long, pos long, gram long, proof long")


def templates(spark: SparkSession, base: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """A few hundred rows: one per 2-gram of a template. Templates have two words or more."""
    rows = []
    for k, (phrase, label) in enumerate([*base.items(), *notices.items()]):
        words = words_of(phrase)
        first, second = (np.array([xxhash.xxh64_intdigest(w, s) for w in words], np.uint64) for s in (1, 2))
        for at, (gram, proof) in enumerate(zip(*gram_hashes(first, second))):
            rows.append((k, label, k < len(base), len(words), at, int(gram), int(proof)))
    return spark.createDataFrame(rows, "template int, label string, base boolean, size int, at int, t_gram long, t_proof long")


def aligned_words(pairs: list[tuple[int, int]]) -> int:
    """Of matched 2-grams (place in the document, place in the template): the most template words that one chain, rising in both, covers."""
    pairs = sorted(set(pairs))
    best = []
    for i, (pos, at) in enumerate(pairs):
        words = 2
        for j in range(i):
            if pairs[j][0] < pos and pairs[j][1] < at:
                words = max(words, best[j] + (1 if pairs[j][1] == at - 1 else 2))
        best.append(words)
    return max(best, default=0)


def scan(spark: SparkSession, docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest share of a template's words that a verified span holds; 0 without one. Templates have two words or more. Null text: no
    words. Rows with equal ids stay apart, null ids stay. An empty table gives no rows; other columns are not read.
    """
    small_batches(spark)
    t = F.broadcast(templates(spark, BASE if base is None else base, NOTICES if notices is None else notices))
    found = grams(docs).join(t, (F.col("gram") == F.col("t_gram")) & (F.col("proof") == F.col("t_proof")) & (F.col("pos") >= 0), "left").where("pos < 0 or template is not null")
    key = ["doc_id", "row"]
    votes = found.groupBy(*key, "template", "label", "base", "size", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.max(F.when(F.col("pos") < 0, F.col("gram"))).alias("n_words"), F.collect_set("at").alias("places")  # at most a template's places
    )
    ahead = Window.partitionBy(*key, "template").orderBy("diagonal").rangeBetween(0, DRIFT)
    near = F.when(F.col("template").isNotNull(), F.flatten(F.collect_list(F.transform("places", lambda at: F.struct((F.col("diagonal") + at).alias("pos"), at.alias("at")))).over(ahead)))
    spans = votes.withColumn("pairs", F.when(~F.col("base"), near))
    missing = F.floor(F.col("size") / MISSING)
    # runs of aligned words have two words or more, and a run of n has n - 1 votes
    likely = 2 * F.size(F.array_distinct(F.transform("pairs", lambda p: p["at"]))) >= F.col("size") - missing

    @F.pandas_udf("int")
    def aligned(column: pd.Series) -> pd.Series:
        return pd.Series([0 if pairs is None else aligned_words([(p["pos"], p["at"]) for p in pairs]) for pairs in column])

    words = F.when(F.col("base"), F.when(F.size("places") == F.col("size") - 1, F.col("size")).otherwise(0)).otherwise(F.coalesce(aligned(F.when(likely, F.col("pairs"))), F.lit(0)))
    spans = spans.withColumn("words", words).withColumn("ok", F.col("words") >= F.when(F.col("base"), F.col("size")).otherwise(F.col("size") - missing))
    is_base = F.col("ok") & F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")  # noqa: E731  at most as many as there are labels
    per_row = spans.groupBy(*key).agg(
        F.max("n_words").alias("n_words"), F.sum(is_base.cast("long")).alias("n_base"),
        F.min(F.when(is_base, F.col("diagonal"))).alias("first_word"), F.max(F.when(is_base, F.col("diagonal"))).alias("last_word"),
        joined(is_base).alias("base_labels"), joined(F.col("ok")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("ok"), F.col("words") / F.col("size"))), F.lit(0.0)).alias("score"),
    )
    return per_row.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", "base_labels", "labels", "score")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))
