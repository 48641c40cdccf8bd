"""Best-fit packing by large-item matching over the histogram of lengths.

Documents above a third of the capacity pair at most twice per bin by greedy matching (largest first, with
the largest partner that still fits); smaller ones best-fit the remaining gaps. Because lengths are integers up
to the capacity, the plan needs only the number of pieces of each length: at most `capacity` rows reach the
driver whatever the corpus size. A plan is a list of intervals of ranks among the pieces of one length; a piece
finds its sequence from its rank alone. Ranks come from counts per (length, bucket), so that a length held by
a third of all rows is still spread over all tasks.
"""

from __future__ import annotations

import bisect
import gc
import os
import re
import struct
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import Memo, materialize, small_batches, table

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 0
#: Rows per (length, bucket) window partition are about this, or fewer.
BUCKET_ROWS = 4096


class Chunks:
    """Ids by the tokenizers library, kept by chunk without white space and by piece: no token of this vocabulary crosses either.

    A piece that is not yet known goes straight to the library's merges; chunks beyond Latin letters go to the library as they are.
    """

    odd = frozenset("\x1c\x1d\x1e\x1f")  # white space to str.split() only
    #: Texts and chunks of these characters keep to them in lower case and under NFC.
    latin = re.compile("[\t-\r\x20-\x7e\xa1-\u012f\u0131-\u017f]*")
    pieces = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z0-9\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xdf-\xf6\xf8-\u017f]+")

    def __init__(self, path: str, bound: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.of_chunk, self.of_piece = Memo(self.whole, bound // 4), Memo(self.merged, bound)
        gc.set_threshold(200_000, 20, 100)  # the caches hold strings only

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, piece: str) -> bytes:
        ids = [t.id for t in self.tokenizer.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str) -> np.ndarray:
        if self.latin.fullmatch(text) and not any(x in text for x in self.special):
            found = map(self.of_piece.__getitem__, self.pieces.findall(text.lower()))
        elif self.odd.isdisjoint(text):
            found = map(self.of_chunk.__getitem__, text.split())
        else:
            found = [self.whole(text)]
        return np.frombuffer(b"".join(found), "<u4")


def cut(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids, if kept). Null text counts as empty."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def pieces(batches):
        chunks = Chunks(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.doc_id, batch.text):
                ids = np.append(chunks.ids(text or ""), np.uint32(END_ID)).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes())) + ((part.astype("int32"),) if keep_ids else ()))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in kind.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(pieces, kind)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Intervals (first rank, number, first sequence, offset) for each length, and the number of sequences."""
    left, taken, out = dict(counts), defaultdict(int), defaultdict(list)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: (first sequence, number)
    n_bins = 0

    def put(length: int, first: int, number: int, offset: int) -> None:
        out[length].append((taken[length], number, first, offset))
        taken[length] += number
        left[length] -= number

    large = sorted(x for x in left if 3 * x > capacity and left[x] > 0)
    for length in reversed(large):
        while left[length] > 0:
            at = bisect.bisect_right(large, min(capacity - length, length)) - 1
            while at >= 0 and (left[large[at]] <= 0 or large[at] == length and left[length] < 2):
                at -= 1
            if at < 0:
                n = left[length]
                put(length, n_bins, n, 0)
                gaps[capacity - length].append((n_bins, n))
            else:
                mate = large[at]
                n = left[length] // 2 if mate == length else min(left[length], left[mate])
                put(length, n_bins, n, 0)
                put(mate, n_bins, n, length)
                gaps[capacity - length - mate].append((n_bins, n))
            n_bins += n
    open_gaps = sorted(g for g in gaps if g > 0)
    for length in sorted((x for x in left if 3 * x <= capacity and left[x] > 0), reverse=True):
        while left[length] > 0:
            at = bisect.bisect_left(open_gaps, length)
            if at == len(open_gaps):
                n = -(-left[length] // (capacity // length))
                gap, first = capacity, n_bins
                n_bins += n
            else:
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    open_gaps.pop(at)
            use = min(n, left[length])
            put(length, first, use, capacity - gap)
            for g, a, m in ((gap - length, first, use), (gap, first + use, n - use)):
                if g > 0 and m > 0:
                    if not gaps[g]:
                        bisect.insort(open_gaps, g)
                    gaps[g].append((a, m))
    return out, n_bins


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Packs whole documents into sequences of at most `capacity` ids.

    Each document is its ids and END_ID; only longer ones are cut. Returns doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and ids). Null or empty text: one piece with END_ID alone. An empty table gives no rows;
    repeated rows are packed once each; further columns of docs are not read.
    """
    small_batches(spark)
    pieces = materialize(cut(docs, path or public_tokenizers.path(VOCABULARY), capacity, keep_ids), "pieces")
    histogram = {r.length: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    intervals, _ = plan(histogram, capacity)
    arrays = {k: np.array(v, np.int64).T for k, v in intervals.items()}
    buckets = max(64, -(-max(histogram.values(), default=0) // BUCKET_ROWS))
    by_bucket = ["length", "bucket"]
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy(*by_bucket).agg(F.count("*").alias("n"))
    before = counts.select(*by_bucket, (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*by_bucket).orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("rank", rank).join(before, by_bucket).withColumn("rank", F.col("rank") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def place(batches):
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for length, rows in batch.groupby("length").indices.items():
                first, _, bins, offsets = arrays[int(length)]
                r = batch["rank"].to_numpy()[rows]
                k = np.searchsorted(first, r, side="right") - 1
                sequence[rows], offset[rows] = bins[k] + r - first[k], offsets[k]
            yield batch[names].assign(doc_id=batch.doc_id.astype("Int64"), sequence_id=sequence, offset=offset)

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInPandas(place, kind)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, table(spark, sf_dir, "documents"))
