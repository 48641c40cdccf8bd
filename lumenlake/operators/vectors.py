"""Term vectors: word n-grams with sublinear counts, smooth inverse document frequency and unit length."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored

#: Letters of these blocks lose their accents: Latin-1 to Latin Extended-B, and Latin Extended Additional.
ACCENTED = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]


def folded(text: Column) -> Column:
    """Letters without accents: those that decompose into one letter and marks become that letter, marks on their own go."""
    pairs = [(chr(c), base) for c in ACCENTED if len(base := "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))) == 1 and base != chr(c)]
    marks = "".join(map(chr, range(0x300, 0x370)))
    return F.translate(text, "".join(c for c, _ in pairs) + marks, "".join(base for _, base in pairs))


def word_lists(df: DataFrame, key: str, text: str, stop: tuple[str, ...] = (), fold: bool = False) -> DataFrame:
    """key, w: the lower-case words of two or more letters or digits, without accents and stop words."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    words = df.select(key, F.regexp_extract_all(folded(plain) if fold else plain, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)).alias("w"))
    if stop:
        words = words.withColumn("w", F.filter("w", lambda x: ~x.isin(*stop)))
    return words


def terms(df: DataFrame, key: str, text: str, stop: tuple[str, ...] = (), fold: bool = False) -> DataFrame:
    """key, term: lower-case words of two or more letters or digits, and pairs of neighbouring ones. Accents go first, stop words before pairs are made."""
    words = word_lists(df, key, text, stop, fold)
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return words.select(key, F.explode(F.concat("w", pairs)).alias("term"))


def char_terms(df: DataFrame, key: str, text: str, low: int = 3, high: int = 5) -> DataFrame:
    """key, term: substrings of low to high letters of each lower-case word with a space on both sides; a padded word that is no longer than n is its own last term."""
    padded = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    words = df.select(key, F.explode(padded).alias("w"))

    def grams(n: int) -> Column:
        longer = F.length("w") > n
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - n + 1, F.lit(1))), lambda i: F.substr(F.col("w"), i, F.lit(n)))
        first = (F.length("w") == n) if n > low else (F.length("w") <= n)
        return F.when(longer, cut).when(first, F.array("w")).otherwise(F.array().cast("array<string>"))

    return words.select(key, F.explode(F.concat(*map(grams, range(low, high + 1)))).alias("term"))


def counted_in_place(df: DataFrame, key: str, text: str, stop: tuple[str, ...] = (), fold: bool = False) -> DataFrame:
    """key, term, tf, where no two rows have one key: the terms of a row are counted where it is."""

    def of(batches):
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.iloc[at : at + 200]
                found = [Counter([*w, *map(" ".join, zip(w, w[1:]))]) for w in map(list, part.w)]
                yield pd.DataFrame({key: part[key].repeat([len(c) for c in found]).to_numpy(), "term": pd.Series([t for c in found for t in c], dtype=object), "tf": pd.Series([n for c in found for n in c.values()], dtype="int64")})

    return word_lists(df, key, text, stop, fold).mapInPandas(of, f"`{key}` {df.schema[key].dataType.simpleString()}, term string, tf long")


def tf_idf(df: DataFrame, key: str, text: str, min_df: int = 2, max_terms: int = 20_000, stop: tuple[str, ...] = (), fold: bool = False) -> DataFrame:
    """key, term, place, weight. The vocabulary is the max_terms most frequent terms that min_df or more rows hold (ties: the smaller term); as it is bounded, it is broadcast.

    place numbers the vocabulary from the rarest term on. Rows with one key count as one text; where there are none, only sums by term and the
    vocabulary's terms are shuffled. Rows without a term of the vocabulary give nothing.
    """
    if df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty():
        counts = counted_in_place(df, key, text, stop, fold)
    else:
        counts = terms(df, key, text, stop, fold).groupBy(key, "term").agg(F.count("*").alias("tf"))
    vocabulary = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df).orderBy(F.desc("total"), "term").limit(max_terms)
    vocabulary = stored(vocabulary.withColumn("place", F.row_number().over(Window.orderBy("df", "term"))), "vocabulary")  # max_terms rows
    n = df.agg(F.count("*").alias("n"))
    raw = (1 + F.log(F.col("tf").cast("double"))) * (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1)
    held = counts.join(F.broadcast(vocabulary.select("term", "place")), "term").select(key, "place", F.col("tf").cast("int")).repartition(key)
    weighed = held.join(F.broadcast(vocabulary), "place").crossJoin(F.broadcast(n)).select(key, "term", "place", raw.alias("raw"))  # n: one row
    return weighed.select(key, "term", "place", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))).alias("weight"))


#: Terms are summed in so many buckets of their hashes, which tasks hand on in parts.
BUCKETS, BUCKET_PARTS = 1 << 20, 16
#: Words that are worked on at once.
SLICE = 500_000
#: xxhash64 of null, which stands between the texts of one key.
GAP = 42


def _slices(batches, columns: tuple[str, ...] = ()):
    """Hashes of words (column h), the row of each and the named columns: a few rows at a time."""
    for b in batches:
        lists = b.column("h")
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        at = 0
        while at < len(b):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
            yield flat[ends[at] : ends[to]], np.repeat(np.arange(to - at), np.diff(ends[at : to + 1])), [b.column(c).slice(at, to - at) for c in columns]
            at = to


def _hashed(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first and second word (GAP: none) of each term: words, and pairs of neighbours."""
    word = h != GAP
    pair = (row[1:] == row[:-1]) & word[1:] & word[:-1]
    a, b = h[:-1][pair], h[1:][pair]
    t = a * np.uint64(0x9E3779B97F4A7C15) + b
    t = (t ^ (t >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    t ^= t >> np.uint64(32)
    one = h[word]
    return np.concatenate([one, t]), np.concatenate([row[word], row[:-1][pair]]), np.concatenate([one, a]), np.concatenate([np.full(len(one), GAP, np.uint64), b])


def _bucket(t: np.ndarray) -> np.ndarray:
    return ((t * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - (BUCKETS.bit_length() - 1))).astype(np.int64)


def _bucket_sums(words: DataFrame) -> np.ndarray:
    """How many terms fall in each bucket: as many as each of its terms has, or more."""
    width = BUCKETS // BUCKET_PARTS

    def of(batches):
        sums = np.zeros(BUCKETS, np.int64)
        for h, row, _ in _slices(batches):
            sums += np.bincount(_bucket(_hashed(h, row)[0]), minlength=BUCKETS)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(BUCKET_PARTS), pa.int32()), "sums": [sums[k * width : (k + 1) * width].tobytes() for k in range(BUCKET_PARTS)]})

    def total(key, batches):
        sums = np.zeros(width, np.int64)
        for b in batches:
            for x in b.column("sums"):
                sums += np.frombuffer(x.as_buffer(), np.int64)
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "sums": [sums.tobytes()]})

    parts = words.mapInArrow(of, "part int, sums binary").groupBy("part").applyInArrow(lambda key, t: pa.Table.from_batches(total(key, t.to_batches())), "part int, sums binary").collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in parts:
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r.sums, np.int64)
    return out


def _merged(parts: list[dict]) -> dict:
    found = {c: np.concatenate([p[c] for p in parts]) for c in ("t", "a", "b", "df", "total")}
    t, at, where = np.unique(found["t"], return_index=True, return_inverse=True)
    sums = {c: np.bincount(where, found[c], len(t)).astype(np.int64) for c in ("df", "total")}
    return {"t": t, "a": found["a"][at], "b": found["b"][at]} | sums | {"of": pa.concat_arrays([p["of"] for p in parts]).take(pa.array(at))}


def _counted(words: DataFrame, chosen: np.ndarray) -> DataFrame:
    """t, a, b, df, total of the terms in the chosen buckets, and one row (of) that holds it."""
    packed, kind = np.packbits(chosen), words.schema["of"].dataType.simpleString()

    def counted(batches):
        kept, parts = np.unpackbits(packed).astype(bool), []
        for h, row, (of,) in _slices(batches, ("of",)):
            t, row, a, b = _hashed(h, row)
            at = np.flatnonzero(kept[_bucket(t)])
            if not len(at):
                continue
            t, row, a, b, rows = t[at], row[at], a[at], b[at], len(of)
            u, first, where, n = np.unique(t, return_index=True, return_inverse=True, return_counts=True)
            held = np.sort(where * rows + row)
            held = held[np.r_[True, held[1:] != held[:-1]]] // rows
            parts.append({"t": u, "a": a[first], "b": b[first], "df": np.bincount(held), "total": n, "of": of.take(pa.array(row[first]))})
            if len(parts) > 1 and sum(len(p["t"]) for p in parts[1:]) > max(SLICE, len(parts[0]["t"])):
                parts = [_merged(parts)]
        if parts:
            found = _merged(parts)
            for at in range(0, len(found["t"]), 20_000):
                yield pa.RecordBatch.from_pydict({c: v[at : at + 20_000] if c == "of" else v[at : at + 20_000].view(np.int64) for c, v in found.items()})

    each = words.mapInArrow(counted, f"t long, a long, b long, df long, total long, of {kind}")
    return each.groupBy("t").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.sum("df").alias("df"), F.sum("total").alias("total"), F.min("of").alias("of"))


def frequent_terms(hashed: DataFrame, min_df: int, max_terms: int, texts: DataFrame, split: Callable[[DataFrame], DataFrame]) -> pd.DataFrame:
    """t (hash), df of the max_terms most frequent terms that min_df or more rows hold (ties: the smaller term). hashed: of, h, the words' hashes; texts: the rows (of) that split() makes words (w) of.

    Only terms of buckets that reach a bound are counted one by one: all that reach it by themselves are among them, so once max_terms do,
    the most frequent ones are; until then the bound falls, down to 1. Terms are told apart by hashes of 64 bits.
    """
    sums, wanted = _bucket_sums(hashed), 2 * max_terms
    while True:
        bound = max(int(np.partition(sums, BUCKETS - wanted)[BUCKETS - wanted]), 1) if wanted < BUCKETS else 1
        found = stored(_counted(hashed, sums >= bound).where((F.col("df") >= min_df) & (F.col("total") >= bound)), "terms")
        n = found.count()
        if n >= max_terms or bound == 1:
            break
        wanted *= 4
    if n <= max_terms:
        return found.select("t", "df").toPandas()
    last = found.orderBy(F.desc("total")).limit(max_terms).agg(F.min("total")).first()[0]
    sure = found.where(F.col("total") > last).select("t", "df").toPandas()
    tied = stored(found.where(F.col("total") == last), "tied")
    needed = tied.select(F.explode(F.array("a", "b")).alias("i")).distinct()
    id_of = F.to_json(F.struct("of.id"))
    named = stored(texts.withColumn("key", id_of).join(tied.select(id_of.alias("key")).distinct(), "key", "left_semi"), "texts")  # a row for each term; else all texts would be split first
    names = split(named).select(F.explode("w").alias("x")).select("x", F.xxhash64("x").alias("i")).join(needed, "i", "left_semi").groupBy("i").agg(F.min("x").alias("x"))
    names = stored(names, "names")
    tied = tied.join(names.select(F.col("i").alias("a"), F.col("x").alias("x")), "a").join(names.select(F.col("i").alias("b"), F.col("x").alias("y")), "b", "left")
    return pd.concat([sure, tied.orderBy(F.concat_ws(" ", "x", "y")).limit(max_terms - len(sure)).select("t", "df").toPandas()])


def term_vectors(df: DataFrame, key: str, text: str, group: str, min_df: int, max_terms: int, stop: tuple[str, ...] = (), fold: bool = False) -> tuple[DataFrame, np.ndarray]:
    """(id, g, copies, n, places, counts; the inverse document frequency by place): tf_idf() in one row for each key and group.

    n terms at places (from the rarest term on) and how often each occurs, both as bytes of integers as long as needed. copies: rows of this key and group. Keys of
    null and rows without a term of the vocabulary give nothing. No term is shuffled, only sums of buckets and of frequent terms.
    """
    plain = df.select(F.struct(F.col(key).alias("id"), F.col(group).alias("g")).alias("of"), F.col(text).alias("text"))
    split = lambda rows: word_lists(rows, "of", "text", stop, fold)
    words = split(plain)
    if repeated := not df.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).isEmpty():
        words = words.groupBy("of.id").agg(F.flatten(F.collect_list(F.concat("w", F.array(F.lit(None).cast("string"))))).alias("w")).select(F.struct("id").alias("of"), "w")
    hashed = stored(words.select("of", F.transform("w", lambda x: F.xxhash64(x)).alias("h")), "words", "zstd", **{"parquet.dictionary.page.size": 8 << 20})
    terms = frequent_terms(hashed, min_df, max_terms, plain, split).sort_values(["df", "t"])
    order = np.argsort(terms["t"].to_numpy().view(np.uint64))
    known, place = terms["t"].to_numpy().view(np.uint64)[order], order.astype(np.int64)
    n = df.count()
    idf = np.log((1.0 + n) / (1.0 + terms["df"].to_numpy().astype(float))) + 1

    def listed(batches):
        held, size = np.zeros(BUCKETS, bool), np.uint16 if len(known) <= 1 << 16 else np.int32
        held[_bucket(known)] = True
        for h, row, (of,) in _slices(batches, ("of",)):
            t, row, _, _ = _hashed(h, row)
            at = np.flatnonzero(held[_bucket(t)])
            t, row = t[at], row[at]
            k = np.searchsorted(known, t)
            at = np.flatnonzero((k < len(known)) & (known[np.minimum(k, len(known) - 1)] == t)) if len(t) else k
            if not len(at):
                continue
            both, tf = np.unique(row[at] * len(known) + place[k[at]], return_counts=True)
            row, where = both // len(known), (both % len(known)).astype(size)
            rows, begin, n = np.unique(row, return_index=True, return_counts=True)
            counts = [tf[i : i + m].astype(np.min_scalar_type(tf[i : i + m].max()) if tf[i : i + m].max() < 1 << 16 else np.int32).tobytes() for i, m in zip(begin, n)]
            yield pa.RecordBatch.from_pydict({"of": of.take(pa.array(rows)), "n": pa.array(n.astype(np.int32)), "places": pa.array([where[i : i + m].tobytes() for i, m in zip(begin, n)], pa.binary()), "counts": pa.array(counts, pa.binary())})

    found = hashed.where("of.id is not null").mapInArrow(listed, f"of {words.schema['of'].dataType.simpleString()}, n int, places binary, counts binary").select("of.*", "n", "places", "counts")
    if not repeated:
        return found.withColumn("copies", F.lit(1).cast("long")), idf
    return found.join(plain.groupBy("of.id", "of.g").agg(F.count("*").alias("copies")), "id"), idf
