"""Phrase collocations by dynamic itemset counting.

The texts are written once as chunks of numbered words, dealt to SHARDS shards. Shards are scanned in turn, round and round. Single words are counted
from the first step on. A longer phrase becomes active at the step after both of its subphrases (without its last, and without its first word) have been counted
often enough, whatever is still to come of their own cycle; it is counted in the next SHARDS steps, each shard once. So phrases of all lengths are
counted side by side, and the scans end once no phrase has become active for a cycle. A phrase that occurs often enough is always found, as
its subphrases occur as often.

Which phrases have reached the threshold is held in a Bloom filter of a fixed number of bits (at most MAX_BITS, so its broadcast is bounded). Bits are
only added, so a phrase is active from the first step at which the filter holds both subphrases, for all tasks alike; it is
active at a step if the filter holds them now and did not SHARDS steps ago. A phrase that the filter holds by mistake is counted and then
dropped, as it does not occur often enough. Phrases are counted by KEY_BITS of their 64-bit hashes; those found are then counted by
their words, so no result rests on a hash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import discard, materialize, new_path, small_batches, table, utf8

LONGEST = 4
AT_LEAST = 30
SHARDS = 2
TOP = 2000
#: A candidate goes if a longer one that holds it has at least this share of its occurrences, in hundredths.
INSIDE = 80
#: A chunk ends after so many words and borders, at the end of a text.
CHUNK = 3 << 19
#: Bits of the filter: an eighth of the number of words, as a power of two, between these.
MIN_BITS, MAX_BITS = 1 << 16, 1 << 29
#: Of a phrase's hash, so many bits are shuffled and counted. Phrases that share them are counted as one, so the filter holds a few more.
KEY_BITS = 48
#: 64-bit words in a block of the filter.
BLOCK = 1 << 13

BORDER = b"."
BORDERS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", BORDER * 10)


def pieces_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case, and borders between its pieces. No word holds the border's character."""
    return utf8(text).lower().translate(BORDERS).replace(BORDER, b" . ").split()


class Codes(dict):
    """Numbers of the words of one language (the lang-th of a chunk); the lists are shared by all languages of the chunk."""

    def __init__(self, lang: int, words: list, lang_of: list):
        super().__init__({BORDER: 0})
        self.lang, self.words, self.lang_of = lang, words, lang_of

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self.lang_of.append(self.lang)
        self[word] = n = len(self.words)
        return n


def chunks(docs: DataFrame) -> DataFrame:
    """shard, n_words, tokens (numbers as 32 bits; 0 is a border), words (of the numbers from 1, joined by a space), lang_of (for each, the place of its language in langs), langs."""
    names = ["shard", "n_words", "tokens", "words", "lang_of", "langs"]

    def of(batches):
        first, nth = TaskContext.get().partitionId(), 0
        words, lang_of, codes, held, size = [], [], {}, [], 0

        def chunk():
            tokens = np.concatenate(held)
            return pd.DataFrame([((first + nth) % SHARDS, int((tokens > 0).sum()), tokens.tobytes(), b" ".join(words), np.array(lang_of, np.int32).tobytes(), list(codes))], columns=names)

        for b in batches:
            for lang, text in zip(b.lang, b.text):
                found = pieces_of(text)
                if not found:
                    continue
                if lang not in codes:
                    codes[lang] = Codes(len(codes), words, lang_of)
                held.append(np.fromiter(map(codes[lang].__getitem__, found), np.int32, len(found)))
                held.append(np.zeros(1, np.int32))
                size += len(found) + 1
                if size >= CHUNK:
                    yield chunk()
                    nth += 1
                    words, lang_of, codes, held, size = [], [], {}, [], 0
        if held:
            yield chunk()

    return docs.mapInPandas(of, "shard int, n_words long, tokens binary, words binary, lang_of binary, langs array<string>")


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def opened(batches):
    """tokens, words and languages of the numbers (0: the border), and hashes of the words in their languages, of each chunk."""
    for b in batches:
        for tokens, words, lang_of, langs in zip(b.tokens, b.words, b.lang_of, b.langs):
            words, lang_of = words.split(b" "), np.frombuffer(lang_of, np.int32)
            seeds = np.array([xxhash.xxh64_intdigest(x.encode()) for x in langs], np.uint64)[lang_of].tolist()
            keys = np.fromiter(map(xxhash.xxh64_intdigest, words, seeds), np.uint64, len(words))
            yield np.frombuffer(tokens, np.int32), np.array([b"", *words], object), np.array([None, *np.array(langs, object)[lang_of]], object), np.r_[np.uint64(0), keys]


class Filter:
    """A Bloom filter with two bits a key."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = keys >> np.uint64(64 - KEY_BITS)
        return (keys & self.mask).astype(np.int64), (keys >> np.uint64(KEY_BITS - int(self.mask).bit_length()) & self.mask).astype(np.int64)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        p, q = self.places(keys)
        return (self.bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool) & (self.bits[q >> 3] >> (q & 7).astype(np.uint8) & 1).astype(bool)


def levels(tokens: np.ndarray, keys: np.ndarray, reached: np.ndarray):
    """For each length n from 1: the places of phrases both of whose subphrases the filter holds, and the keys of the phrases there.

    reached: bits of the filter. The keys of longer phrases are made of those of their subphrases.
    """
    held = Filter(reached)
    at, key = np.flatnonzero(tokens), keys[tokens[tokens > 0]]
    yield at, key
    frequent = np.concatenate([[False], held.holds(keys[1:])])[tokens[at]]
    for n in range(2, LONGEST + 1):
        at, key = at[frequent], key[frequent]
        next_to = np.flatnonzero(at[1:] == at[:-1] + 1)
        at, key = at[next_to], mixed(key[next_to] * np.uint64(0x9E3779B97F4A7C15) + mixed(key[next_to + 1] + np.uint64(n)))
        yield at, key
        frequent = held.holds(key)


def scanned(chunked: DataFrame, step: int, now, before) -> DataFrame:
    """key, n: the phrases that are active at the step, counted by chunk. now, before: broadcast filters of this step and of a cycle ago."""

    def of(batches):
        for tokens, _, _, keys in opened(batches):
            found = []
            ended = levels(tokens, keys, before.value) if before.value.any() else None
            for n, (at, key) in enumerate(levels(tokens, keys, now.value), 1):
                past = next(ended)[0] if ended else at[:0]
                if n > 1:
                    found.append(key[~np.isin(at, past, assume_unique=True)] if len(past) else key)
                elif step < SHARDS:
                    found.append(key)
            distinct, counts = np.unique(np.concatenate(found) >> np.uint64(64 - KEY_BITS), return_counts=True)
            yield pd.DataFrame({"key": distinct.view(np.int64), "n": counts})

    return chunked.select("tokens", "words", "lang_of", "langs").mapInPandas(of, "key long, n long")


@F.pandas_udf(BinaryType())
def _block(words: pd.Series, bits: pd.Series) -> bytes:
    out = np.zeros(BLOCK, np.uint64)
    out[words.to_numpy(np.int64) % BLOCK] = bits.to_numpy(np.int64).view(np.uint64)
    return out.tobytes()


def added(keys: DataFrame, bits: np.ndarray) -> np.ndarray:
    """The filter with the keys. Its blocks are put together by tasks and come to the driver as bytes, a partition at a time: never more than the filter."""
    mask = 8 * len(bits) - 1
    places = F.explode(F.array(F.col("key").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("key", KEY_BITS - mask.bit_length()).bitwiseAND(F.lit(mask))))
    words = keys.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    blocks = words.groupBy(F.floor(F.col("word") / BLOCK).alias("block")).agg(_block("word", "bits").alias("bits"))
    out = bits.copy().view(np.uint64)
    for row in blocks.toLocalIterator():
        part = out[row.block * BLOCK : (row.block + 1) * BLOCK]
        part |= np.frombuffer(row.bits, np.uint64)[: len(part)]
    return out.view(np.uint8)


def frequent(chunked: DataFrame, at_least: int = AT_LEAST) -> np.ndarray:
    """The bits of a filter that holds all phrases (and a few others) that occur at_least times, by cyclic scans of the shards."""
    context = chunked.sparkSession.sparkContext
    n_words = chunked.agg(F.sum("n_words")).first()[0] or 0
    size = MIN_BITS
    while size < min(MAX_BITS, n_words // 8):
        size *= 2
    history = [np.zeros(size // 8, np.uint8)] * (SHARDS + 1)  # the filters of a cycle ago up to now
    carried, step = None, 0
    shared = {}
    while step < SHARDS or (history[-1] != history[0]).any():
        for gone in set(shared) - {id(bits) for bits in history}:
            shared.pop(gone)[1].destroy()
        for bits in (history[-1], history[0]):
            if id(bits) not in shared:
                shared[id(bits)] = bits, context.broadcast(bits)
        new = scanned(chunked.where(F.col("shard") == step % SHARDS), step, shared[id(history[-1])][1], shared[id(history[0])][1])
        rows = new.withColumn("since", F.lit(step))
        rows = rows.unionByName(carried) if carried is not None else rows
        counts = materialize(rows.groupBy("key").agg(F.sum("n").alias("n"), F.min("since").alias("since")), "counts", "zstd")
        if carried is not None:
            discard(before)
        # what was not yet counted often enough goes on until its cycle ends
        carried, before = counts.where((F.col("n") < at_least) & (F.col("since") > step + 1 - SHARDS)), counts
        step += 1
        history = [*history[1:], added(counts.where(F.col("n") >= at_least), history[-1])]
        if (history[-1] == history[-2]).all():
            history[-1] = history[-2]
    discard(before)
    for _, sent in shared.values():
        sent.destroy()
    return history[-1]


def counted(chunked: DataFrame, bits: np.ndarray) -> DataFrame:
    """lang, phrase, f: how often the phrases that the filter holds occur, by their words; and '' with the number of all words of the language."""
    held = chunked.sparkSession.sparkContext.broadcast(bits)

    def of(batches):
        for tokens, word, langs, keys in opened(batches):
            filter_ = Filter(held.value)
            total = pd.Series(1, index=langs[tokens[tokens > 0]]).groupby(level=0).sum()
            out = [pd.DataFrame({"lang": total.index.to_numpy(), "phrase": "", "f": total.to_numpy()})]
            number = tokens.astype(np.int64)  # exact numbers of phrases, from those of their subphrases
            for n, (at, key) in enumerate(levels(tokens, keys, held.value), 1):
                if n > 1:
                    pairs = number[at] << np.int64(32) | number[at + 1]
                    number = np.zeros(len(tokens), np.int64)
                    number[at] = np.unique(pairs, return_inverse=True)[1] + 1
                last = at[filter_.holds(key)]
                _, first, times = np.unique(number[last], return_index=True, return_counts=True)
                place = last[first]
                texts = [b" ".join(p).decode("utf-8", "surrogatepass") for p in zip(*(word[tokens[place + k]] for k in range(n)))]
                out.append(pd.DataFrame({"lang": langs[tokens[place]], "phrase": texts, "f": times}))
            yield pd.concat(out)

    found = chunked.select("tokens", "words", "lang_of", "langs").mapInPandas(of, "lang string, phrase string, f long")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def part(words, first, n):
    return F.array_join(F.slice(words, first, n), " ")


def scored(phrases: DataFrame, at_least: int = AT_LEAST) -> DataFrame:
    """lang, phrase, a, l, r, n, score, dropped of the candidates among phrases (lang, phrase, f)."""
    all_words = phrases.where("phrase = ''").select("lang", F.col("f").alias("n"))
    often = phrases.where((F.col("phrase") != "") & (F.col("f") >= at_least))
    words = F.split("phrase", " ", -1)
    candidates = often.withColumn("words", words).where(F.size("words") > 1).withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part("words", F.lit(1), F.col("k")).alias("first"), part("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    left = often.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = often.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left.hint("merge"), ["lang", "first"]).join(right.hint("merge"), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("a2", (wide("a") * F.lit(2000000)).cast("decimal(30,0)")).withColumn("lr", (wide("l") + wide("r")).cast("decimal(20,0)"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("a2 div lr").alias("score"), "k", "l", "r")).alias("cut"), F.first("a").alias("a"))

    n = F.size("words")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda m: F.transform(F.sequence(F.lit(1), n - m + 1), lambda i: part("words", i, m))))
    inside = candidates.where(n > 2).select("lang", F.col("a").alias("longer"), F.explode(spans).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    met = best.join(inside, ["lang", "phrase"], "left").join(all_words, "lang")
    dropped = F.coalesce(wide("longer") * 100 >= wide("a") * INSIDE, F.lit(False))
    return met.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"), dropped.alias("dropped"))


def phrase_counts(spark: SparkSession, docs: DataFrame, at_least: int = AT_LEAST) -> DataFrame:
    """lang, phrase, f: all phrases of up to LONGEST words that occur at_least times in their language, and '' with the number of all words.

    A null language is `und`; null and empty texts have no words; repeated rows count each time; an empty table gives no rows. Other columns are not
    read. Words of a phrase are joined by a space.
    """
    small_batches(spark)
    path = new_path(spark, "chunks")
    chunked = chunks(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"))
    chunked.write.partitionBy("shard").parquet(path, compression="zstd")
    chunked = spark.read.schema(chunked.schema).parquet(path)
    found = materialize(counted(chunked, frequent(chunked, at_least)), "phrases")
    discard(chunked)
    return found


def collocations(spark: SparkSession, docs: DataFrame, at_least: int = AT_LEAST, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases that no longer one stands for, the best `top` of each language (None: all, without rank)."""
    kept = scored(phrase_counts(spark, docs, at_least), at_least).where("not dropped").drop("dropped")
    if top is None:
        return kept
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(spark, table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_UPPER, _LOWER = (reduce(lambda s, k, a=a: s + chr(ord(a) + k), range(26), "") for a in "Aa")
SQL = f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\n-\\r]')) as piece from documents
), w as (
  select lang, regexp_extract_all(piece, '[^ \\t]+') as ws from pieces
), places as (
  select lang, ws, unnest(range(1, len(ws) + 1)) as i from w
), grams as (
  select lang, m, array_to_string(ws[i:i + m - 1], ' ') as phrase from places, (select unnest([1, 2, 3, 4]) as m) where i + m - 1 <= len(ws)
), f as (
  select lang, m, phrase, count(*) as f from grams group by all
), n as (
  select lang, sum(f)::bigint as n from f where m = 1 group by lang
), cand as (
  select lang, m, phrase, f as a, string_split(phrase, ' ') as ws from f where m > 1 and f >= 30
), cuts as (
  select lang, m, phrase, a, k, array_to_string(ws[1:k], ' ') as p, array_to_string(ws[k + 1:m], ' ') as q from cand, (select unnest([1, 2, 3]) as k) where k < m
), vals as (
  select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, ((2000000::hugeint * c.a) // (x.f + y.f))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.phrase = c.p and x.m = c.k join f y on y.lang = c.lang and y.phrase = c.q and y.m = c.m - c.k
), best as (
  select * from vals qualify row_number() over (partition by lang, phrase order by score, k) = 1
), inside as (
  select lang, array_to_string(ws[i:i + s - 1], ' ') as phrase, max(a) as longer
  from cand, (select unnest([2, 3]) as s), (select unnest([1, 2, 3]) as i) where s < m and i + s - 1 <= m group by 1, 2
), kept as (
  select b.* from best b left join inside i on i.lang = b.lang and i.phrase = b.phrase where i.longer is null or 100 * i.longer < 80 * b.a
)
select k.lang, row_number() over (partition by k.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n.n, score
from kept k join n on n.lang = k.lang qualify rank <= 2000
"""
