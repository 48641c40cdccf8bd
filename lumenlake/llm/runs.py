"""Periodic runs of words by recompression.

The words of a batch of texts are compressed in rounds: equal neighbours become one block letter with its count, then
neighbouring letters of which the first is of one half of the alphabet and the second of the other become one letter. The rounds are a
run-length grammar of logarithmic height, and equal stretches of words get equal letters but near their ends. How far two places
agree (to the right or to the left) is read off the grammar: equal letters are stepped over whole and the level above is tried, at
a difference the level below.

A run of period q and length L agrees with itself q words later along L - q words. Places at the multiples of a step that is shorter by three hold
one that four such words follow, so for each q a grid of places is compared with the places q later: a harmonic
sum of n / q over all q. Where four words agree, the grammar extends both ways, exactly. Of stretches with the same two ends
the smallest period is kept: by the theorem of Fine and Wilf it divides the others.

All is done with numpy over a batch of texts at a time. A text is one row and has to fit in one.
"""

from __future__ import annotations

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, utf8

LEAST = 24
EXPONENT = 3
#: Words that have to agree at a place of the grid before the grammar is asked.
AGREE = 4
#: Texts are compressed together up to about so many words.
BATCH_WORDS = 200_000
#: Grids are made in pieces of about so many places.
GRID = 1 << 20


def halves(letters: np.ndarray, level: int) -> np.ndarray:
    """The half of the alphabet, 0 or 1, that each letter is of; another one at each level."""
    h = (letters.astype(np.uint64) + np.uint64(level << 40)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(60) & np.uint64(1)).astype(np.int64)


class Grammar:
    """Levels of letters over a sequence of words. Negative words are borders: each stands once, and no letter spans one.

    Boundaries (places between letters) of a level are numbered from 0. first[l] gives the boundary below that a letter of level l starts at, above[l] the
    boundary above that is at the same place, or -1.
    """

    def __init__(self, words: np.ndarray):
        self.letters, self.first, self.above = [words], [], []
        self.ahead, self.behind = [], []
        texts = int((words < 0).sum())
        new, rounds_without = int(words.max(initial=0)) + 1, 0
        while True:
            now = self.letters[-1]
            n = len(now)
            starts = np.flatnonzero(np.r_[True, now[1:] != now[:-1]]) if n else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], n]
            of = np.repeat(np.arange(len(starts)), ends - starts)
            self.ahead.append(ends[of] - np.arange(n))  # letters from here to the end of its block
            self.behind.append(np.arange(n) - starts[of] + 1)
            if len(starts) <= 2 * texts + 1 or rounds_without > 8:
                break
            block, size = now[starts].copy(), ends - starts
            many = np.flatnonzero(size > 1)
            if len(many):
                block[many], new = self.named(block[many], size[many], new)
            # letters of one half of the alphabet join those of the other that follow; of both ways round, the one that makes more pairs
            half = halves(block, len(self.letters))
            inner = (block[:-1] >= 0) & (block[1:] >= 0) & (half[:-1] != half[1:])
            one = inner & (half[:-1] == 0)
            two = inner & (half[:-1] == 1)
            pairs = np.flatnonzero(one if one.sum() >= two.sum() else two)
            rounds_without = 0 if len(pairs) or len(many) else rounds_without + 1
            keep = np.ones(len(block), bool)
            keep[pairs + 1] = False
            if len(pairs):
                block[pairs], new = self.named(block[pairs], block[pairs + 1], new)
            first = starts[keep]
            above = np.full(n + 1, -1, np.int64)
            above[first] = np.arange(len(first))
            above[n] = len(first)
            self.first.append(np.r_[first, n])
            self.above.append(above)
            self.letters.append(block[keep])
        self.above.append(np.full(len(self.letters[-1]) + 1, -1, np.int64))
        self.base = np.cumsum([0, *[len(x) + 1 for x in self.letters]])
        pad = lambda parts: np.concatenate([np.r_[p, 0] for p in parts])
        self.all_letters, self.all_ahead, self.all_behind = pad(self.letters), pad(self.ahead), pad(self.behind)
        self.all_above = np.concatenate(self.above)
        self.all_first = np.concatenate([np.zeros(len(words) + 1, np.int64), *self.first])

    @staticmethod
    def named(x: np.ndarray, y: np.ndarray, new: int) -> tuple[np.ndarray, int]:
        """A letter for each distinct pair, from new on."""
        order = np.lexsort((y, x))
        xs, ys = x[order], y[order]
        differs = np.r_[False, (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1])]
        rank = np.cumsum(differs)
        out = np.empty(len(x), np.int64)
        out[order] = rank + new
        return out, new + int(rank[-1]) + 1

    def agree(self, i: np.ndarray, j: np.ndarray, left: bool = False) -> np.ndarray:
        """How many words agree from the places i and j on (left: before them)."""
        a, b, start = i.astype(np.int64), j.astype(np.int64), i.astype(np.int64)
        level = np.zeros(len(a), np.int64)
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        run = self.all_behind if left else self.all_ahead
        last = len(self.letters) - 1
        while len(live):
            base, size = self.base[level], self.base[level + 1] - self.base[level] - 1
            inside = (a > 0) & (b > 0) if left else (a < size) & (b < size)
            x, y = (base + a - 1, base + b - 1) if left else (base + a, base + b)
            x, y = np.where(inside, x, base), np.where(inside, y, base)
            same = inside & (self.all_letters[x] == self.all_letters[y])
            step = np.where(same, np.minimum(run[x], run[y]), 0)
            a, b = (a - step, b - step) if left else (a + step, b + step)
            up_a, up_b = self.all_above[base + a], self.all_above[base + b]
            rises = same & (level < last) & (up_a >= 0) & (up_b >= 0)
            falls = ~same & (level > 0)
            done = ~same & (level == 0)
            if done.any():
                out[live[done]] = np.abs(a[done] - start[done])
            down_a, down_b = self.all_first[base + a], self.all_first[base + b]
            a, b = np.where(rises, up_a, np.where(falls, down_a, a)), np.where(rises, up_b, np.where(falls, down_b, b))
            level = level + rises - falls
            keep = ~done
            live, a, b, level, start = live[keep], a[keep], b[keep], level[keep], start[keep]
        return out


_grid: dict = {}


def grid(n: int, least: int, exponent: int):
    """Pairs (place, place one period later) for a text of n words, in pieces."""
    top = n // exponent
    q = 1
    while q <= top:
        # as many periods as make a piece of about GRID places
        end, places = q, 0
        while end <= top and places < GRID:
            more = min(max(256, end // 4), top + 1 - end)
            periods = np.arange(end, end + more)
            places += int((n // np.maximum(least_step(periods, least, exponent), 1) + 1).sum())
            end += more
        periods = np.arange(q, end)
        step = least_step(periods, least, exponent)
        count = np.maximum(-(-(n - AGREE + 1 - periods) // step), 0)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        i = at * np.repeat(step, count)
        yield i, i + np.repeat(periods, count)
        q = end


def least_step(q: np.ndarray, least: int, exponent: int) -> np.ndarray:
    return np.maximum(least, exponent * q) - q - AGREE + 1


def candidates(words: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the grids after which AGREE words agree with those one period later."""
    n = len(words)
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n <= 4096:  # most texts: their grids are made once for each size of a few
        size = -(-n // 64) * 64
        if (size, least, exponent) not in _grid:
            parts = list(grid(size, least, exponent))
            i, j = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(j, kind="stable")
            if len(_grid) > 200:
                _grid.clear()
            _grid[size, least, exponent] = i[order].astype(np.int32), j[order].astype(np.int32)
        i, j = _grid[size, least, exponent]
        end = np.searchsorted(j, n - AGREE, side="right")
        parts = [(i[:end], j[:end])]
    else:
        parts = grid(n, least, exponent)
    found = []
    for i, j in parts:
        hit = np.flatnonzero(words[i] == words[j])
        for k in range(1, AGREE):
            hit = hit[words[i[hit] + k] == words[j[hit] + k]]
        found.append((i[hit].astype(np.int64), j[hit].astype(np.int64)))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def runs_of(texts: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each sequence of words (numbers from 0), by start, then period.

    Runs have their smallest period, length at least `least` and exponent (3 or more) times the period, and cannot be extended.
    """
    if exponent < 3 or least < 8 * (exponent - 1) - 1 + AGREE:
        raise ValueError("the grid takes exponents of 3 and more, and lengths of some 19 words and more")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    asked = [(k, w, *c) for k, w in enumerate(texts) if len((c := candidates(w, least, exponent))[0])]
    if not asked:
        return out
    words, places, base = [np.array([-1])], [], 1
    for nth, (_, w, i, j) in enumerate(asked):
        places.append((i + base, j + base, np.full(len(i), nth)))
        words += [w, np.array([-2 - nth])]
        base += len(w) + 1
    grammar = Grammar(np.concatenate(words).astype(np.int64))
    i, j, of = (np.concatenate(x) for x in zip(*places))
    pieces = [slice(at, at + GRID) for at in range(0, len(i), GRID)]
    after, before = (np.concatenate([grammar.agree(i[p], j[p], left) for p in pieces]) for left in (False, True))
    q = j - i
    start, length = i - before, before + after + q
    good = length >= np.maximum(least, exponent * q)
    start, length, q, of = start[good], length[good], q[good], of[good]
    order = np.lexsort((q, length, start, of))
    start, length, q, of = start[order], length[order], q[order], of[order]
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]) | (of[1:] != of[:-1])] if len(start) else np.zeros(0, bool)
    bases = np.cumsum([1, *[len(a[1]) + 1 for a in asked]])
    for s, size, p, nth in zip(start[new].tolist(), length[new].tolist(), q[new].tolist(), of[new].tolist()):
        out[asked[nth][0]].append((s - int(bases[nth]), size, p))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def batches_of(rows, words_of, least: int, exponent: int):
    """(row, words, runs) of rows, compressed together up to BATCH_WORDS words."""
    held, size = [], 0
    for row in rows:
        words = words_of(row)
        held.append((row, words))
        size += len(words)
        if size >= BATCH_WORDS:
            yield from searched(held, least, exponent)
            held, size = [], 0
    yield from searched(held, least, exponent)


class Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def searched(held, least: int, exponent: int):
    numbers = Numbers()
    texts = [np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)) for _, words in held]
    for (row, words), runs in zip(held, runs_of(texts, least, exponent)):
        yield row, words, runs


def find_runs(spark: SparkSession, docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """doc_id, start, length, period: the runs of words of each text. Words are what ASCII white space separates, numbered from 0.

    Null and empty texts have none. Repeated rows give their runs again, null ids stay; an empty table gives no rows. Other columns are not read.
    """
    small_batches(spark)

    def of(batches):
        for b in batches:
            out = [(i, *r) for (i, _), _, runs in batches_of(zip(b.doc_id.astype("Int64"), b.text), lambda r: utf8(r[1]).split(), least, exponent) for r in runs]
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "period"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(of, "doc_id long, start long, length long, period long")


def collapse(spark: SparkSession, docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """docs with each run of words cut to its first period. Texts with no run are unchanged, others are their kept words joined by one space; all columns stay."""
    small_batches(spark)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for text, words, runs in batches_of(texts, lambda t: utf8(t).split(), least, exponent):
            out.append(b" ".join(words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()).decode("utf-8", "surrogatepass") if runs else text)
        return pd.Series(out, dtype=object)

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), cut("text").alias("cut"))
    return row.select(*[F.col("cut").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def planted(doc_id, words: list[bytes]) -> list[bytes]:
    """The contract's words: of every tenth id (by its checksum) those from some place on repeat with a period."""
    n = len(words)
    h = None if doc_id is None or doc_id is pd.NA else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *[words[a + i % p] for i in range(n - a)]]


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null id plants nothing."""
    small_batches(spark)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def of(batches):
        for b in batches:
            out = []
            for (i, _), words, runs in batches_of(zip(b.doc_id.astype("Int64"), b.text), lambda r: planted(r[0], utf8(r[1]).split()), LEAST, EXPONENT):
                best = best_run(runs)
                kept = b" ".join([words[k] for k in np.flatnonzero(kept_words(len(words), runs)).tolist()] if runs else words)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
                out.append((i, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=names).astype(dict.fromkeys(names[:6], "Int64"))

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInPandas(of, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
