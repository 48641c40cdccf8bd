"""Phrases, periodic runs and mixing against brute-force versions, on odd rows and on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import mixing, phrases, runs

SF = "/root/testdata/sf0.001"
LONG = "one two three. " * 20000
ODD = [(1, None, "en", None), (2, "", None, "b"), (2, "a b c d e", None, "b"), (None, "a b c d e", "en", None), (None, None, "en", "b"), (3, LONG, "en", "a"), (3, LONG, "en", "a"), (4, "Z z\x1cz z \x00 ﬁ É!", "x", "ü")]


def odd(spark):
    return spark.createDataFrame([(i, t, lang, s, 1, 2, 0.5) for i, t, lang, s in ODD], "doc_id long, text string, lang string, source string, size int, k int, copies double").repartition(3)


def counted(docs, at_least):
    """Contract of op11, by counting every phrase."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, of in f.items():
        often = {p: a for p, a in of.items() if len(p) > 1 and a >= at_least}
        inside = Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        kept = []
        for p, a in often.items():
            if 100 * inside[p] < 80 * a:
                score, k = min((2000000 * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode("utf-8", "surrogatepass"), of[p[:k]], of[p[k:]]))
        out += [(lang, rank, p.decode("utf-8", "surrogatepass"), -a, left, right, n[lang], -score) for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:2000], 1)]
    return sorted(out)


def test_phrases(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").unionByName(odd(spark).select("text", "lang"))
    texts = [tuple(r) for r in docs.collect()]
    for at_least in (2, 30):
        got = phrases.collocations(spark, docs, at_least).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
        assert sorted(map(tuple, got.collect())) == counted(texts, at_least)
    assert phrases.collocations(spark, docs.limit(0)).count() == 0


def test_phrases_of_small_chunks(spark, monkeypatch):
    """Phrases that become frequent in different shards, each long before or after its subphrases' cycles end."""
    monkeypatch.setattr(phrases, "CHUNK", 40)
    rnd = random.Random(3)
    texts = [(" ".join(rnd.choice("abcdefgh") * rnd.choice((1, 2)) for _ in range(rnd.randrange(60))), rnd.choice(("x", "y"))) for _ in range(60)]
    chunked = phrases.chunks(spark.createDataFrame(texts, "text string, lang string").coalesce(1))  # one Python worker, in which the size holds
    assert chunked.select("shard").distinct().count() == phrases.SHARDS or chunked.count() < phrases.SHARDS
    got = phrases.collocations(spark, spark.createDataFrame(texts, "text string, lang string"), 5).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == counted(texts, 5)


def runs_by_force(w, least=24, exponent=3):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs(seed):
    rnd = random.Random(seed)
    texts = [np.zeros(0, np.int64)]
    for _ in range(150):
        n, letters = rnd.choice((1, 23, 24, 25, 60, 200, 500)), rnd.choice((1, 2, 3, 5, 40))
        t = [rnd.randrange(letters) for _ in range(n)]
        for _ in range(rnd.randrange(4)):
            a = rnd.randrange(n)
            p = rnd.randrange(1, max(2, (n - a) // 3 + 1))
            for i in range(a + p, min(n, a + p * rnd.randrange(2, 9) + rnd.randrange(p))):
                t[i] = t[i - p]
        texts.append(np.array(t, np.int64))
    assert runs.runs_of(texts) == [runs_by_force(t.tolist()) for t in texts]


def test_runs_of_long_texts():
    rnd = random.Random(5)
    t = [rnd.randrange(3000) for _ in range(5000)]
    for i in range(2407, 4903):
        t[i] = t[i - 831]
    t[100:900] = [7] * 800
    t[900:1500] = [5, 6, 5] * 200
    x = np.array(t)
    assert runs.runs_of([x, x[:1400]], 24, 3) == [runs_by_force(t), runs_by_force(t[:1400])]
    wide = np.r_[np.arange(30000), np.tile(np.arange(40000, 49000), 4), np.arange(30000)]
    assert runs.runs_of([wide]) == [[(30000, 36000, 9000)]]


def test_grammar_agrees():
    rnd = random.Random(9)
    w = [-1, *[rnd.choice((0, 0, 0, 1)) for _ in range(400)], -2, *[0] * 200, *[1, 0] * 100, -3]
    g = runs.Grammar(np.array(w))
    assert len(g.letters) > 5
    i, j = np.array([rnd.randrange(len(w)) for _ in range(3000)]), np.array([rnd.randrange(len(w)) for _ in range(3000)])
    i, j = i[i != j], j[i != j]
    right, left = g.agree(i, j), g.agree(i, j, left=True)
    for a, b, x, y in zip(i.tolist(), j.tolist(), right.tolist(), left.tolist()):
        n = 0
        while max(a, b) + n < len(w) and w[a + n] == w[b + n]:
            n += 1
        m = 0
        while min(a, b) - m > 0 and w[a - m - 1] == w[b - m - 1]:
            m += 1
        assert (n, m) == (x, y)


def test_runs_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in runs.op12_runs(spark, SF).collect()}
    assert got.keys() == docs.keys() and sum(r.n_runs > 0 for r in got.values()) > 15
    for doc, text in docs.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = runs_by_force(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found)]
        r = got[doc]
        assert r.n_runs == len(found) and r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best and r.exponent_milli == (1000 * best[1] // best[2] if found else None)


def test_runs_odd_rows(spark):
    docs = odd(spark)
    got = Counter(tuple(r) for r in runs.find_runs(spark, docs).collect())
    assert got == {(3, 0, 60000, 3): 2}
    cut = runs.collapse(spark, docs)
    assert cut.columns == docs.columns and Counter((r.doc_id, r.text) for r in cut.collect()) == Counter((i, "one two three." if t == LONG else t) for i, t, _, _ in ODD)
    assert runs.find_runs(spark, docs.limit(0)).count() == 0 == runs.collapse(spark, docs.limit(0)).count()


def targets_by_force(sizes, weights=(3, 1, 2), share=Fraction(3, 2), cap=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        of = sum(weight[s] for s in order if s not in full)
        target = {s: Fraction(cap * sizes[s]) if s in full else rest * weight[s] / of for s in order}
        above = {s for s in order if target[s] > cap * sizes[s]}
        if not above:
            return target
        full |= above


def held_to_targets(rows, spread):
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.copies * r["size"]
        assert 0 <= r.copies <= 2
    target = targets_by_force(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(target[r.source]))
    for s in sizes:
        assert abs(taken[s] - target[s]) <= spread, (s, taken[s], target[s])


def test_mixing(spark):
    rows = mixing.op13_mix(spark, "/root/testdata/sf0.01").collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(words) and all(words[r.doc_id] == r["size"] and r.taken == r.copies * r["size"] for r in rows)
    held_to_targets(rows, 250)


def test_mixing_reruns_agree_and_odd_rows(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice((None, *range(40))), rnd.choice((0, 1, 5, 9)), s) for s in ("a", "b", None, "B", "é") for _ in range(300)] + [(7, 3, "hot")] * 5000 + [(8, 0, "empty")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, size long, source string")
    got = mixing.mix(spark, docs.repartition(5)).collect()
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter(rows)
    held_to_targets(got, 10)
    again = mixing.mix(spark, docs.repartition(2)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again)) != Counter(map(tuple, mixing.mix(spark, docs, seed=1).collect()))
    assert mixing.mix(spark, docs.limit(0)).count() == 0 and all(r.target == 0 == r.copies for r in mixing.mix(spark, docs.where("size = 0")).collect())


def test_mixing_is_fair(spark):
    """Over many sources of equal rows each row is taken about as often as its share."""
    docs = spark.createDataFrame([(1000 * s + k, k, f"s{s:03}") for s in range(300) for k in range(1, 31)], "doc_id long, size long, source string")
    taken, share = defaultdict(Counter), {}
    for r in mixing.mix(spark, docs).collect():
        taken[r.source_size, r.target][r["size"]] += r.copies
        share[r.source_size, r.target] = r.target / r.source_size
    assert len(taken) == 3
    for of, sizes in taken.items():
        assert max(abs(sizes[k] / 100 - share[of]) for k in range(1, 31)) < 0.2  # 4 deviations of a mean of 100 draws


def test_mixture(spark):
    docs = odd(spark)
    mixed = mixing.mixture(spark, docs)
    assert mixed.columns == docs.columns
    copies = mixing.mix(spark, mixing.sized(docs)).agg(F.sum("copies")).first()[0]
    rows = Counter((r.doc_id, r.text, r.lang, r.source) for r in mixed.collect())
    assert sum(rows.values()) == copies and set(rows) <= set(ODD)


def test_filter_comes_to_the_driver_in_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    def whole(self, *_):
        raise AssertionError("the words of the filter were collected as rows")

    monkeypatch.setattr(Classic, "toPandas", whole)
    monkeypatch.setattr(Classic, "collect", whole)
    keys = np.array([0, 1, (1 << 48) - 1, 123456789012345, 1 << 29, 1 << 19, 77 << 40], np.uint64)
    table = spark.createDataFrame([(int(k),) for k in keys], "key long")
    for log in (16, 20, 23):
        held = phrases.Filter(phrases.added(table.select(F.col("key")), np.zeros(1 << log - 3, np.uint8)))
        assert held.holds(keys << np.uint64(64 - 48)).all()
        assert np.unpackbits(held.bits).sum() <= 2 * len(keys)
