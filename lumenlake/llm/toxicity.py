"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to classes. Five small transducers read the classes of a clause: one writes insults, one writes threats (a
threatening verb with an object after it, or an addressee and a word of the future, in any order, before it), one guesses whether the clause is aimed at
someone, one follows the scope of negation, one reported speech. They are composed into one machine; of its paths through a clause the
one whose guesses come true is accepted, and what it has written are the matched clauses, each of a type (insult or threat, aimed,
negated, reported) with the weight of its word. A word alone matches nothing. The score is a logistic function of the sums of weights by type.
The lexicon of insults (words, and stems as word beginnings) and the weights of clause types are learned from labels, on a bounded sample: at
most MAX_TRAIN labelled rows, those with the smallest hash of doc_id; all entries that reach MIN_TOXIC and MIN_WEIGHT in it are used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, small_batches, table

MAX_TRAIN = 8000
STEMS = (4, 5, 6, 7, 8)
MIN_TOXIC, MIN_WEIGHT = 4, 1.5

#: Fixed word lists of the grammar (English, French, German, Spanish).
ADDRESSEES = "you your yours u toi tu vous te ti dich euch dir sie usted ustedes vosotros".split()
OBJECTS = "him her them those these everyone lui eux leur ihn ihm ihnen ellas ellos".split()
SUBJECTS = "he she they il elle ils elles er du ihr sein él ella".split()
NEGATIONS = "not no never isn aren wasn don doesn didn without pas jamais aucun nicht kein keine nie nunca tampoco".split()
CONTRASTS = "but however mais pourtant aber sondern pero sino".split()
REPORTS = "said says say wrote writes called quote quoted quotes claimed reported dit écrit appelé sagte schrieb zitiert dijo escribió llamó".split()
FUTURES = "will shall gonna going ll vais vas va werde wird wirst werden voy".split()
THREATS = "kill killing murder hurt destroy punish stab shoot hang burn tuer frapper töten schlagen matar golpear".split()
THREAT_WEIGHT = 2.0

STOP, PAUSE, QUOTE, WORD, ADDRESSEE, OBJECT, SUBJECT, NEGATION, CONTRAST, REPORT, FUTURE, INSULT, THREAT = ".", ",", '"', "w", "a", "o", "s", "n", "c", "r", "f", "i", "t"
AIMS = {ADDRESSEE, OBJECT, SUBJECT}
CLASSES = (STOP, PAUSE, QUOTE, WORD, ADDRESSEE, OBJECT, SUBJECT, NEGATION, CONTRAST, REPORT, FUTURE, INSULT, THREAT)
MARKS = {**{c: STOP for c in ".!?\n"}, **{c: PAUSE for c in ",;:"}, **{c: QUOTE for c in "\"“”«»„"}}
TOKEN = re.compile(r"[^\W\d_]+|[.!?;:,\n\"“”«»„]")
#: Words after a negation that it still reaches.
SCOPE = 5


class Transducer:
    """arcs(state, class): (next state, output) pairs; final(state): whether a clause may end there; start(state): the state in the next clause."""

    def __init__(self, start, arcs, final=lambda q: True, after_pause=None, after_stop=None):
        self.start, self.arcs, self.final = start, arcs, final
        self.after_pause = after_pause or (lambda q: start)
        self.after_stop = after_stop or (lambda q: start)


def _insult(q, c):
    """Writes each insult that is not alone in its clause. States: words so far, up to two; and after a first word that is an insult, the guess: "+" written, "-" alone and not written."""
    words, guess = q
    if c == QUOTE:
        return [(q, None)]
    if guess == "-":
        return []
    if c == INSULT:
        return [((1, "+"), INSULT), ((1, "-"), None)] if words == 0 else [((2, ""), INSULT)]
    return [((min(words + 1, 2), ""), None)]


def _threat(q, c):
    """Writes threats. States: what came before ("" nothing, "a" an addressee, "f" a word of the future, "af" both; an object after the future
    counts as an addressee) and what is owed: "" nothing, "+" an object, "-" that none comes."""
    before, owed = q
    if c == THREAT:
        if before == "af":
            return [((before, owed), THREAT)]
        return [((before, "-"), None)] if owed == "-" else [((before, "+"), THREAT), *([((before, "-"), None)] if owed == "" else [])]
    if c in (ADDRESSEE, OBJECT):
        if owed == "-":
            return []
        return [(("af" if "f" in before else "a" if c == ADDRESSEE else before, ""), None)]
    if c == FUTURE:
        return [(("af" if "a" in before else "f", owed), None)]
    return [(q, None)]


def _aim(q, c):
    """Guesses at the start: "0" not aimed, "?" aimed (and waits for whom), "!" aimed, and it came."""
    if q == "":
        return [x for guess in "0?" for x in _aim(guess, c)]
    if c in AIMS:
        return [] if q == "0" else [("!", None)]
    return [(q, None)]


def _negation(q, c):
    if c == NEGATION:
        return [(SCOPE, None)]
    return [(0 if c == CONTRAST else max(q - (c != QUOTE), 0), None)]


def _report(q, c):
    """States: 0, 1 after a verb of saying, 2 in quotation marks."""
    if c == QUOTE:
        return [(0 if q == 2 else 2, None)]
    return [(max(q, 1) if c == REPORT else q, None)]


PARTS = (
    Transducer((0, ""), _insult, lambda q: q[1] != "+"),
    Transducer(("", ""), _threat, lambda q: q[1] != "+"),
    Transducer("", _aim, lambda q: q != "?"),
    Transducer(0, _negation),
    Transducer(0, _report, after_pause=lambda q: q),
)


def compose(parts=PARTS) -> dict:
    """The product of the transducers, from the start: (state, class) to a list of (next state, type of the clause written or None).

    A pause or stop leads on from final states only. Types are numbered by insult or threat, aimed, negated, reported: 0 to 15.
    """
    start = tuple(p.start for p in parts)
    moves, todo = {}, [start]
    while todo:
        q = todo.pop()
        for c in CLASSES:
            if (q, c) in moves:
                continue
            if c in (STOP, PAUSE):
                fine = all(p.final(x) for p, x in zip(parts, q))
                found = [(tuple((p.after_stop if c == STOP else p.after_pause)(x) for p, x in zip(parts, q)), None)] if fine else []
            else:
                found = []
                for arcs in product(*(p.arcs(x, c) for p, x in zip(parts, q))):
                    to = tuple(x for x, _ in arcs)
                    kind = next((out for _, out in arcs if out), None)
                    found.append((to, None if kind is None else (kind == THREAT) * 8 + (to[2] != "0") * 4 + (to[3] > 0) * 2 + (to[4] > 0)))
            moves[q, c] = found
            todo += [to for to, _ in found]
    return moves


START = tuple(p.start for p in PARTS)
MOVES = compose()
TYPES = 16


def accepted(classes: list[str], weights: list[float]) -> list[float]:
    """Sums of weights by clause type along the accepted path through one sentence (without its stop)."""
    paths = {START: (0.0,) * TYPES}
    for c, w in zip([*classes, STOP], [*weights, 0.0]):
        then = {}
        for q, sums in paths.items():
            for to, kind in MOVES[q, c]:
                then[to] = sums if kind is None else (*sums[:kind], sums[kind] + w, *sums[kind + 1 :])
        paths = then
    return list(paths[START])


class Grammar:
    """Clause sums of a text. lexicon: {"w" + word or "p" + stem: weight}."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        lists = ((ADDRESSEE, ADDRESSEES), (OBJECT, OBJECTS), (SUBJECT, SUBJECTS), (NEGATION, NEGATIONS), (CONTRAST, CONTRASTS), (REPORT, REPORTS), (FUTURE, FUTURES))
        self.fixed = {w: (k, 0.0) for k, words in lists for w in words} | {c: (k, 0.0) for c, k in MARKS.items()} | {w: (THREAT, THREAT_WEIGHT) for w in THREATS}
        self.kinds = Memo(self.kind)

    def kind(self, word: str) -> tuple[str, float]:
        """The class of a word and, of insults and threats, its weight."""
        if word in self.fixed:
            return self.fixed[word]
        weight = max([self.lexicon.get("w" + word, 0.0), *(self.lexicon.get("p" + word[:n], 0.0) for n in STEMS if len(word) >= n)])
        return (INSULT, weight) if weight > 0 else PLAIN

    def clauses(self, text: str | None) -> list[float]:
        """Sum of weights by the 16 clause types, then the matched weight per hundred tokens. Sentences are read one by one, and only those with an insult or threat."""
        kinds = list(map(self.kinds.__getitem__, TOKEN.findall((text or "").lower())))
        hits = [i for i, k in enumerate(kinds) if k[1]]
        sums, done = [0.0] * (TYPES + 1), -1
        for i in hits:
            if i <= done:
                continue
            first = i
            while first > done + 1 and kinds[first - 1][0] != STOP:
                first -= 1
            done = i
            while done < len(kinds) and kinds[done][0] != STOP:
                done += 1
            part = kinds[first:done]
            for t, x in enumerate(accepted([k for k, _ in part], [w for _, w in part])):
                sums[t] += x
        if hits:
            sums[TYPES] = 100 * sum(sums[:TYPES]) / len(kinds)
        return sums


PLAIN = (WORD, 0.0)


def features(sums) -> np.ndarray:
    """Of rows of clause sums: insults and threats by aimed or not, what is negated, what is reported, all of it, and density."""
    s = np.asarray(sums, float).reshape(-1, TYPES + 1)
    of = lambda f: np.log1p(s[:, [t for t in range(TYPES) if f(t)]].sum(axis=1))
    return np.column_stack([
        np.ones(len(s)), of(lambda t: t in (0, 4)), of(lambda t: t == 4), of(lambda t: t in (8, 12)), of(lambda t: t & 2), of(lambda t: t & 1), of(lambda t: True), np.log1p(s[:, TYPES]),
    ])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    b = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9)
        step = np.linalg.solve(h, x.T @ (y - p) - keep * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def held_out(doc_id):
    """Whether crc32(doc_id as text) mod 5 is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of at most MAX_TRAIN rows, one per doc_id (of repeated ids the largest text); labels of documents that are held out are not read."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and logistic weights. No labels at all: an empty lexicon and a prior that predicts 0."""
    small_batches(docs.sparkSession)
    texts = training_texts(docs, labels).persist()

    def count(batches):
        toxic, clean, n = Counter(), Counter(), [0, 0]
        for b in batches:
            for text, label in zip(b.text, b.toxic):
                words = set(TOKEN.findall((text or "").lower()))
                found = {"w" + w for w in words} | {"p" + w[:k] for w in words for k in STEMS if len(w) > k}
                (toxic if label else clean).update(found)
                n[int(bool(label))] += 1
        toxic[""], clean[""] = n[1], n[0]
        for at in (toxic, clean):
            items = list(at.items())
            yield pd.DataFrame({"item": [x[0] for x in items], "n1": [x[1] if at is toxic else 0 for x in items], "n0": [0 if at is toxic else x[1] for x in items]})

    counts = texts.mapInPandas(count, "item string, n1 long, n0 long").groupBy("item").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counts = counts.where((F.col("n1") >= MIN_TOXIC) | (F.col("item") == "")).persist()
    total = counts.where("item = ''").first()
    n1, n0 = (total.n1, total.n0) if total else (0, 0)
    weight = F.log((F.col("n1") + 0.2) / F.lit(n1 + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(n0 + 1.0)) - 1.0 / F.sqrt("n1")
    rows = counts.where("item <> ''").withColumn("weight", weight).where(F.col("weight") >= MIN_WEIGHT).collect()  # entries of at most MAX_TRAIN texts
    lexicon = {r.item: float(r.weight) for r in rows}

    def clauses(batches):
        grammar = Grammar(lexicon)
        for b in batches:
            yield pd.DataFrame({"sums": [grammar.clauses(t) for t in b.text], "toxic": b.toxic})

    sample = texts.mapInPandas(clauses, "sums array<double>, toxic int").collect()  # at most MAX_TRAIN rows of 17 numbers
    texts.unpersist()
    counts.unpersist()
    if not n1 or not n0:
        return lexicon, np.array([-3.0, 0, 0, 0, 0, 0, 1.0, 0])
    return lexicon, fit_logistic(features([r.sums for r in sample]), np.array([r.toxic for r in sample], float))


def found(model: tuple[dict[str, float], np.ndarray]):
    """A function of a text column: struct of score and matched (the sum of matched clause weights)."""
    lexicon, weights = model

    @F.pandas_udf("score double, matched double")
    def of(texts: pd.Series) -> pd.DataFrame:
        grammar = _grammar(lexicon)
        sums = [grammar.clauses(t) for t in texts]
        p = 1 / (1 + np.exp(-np.clip(features(sums) @ weights, -30, 30)))
        return pd.DataFrame({"score": p, "matched": [math.fsum(s[:TYPES]) for s in sums]})

    return of


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray]) -> DataFrame:
    """doc_id, score, matched (the sum of matched clause weights). Other columns of docs are not read.

    Null and empty texts match no clause and get the score of that. Rows are scored one by one: repeated rows
    and null ids stay. An empty table gives no rows.
    """
    scored = docs.select("doc_id", found(model)("text").alias("found"))
    return scored.select("doc_id", "found.score", "found.matched")


def clean(docs: DataFrame, model: tuple[dict[str, float], np.ndarray], threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns, whatever their names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), found(model)("text").alias("found"))
    return rows.where(F.col("found.score") < threshold).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


_last: list = [None, None]


def _grammar(lexicon: dict[str, float]) -> Grammar:
    """One grammar, and its cache of words, for all batches of a worker."""
    if _last[0] != lexicon:
        _last[:] = [lexicon, Grammar(lexicon)]
    return _last[1]


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "matched")
