"""Exact cosine search of a bounded set of queries, and votes of the similar."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import stored

#: A query set over this many rows is not broadcast.
MAX_BROADCAST = 2000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def normed(v: Column) -> Column:
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))


#: Of a block's rows, so many meet its queries at once. Single precision errs by less than NEAR.
BATCH = 2000
NEAR = 1e-4
#: Stand for similarities of null (a vector without direction), which come last, and of NaN, which come first: pandas doesn't tell them apart.
NONE, NAN = -3.0, 9.0


def _padded(vectors: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows of a matrix, and their lengths; -1 where there is none."""
    out, sizes = np.zeros((len(vectors), width)), np.full(len(vectors), -1)
    for i, v in enumerate(vectors):
        if v is not None:
            out[i, : len(v)], sizes[i] = v, len(v)
    return out, sizes


def _best_of_block(k: int, floor: float | None, grouped: bool):
    """q_id, id, g, s of a block of queries and one of rows: each query's k best, and what rounds to as much or nearly.

    Products in single precision name the candidates, whose cosines are added up in order, in double precision, as dot() does. Of pairs with one
    cosine (copies of a vector) the k smallest ids stay.
    """

    def of(_, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame([], columns=["q_id", "id", "g", "s"])
        width = max([len(v) for v in [*q.q_v, *r.r_v] if v is not None], default=1)
        q_v, q_size = _padded(q.q_v, width)
        q_id, r_id = q.q_id.to_numpy(), r.id.to_numpy()
        kept = np.zeros((3, 0))  # query, row, cosine
        for at in range(0, len(r), BATCH):
            part = r.iloc[at : at + BATCH]
            r_v, r_size = _padded(part.r_v, width)
            with np.errstate(all="ignore"):
                near = q_v.astype(np.float32) @ r_v.astype(np.float32).T
            none = (q_size[:, None] != r_size) | (q_size[:, None] < 0)
            near = np.where(none, np.float32(NONE), np.where(np.isnan(near), np.float32(NAN), near))
            allowed = part.id.to_numpy() < q_id[:, None]
            if grouped:
                allowed &= part.h.to_numpy() == q.h.to_numpy()[:, None]
            near[~allowed] = -np.inf
            least = np.full(len(q), NONE if floor is None else floor - NEAR)
            if len(part) > k:
                least = np.maximum(least, np.partition(near, len(part) - k, axis=1)[:, len(part) - k] - NEAR)
            i, j = np.nonzero(near >= least[:, None])
            s = np.zeros(len(i))
            for d in range(width):
                s += q_v[i, d] * r_v[j, d]
            s[none[i, j]] = NONE
            s[np.isnan(s)] = NAN
            kept = np.concatenate([kept, np.array([i, at + j, s])], axis=1)
            if not kept.shape[1]:
                continue
            kept = kept[:, np.lexsort((r_id[kept[1].astype(np.int64)], -kept[2], kept[0]))]
            nth = np.arange(kept.shape[1])
            new = np.r_[True, kept[0, 1:] != kept[0, :-1]]
            first = np.maximum.accumulate(np.where(new, nth, 0))
            same = np.maximum.accumulate(np.where(new | np.r_[True, kept[2, 1:] != kept[2, :-1]], nth, 0))
            last = kept[2, np.minimum(first + k - 1, len(nth) - 1)]  # of a query with fewer than k, all are among the first k
            kept = kept[:, (nth - same < k) & ((nth - first < k) | (kept[2] >= last - 2e-6))]
        i, j = kept[0].astype(np.int64), kept[1].astype(np.int64)
        return pd.DataFrame({"q_id": q_id[i], "id": r_id[j], "g": q.g.to_numpy()[i], "s": kept[2]})

    return of


def _met_in_blocks(q: DataFrame, r: DataFrame, n: int, group: str | None, k: int, floor: float | None) -> DataFrame:
    """q_id, id, group, s (the cosine): blocks of about MAX_BROADCAST queries meet blocks of rows."""
    blocks, kind = -(-n // MAX_BROADCAST), q.schema[group].dataType if group else None
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>"))
    g = F.col(group).cast("string") if group else F.lit(None).cast("string")
    q = q.where("q_id is not null").select("q_id", g.alias("g"), F.xxhash64(g).alias("h"), "q_v").withColumn("_q", block("q_id")).withColumn("_r", each)
    r = r.where("id is not null").select("id", F.xxhash64(g).alias("h"), "r_v").withColumn("_r", block("id")).withColumn("_q", each)
    found = q.groupBy("_q", "_r").cogroup(r.groupBy("_q", "_r")).applyInPandas(_best_of_block(k, floor, bool(group)), "q_id long, id long, g string, s double")
    return found.select("q_id", "id", *([F.col("g").cast(kind).alias(group)] if group else []), F.when(F.col("s") == NAN, F.lit(float("nan"))).when(F.col("s") > NONE, F.col("s")).alias("s"))


def top_similar(queries: DataFrame, rows: DataFrame, group: str | None, k: int, floor: float | None = None) -> DataFrame:
    """q_id, id, similarity, rank among earlier rows (smaller id), of the same group if one is named, and of similarity `floor` or more. Columns: id, group, v.

    A query set of at most MAX_BROADCAST rows is broadcast. A larger one meets the rows in blocks of both, so that neither
    a group nor a query gathers in one task; a block's pairs come from matrix products, and only its best leave it.
    """
    named = [group] if group else []
    q = queries.select(F.col("id").alias("q_id"), *named, normed(F.col("v")).alias("q_v"))
    r = rows.select("id", *named, normed(F.col("v")).alias("r_v"))
    n = queries.count()
    if n <= MAX_BROADCAST:
        met = r.join(F.broadcast(q), (r["id"] < q["q_id"]) & (r[group].eqNullSafe(q[group]) if group else F.lit(True)))
        met = met.drop(q[group]) if group else met
    else:
        met = _met_in_blocks(q, r, n, group, k, floor)
    cosine = dot(F.col("q_v"), F.col("r_v")) if n <= MAX_BROADCAST else F.col("s")
    pairs = met.select("q_id", "id", *named, F.round(cosine, 6).alias("similarity"))
    if floor is not None:
        pairs = pairs.where(F.col("similarity") >= floor)
    best = lambda *keys: F.row_number().over(Window.partitionBy("q_id", *keys).orderBy(F.desc("similarity"), "id"))
    pairs = pairs.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("rank", best("_part")).where(F.col("rank") <= k).drop("_part")
    return pairs.withColumn("rank", best()).where(F.col("rank") <= k)


#: Rounding of sums may not hide a pair at the floor; bounds in single precision err by less than SLACK.
MARGIN, SLACK = 1e-6, 1e-3
#: Vectors and terms of a block at most, except for one long vector; vectors that meet a block at once.
BLOCK, BLOCK_TERMS, STEP = 8192, 1_500_000, 512
#: Numbers that stand for a vector in bounds: from and to.
LEAST_WIDTH, MOST_WIDTH = 128, 4096


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)].astype(np.int64)


def _numbers(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, {0: np.uint8, 1: np.uint8, 2: np.uint16, 4: np.int32, 8: np.float64}[len(packed) // max(n, 1)])


class _Block:
    """Vectors of one group, by size: id, n (terms of each), need (terms that a partner has at least), start, place and weight (of all terms)."""

    def __init__(self, row, weigh):
        part = lambda c, kind: np.frombuffer(row[c], kind)
        self.id, self.n, self.need = part("ids", np.int64), part("sizes", np.int32), part("needs", np.int32)
        self.start = _starts(self.n)
        self.place = _numbers(row["places"], self.start[-1])
        self.weight = weigh(self.place, _numbers(row["values"], self.start[-1]), self.start)
        self.weight *= np.repeat(part("copies", np.int64), self.n)

    def lengths(self, width: int) -> np.ndarray:
        """Of each vector: the length of what falls to each of `width` places. By Cauchy and Schwarz their products are no less than the vectors'."""
        out = np.zeros((len(self.id), width), np.float32)
        for k in range(0, len(self.id), STEP):
            to = min(k + STEP, len(self.id))
            u, v = self.start[k], self.start[to]
            at = (self.place[u:v].astype(np.uint64) * np.uint64(2654435761) >> np.uint64(8)) % np.uint64(width)
            nth = np.repeat(np.arange(to - k), self.n[k:to])
            out[k:to] = np.sqrt(np.bincount(nth * width + at.astype(np.int64), self.weight[u:v] ** 2, (to - k) * width)).reshape(-1, width)
        return out


def _products(a: _Block, i: np.ndarray, b: _Block, j: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """The products of vectors i of a and j of b, where equal i follow each other."""
    out, begins = np.zeros(len(i)), np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
    for u, v in zip(begins, np.r_[begins[1:], len(i)]):
        mine = slice(a.start[i[u]], a.start[i[u] + 1])
        dense[a.place[mine]] = a.weight[mine]
        for at in range(u, v, STEP):
            of = j[at : min(at + STEP, v)]
            first = _starts(b.n[of])
            terms = np.repeat(b.start[of] - first[:-1], b.n[of]) + np.arange(first[-1])
            out[at : at + len(of)] = np.add.reduceat(dense[b.place[terms]] * b.weight[terms], first[:-1])
        dense[a.place[mine]] = 0
    return out


def _best_of_pair(a: _Block, b: _Block, same: bool, floor: float) -> pd.DataFrame:
    """first, of, s: for each vector of two blocks (or one) the most similar ones with a smaller id in the other, and what rounds to as much."""
    width = 1 << int(max(a.n.max(), b.n.max()) // 2).bit_length()
    width = min(max(width, LEAST_WIDTH), MOST_WIDTH)
    mine = a.lengths(width)
    theirs, dense = mine if same else b.lengths(width), np.zeros(int(max(a.place.max(), b.place.max())) + 1)
    kept, order = [], np.argsort(a.need, kind="stable")
    for at in range(0, len(a.id), STEP):
        row = order[at : at + STEP]
        may = np.flatnonzero((b.n >= a.need[row].min()) & (b.need <= a.n[row].max()))
        near = mine[row] @ (theirs if len(may) == len(b.id) else theirs[may]).T
        found = np.flatnonzero(near.ravel() >= floor - SLACK)
        i, j = row[found // max(len(may), 1)], may[found % max(len(may), 1)]
        if same:
            i, j = i[j < i], j[j < i]
        s = _products(a, i, b, j, dense)
        i, j, s = i[s >= floor - MARGIN], j[s >= floor - MARGIN], s[s >= floor - MARGIN]
        x, y = a.id[i], b.id[j]
        kept.append(pd.DataFrame({"first": np.maximum(x, y), "of": np.minimum(x, y), "s": s}))
        if len(kept) > 1 and sum(map(len, kept[1:])) > 100_000:
            kept = [_nearly_best(pd.concat(kept))]
    return _nearly_best(pd.concat(kept))


def _nearly_best(pairs: pd.DataFrame) -> pd.DataFrame:
    return pairs[pairs.s >= pairs.groupby("first").s.transform("max") - 2 * MARGIN]


def _least_terms(weights: np.ndarray, floor: float) -> int:
    """So many terms at least share with this vector of length 1 those that are alike."""
    return int(np.searchsorted(np.cumsum(np.sort(weights * weights)[::-1]), (floor - SLACK) ** 2)) + 1


_PACKED = "g binary, least int, most int, needs binary, ids binary, copies binary, sizes binary, places binary, values binary"


def _packed(floor: float, one: bool, weigh):
    """Vectors sorted by group and size as blocks of one group, with the fewest terms that a partner needs and the most that a vector has."""

    def block(rows: list) -> dict:
        sizes = np.array([r["n"] for r in rows], np.int32)
        start = _starts(sizes)
        places, values = (np.concatenate([_numbers(r[c], r["n"]) for r in rows]) for c in ("places", "counts"))
        w = weigh(places, values, start)
        needs = np.array([_least_terms(w[i:j], floor) if one else 0 for i, j in zip(start, start[1:])], np.int32)
        whole = lambda c: np.array([r[c] for r in rows], np.int64).tobytes()
        return {"g": rows[0]["g"], "least": int(needs.min()), "most": int(sizes.max()), "needs": needs.tobytes(), "ids": whole("id"), "copies": whole("copies"), "sizes": sizes.tobytes(), "places": places.tobytes(), "values": values.tobytes()}

    def of(batches):
        rows, terms = [], 0
        for b in batches:
            for r in b.to_dict("records"):
                if rows and (r["g"] != rows[0]["g"] or len(rows) >= BLOCK or terms + r["n"] > BLOCK_TERMS):
                    yield pd.DataFrame([block(rows)])
                    rows, terms = [], 0
                rows.append(r)
                terms += r["n"]
        if rows:
            yield pd.DataFrame([block(rows)])

    return of


def best_of_packed(vectors: DataFrame, floor: float, weigh) -> DataFrame:
    """id, of, similarity: for each vector the most similar one with a smaller id in its group g, if that is floor or more. Rounded to 6 places; ties go to the smaller id.

    vectors: id, g, copies, n, places, counts (bytes of numbers of 1, 2, 4 or 8 bytes; weigh(places, counts, starts) makes weights of length 1 of them), one row
    for each id and group. A row that stands for several counts as often. Equal vectors meet as one (their smallest id); the others of them have that
    one, or what it found at similarity 1. The rest meets in blocks of vectors of like size, where each block is read as often as it meets one: no
    pair is shuffled or stored. Of a pair of blocks, products of shortened vectors leave out what can't reach the floor; all others are multiplied.
    """
    vectors = stored(vectors.where("id is not null"), "vectors", "zstd")
    if not (repeated := not vectors.where("copies > 1").isEmpty()):
        repeated = not vectors.groupBy("id").count().where("count > 1").isEmpty()
    g = F.encode(F.col("g").cast("string"), "UTF-8")

    def marked(batches):
        for b in batches:
            start = _starts(b.n.to_numpy())
            places, counts = (np.concatenate([_numbers(x, n) for x, n in zip(b[c], b.n)]) if len(b) else np.zeros(0, np.uint8) for c in ("places", "counts"))
            w = weigh(places, counts, start).round(12)
            yield pd.DataFrame({"id": b.id, "g": b.g, "mark": [hashlib.md5(p + w[i:j].tobytes()).digest() for p, i, j in zip(b.places, start, start[1:])]})

    met = vectors.select(F.col("id").cast("long").alias("id"), g.alias("g"), "copies", "n", "places", "counts")
    if not repeated:
        classes = stored(met.select("id", "g", "n", "places", "counts").mapInPandas(marked, "id long, g binary, mark binary").groupBy("g", "mark").agg(F.min("id").alias("first"), F.collect_list("id").alias("ids")).select("first", "ids"), "classes")
        met = met.join(classes.select(F.col("first").alias("id")).hint("merge"), "id", "left_semi")
    size = vectors.agg(F.count("*").alias("n"), F.sum("n").alias("terms")).first()
    parts = max(1, -(-size["n"] // BLOCK), -(-(size["terms"] or 0) // BLOCK_TERMS))
    rows = met.repartitionByRange(parts, "g", "n", "id").sortWithinPartitions("g", "n", "id")
    blocks = stored(rows.mapInPandas(_packed(floor, not repeated, weigh), _PACKED).withColumn("no", F.monotonically_increasing_id()), "blocks")
    names = blocks.columns
    count, held = blocks.agg(F.count("*"), F.sum(F.length("places") + F.length("values"))).first()
    parts = max(1, min(count, -(-(held or 0) // (2 * BLOCK_TERMS))))  # a large block, or many small ones
    side = lambda of: blocks.repartitionByRange(max(count, 1), "no").coalesce(parts).select(*[F.col(c).alias(f"{of}{c}") for c in names])
    alike = (F.col("ag") == F.col("bg")) & (F.col("ano") >= F.col("bno")) & (F.col("aleast") <= F.col("bmost")) & (F.col("bleast") <= F.col("amost"))
    pairs = side("a").hint("shuffle_replicate_nl").join(side("b"), alike)

    def compared(batches):
        for batch in batches:
            for k in range(len(batch)):
                r = batch.slice(k, 1).to_pylist()[0]
                a = _Block({c: r[f"a{c}"] for c in names}, weigh)
                same = r["ano"] == r["bno"]
                best = _best_of_pair(a, a if same else _Block({c: r[f"b{c}"] for c in names}, weigh), same, floor)
                yield pa.RecordBatch.from_pydict({"first": best["first"].to_numpy(np.int64), "of": best["of"].to_numpy(np.int64), "s": best["s"].to_numpy(float)})

    found = pairs.mapInArrow(compared, "first long, of long, s double").select("first", "of", F.round("s", 6).alias("similarity")).where(F.col("similarity") >= floor)
    best = found.groupBy("first").agg(F.max(F.struct("similarity", (-F.col("of")).alias("o"))).alias("b")).select(F.col("first").alias("id"), (-F.col("b.o")).alias("of"), F.col("b.similarity").alias("similarity"))
    if repeated:
        return best
    best = stored(best, "best")
    copies = classes.select("first", F.explode("ids").alias("id")).where("id <> first").join(best.select(F.col("id").alias("first"), "of", "similarity"), "first", "left")
    return best.unionByName(copies.select("id", F.when(F.col("similarity") >= 1, F.col("of")).otherwise(F.col("first")).alias("of"), F.lit(1.0).alias("similarity")))


def by_counts(idf: np.ndarray):
    """weigh() for counts of terms: sublinear, times the inverse document frequency."""

    def weigh(places: np.ndarray, counts: np.ndarray, start: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts.astype(float))) * idf[places]
        return x / np.sqrt(np.repeat(np.add.reduceat(x * x, start[:-1]), np.diff(start))) if len(x) else x

    return weigh


def best_prior(vectors: DataFrame, key: str, group: str, floor: float) -> DataFrame:
    """key, of, similarity as best_of_packed() finds them. vectors: key, group, place, weight; each of unit length."""
    listed = vectors.groupBy(F.col(key).alias("id"), F.col(group).alias("g")).agg(F.array_sort(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), F.col("weight").cast("double").alias("weight")))).alias("v"))
    listed = listed.select("id", "g", F.col("v.place").alias("p"), F.col("v.weight").alias("w"))

    def packed(batches):
        for b in batches:
            yield pd.DataFrame({"id": b.id, "g": b.g, "copies": 1, "n": [len(p) for p in b.p], "places": [np.asarray(p, np.int32).tobytes() for p in b.p], "counts": [np.asarray(w, float).tobytes() for w in b.w]})

    kinds = {f.name: f.dataType.simpleString() for f in listed.schema}
    rows = listed.mapInPandas(packed, f"id {kinds['id']}, g {kinds['g']}, copies long, n int, places binary, counts binary")
    return best_of_packed(rows, floor, lambda _, weights, start: weights.astype(float)).withColumnRenamed("id", key)
