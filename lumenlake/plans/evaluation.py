"""Queries over evaluation, labels, term vectors and files, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import evaluation, similarity, temporal, vectors
from ..sources import files


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scored(spark, d):
    s = F.round(F.least(F.lit(1.0), F.col("n_chars") / 5000.0), 2)
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality", s.alias("score"))


def threshold_search(spark, d):
    return evaluation.best_threshold(_scored(spark, d), "quality", "score", "lang").select("lang", "threshold", F.round("f1", 6).alias("f1"))


#: A plain guess at the language: the first of these words that occurs.
GUESSES = [(" the ", "en"), (" der ", "de"), (" que ", "es"), (" les ", "fr")]


def multiclass_metrics(spark, d):
    t = F.coalesce("text", F.lit(""))
    guess = F.when(t.contains(GUESSES[0][0]), GUESSES[0][1])
    for word, lang in GUESSES[1:]:
        guess = guess.when(t.contains(word), lang)
    docs = _t(spark, d, "documents").where("lang is not null").select("lang", guess.otherwise("en").alias("guess"))
    return evaluation.per_class(docs, "lang", "guess").select("class", "tp", "fp", "fn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "macro_f1")])


def reliability_curve(spark, d):
    return evaluation.reliability(_scored(spark, d), "quality", "score").select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("rate", 6).alias("rate"))


def spearman_by_priority(spark, d):
    o = _t(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("x"), F.dayofyear("o_orderdate").alias("y"))
    return evaluation.spearman(o, "x", "y", "o_orderpriority").select("o_orderpriority", F.round("spearman", 6).alias("spearman"))


def nearest_rank_percentiles(spark, d):
    return evaluation.nearest_rank(_t(spark, d, "events"), "value", "event_type", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def prior_frequency(spark, d):
    return evaluation.prior_counts(_t(spark, d, "events"), ["event_type", "user_id"], ["ts", "event_id"]).select("event_id", "prior")


def leaderboard_hits(spark, d):
    parts = temporal.chronological_split(_t(spark, d, "events"), "event_type", ["ts", "event_id"])
    return evaluation.hit_rates(parts.where("part = 'train'"), parts.where("part = 'test'"), "event_type", "user_id")


CLASSES = {"promo": "offer", "type:economy": "offer", "small": "size", "medium": "size", "large": "size", "standard": "plain"}
PRIORITY = ["offer", "size", "plain"]


def category_by_priority(spark, d):
    tags = F.array(F.concat(F.lit(" "), "p_type", F.lit("\t")), F.concat(F.lit("*Type:"), "p_type"), F.lit(None).cast("string"))
    return _t(spark, d, "part").select("p_partkey", labels.category(tags, CLASSES, PRIORITY).alias("category"))


def report_gaps(spark, d):
    t = F.coalesce("text", F.lit(""))
    tests = {"short": F.regexp_count(t, F.lit(r"[\p{L}\p{N}_]+")) < 40, "no_question": ~t.contains("?"), "no_number": ~t.rlike("[0-9]")}
    found = labels.gaps(tests)
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("gaps"), (F.size(found) >= 2).cast("int").alias("needs_info"))


def term_weights(spark, d):
    return vectors.tf_idf(_t(spark, d, "benchmark"), "item_id", "text").select("item_id", "term", F.round("weight", 6).alias("weight"))


#: Frequent words of the four languages of the documents.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "on", "with", "der", "die", "das", "und", "des", "de", "la", "le", "les", "el", "los", "que", "un", "une", "en", "qui", "por", "para")
LIKE = 0.8


def document_term_weights(spark, d):
    """Words without accents and stop words, and pairs of them, that five documents hold."""
    found = vectors.tf_idf(_t(spark, d, "documents"), "doc_id", "text", 5, 5000, STOP_WORDS, True)
    return found.select("doc_id", "term", F.round("weight", 6).alias("weight"))


def tfidf_cosine_dups(spark, d):
    """For each document the most similar earlier one of its language, if the cosine of their terms is LIKE or more."""
    docs = _t(spark, d, "documents").select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"))
    found, idf = vectors.term_vectors(docs, "doc_id", "text", "lang", 2, 20_000, STOP_WORDS, True)
    return similarity.best_of_packed(found, LIKE, similarity.by_counts(idf)).select(F.col("id").alias("doc_id"), "of", F.round("similarity", 4).alias("similarity"))


def recent_trend(spark, d):
    per = _t(spark, d, "events").where("event_type = 'view'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return per.orderBy(F.desc("day")).limit(30)


def user_analytics(spark, d):
    e = _t(spark, d, "events").where("event_type = 'view'")
    return e.groupBy("user_id").agg(F.count("*").alias("scored"), F.round(F.avg((F.col("value") >= 50).cast("int")), 6).alias("positive_rate"), F.round(F.avg("value"), 6).alias("mean_value"))


def scan_windows(spark, d):
    span = _t(spark, d, "orders").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    return span.select(files.date_windows(F.col("a"), F.col("b"), 90).alias("w")).select("w.*")


def half_split(spark, d):
    rows = temporal.ranked(_scored(spark, d), "lang", ["doc_id"])
    return rows.select("doc_id", F.when(F.col("_k") <= F.floor(F.col("_n") / 2), "tune").otherwise("verify").alias("half"))


def csv_round_trip(spark, d):
    talks = _t(spark, d, "conversations").select("conv_id", "turn", F.nullif("text", F.lit("")).alias("text"), F.split("role", "s").alias("parts"))
    path = files.shared_path(spark, "csv")
    files.write_csv(talks, path)
    return files.read_csv(spark, path, talks.schema).select("conv_id", "turn", "text", F.array_join("parts", "|").alias("parts"))


def jsonl_replay(spark, d):
    path = files.shared_path(spark, "ledger")
    files.write_jsonl(_t(spark, d, "events").select(F.col("event_type").alias("type"), "event_id", "user_id", "value"), path)
    return files.replay_jsonl(spark, path, "type string, event_id long, user_id long, value double", "type", ["view", "purchase"])[0]


def props_json(spark, d):
    return _t(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


QUERIES = {
    f.__name__: f
    for f in (
        threshold_search, multiclass_metrics, reliability_curve, spearman_by_priority, nearest_rank_percentiles, prior_frequency, leaderboard_hits, category_by_priority, report_gaps,
        term_weights, document_term_weights, tfidf_cosine_dups, recent_trend, user_analytics, scan_windows, half_split, csv_round_trip, jsonl_replay, props_json,
    )
}

_S = "(SELECT doc_id, lang, quality, round(least(1.0::double, n_chars / 5000.0::double), 2) AS score FROM documents JOIN labels USING (doc_id))"
_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
_GUESS = "CASE " + " ".join(f"WHEN contains(coalesce(text, ''), '{w}') THEN '{k}'" for w, k in GUESSES) + " ELSE 'en' END"

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _weights(min_df: int, max_terms: int) -> str:
    return f"""w AS (SELECT doc_id, [x FOR x IN regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\\p{{L}}\\p{{N}}_]{{2,}}') IF x NOT IN ({_STOP})] AS w FROM documents),
        t AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)),
        c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), v AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= {min_df} ORDER BY sum(tf) DESC, term LIMIT {max_terms}),
        r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0::double + (SELECT count(*) FROM documents)) / (1.0::double + df)) + 1) AS x FROM c JOIN v USING (term)), u AS (SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM r)"""


SQL = {
    "document_term_weights": f"WITH {_weights(5, 5000)} SELECT doc_id, term, round(weight, 6) AS weight FROM u",
    "tfidf_cosine_dups": f"""WITH {_weights(2, 20000)}, l AS (SELECT u.*, coalesce(lang, '') AS lang FROM u JOIN documents USING (doc_id)),
        s AS (SELECT a.doc_id, b.doc_id AS of, round(sum(a.weight * b.weight), 6) AS similarity FROM l a JOIN l b ON a.term = b.term AND a.lang = b.lang AND b.doc_id < a.doc_id GROUP BY 1, 2 HAVING round(sum(a.weight * b.weight), 6) >= {LIKE}::double)
        SELECT doc_id, of, round(similarity, 4) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, of) = 1""",
    "threshold_search": f"""WITH s AS {_S}, m AS (SELECT lang, t, count(*) FILTER (quality = 1 AND score >= t) AS tp, count(*) FILTER (quality <> 1 AND score >= t) AS fp, count(*) FILTER (quality = 1 AND score < t) AS fn, sum(quality) AS p, count(*) AS n
        FROM s, (SELECT unnest([{', '.join(f'{t}::double' for t in evaluation.GRID)}]) AS t) GROUP BY 1, 2),
        r AS (SELECT *, coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, p > 0 AND p < n AS fit FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY f1 DESC, t) AS rank FROM r)
        SELECT lang, CASE WHEN fit THEN t ELSE 0.5::double END AS threshold, CASE WHEN fit THEN round(f1, 6) END AS f1 FROM k WHERE rank = 1""",
    "multiclass_metrics": f"""WITH g AS (SELECT lang, {_GUESS} AS guess FROM documents WHERE lang IS NOT NULL), c AS (SELECT lang AS class FROM g UNION SELECT guess FROM g),
        m AS (SELECT class, count(*) FILTER (lang = class AND guess = class) AS tp, count(*) FILTER (lang <> class AND guess = class) AS fp, count(*) FILTER (lang = class AND guess <> class) AS fn, count(*) FILTER (lang = class) AS support FROM g, c GROUP BY 1),
        r AS (SELECT *, coalesce(tp::double / nullif(tp + fp, 0), 0) AS p, coalesce(tp::double / nullif(tp + fn, 0), 0) AS q, coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM m)
        SELECT class, tp, fp, fn, support, round(p, 6) AS precision, round(q, 6) AS recall, round(f, 6) AS f1, round(avg(f) OVER (), 6) AS macro_f1 FROM r""",
    "reliability_curve": f"""WITH s AS {_S}, e AS (SELECT unnest(quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM s),
        b AS (SELECT doc_id, score, quality, (SELECT count(*) FROM e WHERE edge < score)::int AS bin FROM s) SELECT bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(quality), 6) AS rate FROM b GROUP BY 1""",
    "spearman_by_priority": """WITH o AS (SELECT o_orderpriority, o_totalprice::double AS x, dayofyear(o_orderdate) AS y FROM orders),
        r AS (SELECT o_orderpriority, rank() OVER (PARTITION BY o_orderpriority ORDER BY x) + (count(*) OVER (PARTITION BY o_orderpriority, x) - 1) / 2.0::double AS rx, rank() OVER (PARTITION BY o_orderpriority ORDER BY y) + (count(*) OVER (PARTITION BY o_orderpriority, y) - 1) / 2.0::double AS ry FROM o)
        SELECT o_orderpriority, round(coalesce(corr(rx, ry), 0), 6) AS spearman FROM r GROUP BY 1""",
    "nearest_rank_percentiles": "WITH l AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT event_type, " + ", ".join(f"v[least(n - 1, floor(n * {q}::double)::bigint) + 1] AS {p}" for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM l",
    "prior_frequency": "SELECT event_id, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS prior FROM events",
    "leaderboard_hits": """WITH s AS (SELECT *, CASE WHEN k <= least(greatest(round_even(n * 0.8::double, 0), 1), n - 1) THEN 'train' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)),
        c AS (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS rank FROM s WHERE part = 'train' GROUP BY 1, 2),
        r AS (SELECT t.event_type, count(*) AS n, round(count(*) FILTER (rank <= 1) / count(*), 4) AS hit_1, round(count(*) FILTER (rank <= 3) / count(*), 4) AS hit_3, round(count(*) FILTER (rank <= 5) / count(*), 4) AS hit_5 FROM (SELECT * FROM s WHERE part = 'test') t LEFT JOIN c USING (event_type, user_id) GROUP BY 1)
        SELECT * FROM r UNION ALL SELECT NULL, sum(n)::bigint, round(sum(hit_1 * n) / sum(n), 4), round(sum(hit_3 * n) / sum(n), 4), round(sum(hit_5 * n) / sum(n), 4) FROM r""",
    "category_by_priority": "SELECT p_partkey, CASE WHEN lower(p_type) IN ('promo', 'economy') THEN 'offer' WHEN lower(p_type) IN ('small', 'medium', 'large') THEN 'size' WHEN lower(p_type) = 'standard' THEN 'plain' END AS category FROM part",
    "report_gaps": r"""SELECT conv_id, turn, concat_ws(',', a, b, c) AS gaps, ((a IS NOT NULL)::int + (b IS NOT NULL)::int + (c IS NOT NULL)::int >= 2)::int AS needs_info FROM (SELECT conv_id, turn, CASE WHEN length(regexp_replace(regexp_replace(coalesce(text, ''), '[\p{L}\p{N}_]+', chr(1), 'g'), '[^\x01]', '', 'g')) < 40 THEN 'short' END AS a,
        CASE WHEN NOT contains(coalesce(text, ''), '?') THEN 'no_question' END AS b, CASE WHEN NOT regexp_matches(coalesce(text, ''), '[0-9]') THEN 'no_number' END AS c FROM conversations)""",
    "term_weights": f"""WITH w AS (SELECT item_id, {_TOKENS} AS w FROM benchmark), t AS (SELECT item_id, unnest(w) AS term FROM w UNION ALL SELECT item_id, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)),
        c AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY 1, 2), v AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 2 ORDER BY sum(tf) DESC, term LIMIT 20000),
        r AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1.0::double + (SELECT count(*) FROM benchmark)) / (1.0::double + df)) + 1) AS x FROM c JOIN v USING (term)) SELECT item_id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS weight FROM r""",
    "recent_trend": "SELECT ts::date AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY 1 DESC LIMIT 30",
    "user_analytics": "SELECT user_id, count(*) AS scored, round(avg((value >= 50)::int), 6) AS positive_rate, round(avg(value), 6) AS mean_value FROM events WHERE event_type = 'view' GROUP BY 1",
    "scan_windows": "WITH s AS (SELECT min(o_orderdate)::date AS a, max(o_orderdate)::date AS b FROM orders) SELECT g::date AS from_day, least(g::date + 89, b) AS to_day FROM (SELECT b, unnest(generate_series(a::timestamp, b::timestamp, INTERVAL 90 DAY)) AS g FROM s)",
    "half_split": f"SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= floor(count(*) OVER (PARTITION BY lang) / 2) THEN 'tune' ELSE 'verify' END AS half FROM {_S}",
    "csv_round_trip": "SELECT conv_id, turn, nullif(text, '') AS text, replace(role, 's', '|') AS parts FROM conversations",
    "jsonl_replay": "SELECT event_type AS type, event_id, user_id, value FROM events WHERE event_type IN ('view', 'purchase')",
    "props_json": "SELECT event_id, (props::json ->> 'k')::bigint AS k FROM events",
}
