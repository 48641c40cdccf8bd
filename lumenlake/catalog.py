"""Named queries over the tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import evaluation as evaluation_ops
from .operators import metrics, rules, similarity, temporal
from .plans import evaluation, issues, streams, training
from .streaming import ledger


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules in order, as (id, SQL condition, class; None drops).
RULES = [
    ("no_text", "text is null or text = ''", None), ("toxic", "toxic = 1", None), ("good", "quality = 1", 1), ("bad", "quality = 0", 0),
    ("long", "n_chars > 5000", 1), ("short", "n_chars < 100", 0),
]
_CASE = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c, _ in RULES) + " ELSE 'unknown' END"
_LABEL = "CASE label_rule " + " ".join(f"WHEN '{r}' THEN {k}" for r, _, k in RULES if k is not None) + " END"


def _labeled(spark, d):
    docs = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")
    return rules.label(docs, [(r, F.expr(c)) for r, c, _ in RULES], {r: k for r, _, k in RULES if k is not None}, "unknown")


def rule_label_documents(spark, d):
    return _labeled(spark, d).where("label is not null").select("doc_id", "label_rule", "label")


def rule_audit_histogram(spark, d):
    return rules.audit(_labeled(spark, d), [r for r, _, _ in RULES] + ["unknown"])


def text_shape_features(spark, d):
    return _t(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in text.shape(F.col("text")).items()])


KEYWORDS = ["the", "error", "expected", "version", "tion", "que"]


def keyword_hits(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", text.keyword_hits(F.col("text"), KEYWORDS).alias("hits"))


def cyclical_time(spark, d):
    s, c = temporal.cyclical(F.hour("ts"), 24)
    return _t(spark, d, "events").select("event_id", F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"), (F.round(s, 6) + F.lit(0.0)).alias("hour_sin"), (F.round(c, 6) + F.lit(0.0)).alias("hour_cos"))


def floor_days_between(spark, d):
    o, line = _t(spark, d, "orders").select("o_orderkey", "o_orderdate"), _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    days = temporal.days_between(F.col("l_shipdate"), F.col("o_orderdate"))
    return line.join(o, line.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", days.alias("days"), temporal.day_bucket(days).alias("bucket"))


def first_event_per_user(spark, d):
    return temporal.first_flag(_t(spark, d, "events"), ["event_type", "user_id"], ["ts", "event_id"]).select("event_id", "is_first")


def asof_last_signup(spark, d):
    e = _t(spark, d, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'signup'").select("user_id", "ts", F.col("ts").alias("signup_ts"))
    return temporal.as_of(left, right, "user_id", "ts", "signup_ts", "last_signup").select("event_id", "user_id", "last_signup")


def author_dimension_join(spark, d):
    c, n = _t(spark, d, "customer").select("c_custkey", "c_nationkey"), _t(spark, d, "nation").select("n_nationkey", "n_name")
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey, "left").select("o_orderkey", "n_name")


def chrono_split(spark, d):
    return temporal.chronological_split(_t(spark, d, "events"), "event_type", ["ts", "event_id"]).select("event_id", "event_type", "part")


def walk_forward_folds(spark, d):
    f = temporal.walk_forward(_t(spark, d, "events"), "event_type", ["ts", "event_id"], 3, 0.10)
    return f.groupBy("event_type", "fold", "part").agg(F.count("*").alias("n"), F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"))


def _scored(spark, d):
    s = F.round(F.least(F.lit(1.0), F.col("n_chars") / 5000.0), 2)
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select("lang", "quality", s.alias("score"))


def binary_metrics_grouped(spark, d):
    m = metrics.confusion(_scored(spark, d), "quality", "score", 0.5, "lang")
    return m.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "brier")])


def ranking_metrics(spark, d):
    return metrics.auc(_scored(spark, d), "quality", "score", "lang").select("lang", *[F.round(c, 6).alias(c) for c in ("roc_auc", "average_precision")])


def balanced_weights(spark, d):
    c = _t(spark, d, "labels").groupBy("quality").agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total"), F.count("*").alias("k")))).select("quality", "n", F.round(F.col("total") / (F.col("k") * F.col("n")), 6).alias("weight"))


def cosine_topk(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return similarity.top_similar(e.where("id % 20 = 0"), e, "label", 3).select("q_id", "id", "similarity", "rank")


def similar_weighted_vote(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    found = similarity.top_similar(e.where("id % 20 = 0"), e, None, 20)
    return found.join(e.select("id", "label"), "id").groupBy("q_id", "label").agg(F.round(F.sum("similarity"), 6).alias("vote"))


def _ledger(spark, d):
    kind = F.when(F.col("event_type") == "view", "prediction").when(F.col("event_type") == "purchase", "outcome")
    return _t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), kind.alias("kind"), "value")


def ledger_grade(spark, d):
    last = _ledger(spark, d).groupBy("key", "at", "kind").agg(F.max("value").alias("value"))
    return ledger.grade(last)


def facet_daily(spark, d):
    return _t(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))


def facet_deciles(spark, d):
    b = F.least(F.lit(9), F.floor(F.col("score") * 10)).cast("int")
    have = _scored(spark, d).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return spark.range(10).select(F.col("id").cast("int").alias("bin")).join(have, "bin", "left").fillna(0, ["n"])


def latency_percentiles(spark, d):
    places = {p: lambda n, q=q: F.greatest(F.ceil(n * F.lit(q)) - 1, F.lit(0)) for p, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}
    return evaluation_ops.order_statistics(_t(spark, d, "events"), "value", "event_type", places).select("event_type", *[F.round(p, 6).alias(p) for p in places])


def mae_vs_median(spark, d):
    o = _t(spark, d, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("y"))
    middle = evaluation_ops.order_statistics(o, "y", "o_orderpriority", {"a": lambda n: F.floor((n - 1) / 2), "b": lambda n: F.floor(n / 2)})
    return o.join(middle.select("o_orderpriority", ((F.col("a") + F.col("b")) / 2).alias("m")), "o_orderpriority").groupBy("o_orderpriority").agg(F.round(F.avg(F.abs(F.col("y") - F.col("m"))), 4).alias("mae"), F.round(F.max("m"), 4).alias("median"))


QUERIES = {
    f.__name__: f
    for f in (
        rule_label_documents, rule_audit_histogram, text_shape_features, keyword_hits, cyclical_time, floor_days_between, first_event_per_user, asof_last_signup, author_dimension_join,
        chrono_split, walk_forward_folds, binary_metrics_grouped, ranking_metrics, balanced_weights, cosine_topk, similar_weighted_vote, ledger_grade, facet_daily, facet_deciles, latency_percentiles, mae_vs_median,
    )
}

_S = "(SELECT lang, quality, round(least(1.0::double, n_chars / 5000.0::double), 2) AS score FROM documents JOIN labels USING (doc_id))"
_DOT = "round(list_dot_product(q.embedding::double[], r.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(r.embedding::double[], r.embedding::double[]))), 6)"

SQL = {
    "rule_label_documents": f"SELECT doc_id, label_rule, {_LABEL} AS label FROM (SELECT doc_id, {_CASE} AS label_rule FROM documents LEFT JOIN labels USING (doc_id)) WHERE {_LABEL} IS NOT NULL",
    "rule_audit_histogram": "SELECT label_rule, coalesce(n, 0) AS n FROM (VALUES " + ", ".join(f"('{r}')" for r in [*[r for r, _, _ in RULES], "unknown"]) + f") v(label_rule) LEFT JOIN (SELECT {_CASE} AS label_rule, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1) USING (label_rule)",
    "text_shape_features": r"""SELECT doc_id, length(t) AS n_code_points, len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) AS n_tokens, regexp_matches(t, '```|~~~|\n    \S')::int AS has_code,
        regexp_matches(t, '(?i)https?://')::int AS has_link, regexp_matches(t, '(?i)!\[[^\]]*\]\(|<img\b')::int AS has_image, regexp_matches(t, '(?m)^#{1,4} |<!--')::int AS has_template FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "keyword_hits": "SELECT conv_id, turn, " + " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::int" for w in KEYWORDS) + " AS hits FROM conversations",
    "cyclical_time": "SELECT event_id, hour(ts)::int AS hour, (isodow(ts) - 1)::int AS weekday, round(sin(2 * pi() * hour(ts) / 24), 6) + 0.0::double AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) + 0.0::double AS hour_cos FROM events",
    "floor_days_between": "SELECT l_orderkey, l_linenumber, days, CASE WHEN days <= 3 THEN 'days' WHEN days <= 21 THEN 'weeks' WHEN days <= 90 THEN 'months' ELSE 'longer' END AS bucket FROM (SELECT l_orderkey, l_linenumber, floor((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000)::bigint AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "first_event_per_user": "SELECT event_id, (row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1)::int AS is_first FROM events",
    "asof_last_signup": "SELECT p.event_id, p.user_id, s.ts AS last_signup FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts",
    "author_dimension_join": "SELECT o_orderkey, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "chrono_split": "SELECT event_id, event_type, CASE WHEN k <= least(greatest(round_even(n * 0.8::double, 0), 1), n - 1) THEN 'train' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)",
    "walk_forward_folds": f"""SELECT event_type, fold, part, count(*) AS n, min(ts) AS from_ts, max(ts) AS to_ts FROM (SELECT event_type, fold, ts, CASE WHEN k <= round_even(n * lo, 0) THEN 'train' WHEN k <= round_even(n * hi, 0) THEN 'validation' END AS part
        FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events), (VALUES {', '.join(f'({i}, {lo!r}::double, {hi!r}::double)' for i, (lo, hi) in enumerate(temporal.fold_bounds(3, 0.10)))}) f(fold, lo, hi)) WHERE part IS NOT NULL GROUP BY 1, 2, 3""",
    "binary_metrics_grouped": f"""WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND score >= 0.5) AS tp, count(*) FILTER (quality <> 1 AND score >= 0.5) AS fp, count(*) FILTER (quality = 1 AND score < 0.5) AS fn, count(*) FILTER (quality <> 1 AND score < 0.5) AS tn, avg((score - quality) ** 2) AS b FROM {_S} GROUP BY ROLLUP (lang)),
        r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS q FROM c)
        SELECT lang, tp, fp, fn, tn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(b, 6) AS brier FROM r""",
    "ranking_metrics": f"""WITH s AS (SELECT lang, score, sum(quality)::double AS pos, count(*) AS n FROM {_S} GROUP BY 1, 2), w AS (SELECT *, sum(pos) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY score DESC) AS seen FROM s)
        SELECT lang, round(sum((n - pos) * (tp - pos / 2)) / nullif(sum(pos) * sum(n - pos), 0), 6) AS roc_auc, round(sum(pos * tp / seen) / nullif(sum(pos), 0), 6) AS average_precision FROM w GROUP BY 1""",
    "balanced_weights": "SELECT quality, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6)::double AS weight FROM labels GROUP BY 1",
    "cosine_topk": f"SELECT q_id, id, similarity, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, id) AS rank FROM (SELECT q.vec_id AS q_id, r.vec_id AS id, {_DOT} AS similarity FROM embeddings q JOIN embeddings r ON q.label = r.label AND r.vec_id < q.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 3",
    "similar_weighted_vote": f"SELECT q_id, label, round(sum(similarity), 6) AS vote FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, id) AS rank FROM (SELECT q.vec_id AS q_id, r.vec_id AS id, r.label, {_DOT} AS similarity FROM embeddings q JOIN embeddings r ON r.vec_id < q.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 20 GROUP BY 1, 2",
    "ledger_grade": """WITH l AS (SELECT user_id AS key, ts AS "at", event_type = 'purchase' AS o, max(value) AS value FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2, 3),
        r AS (SELECT *, count(*) FILTER (o) OVER (PARTITION BY key ORDER BY "at", o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS round FROM l)
        SELECT key, max("at") FILTER (o) AS "at", arg_max(value, "at") FILTER (NOT o) AS score, max(value) FILTER (o) AS outcome FROM r GROUP BY key, round HAVING bool_or(o) AND bool_or(NOT o)""",
    "facet_daily": "SELECT ts::date AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "facet_deciles": f"SELECT bin, coalesce(n, 0) AS n FROM (SELECT range::int AS bin FROM range(10)) LEFT JOIN (SELECT least(9, floor(score * 10))::int AS bin, count(*) AS n FROM {_S} GROUP BY 1) USING (bin)",
    "latency_percentiles": "SELECT event_type, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "mae_vs_median": "SELECT o_orderpriority, round(avg(abs(y - m)), 4) AS mae, round(max(m), 4) AS median FROM (SELECT o_orderpriority, o_totalprice::double AS y, median(o_totalprice::double) OVER (PARTITION BY o_orderpriority) AS m FROM orders) GROUP BY 1",
}

QUERIES |= evaluation.QUERIES | issues.QUERIES | training.QUERIES | streams.QUERIES
SQL |= evaluation.SQL | issues.SQL | streams.SQL
