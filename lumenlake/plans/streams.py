"""Queries that run as streams over what is there, and the SQL that gives the same rows in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_path
from ..streaming import latency, sinks, triage


def _source(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def _issue_events(events: DataFrame) -> DataFrame:
    """Events dressed as events of issues, one issue for each user: no table holds any."""
    k, kind = F.from_json("props", "k long")["k"], F.col("event_type")
    action = F.when(kind == "view", "opened").when(kind == "click", "edited").when(kind == "purchase", "closed").when(kind == "signup", "labeled").otherwise("unlabeled")
    names = F.when(k % 4 == 0, F.array(F.lit("Bug"))).when(k % 4 == 1, F.array(F.lit("question"))).when(k % 4 == 2, F.array(F.lit("x"), F.lit("duplicate"))).otherwise(F.array().cast("array<string>"))
    return events.select(
        F.col("user_id").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("at"), action.alias("action"), F.when(F.col("event_id") % 11 == 0, "ci-bot").when(F.col("event_id") % 13 > 0, "alice").alias("author"),
        (k % 7 == 0).alias("closed"), F.when(k % 5 > 0, F.concat(F.lit("l"), (k % 3).cast("string"))).alias("label"), (F.col("value") / 100).alias("score"), F.lit(False).alias("locked"), names.alias("labels"),
        F.when(k % 3 == 0, "completed").when(k % 3 == 1, "not_planned").alias("state_reason"),
    )


def _rows(graded: DataFrame) -> DataFrame:
    return graded.select("event_id", "key", "route", F.round("score", 4).alias("score"), F.col("outcome").cast("double").alias("outcome"))


def _run(spark, stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    path = shared_path(spark, tag)
    sinks.run_available(stream, f"{path}/rows", f"{path}/state", mode)
    return sinks.written(spark, f"{path}/rows", f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stream.schema)}, batch long")


def stream_event_routes(spark, d):
    """All events by their route: those with state through the stream's processor, the others as they come."""
    routed = triage.routes(_issue_events(_source(spark, d)))
    graded = _run(spark, triage.graded_stream(routed), "graded").drop("batch", "at")
    other = triage.routes(_issue_events(spark.read.parquet(f"{d}/events.parquet"))).where(~F.col("route").isin(*triage.STATEFUL))
    both = _rows(graded).withColumn("change", F.lit(None).cast("string")).unionByName(_rows(other).join(other.select("event_id", "change"), "event_id"))
    return both


def stream_restarted(spark, d):
    """The stateful routes by two streams: the second starts from the open predictions that the first one's ledger shows."""
    events = spark.read.parquet(f"{d}/events.parquet")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    middle = F.lit(first) + (F.lit(last) - F.lit(first)) / 2
    parts = [triage.routes(_issue_events(_source(spark, d).where(c))) for c in (F.col("ts") < middle, F.col("ts") >= middle)]
    ledger = _run(spark, triage.graded_stream(parts[0]), "ledger").drop("batch")
    rest = _run(spark, triage.graded_stream(parts[1], triage.open_predictions(ledger)), "rest").drop("batch")
    return _rows(ledger.unionByName(rest))


def stream_counters(spark, d):
    routed = triage.routes(_issue_events(_source(spark, d)))
    found = triage.counters(routed, "1 day", "2 days", F.pmod("key", F.lit(10)))
    rows = sinks.latest(_run(spark, found, "counters", "update"), ["start", "shard"])
    return rows.select(F.to_date("start").alias("day"), "shard", "scored", "positive", F.round("total", 4).alias("total"), "rescored")


def _requests(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_type").alias("endpoint"), F.col("ts").cast("timestamp").alias("at"), "event_id", F.col("value").alias("ms"), (F.from_json("props", "k long")["k"] >= 95).alias("failed"))


def stream_latency(spark, d):
    """The last 1000 samples of each endpoint, and its errors."""
    return sinks.latest(_run(spark, latency.ring_stream(_requests(_source(spark, d))), "latency", "update"), ["endpoint"])


def latency_sketches(spark, d):
    """Approximate percentiles of each endpoint from the sketches of all days."""
    return latency.merged(latency.sketches(_requests(spark.read.parquet(f"{d}/events.parquet"))), ["endpoint"])


def _routed(spark, d):
    return triage.routes(_issue_events(spark.read.parquet(f"{d}/events.parquet")))


def facet_resolutions(spark, d):
    return triage.resolutions(triage.graded_batch(_routed(spark, d)))


def facet_duplicates(spark, d):
    """Every sixth event stands for one with related candidates, the label l2 for a duplicate's."""
    return triage.duplicates(_routed(spark, d), F.col("event_id") % 6 == 0, "L2")


def facet_components(spark, d):
    return triage.components(_routed(spark, d), F.pmod("key", F.lit(10)))


QUERIES = {f.__name__: f for f in (stream_event_routes, stream_restarted, stream_counters, stream_latency, latency_sketches, facet_resolutions, facet_duplicates, facet_components)}

_ROUTES = """(SELECT event_id, user_id AS key, ts, CASE
    WHEN event_type IN ('view', 'click') AND event_id % 11 = 0 THEN 'ignored' WHEN event_type = 'view' THEN 'scored' WHEN event_type = 'click' AND k % 7 = 0 THEN 'ignored' WHEN event_type = 'click' THEN 'rescored'
    WHEN event_type = 'purchase' AND (event_id % 11 > 0 AND event_id % 13 = 0 OR k % 4 = 1) THEN 'ignored' WHEN event_type = 'purchase' THEN 'outcome' WHEN k % 5 > 0 THEN 'recorded' ELSE 'ignored' END AS route,
    value / 100 AS p, (k % 4 = 0 AND k % 3 = 0)::int AS y, CASE WHEN event_type = 'signup' THEN '+' ELSE '-' END || 'l' || (k % 3) AS change
  FROM (SELECT *, (props::json ->> 'k')::bigint AS k FROM events))"""
_GRADED = f"""SELECT event_id, key, CASE WHEN route <> 'outcome' THEN route WHEN held IS NULL THEN 'unmatched' ELSE 'graded' END AS route, round(CASE WHEN route = 'outcome' THEN held ELSE p END, 4) AS score, CASE WHEN route = 'outcome' THEN y::double END AS outcome
  FROM (SELECT *, last_value(CASE WHEN route <> 'outcome' THEN p END IGNORE NULLS) OVER (PARTITION BY key, round ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held
    FROM (SELECT *, count(*) FILTER (route = 'outcome') OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS round FROM {_ROUTES} WHERE route IN ('scored', 'rescored', 'outcome')))"""
SQL = {
    "stream_event_routes": f"SELECT *, NULL::varchar AS change FROM ({_GRADED}) UNION ALL SELECT event_id, key, route, NULL, NULL, CASE WHEN route = 'recorded' THEN change END FROM {_ROUTES} WHERE route NOT IN ('scored', 'rescored', 'outcome')",
    "stream_restarted": _GRADED,
    "stream_counters": f"SELECT ts::date AS day, key % 10 AS shard, count(*) FILTER (route = 'scored') AS scored, count(*) FILTER (route = 'scored' AND p >= 0.5) AS positive, round(sum(CASE WHEN route = 'scored' THEN p ELSE 0 END), 4) AS total, count(*) FILTER (route = 'rescored') AS rescored FROM {_ROUTES} WHERE route IN ('scored', 'rescored') GROUP BY 1, 2",
    "stream_latency": """SELECT endpoint, n, v[least(n, floor(n * 0.5)::bigint + 1)] AS p50, v[least(n, floor(n * 0.95)::bigint + 1)] AS p95, v[least(n, floor(n * 0.99)::bigint + 1)] AS p99, errors
  FROM (SELECT event_type AS endpoint, count(*) FILTER (nth <= 1000) AS n, list_sort(list(value) FILTER (nth <= 1000)) AS v, count(*) FILTER ((props::json ->> 'k')::bigint >= 95) AS errors
    FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS nth FROM events) GROUP BY 1)""",
    "facet_resolutions": f"""SELECT count(*) FILTER (route = 'graded' AND outcome = 1) AS resolved_actionable, count(*) FILTER (route = 'graded' AND outcome = 0) AS resolved_non_actionable,
    (SELECT count(*) FROM (SELECT route, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS nth FROM {_ROUTES} WHERE route IN ('scored', 'rescored', 'outcome')) WHERE nth = 1 AND route <> 'outcome') AS awaiting_outcome FROM ({_GRADED})""",
    "facet_duplicates": f"""SELECT count(*) FILTER (route = 'scored' AND event_id % 6 = 0) AS with_related, round(count(*) FILTER (route = 'scored' AND event_id % 6 = 0) / count(*) FILTER (route IN ('scored', 'rescored')), 4) AS rate,
    count(*) FILTER (route = 'recorded' AND change = '+l2') AS duplicate_labels FROM {_ROUTES}""",
    "facet_components": f"SELECT key % 10 AS component, count(*) AS scored, round(count(*) FILTER (p >= 0.5) / count(*), 4) AS positive_rate, round(sum(p) / count(*), 4) AS mean_score FROM {_ROUTES} WHERE route IN ('scored', 'rescored') GROUP BY 1",
}
