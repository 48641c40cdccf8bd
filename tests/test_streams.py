"""Streams over several micro-batches against their batch twins: order, repeats, late events, restarts, expiry."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenlake.plans import streams
from lumenlake.streaming import latency, ledger, sinks, triage

SCHEMA = "key long, event_id long, at timestamp, action string, author string, closed boolean, label string, score double, locked boolean, labels array<string>, state_reason string"
T0 = dt.datetime(2024, 1, 1)


def event(i, key, action, hours=None, **more):
    row = {"author": "alice", "closed": False, "label": None, "score": i / 100, "locked": False, "labels": [], "state_reason": None} | more
    return (key, i, T0 + dt.timedelta(hours=i if hours is None else hours), action, *row.values())


class Folder:
    """A folder to which micro-batches are added as files."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n = spark, str(path), 0

    def add(self, rows, schema=SCHEMA):
        (rows if hasattr(rows, "write") else self.spark.createDataFrame(rows, schema)).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        self.n += 1

    def stream(self, schema=SCHEMA):
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")

    def run(self, stream, name="out", mode="append", put=None):
        sinks.run_available(stream, f"{self.path}/{name}", f"{self.path}/{name}-state", mode, put)
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema)
        return sinks.written(self.spark, f"{self.path}/{name}", f"{kinds}, batch long")


def test_routes_of_each_kind(spark):
    """Bots, edits of closed issues, dropped outcomes and label events without a label are ignored; closing is graded by the label rules."""
    rows = [
        event(1, 7, "opened", score=0.9), event(2, 7, "edited", score=0.3), event(3, 7, "edited", score=0.8, closed=True), event(4, 7, "edited", score=0.7, author="a[bot]"), event(5, 7, "closed", state_reason="completed", labels=["Bug"]),
        event(6, 7, "closed", state_reason="not_planned"), event(7, 8, "opened", author="x-bot"), event(8, 8, "closed", labels=["question"]), event(9, 8, "closed", author=None), event(10, 8, "labeled", label="ui"),
        event(11, 8, "unlabeled", label="ui"), event(12, 8, "labeled", label=""), event(13, 8, "pinned"), event(14, None, "opened"), event(15, None, "labeled", label="ui"), event(16, 8, "closed", author="dependabot[bot]"),
    ]
    got = {r.event_id: (r.route, r.change) for r in triage.routes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(1, 17)] == [
        ("scored", None), ("rescored", None), ("ignored", None), ("ignored", None), ("outcome", None), ("outcome", None), ("ignored", None), ("ignored", None), ("ignored", None), ("recorded", "+ui"),
        ("recorded", "-ui"), ("ignored", None), ("acknowledged", None), ("rejected", None), ("ignored", None), ("ignored", None),
    ]
    graded = {r.event_id: (r.route, r.score, r.outcome) for r in triage.graded_batch(triage.routes(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert graded == {1: ("scored", 0.9, None), 2: ("rescored", 0.3, None), 5: ("graded", 0.3, 1), 6: ("unmatched", None, 0)}
    assert triage.routes(spark.createDataFrame([], SCHEMA)).count() == 0


def some_events(n=300, keys=12, seed=4):
    rnd = random.Random(seed)
    actions = ("opened", "edited", "closed", "labeled", "other")
    return [event(i, rnd.randrange(keys), rnd.choice(actions), i // 3, author=rnd.choice(("a", "b", "c[bot]")), closed=rnd.random() < 0.2, labels=rnd.choice(([], ["bug"], ["question"])), state_reason="completed") for i in range(n)]


COLUMNS = ("key", "event_id", "route", "score", "outcome")


def test_routes_stream_recovers(spark, tmp_path):
    """Five micro-batches; the sink breaks at the third. Restarted, the rows are those of the batch, each once; a second stream starts from the ledger alone."""
    events, folder = some_events(), Folder(spark, tmp_path)
    for k in range(5):
        folder.add(events[60 * k : 60 * (k + 1)])
    expected = Counter(tuple(r) for r in triage.graded_batch(triage.routes(spark.createDataFrame(events, SCHEMA))).select(*COLUMNS).collect())
    put = sinks.batch_sink(f"{folder.path}/out")

    def breaks(rows, batch):
        put(rows, batch)
        if batch == 2:
            raise OSError("lost")

    with pytest.raises(Exception, match="lost"):
        folder.run(triage.graded_stream(triage.routes(folder.stream())), put=breaks)
    rows = folder.run(triage.graded_stream(triage.routes(folder.stream())))
    assert Counter(tuple(r) for r in rows.select(*COLUMNS).collect()) == expected and rows.select("batch").distinct().count() == 5

    early = rows.where("batch < 2").drop("batch")
    rest = Folder(spark, tmp_path / "rest")
    rest.add(events[120:])
    late = rest.run(triage.graded_stream(triage.routes(rest.stream()), triage.open_predictions(early)))
    assert Counter(tuple(r) for r in early.select(*COLUMNS).unionByName(late.select(*COLUMNS)).collect()) == expected


def test_predictions_expire(spark, tmp_path):
    """By event time, and only where asked for."""
    folder = Folder(spark, tmp_path)
    for rows in ([event(1, 1, "opened", 0), event(2, 2, "opened", 1)], [event(3, 3, "opened", 100)], [event(4, 4, "opened", 101)], [event(5, 1, "closed", 102), event(6, 3, "closed", 103)]):
        folder.add(rows)
    routed = triage.routes(folder.stream())
    kept = {r.event_id: r.route for r in folder.run(triage.graded_stream(routed)).collect()}
    assert kept[5] == kept[6] == "graded"
    gone = folder.run(triage.graded_stream(triage.routes(folder.stream().withWatermark("at", "1 hour")), keep="48 hours"), "expiring")
    found = Counter((r.event_id, r.route) for r in gone.collect())
    assert found[1, "expired"] == found[2, "expired"] == found[5, "unmatched"] == found[6, "graded"] == 1 and found[3, "expired"] == 0


def test_counters_drop_repeats_and_late_events(spark, tmp_path):
    folder = Folder(spark, tmp_path)
    first = [event(1, 1, "opened", 1), event(2, 1, "edited", 2), event(60, 1, "opened", 3), event(3, 2, "opened", 30)]
    folder.add(first)
    folder.add([first[0], event(4, 2, "opened", 31), event(61, 1, "opened", 5)])  # a repeat, and one that is late but not too late
    folder.add([event(5, 1, "opened", 200)])
    folder.add([event(7, 1, "opened", 201)])
    folder.add([event(6, 1, "opened", 4)])  # too late: the watermark of the batch before the last counts
    rows = sinks.latest(folder.run(triage.counters(triage.routes(folder.stream()), "1 day", "2 days"), mode="update"), ["start", "shard"])
    got = {(r.start.day, r.shard): (r.scored, r.positive, round(r.total, 4), r.rescored) for r in rows.collect()}
    assert got == {(1, 1): (3, 2, 1.22, 1), (2, 2): (2, 0, 0.07, 0), (9, 1): (2, 0, 0.12, 0)}


REQUESTS = "endpoint string, at timestamp, event_id long, ms double, failed boolean"


def test_latency_ring(spark, tmp_path):
    rnd, folder = random.Random(7), Folder(spark, tmp_path)
    rows = [(rnd.choice("ab"), T0 + dt.timedelta(seconds=i), i, rnd.random(), rnd.random() < 0.1) for i in range(400)]
    for k in range(4):
        folder.add(rows[100 * k : 100 * (k + 1)], REQUESTS)
    got = {r.endpoint: r for r in sinks.latest(folder.run(latency.ring_stream(folder.stream(REQUESTS), 50), mode="update"), ["endpoint"]).collect()}
    for endpoint in "ab":
        own = [r for r in rows if r[0] == endpoint]
        last = sorted(r[3] for r in own[-50:])
        r = got[endpoint]
        assert (r.n, r.p50, r.p95, r.p99, r.errors) == (50, last[25], last[47], last[49], sum(x[4] for x in own))
    assert [latency.at_share(list(range(1, 101)), s) for s in latency.SHARES] == [51, 96, 100]


def test_latency_sketches_hold_their_rank(spark):
    rnd = random.Random(8)
    rows = [("a", T0 + dt.timedelta(minutes=i), i, rnd.lognormvariate(0, 2), i % 10 == 0) for i in range(30000)]
    found = latency.sketches(spark.createDataFrame(rows, REQUESTS)).cache()
    assert found.count() == 21
    r = latency.merged(found, ["endpoint"]).first()
    values = sorted(x[3] for x in rows)
    assert (r.n, r.errors) == (30000, 3000)
    for share, value in zip(latency.SHARES, (r.p50, r.p95, r.p99)):
        assert abs(sum(v <= value for v in values) / len(values) - share) < 0.01


def test_ledger_expires_only_where_asked(spark, tmp_path):
    schema, folder = "key long, at timestamp, kind string, value double", Folder(spark, tmp_path)
    for rows in ([(1, 0, "prediction", 0.5)], [(2, 900, "prediction", 0.25)], [(3, 901, "prediction", 0.75)], [(1, 1000, "outcome", 1.0), (2, 1001, "outcome", 0.0)]):
        folder.add([(k, T0 + dt.timedelta(hours=h), kind, v) for k, h, kind, v in rows], schema)
    never = folder.run(ledger.grade_stream(folder.stream(schema)), "never")
    assert sorted((r.key, r.score, r.outcome) for r in never.collect()) == [(1, 0.5, 1.0), (2, 0.25, 0.0)]
    days = folder.run(ledger.grade_stream(folder.stream(schema).withWatermark("at", "1 hour"), "10 days"), "days")
    assert sorted((r.key, r.score, r.outcome) for r in days.collect()) == [(2, 0.25, 0.0)]


def test_sketch_query_is_near_the_exact_percentiles(spark):
    got = {r.endpoint: r for r in streams.latency_sketches(spark, "/root/testdata/sf0.001").collect()}
    for endpoint, r in got.items():
        values = [x.value for x in spark.read.parquet("/root/testdata/sf0.001/events.parquet").where(F.col("event_type") == endpoint).select("value").collect()]
        for share, value in zip(latency.SHARES, (r.p50, r.p95, r.p99)):
            assert abs(sum(v <= value for v in values) / len(values) - share) < 0.02
