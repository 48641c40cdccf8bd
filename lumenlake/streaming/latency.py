"""Latencies of endpoints: the last samples of each in a ring, and mergeable sketches for each window."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LAST = 1000
SHARES = (0.5, 0.95, 0.99)
OUT = "endpoint string, n long, p50 double, p95 double, p99 double, errors long"


def at_share(values: list[float], share: float) -> float:
    """Nearest rank: the value at place floor(n * share) of the sorted values."""
    return values[min(len(values) - 1, int(len(values) * share))]


class Ring(StatefulProcessor):
    """Of one endpoint: the last samples by time, and how many requests failed since the beginning."""

    def __init__(self, last: int = LAST):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getListState("samples", "micros long, event_id long, ms double")
        self.errors = handle.getValueState("errors", "n long")

    def handleInputRows(self, key, rows, timerValues):
        failed = 0

        def new():
            nonlocal failed
            for r in rows:
                failed += bool(r["failed"])
                yield r["micros"], r["event_id"], r["ms"]

        held = [tuple(x) for x in self.samples.get()]
        kept = sorted(heapq.nlargest(self.last, [*held, *heapq.nlargest(self.last, new())]))  # never more than the ring, twice
        self.samples.put(kept)
        failed += self.errors.get()[0] if self.errors.exists() else 0
        self.errors.update((failed,))
        values = sorted(x[2] for x in kept)
        yield Row(endpoint=key[0], n=len(values), **{f"p{round(100 * s)}": at_share(values, s) for s in SHARES}, errors=failed)

    def close(self) -> None:
        pass


def ring_stream(requests: DataFrame, last: int = LAST) -> DataFrame:
    """endpoint, n, p50, p95, p99 of its last samples and errors of a stream (endpoint, at, event_id, ms, failed), in update mode."""
    rows = requests.select("endpoint", F.unix_micros("at").alias("micros"), "event_id", "ms", "failed")
    return rows.groupBy("endpoint").transformWithState(Ring(last), OUT, "Update", "None")


def sketches(requests: DataFrame, every: str = "1 day", k: int = 400) -> DataFrame:
    """start, endpoint, n, errors, sketch (KLL) of each window; also in a stream. Sketches of any windows can be merged."""
    found = requests.groupBy(F.window("at", every).alias("window"), "endpoint").agg(F.count("ms").alias("n"), F.count_if("failed").alias("errors"), F.kll_sketch_agg_double("ms", F.lit(k)).alias("sketch"))
    return found.select(F.col("window.start").alias("start"), "endpoint", "n", "errors", "sketch")


def merged(found: DataFrame, by: list[str], shares: tuple[float, ...] = SHARES) -> DataFrame:
    """n, errors and approximate percentiles of the windows of each group together."""
    one = found.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return one.select(*by, "n", "errors", *[F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias(f"p{round(100 * s)}") for s in shares])
