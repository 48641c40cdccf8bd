"""A ledger of predictions and outcomes: batch grading and its streaming twin."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GRADED = "key long, at timestamp, score double, outcome double"


def rounds(events: DataFrame) -> DataFrame:
    """Adds round: the number of outcomes of the key before the row. At one moment predictions come before outcomes, smaller values first.

    The rows of one key pass one window, as each depends on those before it.
    """
    by = Window.partitionBy("key").orderBy("at", F.col("kind") == "outcome", "value").rowsBetween(Window.unboundedPreceding, -1)
    return events.where("kind in ('prediction', 'outcome')").withColumn("round", F.count_if(F.col("kind") == "outcome").over(by))


def grade(events: DataFrame) -> DataFrame:
    """Each outcome with the latest prediction since the outcome before it; it uses that up. Columns: key, at, kind (prediction, outcome), value.

    An outcome without such a prediction is dropped.
    """
    is_outcome = F.col("kind") == "outcome"
    matched = rounds(events).groupBy("key", "round").agg(
        F.max(F.when(is_outcome, F.struct("at", "value"))).alias("o"), F.max(F.when(~is_outcome, F.struct("at", "value"))).alias("p")
    ).where("o is not null and p is not null")
    return matched.select("key", F.col("o.at").alias("at"), F.col("p.value").alias("score"), F.col("o.value").alias("outcome"))


def open_counts(events: DataFrame) -> DataFrame:
    """key, scored, resolved, unmatched (outcomes without a prediction), pending (1 if the latest prediction still waits)."""
    is_outcome = F.col("kind") == "outcome"
    per = rounds(events).groupBy("key", "round").agg(F.count_if(is_outcome).alias("o"), F.count_if(~is_outcome).alias("p"))
    fits = lambda a, b: F.count_if(a & b)
    has_o, has_p = F.col("o") > 0, F.col("p") > 0
    return per.groupBy("key").agg(F.sum("p").alias("scored"), fits(has_o, has_p).alias("resolved"), fits(has_o, ~has_p).alias("unmatched"), fits(~has_o, has_p).alias("pending"))


def grade_stream(events: DataFrame, keep: str | None = None) -> DataFrame:
    """The same for a stream: the state of a key is its latest prediction; an outcome takes it.

    A prediction waits for its outcome without end, as in grade(). keep: it goes once the watermark on `at` (which it needs) has
    passed it by so much. Rows of a key are ordered within each micro-batch, whose size the source's options bound.
    """
    limit = None if keep is None else pd.Timedelta(keep) // pd.Timedelta("1ms")

    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).assign(_side=lambda d: d.kind.eq("outcome")).sort_values(["at", "_side", "value"])
        score, at = state.get if state.exists else (None, None)
        out = []
        for r in rows.itertuples(index=False):
            if r.kind == "prediction":
                score, at = r.value, r.at.value // 1_000_000
            elif score is not None:
                out.append((key[0], r.at, score, r.value))
                score = None
        if score is not None:
            state.update((score, at))
            if limit is not None:
                state.setTimeoutTimestamp(max(at + limit, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["key", "at", "score", "outcome"])

    wanted = events.where("kind in ('prediction', 'outcome')")
    timeout = GroupStateTimeout.NoTimeout if limit is None else GroupStateTimeout.EventTimeTimeout
    return wanted.groupBy("key").applyInPandasWithState(step, GRADED, "score double, at long", "append", timeout)
