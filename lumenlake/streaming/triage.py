"""Events of issues as a stream: opened ones are scored, edits score again, closing grades, label changes are recorded.

What an event is follows from the event alone, by Spark conditions (routes). Only scores and outcomes meet the state: one
open prediction for each issue, which an edit overwrites and an outcome uses up.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import labels
from ..operators import rules

#: Routes that meet the state.
STATEFUL = ("scored", "rescored", "outcome")
OUT = "key long, event_id long, at timestamp, route string, score double, outcome int"


def outcome_of(author: Column, locked: Column, names: Column, state_reason: Column, number: Column) -> Column:
    """The class that the label rules give a closed issue, or null where they drop it. Links to merged changes are not known at this point."""
    reason = F.nullif(F.upper(F.coalesce(state_reason, F.lit(""))), F.lit(""))
    nothing = F.array().cast("array<struct<merged:boolean,body:string>>")
    found = labels.issue_rules(author, locked, names, reason, F.lit(False), nothing, number)
    return labels.issue_label(rules.first_rule(found[:-1], found[-1][0]))


def routes(events: DataFrame) -> DataFrame:
    """key, event_id, at, route, score, outcome, change of events (key, event_id, at, action, author, closed, label, score, locked, labels, state_reason).

    Routes: rejected (no key), ignored (bots, edits of closed issues, label events without a label, outcomes that the rules drop), scored, rescored,
    recorded (change: + or - and the label), outcome, acknowledged (any other action). Works on a stream and on a table.
    """
    c = F.col
    bot = F.coalesce(labels.looks_like_bot(c("author")), F.lit(False))
    outcome = outcome_of(c("author"), c("locked"), c("labels"), c("state_reason"), c("key"))
    named = F.coalesce(c("label") != "", F.lit(False))
    known = c("action").isin("opened", "edited", "closed")
    route = (
        F.when(known & c("key").isNull(), "rejected").when(c("action").isin("opened", "edited") & bot, "ignored").when(c("action") == "opened", "scored")
        .when((c("action") == "edited") & F.coalesce(c("closed"), F.lit(False)), "ignored").when(c("action") == "edited", "rescored")
        .when((c("action") == "closed") & outcome.isNull(), "ignored").when(c("action") == "closed", "outcome")
        .when(c("action").isin("labeled", "unlabeled"), F.when(named & c("key").isNotNull(), "recorded").otherwise("ignored")).otherwise("acknowledged")
    )
    found = events.select("key", "event_id", "at", route.alias("route"), "score", outcome.cast("int").alias("outcome"), F.concat(F.when(c("action") == "labeled", "+").otherwise("-"), c("label")).alias("change"))
    return found.select(
        "key", "event_id", "at", "route", F.when(c("route").isin("scored", "rescored"), c("score")).alias("score"), F.when(c("route") == "outcome", c("outcome")).alias("outcome"), F.when(c("route") == "recorded", c("change")).alias("change")
    )


class OpenPrediction(StatefulProcessor):
    """Of one issue: its latest prediction since the last outcome. keep: event time after which a prediction expires; None never."""

    def __init__(self, keep: str | None = None):
        self.keep = None if keep is None else pd.Timedelta(keep) // pd.Timedelta("1ms")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "score double, event_id long")

    def handleInputRows(self, key, rows, timerValues):
        """The events of one micro-batch are put in order here; how many these are, the source's options bound."""
        held = self.pending.get() if self.pending.exists() else None
        for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
            route, score = r["route"], r["score"]
            if route == "outcome":
                route, score = ("unmatched", None) if held is None else ("graded", held[0])
                held = None
            else:
                held = (score, r["event_id"])
                if self.keep is not None:
                    for old in list(self.handle.listTimers()):
                        self.handle.deleteTimer(old)
                    self.handle.registerTimer(int(r["at"].timestamp() * 1000) + self.keep)
            yield Row(key=key[0], event_id=r["event_id"], at=r["at"], route=route, score=score, outcome=r["outcome"])
        self.pending.clear() if held is None else self.pending.update(held)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.pending.update((initialState["score"], initialState["event_id"]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.pending.exists():
            score, event_id = self.pending.get()
            self.pending.clear()
            yield Row(key=key[0], event_id=event_id, at=pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms").to_pydatetime(), route="expired", score=score, outcome=None)

    def close(self) -> None:
        pass


def graded_stream(routed: DataFrame, initial: DataFrame | None = None, keep: str | None = None) -> DataFrame:
    """The stateful routes of a stream: scored and rescored rows as they are, outcomes as graded (with the score that they grade) or unmatched.

    initial: open predictions (key, event_id, score) to begin with. keep needs a watermark on `at`; expired predictions give rows of their own.
    """
    rows = routed.where(F.col("route").isin(*STATEFUL)).drop("change").groupBy("key")
    start = None if initial is None else initial.groupBy("key")
    return rows.transformWithState(OpenPrediction(keep), OUT, "Append", "None" if keep is None else "EventTime", start)


def graded_batch(routed: DataFrame) -> DataFrame:
    """The same for a table: windows over the events of a key, which all depend on those before them."""
    order = Window.partitionBy("key").orderBy("at", "event_id")
    rows = routed.where(F.col("route").isin(*STATEFUL)).drop("change")
    closes = F.col("route") == "outcome"
    rows = rows.withColumn("round", F.count_if(closes).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    held = F.last("score", ignorenulls=True).over(Window.partitionBy("key", "round").orderBy("at", "event_id"))
    rows = rows.withColumn("held", held)
    return rows.select(
        "key", "event_id", "at", F.when(~closes, F.col("route")).when(F.col("held").isNull(), "unmatched").otherwise("graded").alias("route"), F.when(closes, F.col("held")).otherwise(F.col("score")).alias("score"), "outcome"
    )


def open_predictions(graded: DataFrame) -> DataFrame:
    """key, event_id, score of what still waits for its outcome, from a ledger of scored, rescored, graded and unmatched rows: the state, rebuilt."""
    scored = F.col("route").isin("scored", "rescored")
    last = graded.where("route <> 'expired'").groupBy("key").agg(F.max(F.struct("at", "event_id", scored.alias("waits"), "score")).alias("last"))
    gone = graded.where("route = 'expired'").select("key", "event_id")
    return last.where("last.waits").select("key", "last.event_id", "last.score").join(gone, ["key", "event_id"], "left_anti")


def counters(routed: DataFrame, every: str = "1 day", late: str | None = None, shard: Column | None = None) -> DataFrame:
    """start, shard, scored, positive, total, rescored of each window of event time.

    On a stream, late is how late an event may come: later ones are dropped (one micro-batch on, as two stateful steps follow each other),
    and an event_id that comes again within it counts once.
    """
    rows = routed.where(F.col("route").isin("scored", "rescored")).withColumn("shard", F.col("key") if shard is None else shard)
    if late is not None:
        rows = rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    new = F.col("route") == "scored"
    found = rows.groupBy(F.window("at", every).alias("window"), "shard").agg(
        F.count_if(new).alias("scored"), F.count_if(new & (F.col("score") >= 0.5)).alias("positive"), F.sum(F.when(new, F.col("score")).otherwise(0.0)).alias("total"), F.count_if(~new).alias("rescored")
    )
    return found.select(F.col("window.start").alias("start"), "shard", "scored", "positive", "total", "rescored")


def share(part: Column, whole: Column) -> Column:
    """Rounded to 4 places; null of nothing."""
    return F.round(F.try_divide(part, whole), 4)


def resolutions(graded: DataFrame) -> DataFrame:
    """One row: graded outcomes of both classes, and the predictions that still wait for theirs."""
    done = graded.agg(*[F.count_if((F.col("route") == "graded") & (F.col("outcome") == y)).alias(name) for name, y in (("resolved_actionable", 1), ("resolved_non_actionable", 0))])
    return done.crossJoin(F.broadcast(open_predictions(graded).agg(F.count("*").alias("awaiting_outcome"))))  # one row each


def duplicates(routed: DataFrame, related: Column, word: str = "duplicate") -> DataFrame:
    """One row: new predictions that had related candidates, their share of all predictions (edits count too), and labels with the word that were added."""
    new = F.col("route") == "scored"
    named = F.col("change").startswith("+") & F.contains(F.lower("change"), F.lit(word.lower()))
    found = routed.agg(F.count_if(new & related).alias("with_related"), F.count_if(F.col("route").isin("scored", "rescored")).alias("n"), F.count_if(named).alias("duplicate_labels"))
    return found.select("with_related", share(F.col("with_related"), F.col("n")).alias("rate"), "duplicate_labels")


def components(routed: DataFrame, component: Column) -> DataFrame:
    """component, scored (edits count too), positive_rate, mean_score."""
    rows = routed.where(F.col("route").isin("scored", "rescored")).groupBy(component.alias("component"))
    found = rows.agg(F.count("*").alias("scored"), F.count_if(F.col("score") >= 0.5).alias("p"), F.sum("score").alias("s"))
    return found.select("component", "scored", share(F.col("p"), F.col("scored")).alias("positive_rate"), share(F.col("s"), F.col("scored")).alias("mean_score"))
