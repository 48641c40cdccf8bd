"""Queries over nested nodes, label sets, people, events and sets, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys, labels
from ..operators import evaluation, nodes, rolling, rules, similarity, temporal, vectors
from ..sources import files
from ..streaming import ledger


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nested(spark, d):
    """Orders as nodes: a customer, and lines in order."""
    line = F.struct("l_linenumber", "l_returnflag", "l_linestatus", F.when(F.col("l_returnflag") != "N", F.concat(F.lit("s"), "l_suppkey")).alias("who"))
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return _t(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")


def nested_flatten(spark, d):
    people = nodes.pick(F.col("lines"), lambda x: x["l_linestatus"] == "O", lambda x: F.concat(F.lit("n"), x["l_linenumber"].cast("string")))
    closer = nodes.last_known(F.col("lines"), lambda x: x["who"])
    return _nested(spark, d).select(
        "o_orderkey", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), nodes.any_where(F.col("lines"), lambda x: x["l_returnflag"] == "R").cast("int").alias("returned"),
        F.array_join(people, ",").alias("open_lines"), closer.alias("closer"), F.array_join(nodes.with_one(people, closer), ",").alias("people"),
    )


def assignment_explode(spark, d):
    people = F.explode(nodes.pick(F.col("lines"), lambda x: x["who"].isNotNull(), lambda x: F.struct(x["l_linenumber"].alias("place"), x["who"].alias("who"))))
    return _nested(spark, d).select("o_orderkey", people.alias("p")).select("o_orderkey", "p.place", "p.who")


def _login():
    names = ("dependabot[bot]", "Dependabot[bot]", "tidy[bot]", "triage-bot", "", "alice", "bob")
    return F.when(F.col("c_custkey") % 8 < 7, F.try_element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % 8 + 1).cast("int")))


def author_predicates(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", _login().alias("login"))
    x = F.col("login")
    named = F.coalesce((x != "") & ~labels.known_bot(x), F.lit(False))
    return c.select("c_custkey", *[f.cast("int").alias(n) for n, f in (("listed", labels.known_bot(x)), ("named", named), ("human", labels.is_human(x)), ("bot_like", labels.looks_like_bot(x)))])


def human_owners(spark, d):
    """Customers without the listed bots, by anti-join."""
    bots = spark.createDataFrame([(b,) for b in labels.BOTS], "login string")
    c = _t(spark, d, "customer").select("c_custkey", _login().alias("login"))
    return c.join(F.broadcast(bots), "login", "left_anti").select("c_custkey")


def _pick(column: str, *values):
    return F.element_at(F.array(*values), (F.pmod(F.col(column), F.lit(len(values))) + 1).cast("int"))


_SETS = (["Bug"], ["question", "bug"], [], [" Duplicate\n"], [None, "type: bug"], ["enhancement"], ["needs more info", "defect"])
_BODIES = ("Fixes #{}", "prefixes #{}", "closed   #{}1", "RESOLVES #{}.", "see #{}")


def _issues(spark, d):
    """Orders dressed as issues: every combination of authors, labels, states and references occurs."""
    k = "o_orderkey"
    sets = [F.array(*[F.lit(x).cast("string") for x in s]) if s else F.array().cast("array<string>") for s in _SETS]
    bodies = [F.concat(*[x for part in zip(map(F.lit, b.split("{}")), [F.col(k).cast("string"), F.lit("")]) for x in part]) for b in _BODIES]
    return _t(spark, d, "orders").select(
        k, _pick(k, *map(F.lit, ("alice", "bob", "dependabot[bot]", "", "carol", "dan", "eve", "frank", "gil", "hal", "ira"))).alias("author"), (F.col(k) % 17 == 0).alias("locked"), _pick(k, *sets).alias("labels"),
        _pick(k, F.lit("COMPLETED"), F.lit("NOT_PLANNED"), F.lit(None).cast("string")).alias("state_reason"), (F.col(k) % 13 == 0).alias("merged_link"),
        F.array(F.struct((F.col(k) % 2 == 0).alias("merged"), _pick(k, *bodies).alias("body"))).alias("references"),
    )


def _ruled(spark, d):
    c = F.col
    found = labels.issue_rules(c("author"), c("locked"), c("labels"), c("state_reason"), c("merged_link"), c("references"), c("o_orderkey"))
    return _issues(spark, d).withColumn("label_rule", rules.first_rule(found[:-1], found[-1][0]))


def issue_labels(spark, d):
    return _ruled(spark, d).select("o_orderkey", "label_rule", labels.issue_label(F.col("label_rule")).alias("label")).where("label is not null")


def issue_audit(spark, d):
    return rules.audit(_ruled(spark, d), [*labels.DROPS, *labels.POSITIVE, *labels.NEGATIVE])


def closing_reference_match(spark, d):
    return _issues(spark, d).select("o_orderkey", labels.closes(F.col("references")[0]["body"], F.col("o_orderkey")).cast("int").alias("closes"))


def duplicate_labels(spark, d):
    """Labels as a JSON cell: any that contains the word counts; a broken cell has none."""
    cell = F.when(F.col("p_partkey") % 9 == 0, F.lit("[broken")).otherwise(F.to_json(F.array(F.concat(F.lit("Is-"), "p_type"), F.lit("x"))))
    found = labels.any_contains(F.from_json(cell, "array<string>"), "promo")
    return _t(spark, d, "part").select("p_partkey", found.cast("int").alias("is_promo"))


def threshold_override(spark, d):
    over = F.str_to_map(F.lit("view=35,click=60.5"), F.lit(","), F.lit("="))
    limit = F.coalesce(F.try_element_at(over, F.col("event_type")).try_cast("double"), F.lit(50.0))
    return _t(spark, d, "events").select("event_id", limit.alias("threshold"), F.when(F.col("value") >= limit, "yes").otherwise("no").alias("decision"))


def event_routing(spark, d):
    """Views are scored, clicks scored again, purchases graded, signups counted as labels; the rest is acknowledged."""
    route = F.when(F.col("event_type") == "view", "score").when(F.col("event_type") == "click", "rescore").when(F.col("event_type") == "purchase", "grade").when(F.col("event_type") == "signup", "label").otherwise("acknowledge")
    per = _t(spark, d, "events").groupBy(F.to_date("ts").alias("day"), route.alias("route"))
    return per.agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("positive"), F.round(F.sum("value"), 4).alias("total"))


def closed_payload(spark, d):
    k = F.from_json("props", "k long")["k"]
    reason = F.when(k % 3 == 0, "completed").when(k % 3 == 1, "")
    state = F.nullif(F.upper(F.coalesce(reason, F.lit(""))), F.lit(""))
    return _t(spark, d, "events").where("event_type = 'purchase'").select("event_id", state.alias("state_reason"), F.lit(False).alias("merged_link"), F.size(F.array()).cast("long").alias("n_references"))


def text_cuts(spark, d):
    t, s = F.coalesce("text", F.lit("")), F.col("source")
    blob = F.concat(F.coalesce("source", F.lit("")), F.lit("\n\n"), t)
    return _t(spark, d, "documents").select(
        "doc_id", F.length(F.substring(blob, 1, 4000)).cast("long").alias("blob_length"), F.substring(t, 1, 120).alias("title"), F.substring(F.split(t, "\n")[0], 1, 90).alias("first_line"),
        F.split(s, "/", 2)[0].alias("owner"), F.try_element_at(F.split(s, "/", 2), F.lit(2)).alias("name"),
    )


def time_parse(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, F.lit("not a time")).when(F.col("event_id") % 5 == 1, F.lit(None)).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    at = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    return _t(spark, d, "events").select("event_id", F.coalesce(F.hour(at), F.lit(0)).alias("hour"), F.coalesce(F.weekday(at), F.lit(0)).alias("weekday"))


def best_class(spark, d):
    scores = F.create_map(F.lit("click"), F.pmod("event_id", F.lit(7)), F.lit("buy"), F.pmod("event_id", F.lit(5)), F.lit("view"), F.lit(3).cast("long"))
    return _t(spark, d, "events").select("event_id", nodes.best_key(scores).alias("best"))


def log_days(spark, d):
    o, line = _t(spark, d, "orders").select("o_orderkey", "o_orderdate"), _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    days = temporal.elapsed_days(F.col("l_shipdate"), F.col("o_orderdate"))
    target = F.when(days.isNotNull(), F.log1p(F.greatest(days, F.lit(0.0))))
    back = F.expm1(F.greatest(target, F.lit(0.0)))
    return line.join(o, line.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", F.round(target, 6).alias("log_days"), F.round(back, 4).alias("days"))


def set_tests(spark, d):
    kinds = F.array_sort(F.collect_set("event_type"))
    per = _t(spark, d, "events").where("value < 20").groupBy("user_id").agg(kinds.alias("kinds"))
    some, need = F.array(F.lit("error"), F.lit("signup")), F.array(F.lit("click"), F.lit("view"))
    return per.select("user_id", F.arrays_overlap("kinds", some).cast("int").alias("overlaps"), (F.size(F.array_except(need, F.col("kinds"))) == 0).cast("int").alias("has_all"), F.array_join(F.array_sort(F.array_except(F.col("kinds"), some)), ",").alias("others"))


def customers_without_events(spark, d):
    e = _t(spark, d, "events").where("value > 50").select(F.col("user_id").alias("k")).distinct()
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k")).distinct().join(e, "k", "left_anti")


def head_n_per_group(spark, d):
    return temporal.ranked(_t(spark, d, "events"), "event_type", ["ts", "event_id"]).where("_k <= 20").select("event_type", "event_id", F.col("_k").cast("int").alias("place"))


def last_n_per_group(spark, d):
    rows = temporal.ranked(_t(spark, d, "events"), "event_type", ["ts", "event_id"]).where("_k > _n - 20")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("ts").alias("from_ts"))


def rolling_latency(spark, d):
    """Percentiles of the last 50 values of its type at each event."""
    rows = rolling.rolling_percentiles(_t(spark, d, "events"), "event_type", ["ts", "event_id"], "value", 50, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return rows.select("event_type", "event_id", "n", "p50", "p95", "p99")


def rolling_users(spark, d):
    """Of the last 100 events of its type at each event: distinct users, the first time and the highest value."""
    frame = {"users": F.collect_set("user_id"), "since": F.min("ts"), "highest": F.max("value")}
    rows = rolling.last_rows(_t(spark, d, "events"), "event_type", ["ts", "event_id"], 100, frame)
    return rows.select("event_type", "event_id", F.size("users").cast("long").alias("users"), "since", "highest")


def event_summary(spark, d):
    v = F.col("value")
    return _t(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev(v), 4).alias("std"), F.min(v).alias("least"), F.max(v).alias("most")
    )


def _ledger(spark, d):
    kind = F.when(F.col("event_type") == "view", "prediction").when(F.col("event_type") == "purchase", "outcome")
    rows = _t(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("at"), kind.alias("kind"), "value")
    return rows.where("kind is not null").groupBy("key", "at", "kind").agg(F.max("value").alias("value"))


def live_rates(spark, d):
    y, p = F.col("outcome") >= 50, F.col("score") >= 50
    c = ledger.grade(_ledger(spark, d)).groupBy(F.pmod("key", F.lit(10)).alias("shard")).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("shard", "tp", "fp", "fn", "tn", F.round(F.try_divide(tp, tp + fp), 4).alias("precision"), F.round(F.try_divide(tp, tp + fn), 4).alias("recall"), F.round(F.try_divide(tp + tn, tp + fp + fn + tn), 4).alias("accuracy"))


def ledger_open(spark, d):
    return ledger.open_counts(_ledger(spark, d))


def extreme_rows(spark, d):
    row = F.struct("value", (-F.col("event_id")).alias("less"))
    e = _t(spark, d, "events").groupBy("event_type").agg(F.max(F.when(F.col("value") < 90, row)).alias("hi"), F.min(F.when(F.col("value") > 10, F.struct("value", "event_id"))).alias("lo"))
    return e.select("event_type", (-F.col("hi.less")).alias("top_event"), F.col("hi.value").alias("top_value"), F.col("lo.event_id").alias("low_event"), F.col("lo.value").alias("low_value"))


def user_report(spark, d):
    """Users by mean value, best first: their places."""
    per = _t(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    return per.orderBy(F.desc("mean"), "user_id").limit(15)


def similar_above_floor(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return similarity.top_similar(e.where("id % 10 = 0"), e, "label", 3, 0.2).select("q_id", "id", "similarity", "rank")


def max_prior_similarity(spark, d):
    """Each queried vector's largest similarity to an earlier one of its label, cut to 0..1; 0 without one."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    asked = e.where("id % 10 = 0")
    best = similarity.top_similar(asked, e, "label", 1)
    return asked.join(best.select(F.col("q_id").alias("id"), "similarity"), "id", "left").select("id", F.least(F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("most"))


def running_hits(spark, d):
    parts = temporal.chronological_split(_t(spark, d, "events"), "event_type", ["ts", "event_id"])
    rows = parts.select("event_type", "user_id", "ts", "event_id", (F.col("part") == "test").cast("int").alias("test"))
    return evaluation.running_leaderboard(rows, "event_type", "user_id", ["ts", "event_id"])


def assignment_decision(spark, d):
    """Which of two hit rates by group wins by the margin: similarity, frequency, or similarity as the default within noise."""
    r = _t(spark, d, "events").groupBy("event_type").agg(F.avg((F.col("value") >= 45).cast("double")).alias("s"), F.avg(F.when(F.col("user_id") % 2 == 0, (F.col("value") < 50).cast("double"))).alias("f"))
    text = F.when(F.col("s").isNull() | F.col("f").isNull(), "insufficient").when(F.col("s") >= F.col("f") + 0.05, "similarity").when(F.col("f") >= F.col("s") + 0.05, "most_active").otherwise("within_noise")
    return r.select("event_type", text.alias("decision"))


def release_scan(spark, d):
    """Release dates: published, else created; those with neither go; in order of time."""
    k = F.col("o_orderkey")
    published, created = F.when(k % 3 == 0, F.col("o_orderdate")), F.when(k % 4 != 1, F.date_sub("o_orderdate", 2).cast("timestamp_ntz"))
    rows = _t(spark, d, "orders").select("o_orderpriority", "o_orderkey", F.coalesce(published.cast("timestamp_ntz"), created).alias("at")).where("at is not null")
    return temporal.ranked(rows, "o_orderpriority", ["at", "o_orderkey"]).select("o_orderkey", "at", F.col("_k").cast("long").alias("place"))


def pruned_labels(spark, d):
    """A CSV table read back with the columns that are asked for, typed; rows without a label go."""
    path = files.shared_path(spark, "labels")
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left").select("doc_id", "lang", "source", "quality")
    files.write_csv(rows, path)
    wanted = [c for c in ("doc_id", "quality", "missing") if c in rows.columns]
    return files.read_csv(spark, path, rows.schema).select(*wanted).dropna(subset=["quality"])


def cost_probe(spark, d):
    """Pages and calls that a whole scan would take, from the counts of a part of it."""
    n = _t(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("people"))
    return n.select("o_orderpriority", F.ceil(F.col("n") / 50).cast("long").alias("pages"), F.ceil(F.col("people") / 50).cast("long").alias("lookups"), (F.ceil(F.col("n") / 50) + F.ceil(F.col("people") / 50)).cast("long").alias("calls"))


def content_keys(spark, d):
    """The key of a cached answer: SHA-256 of its arguments in order of their names."""
    return _t(spark, d, "events").select("event_id", keys.content_key({"b": F.col("event_type"), "a": F.col("event_id")}).alias("key"))


def char_term_counts(spark, d):
    return vectors.char_terms(_t(spark, d, "benchmark"), "item_id", "text").groupBy("item_id", "term").agg(F.count("*").alias("n"))


def kind_counts(spark, d):
    path = files.shared_path(spark, "kinds")
    files.write_jsonl(_t(spark, d, "events").select(F.col("event_type").alias("type"), "event_id"), path)
    return files.replay_jsonl(spark, path, "type string, event_id long", "type", ["view"])[1]


def label_facets(spark, d):
    """Of signups as label events: all, those with a doubled label, and the 15 most frequent labels with their share."""
    e = _t(spark, d, "events").where("event_type = 'signup'").select(F.concat(F.lit("l"), (F.col("event_id") % 23).cast("string")).alias("label"))
    per = e.groupBy("label").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # one row per label
    return per.select("label", "n", F.sum("n").over(whole).alias("all"), F.round(F.col("n") / F.sum("n").over(whole), 6).alias("share"), F.contains("label", F.lit("2")).cast("int").alias("doubled")).orderBy(F.desc("n"), "label").limit(15)


def positional_pairs(spark, d):
    """Scores and truths stay in one row, so no join by position is needed; rows without a truth keep their score."""
    docs, known = _t(spark, d, "documents").select("doc_id", "n_chars"), _t(spark, d, "labels").select("doc_id", "quality")
    return docs.join(known, "doc_id", "left").select("doc_id", F.round(F.col("n_chars") / 5000, 4).alias("score"), F.coalesce("quality", F.lit(-1)).alias("quality"))


QUERIES = {
    f.__name__: f
    for f in (
        nested_flatten, assignment_explode, author_predicates, human_owners, issue_labels, issue_audit, closing_reference_match, duplicate_labels, threshold_override, event_routing, closed_payload,
        text_cuts, time_parse, best_class, log_days, set_tests, customers_without_events, head_n_per_group, last_n_per_group, rolling_latency, rolling_users, event_summary, live_rates, ledger_open, extreme_rows, user_report,
        similar_above_floor, max_prior_similarity, running_hits, assignment_decision, release_scan, pruned_labels, cost_probe, content_keys, char_term_counts, kind_counts, label_facets, positional_pairs,
    )
}


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


_LINES = "(SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CASE WHEN l_returnflag <> 'N' THEN 's' || l_suppkey END AS who FROM lineitem)"
_LOGINS = "(SELECT c_custkey, CASE WHEN c_custkey % 8 < 7 THEN ['dependabot[bot]', 'Dependabot[bot]', 'tidy[bot]', 'triage-bot', '', 'alice', 'bob'][c_custkey % 8 + 1] END AS login FROM customer)"
_ISSUES = f"""(SELECT o_orderkey AS k, ['alice', 'bob', 'dependabot[bot]', '', 'carol', 'dan', 'eve', 'frank', 'gil', 'hal', 'ira'][o_orderkey % 11 + 1] AS author,
    list_transform([{', '.join(_list(s) if s else "[]::varchar[]" for s in _SETS)}][o_orderkey % 7 + 1], lambda x: lower(trim(coalesce(x, ''), ' ' || chr(9) || chr(10) || chr(13)))) AS l, ['COMPLETED', 'NOT_PLANNED', NULL][o_orderkey % 3 + 1] AS state, o_orderkey % 13 = 0 AS link,
    o_orderkey % 2 = 0 AND o_orderkey % 5 IN (0, 3) AS refers FROM orders)"""
_RULED = f"""(SELECT k, CASE WHEN author = '' THEN 'drop_no_author' WHEN list_contains({_list(labels.BOTS)}, author) THEN 'drop_bot' WHEN list_has_any(l, {_list(labels.QUESTION_LABELS)}) THEN 'drop_question' WHEN link THEN 'R1_merged_pr_link' WHEN refers THEN 'R1b_merged_pr_textual_reference'
    WHEN list_has_any(l, {_list(labels.BUG_LABELS)}) AND coalesce(state = 'COMPLETED', false) THEN 'R2_bug_label_completed' WHEN list_has_any(l, {_list(labels.REJECTED_LABELS)}) THEN 'R3_non_actionable_label' WHEN state = 'NOT_PLANNED' THEN 'R3b_state_not_planned' ELSE 'R4_default_non_actionable' END AS rule FROM {_ISSUES})"""
_RULES = [*labels.DROPS, *labels.POSITIVE, *labels.NEGATIVE]
_L = """(SELECT user_id AS key, ts AS "at", event_type = 'purchase' AS o, max(value) AS value FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1, 2, 3)"""
_ROUNDS = f"""(SELECT *, count(*) FILTER (o) OVER (PARTITION BY key ORDER BY "at", o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS round FROM {_L})"""
_SIM = "round(list_dot_product(q.embedding::double[], r.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(r.embedding::double[], r.embedding::double[]))), 6)"
_PAIRS = f"(SELECT q.vec_id AS q_id, r.vec_id AS id, {_SIM} AS similarity FROM embeddings q JOIN embeddings r ON q.label = r.label AND r.vec_id < q.vec_id WHERE q.vec_id % 10 = 0)"

SQL = {
    "nested_flatten": f"""WITH l AS (SELECT l_orderkey, count(*) AS n, max((l_returnflag = 'R')::int) AS r, coalesce(string_agg('n' || l_linenumber, ',' ORDER BY l_linenumber, l_returnflag, l_linestatus, who) FILTER (l_linestatus = 'O'), '') AS o, last(who ORDER BY l_linenumber, l_returnflag, l_linestatus, who) FILTER (who IS NOT NULL) AS c FROM {_LINES} GROUP BY 1)
        SELECT o_orderkey, coalesce(n, 0) AS n_lines, coalesce(r, 0) AS returned, coalesce(o, '') AS open_lines, c AS closer, concat_ws(',', nullif(o, ''), c) AS people FROM orders LEFT JOIN l ON o_orderkey = l_orderkey""",
    "assignment_explode": f"SELECT o_orderkey, l_linenumber AS place, who FROM orders JOIN {_LINES} ON o_orderkey = l_orderkey WHERE who IS NOT NULL",
    "author_predicates": f"SELECT c_custkey, coalesce(b, false)::int AS listed, coalesce(login <> '' AND NOT b, false)::int AS named, coalesce(login <> '' AND NOT b AND NOT suffix(login, '[bot]'), false)::int AS human, coalesce(suffix(login, '[bot]') OR suffix(login, '-bot'), false)::int AS bot_like FROM (SELECT *, list_contains({_list(labels.BOTS)}, login) AS b FROM {_LOGINS})",
    "human_owners": f"SELECT c_custkey FROM {_LOGINS} WHERE login IS NULL OR NOT list_contains({_list(labels.BOTS)}, login)",
    "issue_labels": f"SELECT k AS o_orderkey, rule AS label_rule, (starts_with(rule, 'R1') OR starts_with(rule, 'R2'))::int AS label FROM {_RULED} WHERE NOT starts_with(rule, 'drop')",
    "issue_audit": "SELECT label_rule, coalesce(n, 0) AS n FROM (VALUES " + ", ".join(f"('{r}')" for r in _RULES) + f") v(label_rule) LEFT JOIN (SELECT rule AS label_rule, count(*) AS n FROM {_RULED} GROUP BY 1) USING (label_rule)",
    "closing_reference_match": "SELECT o_orderkey, (o_orderkey % 5 IN (0, 3))::int AS closes FROM orders",
    "duplicate_labels": "SELECT p_partkey, (p_partkey % 9 <> 0 AND contains(lower(p_type), 'promo'))::int AS is_promo FROM part",
    "threshold_override": "SELECT event_id, t AS threshold, CASE WHEN value >= t THEN 'yes' ELSE 'no' END AS decision FROM (SELECT *, CASE event_type WHEN 'view' THEN 35.0::double WHEN 'click' THEN 60.5::double ELSE 50.0::double END AS t FROM events)",
    "event_routing": "SELECT ts::date AS day, CASE event_type WHEN 'view' THEN 'score' WHEN 'click' THEN 'rescore' WHEN 'purchase' THEN 'grade' WHEN 'signup' THEN 'label' ELSE 'acknowledge' END AS route, count(*) AS n, count(*) FILTER (value >= 50) AS positive, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "closed_payload": "SELECT event_id, CASE WHEN (props::json ->> 'k')::bigint % 3 = 0 THEN 'COMPLETED' END AS state_reason, false AS merged_link, 0::bigint AS n_references FROM events WHERE event_type = 'purchase'",
    "text_cuts": "SELECT doc_id, least(4000, length(coalesce(source, '') || chr(10) || chr(10) || coalesce(text, ''))) AS blob_length, substring(coalesce(text, ''), 1, 120) AS title, substring(string_split(coalesce(text, ''), chr(10))[1], 1, 90) AS first_line, string_split(source, '/')[1] AS owner, CASE WHEN contains(source, '/') THEN substring(source, strpos(source, '/') + 1) END AS name FROM documents",
    "time_parse": "SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN 0 ELSE hour(ts) END::int AS hour, CASE WHEN event_id % 5 IN (0, 1) THEN 0 ELSE isodow(ts) - 1 END::int AS weekday FROM events",
    "best_class": "SELECT event_id, CASE WHEN b >= c AND b >= 3 THEN 'buy' WHEN c >= 3 THEN 'click' ELSE 'view' END AS best FROM (SELECT event_id, event_id % 7 AS c, event_id % 5 AS b FROM events)",
    "log_days": "SELECT l_orderkey, l_linenumber, round(t, 6) AS log_days, round(exp(t) - 1, 4) AS days FROM (SELECT *, ln(1 + greatest((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000, 0)) AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "set_tests": "SELECT user_id, list_has_any(k, ['error', 'signup'])::int AS overlaps, list_has_all(k, ['click', 'view'])::int AS has_all, array_to_string(list_sort(list_filter(k, lambda x: x NOT IN ('error', 'signup'))), ',') AS others FROM (SELECT user_id, list(DISTINCT event_type) AS k FROM events WHERE value < 20 GROUP BY 1)",
    "customers_without_events": "SELECT c_custkey AS k FROM customer EXCEPT SELECT user_id FROM events WHERE value > 50",
    "head_n_per_group": "SELECT event_type, event_id, place::int AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM events) WHERE place <= 20",
    "last_n_per_group": "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, min(ts) AS from_ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 20 GROUP BY 1",
    "rolling_latency": """
        WITH frames AS (SELECT event_type, event_id, list_sort(list(value) FILTER (WHERE value IS NOT NULL) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) AS f FROM events)
        SELECT event_type, event_id, coalesce(len(f), 0) AS n, f[CAST(least(len(f) - 1, floor(len(f) * 0.5)) AS BIGINT) + 1] AS p50, f[CAST(least(len(f) - 1, floor(len(f) * 0.95)) AS BIGINT) + 1] AS p95,
            f[CAST(least(len(f) - 1, floor(len(f) * 0.99)) AS BIGINT) + 1] AS p99 FROM frames""",
    "rolling_users": """
        SELECT event_type, event_id, count(DISTINCT user_id) OVER w AS users, min(ts) OVER w AS since, max(value) OVER w AS highest FROM events
        WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""",
    "event_summary": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS least, max(value) AS most FROM events GROUP BY 1",
    "live_rates": f"""WITH g AS (SELECT key, arg_max(value, "at") FILTER (NOT o) AS score, max(value) FILTER (o) AS outcome FROM {_ROUNDS} GROUP BY key, round HAVING bool_or(o) AND bool_or(NOT o)),
        c AS (SELECT key % 10 AS shard, count(*) FILTER (outcome >= 50 AND score >= 50) AS tp, count(*) FILTER (outcome < 50 AND score >= 50) AS fp, count(*) FILTER (outcome >= 50 AND score < 50) AS fn, count(*) FILTER (outcome < 50 AND score < 50) AS tn FROM g GROUP BY 1)
        SELECT *, round(tp::double / nullif(tp + fp, 0), 4) AS precision, round(tp::double / nullif(tp + fn, 0), 4) AS recall, round((tp + tn)::double / nullif(tp + fp + fn + tn, 0), 4) AS accuracy FROM c""",
    "ledger_open": f"WITH r AS (SELECT key, round, count(*) FILTER (o) AS o, count(*) FILTER (NOT o) AS p FROM {_ROUNDS} GROUP BY 1, 2) SELECT key, sum(p)::bigint AS scored, count(*) FILTER (o > 0 AND p > 0) AS resolved, count(*) FILTER (o > 0 AND p = 0) AS unmatched, count(*) FILTER (o = 0 AND p > 0) AS pending FROM r GROUP BY 1",
    "extreme_rows": "WITH h AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events WHERE value < 90), l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k FROM events WHERE value > 10) SELECT h.event_type, h.event_id AS top_event, h.value AS top_value, l.event_id AS low_event, l.value AS low_value FROM h JOIN l ON h.event_type = l.event_type AND h.k = 1 AND l.k = 1",
    "user_report": "SELECT user_id, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
    "similar_above_floor": f"SELECT q_id, id, similarity, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, id) AS rank FROM {_PAIRS} WHERE similarity >= 0.2) WHERE rank <= 3",
    "max_prior_similarity": f"SELECT vec_id AS id, least(greatest(coalesce(max(similarity), 0.0::double), 0.0::double), 1.0::double) AS most FROM embeddings LEFT JOIN {_PAIRS} ON q_id = vec_id WHERE vec_id % 10 = 0 GROUP BY 1",
    "running_hits": """WITH s AS (SELECT *, k > least(greatest(round_even(n * 0.8::double, 0), 1), n - 1) AS test FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)),
        c AS (SELECT t.event_type, t.event_id, t.user_id, p.user_id AS item, count(*) AS c FROM s t JOIN s p ON p.event_type = t.event_type AND p.k < t.k WHERE t.test GROUP BY 1, 2, 3, 4),
        w AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY c DESC, item) AS rank FROM c),
        r AS (SELECT t.event_type, count(*) AS n, round(count(*) FILTER (rank <= 1) / count(*), 4) AS hit_1, round(count(*) FILTER (rank <= 3) / count(*), 4) AS hit_3, round(count(*) FILTER (rank <= 5) / count(*), 4) AS hit_5 FROM s t LEFT JOIN w ON w.event_id = t.event_id AND w.item = t.user_id WHERE t.test GROUP BY 1)
        SELECT * FROM r UNION ALL SELECT NULL, sum(n)::bigint, round(sum(hit_1 * n) / sum(n), 4), round(sum(hit_3 * n) / sum(n), 4), round(sum(hit_5 * n) / sum(n), 4) FROM r""",
    "assignment_decision": "SELECT event_type, CASE WHEN s IS NULL OR f IS NULL THEN 'insufficient' WHEN s >= f + 0.05::double THEN 'similarity' WHEN f >= s + 0.05::double THEN 'most_active' ELSE 'within_noise' END AS decision FROM (SELECT event_type, avg((value >= 45)::int) AS s, avg(CASE WHEN user_id % 2 = 0 THEN (value < 50)::int END) AS f FROM events GROUP BY 1)",
    "release_scan": """SELECT o_orderkey, "at", row_number() OVER (PARTITION BY o_orderpriority ORDER BY "at", o_orderkey) AS place FROM (SELECT o_orderpriority, o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate END, CASE WHEN o_orderkey % 4 <> 1 THEN (o_orderdate::date - 2)::timestamp END) AS "at" FROM orders) WHERE "at" IS NOT NULL""",
    "pruned_labels": "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL",
    "cost_probe": "SELECT o_orderpriority, ceil(n / 50)::bigint AS pages, ceil(p / 50)::bigint AS lookups, (ceil(n / 50) + ceil(p / 50))::bigint AS calls FROM (SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS p FROM orders GROUP BY 1)",
    "content_keys": """SELECT event_id, sha256('{"a":' || event_id || ',"b":"' || event_type || '"}') AS key FROM events""",
    "char_term_counts": r"""WITH w AS (SELECT item_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) || ' ' AS w FROM benchmark), g AS (SELECT item_id, w, length(w) AS m, unnest([3, 4, 5]) AS n FROM w),
        t AS (SELECT item_id, substring(w, i, n) AS term FROM (SELECT *, unnest(range(1, m - n + 2)) AS i FROM g WHERE m > n) UNION ALL SELECT item_id, w FROM g WHERE m = n OR (n = 3 AND m < 3)) SELECT item_id, term, count(*) AS n FROM t GROUP BY 1, 2""",
    "kind_counts": "SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1",
    "label_facets": "SELECT label, n, sum(n) OVER ()::bigint AS \"all\", round(n / sum(n) OVER (), 6)::double AS share, contains(label, '2')::int AS doubled FROM (SELECT 'l' || (event_id % 23) AS label, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1) ORDER BY n DESC, label LIMIT 15",
    "positional_pairs": "SELECT doc_id, round(n_chars / 5000.0::double, 4) AS score, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)",
}
