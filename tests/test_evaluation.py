"""Hand-computed cases of evaluation, labels, files and models."""

import hashlib
import time

import duckdb
import numpy as np
import pytest

from lumenlake.functions import keys, labels
from lumenlake.operators import evaluation, metrics, models, prefix, rolling, rules, similarity, temporal, vectors
from lumenlake.plans import evaluation as plans_evaluation
from lumenlake.plans import training
from lumenlake.sources import files
from lumenlake.streaming import ledger
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_best_threshold_is_the_lowest(spark):
    rows = [("a", 0, 0.2)] * 50 + [("a", 1, 0.4)] * 50 + [("b", 1, 0.9)] * 3
    got = {r.g: (r.threshold, r.f1) for r in evaluation.best_threshold(spark.createDataFrame(rows, "g string, y int, p double"), "y", "p", "g").collect()}
    assert got == {"a": (0.22, 1.0), "b": (0.5, None)}


def test_nearest_rank(spark):
    df = spark.range(1, 101).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    r = evaluation.nearest_rank(df, "v", "g", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    assert (r.p50, r.p95, r.p99) == (51, 96, 100)


def test_spearman_ties_and_constants(spark):
    rows = [("a", x, y) for x, y in ((1, 1), (2, 2), (2, 3), (4, 4))] + [("b", 1, 5), ("b", 1, 6), ("c", None, 1)]
    got = {r.g: r.spearman for r in evaluation.spearman(spark.createDataFrame(rows, "g string, x int, y int"), "x", "y", "g").collect()}
    assert got["a"] == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4], [1, 2, 3, 4])[0, 1]) and got["b"] == 0.0 and "c" not in got


def test_per_class_and_hits(spark):
    rows = [("x", "x"), ("x", "y"), ("y", "y"), ("z", "x")]
    got = {r["class"]: (r.tp, r.fp, r.fn, r.support) for r in evaluation.per_class(spark.createDataFrame(rows, "t string, p string"), "t", "p").collect()}
    assert got == {"x": (1, 1, 1, 2), "y": (1, 1, 0, 1), "z": (0, 0, 1, 1)}
    train = spark.createDataFrame([("r", "a")] * 3 + [("r", "b")] * 2 + [("s", "c")], "repo string, who string")
    test = spark.createDataFrame([("r", "a"), ("r", "b"), ("r", "q"), ("s", "c")], "repo string, who string")
    hits = {r.repo: (r.n, r.hit_1, r.hit_3) for r in evaluation.hit_rates(train, test, "repo", "who").collect()}
    assert hits == {"r": (3, 0.3333, 0.6667), "s": (1, 1.0, 1.0), None: (4, 0.5, 0.75)}


def test_category(spark):
    classes = {"bug": "bug", "type:bug": "bug", "regression": "bug", "type:support": "question", "question": "question", "feature-request": "feature", "duplicate": "duplicate"}
    cases = [(["bug"], "bug"), (["type:bug"], "bug"), ([" Type:Bug\n"], "bug"), (["bug", "*duplicate"], "duplicate"), (["feature-request", "*question"], "question"), (["stale", None], None), ([], None), (None, None)]
    df = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(cases)], "k int, x array<string>")
    got = {r.k: r.c for r in df.select("k", labels.category(F.col("x"), classes, ["duplicate", "question", "bug", "feature"]).alias("c")).collect()}
    assert [got[k] for k in range(len(cases))] == [c for _, c in cases]


def test_csv_keeps_quotes_lines_and_nesting(spark, tmp_path):
    rows = [(1, 'a "b"\nc, d', ["x", 'y"'], True), (2, None, [], None), (3, "NA", None, False)]
    df = spark.createDataFrame(rows, "k int, t string, l array<string>, b boolean")
    files.write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "c"), df.schema).collect())) == sorted(rows)


def test_replay_skips_broken_and_counts_unknown(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "x.json").write_text('{"type":"view","k":1}\nnot json\n{"type":"odd","k":2}\n')
    known, counts = files.replay_jsonl(spark, str(tmp_path / "l"), "type string, k long", "type", ["view"])
    assert [tuple(r) for r in known.collect()] == [("view", 1)]
    assert {r.type: r.n for r in counts.collect()}["odd"] == 1


def test_runs_are_appended_with_equal_digests(spark, tmp_path):
    df = spark.range(20)
    for run, rows in (("a", df), ("b", df.orderBy(F.desc("id"))), ("c", df.limit(19))):
        files.register_run(spark, rows, run, str(tmp_path / "runs"))
    got = {r.run: (r.n_rows, r.digest) for r in spark.read.parquet(str(tmp_path / "runs")).collect()}
    assert got["a"] == got["b"] != got["c"] and got["c"][0] == 19


def test_models(spark):
    chosen = models.select_by_folds(temporal.walk_forward(training._frame(spark, "/root/testdata/sf0.01"), "all", ["doc_id"], 2, 0.2).cache(), training.COLUMNS, "quality", ["logistic", "logistic_balanced"]).collect()
    assert len(chosen) == 2 and sum(r.chosen for r in chosen) == 1 and max(r.mean_ap for r in chosen) > 0.9
    rows = training.calibrated_scores(spark, "/root/testdata/sf0.01").collect()
    assert rows and all(0 <= r.calibrated <= 1 for r in rows)
    assert training.effort_regression(spark, SF).first().spearman > 0.3


def test_walk_forward_rounds_its_bounds(spark):
    df = spark.range(1, 16).select(F.lit("g").alias("g"), F.col("id"))
    got = {(r.fold, r.part): (r.a, r.b) for r in temporal.walk_forward(df, "g", ["id"], 3, 0.1).groupBy("fold", "part").agg(F.min("id").alias("a"), F.max("id").alias("b")).collect()}
    assert got[0, "train"] == (1, 11) and got[0, "validation"] == (12, 12)
    for n, fraction, train in ((10, 0.2, 8), (10, 0.15, 8), (2, 0.2, 1), (1, 0.2, 1)):
        assert temporal.chronological_split(df.limit(n), "g", ["id"], fraction).where("part = 'train'").count() == train


def test_ranks_keep_null_groups_and_keys(spark):
    rows = [(None, 5), (None, None), (None, 70_000), ("a", 200_000), ("a", 1)]
    got = {(r.g, r.k): (r["_k"], r["_n"]) for r in temporal.ranked(spark.createDataFrame(rows, "g string, k long"), "g", ["k"]).collect()}
    assert got == {(None, None): (1, 3), (None, 5): (2, 3), (None, 70_000): (3, 3), ("a", 1): (1, 2), ("a", 200_000): (2, 2)}


def test_elapsed_days(spark):
    rows = [("2024-03-04 00:30:00", "2024-03-03 23:30:00", 0), ("2024-03-03 23:30:00", "2024-03-04 00:30:00", -1), ("2024-03-04 15:00:00", "2024-02-01 00:00:00", 32), ("2024-03-04 15:00:00", "2020-03-04 00:00:00", 1461)]
    df = spark.createDataFrame(rows, "a string, b string, want int")
    assert df.where(temporal.days_between(F.col("a").cast("timestamp"), F.col("b").cast("timestamp")) != F.col("want")).count() == 0


def test_an_outcome_uses_its_prediction_up(spark):
    kinds = ["prediction", "outcome", "outcome", "prediction", "prediction", "outcome"]
    df = spark.createDataFrame([(1, k, kind, float(k)) for k, kind in enumerate(kinds)] + [(2, 0, "outcome", 9.0), (3, 0, "prediction", 9.0)], "key long, at int, kind string, value double")
    df = df.withColumn("at", F.timestamp_seconds("at"))
    assert sorted((r.key, r.score, r.outcome) for r in ledger.grade(df).collect()) == [(1, 0.0, 1.0), (1, 4.0, 5.0)]
    assert {r.key: tuple(r)[1:] for r in ledger.open_counts(df).collect()} == {1: (3, 2, 1, 0), 2: (0, 0, 1, 0), 3: (1, 0, 0, 1)}


def test_issue_rules(spark):
    base = {"author": "alice", "locked": False, "labels": [], "state_reason": None, "merged_link": False, "references": [], "number": 1}
    words = "Fix Fixes Fixed Close Closes Closed Resolve Resolves Resolved fix fixes fixed CLOSES RESOLVED".split()
    cases = [
        ({"author": None}, "drop_no_author"), ({"author": ""}, "drop_no_author"), ({"author": "dependabot[bot]", "merged_link": True}, "drop_bot"), ({"locked": True, "merged_link": True}, "R1_merged_pr_link"), ({"labels": ["question"], "merged_link": True}, "drop_question"),
        ({"number": 42, "references": [(False, "Fixes #42")]}, "R4_default_non_actionable"), ({"number": 123, "references": [(True, "Fixes #1234")]}, "R4_default_non_actionable"), ({"number": 42, "references": [(True, "prefixes #42")]}, "R4_default_non_actionable"),
        ({"labels": ["Bug "], "state_reason": "COMPLETED"}, "R2_bug_label_completed"), ({"labels": ["bug"]}, "R4_default_non_actionable"), ({"state_reason": "NOT_PLANNED"}, "R3b_state_not_planned"), ({}, "R4_default_non_actionable"),
        *[({"labels": [None, x]}, "R3_non_actionable_label") for x in ("duplicate", "invalid", "wontfix", "stale", "not-a-bug")], *[({"number": 42, "references": [(True, f"{w} #42")]}, "R1b_merged_pr_textual_reference") for w in words],
    ]
    rows = [(k, *{**base, **over}.values(), rule) for k, (over, rule) in enumerate(cases)]
    df = spark.createDataFrame(rows, "k int, author string, locked boolean, labels array<string>, state_reason string, merged_link boolean, references array<struct<merged: boolean, body: string>>, number long, want string")
    found = labels.issue_rules(*[F.col(c) for c in base])
    assert df.where(rules.first_rule(found[:-1], found[-1][0]) != F.col("want")).select("k").collect() == []
    locked = labels.issue_rules(*[F.col(c) for c in base], drop_locked=True)
    assert df.where("k = 3").select(rules.first_rule(locked[:-1], locked[-1][0])).first()[0] == "drop_locked"


def test_large_query_sets_meet_rows_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, i % 3, [float(x) for x in rng.normal(size=4)]) for i in range(60)], "id long, g int, v array<double>")
    small = sorted(map(tuple, similarity.top_similar(df, df, "g", 3, 0.1).select("q_id", "id", "similarity", "rank").collect()))
    monkeypatch.setattr(similarity, "MAX_BROADCAST", 7)
    assert sorted(map(tuple, similarity.top_similar(df, df, "g", 3, 0.1).select("q_id", "id", "similarity", "rank").collect())) == small


def test_running_sums_share_a_hot_group(spark):
    """Hundreds of thousands of distinct scores in one group: the same values as a sort, and no range holds more than its share."""
    n = 100_000
    df = spark.range(n).select(F.lit("g").alias("g"), (F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / F.lit(float(1 << 52))).alias("p"), "id").withColumn("y", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) < 60 * F.col("p") + 20).cast("int"))
    df = df.unionByName(spark.createDataFrame([("few", 0.5, 1, 1), ("few", 0.5, 2, 0), (None, 0.25, 3, 1), (None, 0.75, 4, 0)], "g string, p double, id long, y int")).cache()
    rows = df.where("g = 'g'").toPandas().sort_values("p", ascending=False)
    y, at = rows.y.to_numpy(), np.arange(1, n + 1)
    tp = np.cumsum(y)
    roc, ap = (tp * (1 - y)).sum() / (y.sum() * (n - y.sum())), (y * tp / at).sum() / y.sum()
    got = {r.g: r for r in metrics.auc(df, "y", "p", "g").collect()}
    assert got["g"].roc_auc == pytest.approx(roc) and got["g"].average_precision == pytest.approx(ap)
    assert (got["few"].roc_auc, got["few"].average_precision) == (0.5, 0.5) and (got[None].roc_auc, got[None].average_precision) == (0.0, 0.5)
    largest = prefix.ranged(df, "g", "p").where("g = 'g'").groupBy("_range").count().agg(F.max("count")).first()[0]
    assert largest < 0.02 * n
    x = df.where("g = 'g'").select("g", F.col("p").alias("x"), (F.col("p") * F.col("p") + F.col("y")).alias("z"))
    pandas = x.toPandas()
    assert evaluation.spearman(x, "x", "z", "g").first().spearman == pytest.approx(pandas.x.rank().corr(pandas.z.rank()))


def test_best_prior_loses_no_link(spark):
    """Against all pairs: random sparse vectors with copies, near copies and one very common term."""
    rnd = np.random.default_rng(6)
    rows, known = [], {}
    for k in range(150):
        if k % 5 == 1:
            v = dict(known[k - 1])
        elif k % 5 == 2:
            v = {**known[k - 1], int(rnd.integers(0, 60)): 0.3}
        else:
            v = {int(p): float(w) for p, w in zip(rnd.choice(60, 8, replace=False), rnd.random(8) + 0.1)} | {60: 1.0}
        length = np.sqrt(sum(w * w for w in v.values()))
        known[k] = {p: float(w / length) for p, w in v.items()}
        rows += [(k, "ab"[k // 5 % 2], p, w) for p, w in known[k].items()]
    got = {r.k: (r.of, r.similarity) for r in similarity.best_prior(spark.createDataFrame(rows, "k long, g string, place int, weight double"), "k", "g", 0.6).collect()}
    expected = {}
    for k, v in known.items():
        found = [(-round(sum(w * known[j].get(p, 0.0) for p, w in v.items()), 6), j) for j in range(k) if j // 5 % 2 == k // 5 % 2]
        if found and -min(found)[0] >= 0.6:
            expected[k] = (min(found)[1], -min(found)[0])
    assert {k: of for k, (of, _) in got.items()} == {k: of for k, (of, _) in expected.items()} and all(got[k][1] == pytest.approx(expected[k][1], abs=2e-6) for k in got) and len(got) > 60
    assert similarity.best_prior(spark.createDataFrame([], "k long, g string, place int, weight double"), "k", "g", 0.6).count() == 0


def _cosine_dups(spark, tmp_path, rows):
    """The query's rows, those of its SQL, and the bytes that the query shuffled."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    written = lambda: time.sleep(1) or spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    got = sorted(map(tuple, plans_evaluation.tfidf_cosine_dups(spark, str(tmp_path)).collect()))
    after = written()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    return got, sorted(db.execute(plans_evaluation.SQL["tfidf_cosine_dups"]).fetchall()), after - before


def test_cosine_dups_shuffle_no_pairs(spark, tmp_path):
    """Documents that share their rarest terms, as those of a language do: neither the terms of rows nor pairs are shuffled."""
    rnd = np.random.default_rng(4)
    pool = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(rnd.choice(pool, 70)), "en") for k in range(900)]
    rows += [(900 + k, rows[k * 7][1] + (" w1 w2" if k % 2 else ""), "en") for k in range(60)]
    got, want, shuffled = _cosine_dups(spark, tmp_path, rows)
    assert got == want and len(got) == 60
    assert shuffled < 10 * sum(len(r[1]) for r in rows)


def test_cosine_dups_odd_rows(spark, tmp_path):
    """Ids that repeat in one language or two count as often as in SQL; ids, texts and languages of null, and rows without terms."""
    texts = ["alpha beta gamma delta", "alpha beta gamma epsilon", "zeta eta theta iota kappa", "alpha beta gamma delta", "zeta eta theta iota", "x", "", None, "one two", "one one two two"]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(20 + k, t, None) for k, t in enumerate(texts)]
    got, want, _ = _cosine_dups(spark, tmp_path / "plain", rows)
    assert got == want and len(got) >= 4
    rows += [(1, texts[0], "en"), (3, texts[2], "de"), (4, texts[3], "en"), (4, texts[4], "en"), (None, texts[0], "en"), (None, texts[2], "en"), (40, texts[2], "de")]
    got, want, _ = _cosine_dups(spark, tmp_path / "repeated", rows)
    assert got == want and len(got) >= 4


def test_frequent_terms_of_ties(spark):
    """Of terms with one count the smallest are taken, words and pairs alike; a bound that too few terms reach falls."""
    df = spark.createDataFrame([(k, " ".join(f"{c}{c}" for c in "fbdgaceh"[: 4 + k % 5]) + " zz" * 40, "en") for k in range(40)], "id long, text string, g string")
    for most in (1, 2, 3, 6, 9, 12, 100):
        want = vectors.tf_idf(df, "id", "text", 2, most).groupBy("id").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
        found, idf = vectors.term_vectors(df, "id", "text", "g", 2, most)
        weigh = similarity.by_counts(idf)
        got = {r.id: (r.n, round(float(weigh(np.frombuffer(r.places, np.uint16), np.frombuffer(r.counts, np.uint8), np.array([0, r.n])).sum()), 6)) for r in found.collect()}
        assert got == {r.id: (r.n, round(r.w, 6)) for r in want.collect()}, most


def test_accents_fold(spark):
    df = spark.createDataFrame([("ÉÀñ ß ø ǎ ế é 日本",)], "t string")
    assert df.select(vectors.folded(F.lower("t"))).first()[0] == "ean ß ø a e e 日本"


@pytest.mark.parametrize("last", [1, 3, 7])
def test_rolling_frames_across_blocks(spark, last):
    """Blocks of 4 rows, groups of null, null values and an extra column: frames equal a slice of the sorted rows."""
    rng = np.random.default_rng(last)
    rows = [(g, i, None if rng.random() < 0.3 else float(rng.integers(0, 9)), "x") for g in ("a", None, "b") for i in range({"a": 23, None: 9, "b": 1}[g])]
    df = spark.createDataFrame(rows, "g string, at long, v double, n_rows string").repartition(5)
    got = {(r.g, r["at"]): r for r in rolling.rolling_percentiles(df, "g", ["at"], "v", last, {"low": 0.0, "mid": 0.5, "high": 0.99}).collect()}
    small = {(r.g, r["at"]): r.seen for r in rolling.last_rows(df, "g", ["at"], last, {"seen": F.collect_list("at")}, least_block=4).collect()}
    assert len(got) == len(small) == len(rows)
    for g, i, _, _ in rows:
        frame = sorted(v for h, j, v, _ in rows if h == g and i - last < j <= i and v is not None)
        at = lambda share: frame[min(len(frame) - 1, int(len(frame) * share))] if frame else None
        assert (got[g, i].n, got[g, i].low, got[g, i].mid, got[g, i].high, got[g, i].n_rows) == (len(frame), at(0.0), at(0.5), at(0.99), "x")
        assert small[g, i] == list(range(max(0, i - last + 1), i + 1))
    assert rolling.rolling_percentiles(df.limit(0), "g", ["at"], "v", last, {"mid": 0.5}).count() == 0


def test_macro_f1_by_group(spark):
    rng = np.random.default_rng(5)
    rows = [(g, int(t), int(t) if rng.random() < 0.6 else int(rng.integers(0, 4))) for g in ("a", "b", None) for t in rng.integers(0, 3, 60)]
    got = {r.g: r.macro_f1 for r in evaluation.macro_f1(spark.createDataFrame(rows, "g string, t int, p int"), "t", "p", "g").collect()}
    for g in ("a", "b", None):
        pairs = [(t, p) for h, t, p in rows if h == g]
        f1 = [2 * sum(t == p == c for t, p in pairs) / (sum(t == c for t, _ in pairs) + sum(p == c for _, p in pairs)) for c in {x for pair in pairs for x in pair}]
        assert got[g] == pytest.approx(sum(f1) / len(f1))


def _two_features(spark, n, classes=3):
    rng = np.random.default_rng(n)
    return spark.createDataFrame([(i, 1, i % classes, float(rng.normal(i % classes)), float(rng.normal(-(i % classes)))) for i in range(n)], "id long, all int, y int, a double, b double")


def test_selection_equals_separate_fits(spark):
    folds = temporal.walk_forward(_two_features(spark, 300), "all", ["id"], 2, 0.2).cache()
    got = {r.model: r for r in models.select_classes(folds, ["a", "b"], "y").collect()}
    assert set(got) == {"logistic", "logistic_balanced", "forest_balanced"} and sum(r.chosen for r in got.values()) == 1
    alone = []
    for k in (0, 1):
        train = models.balanced(folds.where((F.col("fold") == k) & (F.col("part") == "train")), "y")
        seen = models.predictions(models.fit(train, ["a", "b"], models.candidates("y")["logistic"]), folds.where((F.col("fold") == k) & (F.col("part") == "validation")), "p")
        alone.append(evaluation.per_class(seen.withColumn("p", F.col("p").cast("int")), "y", "p").first().macro_f1)
    assert got["logistic"].folds == 2 and got["logistic"].mean_f1 == pytest.approx(np.mean(alone)) and got["logistic"].std_f1 == pytest.approx(np.std(alone))
    ranks = models.select_regression(folds.withColumn("t", F.col("y").cast("double")), ["a", "b"], "t").collect()
    assert {r.model for r in ranks} == {"ridge", "forest"} and all(r.folds == 2 and r.mean_rank > 0.4 for r in ranks) and sum(r.chosen for r in ranks) == 1


def test_sigmoids_need_all_classes(spark):
    df = _two_features(spark, 300)
    model = models.fit(models.balanced(df, "y"), ["a", "b"], models.candidates("y")["logistic_balanced"])
    assert models.sigmoids(model, df, df.where("y < 2"), "y") is None
    plain = [r.probabilities for r in models.class_probabilities(model, df, None).orderBy("id").collect()]
    curves = models.sigmoids(model, df, df, "y")
    fine = [r.probabilities for r in models.class_probabilities(model, df, curves).orderBy("id").collect()]
    assert len(curves) == 3 and np.allclose(np.sum(fine, axis=1), 1) and np.allclose(np.sum(plain, axis=1), 1)
    want = 1 / (1 + np.exp(-(np.array(plain) * [a for a, _ in curves] + [b for _, b in curves])))
    assert np.allclose(fine, want / want.sum(axis=1, keepdims=True))


def test_models_are_saved_with_a_digest(spark, tmp_path):
    df = _two_features(spark, 100, 2)
    model = models.fit(models.balanced(df, "y"), ["a", "b"], models.candidates("y")["logistic"])
    path = f"file://{tmp_path}/model"
    found = models.save(spark, model, path)
    assert found == models.digest(spark, path) and len(found) == 64
    assert models.scores(models.load(spark, path), df).orderBy("id").collect() == models.scores(model, df).orderBy("id").collect()
    part = next(p for p in (tmp_path / "model").rglob("part-*") if "metadata" in str(p))
    part.write_text(part.read_text().replace("Pipeline", "pipeline", 1))
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        models.load(spark, path)


def test_importances_of_active_features(spark):
    df = _two_features(spark, 200, 2).withColumn("b", F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("b"))).withColumn("c", F.lit(1.0))
    columns = ["a", "b", "c"]
    model = models.fit(models.balanced(df, "y"), columns, models.candidates("y")["forest_balanced"])
    weights = model.stages[-1].featureImportances.toArray()
    got = {(r.id, r["rank"]): (r.feature, r.importance) for r in models.importances(model, df, "id", columns, 2).collect()}
    want = {}
    for r in df.collect():
        active = sorted((-w, i) for i, (c, w) in enumerate(zip(columns, weights)) if r[c] != 0 and w > 0)[:2]
        want |= {(r.id, k): (columns[i], -less) for k, (less, i) in enumerate(active, 1)}
    assert got == want and {f for f, _ in got.values()} == {"a", "b"}


def test_labels_lose_all_white_space(spark):
    df = spark.createDataFrame([(["\u00a0Bug\u3000", "\u2003**Docs\x1f", "a\u00a0b", None],)], "x array<string>")
    assert tuple(df.select(labels.plain(F.col("x")), labels.normal(F.col("x"))).first()) == (["bug", "**docs", "a\u00a0b", ""], ["bug", "docs", "a\u00a0b", ""])


def test_content_key(spark):
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c string")
    made = [keys.content_key({n: F.col(n) for n in order}) for order in ("abc", "cba", "ab")]
    one, two, less = df.select(*[k.alias(f"k{i}") for i, k in enumerate(made)]).first()
    assert one == two == hashlib.sha256(b'{"a":1,"b":"x","c":null}').hexdigest() != less


def test_blocks_of_queries_and_rows_are_multiplied(spark, monkeypatch):
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.normal(size=6)] for _ in range(40)]
    odd = [None, [0.0] * 6, [1.0, 2.0], [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6]
    rows = [(i, None if i % 7 == 0 else i % 3, [*vectors, *odd][i * 11 % 45] if i % 4 else vectors[0]) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, g int, v array<double>")
    asked = df.where("id % 2 = 0")
    for group, k, floor in (("g", 3, 0.1), (None, 5, None), ("g", 4, None), (None, 100, None)):
        run = lambda: sorted(map(str, similarity.top_similar(asked, df, group, k, floor).collect()))  # noqa: E731, B023
        with monkeypatch.context() as m:
            small = run()
            m.setattr(similarity, "MAX_BROADCAST", 50)
            m.setattr(similarity, "BATCH", 16)
            assert run() == small
            assert "Join" not in similarity.top_similar(asked, df, group, k, floor)._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_where_their_row_is(spark):
    from lumenlake.operators import vectors

    rows = [(1, "Été in the red red House"), (2, "red house, red"), (3, None), (4, "x"), (5, "the red house is red")]
    docs = spark.createDataFrame(rows, "k long, text string")
    for stop, fold in (((), False), (("the", "in"), True)):
        plain = vectors.terms(docs, "k", "text", stop, fold).groupBy("k", "term").agg(F.count("*").alias("tf"))
        assert sorted(map(tuple, vectors.counted_in_place(docs, "k", "text", stop, fold).collect())) == sorted(map(tuple, plain.collect()))
    found = vectors.tf_idf(docs, "k", "text", 2, 10)
    assert "hashpartitioning(k#" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", term#" not in "".join(x for x in plan.splitlines() if "hashpartitioning(k#" in x)
    twice = vectors.tf_idf(docs.unionByName(docs), "k", "text", 2, 10).groupBy("k", "term").count()  # rows with one key are one text
    assert twice.where("count > 1").isEmpty() and twice.count() == found.count() > 0
