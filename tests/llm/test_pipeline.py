"""The pipeline's near-duplicate stage on odd rows, and the whole pipeline on the smallest tables."""

from collections import Counter

import corpus_pipeline
from lumenlake.llm import simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_near_duplicate_stage(spark):
    text = "one two three four five six seven eight nine ten"
    other, nameless = "quite another row that has the same id as the one above it", "a row that has no id at all but words of its own"
    rows = [(1, text), (1, text), (2, text), (2, other), (None, nameless), (None, nameless), (5, text), (7, "alone among all the others here with nothing to share")]
    docs = spark.createDataFrame([(i, t, 9, "r", 1) for i, t in rows], "doc_id long, text string, goes int, row string, nth int")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter(tuple(r)[:2] for r in got.collect()) == Counter(rows[1:6] + rows[7:])
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_stages_on_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(5000))
    rows = [(1, None), (2, ""), (2, ""), (None, "no id"), (None, None), (3, long), (4, long + " end"), (1, "another text of id one")]
    names = "doc_id long, text string, score double, matched int, cut_spans string, found int, n_chars int, label string"
    docs = spark.createDataFrame([(i, t, 0.5, 1, "c", 2, len(t or ""), "l") for i, t in rows], names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    left = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, SF).where("doc_id > 2").collect()}
    assert left == {3: long, 4: " end"}
    packed = corpus_pipeline.pack(spark, docs, SF)
    assert packed.where("piece = 0").count() == docs.count() and corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0


def test_whole_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scored = toxicity.clean(docs, toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet")))
    groups = simhash.near_duplicates(spark, scored).collect()
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in groups if r.doc_id == r.component_id}
    assert 0 < scored.count() < docs.count() and len({r.doc_id for r in rows}) > 0.7 * docs.count()
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048
