"""Queries that fit models; no SQL, as fits are not exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import models, temporal
from ..sources import files

COLUMNS = ["n_code_points", "n_tokens", "has_code", "has_link", "has_template"]


def _frame(spark: SparkSession, d: str) -> DataFrame:
    docs, known = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    shape = [c.cast("double").alias(n) for n, c in text.shape(F.col("text")).items()]
    return docs.join(known.where("quality is not null"), "doc_id").select("doc_id", "lang", F.lit(1).alias("all"), F.col("quality").cast("int").alias("quality"), *shape)


def model_selection(spark, d):
    return models.select_by_folds(temporal.walk_forward(_frame(spark, d), "all", ["doc_id"], 3, 0.10), COLUMNS, "quality")


def _languages(spark: SparkSession, d: str) -> DataFrame:
    """All documents with their shape and the number of their language, in order of its code; documents without a language are left out."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where("lang is not null")
    known = [r.lang for r in docs.select("lang").distinct().orderBy("lang").collect()]  # a table of languages
    number = F.array_position(F.array(*map(F.lit, known)), F.col("lang")) - 1
    return docs.select("doc_id", F.lit(1).alias("all"), number.cast("int").alias("class"), *[c.cast("double").alias(n) for n, c in text.shape(F.col("text")).items()])


def class_selection(spark, d):
    """Candidates for the language from the shape of a text, by macro-F1."""
    return models.select_classes(temporal.walk_forward(_languages(spark, d), "all", ["doc_id"], 3, 0.10), COLUMNS, "class")


def class_calibration(spark, d):
    """Probabilities of the languages of the newest documents: by sigmoids from the newest of the rest, or uncalibrated where these lack a language."""
    parts = files.stored(temporal.chronological_split(_languages(spark, d), "all", ["doc_id"]).withColumnRenamed("part", "outer_part"), "parts")
    inner = files.stored(temporal.chronological_split(parts.where("outer_part = 'train'"), "all", ["doc_id"], 0.15), "inner")
    fitting, held = inner.where("part = 'train'"), inner.where("part = 'test'")
    model = models.fit(models.balanced(fitting, "class"), COLUMNS, models.candidates("class")["logistic_balanced"])
    curves = models.sigmoids(model, fitting, held, "class")
    found = models.class_probabilities(model, parts.where("outer_part = 'test'"), curves)
    return found.select("doc_id", "class", "probabilities", F.lit("uncalibrated" if curves is None else "sigmoid").alias("calibration"))


def reloaded_scores(spark, d):
    """Scores of a model that was saved, checked against its digest and loaded again."""
    frame = _frame(spark, d)
    path = files.shared_path(spark, "model")
    models.save(spark, models.fit(models.balanced(frame, "quality"), COLUMNS, models.candidates("quality")["logistic_balanced"]), path)
    return models.scores(models.load(spark, path), frame).select("doc_id", "quality", "score")


def calibrated_scores(spark, d):
    """Newest rows test; of the rest the newest calibrate, and the oldest fit."""
    parts = temporal.chronological_split(_frame(spark, d), "lang", ["doc_id"]).withColumnRenamed("part", "outer_part")
    inner = files.stored(temporal.chronological_split(parts.where("outer_part = 'train'"), "lang", ["doc_id"], 0.15), "inner")
    model = models.fit(models.balanced(inner.where("part = 'train'"), "quality"), COLUMNS, models.candidates("quality")["logistic_balanced"])
    curve = models.calibrate(models.scores(model, inner.where("part = 'test'")), "quality")
    return models.calibrated(curve, models.scores(model, parts.where("outer_part = 'test'"))).select("doc_id", "quality", "score", "calibrated")


def _effort(spark: SparkSession, d: str) -> DataFrame:
    o, line = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")
    per = line.groupBy("l_orderkey").agg(F.count("*").cast("double").alias("lines"), F.sum(F.col("l_quantity").cast("double")).alias("quantity"), F.sum(F.col("l_extendedprice").cast("double")).alias("price"))
    return o.join(per, o.o_orderkey == per.l_orderkey).select("o_orderkey", "o_orderpriority", "o_orderdate", F.lit(1).alias("all"), "lines", "quantity", F.log1p("price").alias("target"))


def effort_selection(spark, d):
    """Regressions by the rank correlation of their predictions on walk-forward folds."""
    return models.select_regression(temporal.walk_forward(_effort(spark, d), "all", ["o_orderdate", "o_orderkey"], 3, 0.10), ["lines", "quantity"], "target")


def effort_regression(spark, d):
    frame = _effort(spark, d)
    parts = files.stored(temporal.chronological_split(frame, "o_orderpriority", ["o_orderdate", "o_orderkey"]), "parts")
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    median = train.agg(F.median("target")).first()[0]
    found = models.regression(train, ["lines", "quantity"], "target").transform(test)
    return models.ship_gate(found.select("target", "prediction"), "target", "prediction", median if median is not None else 0.0)


def linear_explanations(spark, d):
    frame = _frame(spark, d)
    model = models.fit(models.balanced(frame, "quality"), COLUMNS, models.candidates("quality")["logistic_balanced"])
    return models.explanations(model, frame, "doc_id", COLUMNS, 3)


def forest_explanations(spark, d):
    """The three most important features that a text has, by the forest for quality."""
    frame = _frame(spark, d)
    model = models.fit(models.balanced(frame, "quality"), COLUMNS, models.candidates("quality")["forest_balanced"])
    return models.importances(model, frame, "doc_id", COLUMNS, 3)


QUERIES = {f.__name__: f for f in (model_selection, class_selection, effort_selection, calibrated_scores, class_calibration, effort_regression, linear_explanations, forest_explanations, reloaded_scores)}
