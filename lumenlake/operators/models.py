"""Models by Spark's own library: features, candidates, selection on walk-forward folds, calibration, regression."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import stored
from . import evaluation, metrics

#: Candidates that are fitted at the same time.
FITS = 4


def prepare(columns: list[str], mean: bool = False) -> list:
    """Median imputation, assembly and scaling without centring."""
    filled = [f"{c}_filled" for c in columns]
    return [Imputer(strategy="median", inputCols=columns, outputCols=filled, relativeError=1e-4), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(withMean=mean, inputCol="raw", outputCol="features")]


def balanced(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weights n / (k * n_class): the counts are one row per class."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy()
    weights = counts.select(label, (F.sum("_n").over(whole) / (F.count("*").over(whole) * F.col("_n"))).alias(out))
    return df.join(F.broadcast(weights), label)


def candidates(label: str, seed: int = 7, trees: int = 40) -> dict[str, object]:
    at = {"featuresCol": "features", "labelCol": label}
    return {
        "logistic": LogisticRegression(regParam=0.001, standardization=False, maxIter=200, **at),
        "logistic_balanced": LogisticRegression(regParam=0.001, standardization=False, maxIter=200, weightCol="weight", **at),
        "forest_balanced": RandomForestClassifier(numTrees=trees, maxDepth=8, seed=seed, weightCol="weight", **at),
        "boosted": GBTClassifier(maxIter=10, maxDepth=4, seed=seed, **at),
    }


def fit(train: DataFrame, columns: list[str], model) -> PipelineModel:
    return Pipeline(stages=[*prepare(columns), model]).fit(train)


def scores(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """Adds the probability of class 1."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    return model.transform(df).select(*kept, vector_to_array("probability")[1].alias(out))


def vote(df: DataFrame, models: dict[str, PipelineModel], out: str = "score") -> DataFrame:
    """Soft voting: the mean of the models' probabilities."""
    for name, model in models.items():
        df = scores(model, df, f"_{name}")
    names = [f"_{n}" for n in models]
    return df.withColumn(out, sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).drop(*names)


def fold_predictions(folds: DataFrame, columns: list[str], label: str, estimators: dict[str, object], predict: Callable, weighted: bool) -> DataFrame:
    """run (model and fold), label, out: each validation row once for each candidate and fold, as one table that is written once.

    The models are fitted FITS at a time. predict(model, rows, out) adds the column out. weighted: training rows get balanced weights.
    """
    folds = stored(folds, "folds")
    numbers = sorted(r.fold for r in folds.select("fold").distinct().collect())  # as many as there are folds

    def scored(job) -> DataFrame:
        name, k = job
        train, held = (folds.where((F.col("fold") == k) & (F.col("part") == part)) for part in ("train", "validation"))
        model = fit(balanced(train, label) if weighted else train, columns, estimators[name])
        return predict(model, held, "out").select(F.struct(F.lit(name).alias("model"), F.lit(k).alias("fold")).alias("run"), label, "out")

    with ThreadPool(FITS) as pool:
        parts = pool.map(inheritable_thread_target(folds.sparkSession)(scored), [(name, k) for name in estimators for k in numbers], chunksize=1)
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    return stored(long, "scored")


def chosen(measured: DataFrame, measure: str, names: list[str], short: str) -> DataFrame:
    """model, folds, mean and std (of the population) of a measure by run; chosen: 1 for the highest mean, ties to the earlier name. A fold whose measure is null does not count."""
    place = F.array_position(F.array(*map(F.lit, names)), F.col("model"))
    means = measured.select("run.model", measure).groupBy("model").agg(F.count(measure).alias("folds"), F.avg(measure).alias(f"mean_{short}"), F.stddev_pop(measure).alias(f"std_{short}"))
    best = F.row_number().over(Window.partitionBy().orderBy(F.desc_nulls_last(f"mean_{short}"), place))  # a row per candidate
    return means.withColumn("chosen", (best == 1).cast("int"))


def select_by_folds(folds: DataFrame, columns: list[str], label: str, names: list[str] | None = None) -> DataFrame:
    """model, folds, mean_ap, std_ap, chosen: average precision on each fold's validation part.

    folds has fold and part (train, validation), as walk_forward gives. A fold with one class alone does not count.
    """
    of = {n: m for n, m in candidates(label).items() if names is None or n in names}
    long = fold_predictions(folds, columns, label, of, scores, True)
    return chosen(metrics.auc(long, label, "out", "run"), "average_precision", list(of), "ap")


def predictions(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", out)


def select_classes(folds: DataFrame, columns: list[str], label: str, seed: int = 7) -> DataFrame:
    """model, folds, mean_f1, std_f1, chosen: macro-F1 of candidates for several classes, numbered from 0, on each fold's validation part."""
    of = {n: m for n, m in candidates(label, seed).items() if n != "boosted"}  # Spark's boosted trees know two classes
    long = fold_predictions(folds, columns, label, of, predictions, True).withColumn("out", F.col("out").cast(folds.schema[label].dataType))
    return chosen(evaluation.macro_f1(long, label, "out", "run"), "macro_f1", list(of), "f1")


def select_regression(folds: DataFrame, columns: list[str], target: str, seed: int = 7) -> DataFrame:
    """model, folds, mean_rank, std_rank, chosen: rank correlation of candidates on each fold's validation part."""
    of = {kind: regressor(target, kind, seed) for kind in ("ridge", "forest")}
    long = fold_predictions(folds, columns, target, of, predictions, False)
    return chosen(evaluation.spearman(long, target, "out", "run"), "spearman", list(of), "rank")


def calibrate(scored: DataFrame, label: str, score: str = "score"):
    """Isotonic calibration fitted on scored rows; apply it with calibrated()."""
    return IsotonicRegression(featuresCol=score, labelCol=label).fit(scored.withColumn(label, F.col(label).cast("double")))


def sigmoid(scored: DataFrame, label: str, score: str = "score") -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=[score], outputCol="features"), LogisticRegression(labelCol=label, maxIter=200)]).fit(scored)


def sigmoids(model: PipelineModel, fitted_on: DataFrame, held: DataFrame, label: str) -> list[tuple[float, float]] | None:
    """Slope and intercept of a sigmoid for each class against the rest, fitted on held rows; None where these lack a class that the model was fitted on."""
    if not fitted_on.select(label).distinct().join(held.select(label).distinct(), label, "left_anti").isEmpty():
        return None
    rows = stored(model.transform(held).select(F.col(label).alias("y"), vector_to_array("probability").alias("p")), "held")
    found = []
    for k in range(len(rows.first().p)):  # as many as there are classes
        one = rows.select((F.col("y") == k).cast("int").alias("y"), F.col("p")[k].alias("p"))
        if one.where("y = 1").isEmpty():  # a number between the classes that no row has
            found.append((0.0, -30.0))
            continue
        fitted = sigmoid(one, "y", "p").stages[-1]
        found.append((float(fitted.coefficients[0]), float(fitted.intercept)))
    return found


def class_probabilities(model: PipelineModel, df: DataFrame, curves: list[tuple[float, float]] | None, out: str = "probabilities") -> DataFrame:
    """Adds the probabilities of the classes: through their sigmoids, made to sum to one, or the model's own where there are none."""
    plain = vector_to_array("probability")
    kept = [F.col(f"`{c}`") for c in df.columns]
    if curves is None:
        return model.transform(df).select(*kept, plain.alias(out))
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in curves])
    raw = F.zip_with(plain, pairs, lambda p, s: 1 / (1 + F.exp(-(p * s["a"] + s["b"]))))
    total = F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x)
    return model.transform(df).select(*kept, raw.alias("_raw")).select(*kept, F.transform("_raw", lambda x: x / total).alias(out))


def calibrated(model, df: DataFrame, out: str = "calibrated") -> DataFrame:
    return model.transform(df).withColumnRenamed("prediction", out)


def regressor(target: str, kind: str = "ridge", seed: int = 7):
    return LinearRegression(regParam=0.001, labelCol=target) if kind == "ridge" else RandomForestRegressor(numTrees=40, minInstancesPerNode=5, featureSubsetStrategy="sqrt", labelCol=target, seed=seed)


def regression(train: DataFrame, columns: list[str], target: str, kind: str = "ridge", seed: int = 7) -> PipelineModel:
    return Pipeline(stages=[*prepare(columns), regressor(target, kind, seed)]).fit(train)


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the names and contents of a saved model's files, in order of name. They are as many as the model has stages and parts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1], -1)
    return hashlib.sha256("".join(f"{r.name} {r.sha}\n" for r in files.select(name.alias("name"), F.sha2("content", 256).alias("sha")).orderBy("name").collect()).encode()).hexdigest()


def save(spark: SparkSession, model: PipelineModel, path: str) -> str:
    """Writes the model to a new folder, and its digest to path + ".sha256"; returns the digest."""
    model.write().save(path)
    found = digest(spark, path)
    spark.createDataFrame([(found,)], "digest string").coalesce(1).write.text(f"{path.rstrip('/')}.sha256")
    return found


def load(spark: SparkSession, path: str) -> PipelineModel:
    """The model that save() wrote; ValueError where its files are not those that were saved."""
    if [r.value for r in spark.read.text(f"{path.rstrip('/')}.sha256").collect()] != [digest(spark, path)]:  # one line
        raise ValueError(f"{path} does not hold the model that was saved there")
    return PipelineModel.load(path)


def ship_gate(test: DataFrame, target: str, predicted: str, median: float, least_rank: float = 0.30, least_gain: float = 0.10) -> DataFrame:
    """n, mae, baseline_mae, gain, spearman, ships: against the training median as a constant."""
    rows = test.withColumn("all", F.lit(1))
    errors = rows.groupBy("all").agg(F.count("*").alias("n"), F.avg(F.abs(F.col(target) - F.col(predicted))).alias("mae"), F.avg(F.abs(F.col(target) - F.lit(median))).alias("baseline_mae"))
    both = errors.join(evaluation.spearman(rows, target, predicted, "all"), "all").withColumn("gain", 1 - F.try_divide("mae", "baseline_mae"))
    return both.select("n", "mae", "baseline_mae", "gain", "spearman", ((F.col("spearman") >= least_rank) & (F.col("gain") >= least_gain)).alias("ships"))


def explanations(model: PipelineModel, df: DataFrame, key: str, columns: list[str], k: int = 6) -> DataFrame:
    """key, rank, feature, contribution: the k largest by absolute coefficient times value of a linear model."""
    weights = [float(x) for x in model.stages[-1].coefficients]
    pairs = F.arrays_zip(F.array(*map(F.lit, columns)).alias("f"), F.zip_with(vector_to_array("features"), F.array(*map(F.lit, weights)), lambda a, b: a * b).alias("c"))
    ordered = F.array_sort(F.transform(pairs, lambda p: F.struct((-F.abs(p.c)).alias("less"), p.f.alias("feature"), p.c.alias("contribution"))))
    found = model.transform(df).select(key, F.posexplode(F.slice(ordered, 1, k)).alias("at", "p"))
    return found.select(key, (F.col("at") + 1).alias("rank"), "p.feature", "p.contribution")


def importances(model: PipelineModel, df: DataFrame, key: str, columns: list[str], k: int = 6) -> DataFrame:
    """key, rank, feature, importance: of the features that are not 0 in the row, the k that a forest gives most importance, ties in order of columns.

    The importance is the whole forest's: a size without direction. Features without importance are left out, so a row may have fewer than k, or none.
    """
    weights = [float(x) for x in model.stages[-1].featureImportances.toArray()]
    pairs = F.arrays_zip(F.array(*map(F.lit, columns)).alias("f"), F.array(*map(F.lit, weights)).alias("w"), F.array(*map(F.lit, range(len(columns)))).alias("i"), vector_to_array("features").alias("x"))
    active = F.transform(F.filter(pairs, lambda p: (p.x != 0) & (p.w > 0)), lambda p: F.struct((-p.w).alias("less"), p.i.alias("place"), p.f.alias("feature"), p.w.alias("importance")))
    found = model.transform(df).select(key, F.posexplode(F.slice(F.array_sort(active), 1, k)).alias("at", "p"))
    return found.select(key, (F.col("at") + 1).alias("rank"), "p.feature", "p.importance")
