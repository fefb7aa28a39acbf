"""Comparison of feature sets by cross-validated classifiers of pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stats import _order


def with_folds(rows: DataFrame, label: str, key: str, group: str | None, cv: int, seed: int = 42) -> DataFrame:
    """Adds fold: whole groups in md5 order, or rows dealt in md5 order inside each label."""
    if group:
        g = rows.select(group).distinct().select(group, ((F.row_number().over(Window.orderBy(_order(seed, F.col(group)), group)) - 1) % cv).alias("fold"))
        return rows.join(g, group)
    return rows.withColumn("fold", (F.row_number().over(Window.partitionBy(label).orderBy(_order(seed, F.col(key)), key)) - 1) % cv)


def classifier_of(name: str, seed: int):
    if name == "svm":  # a linear machine against the rest: pyspark.ml has no radial kernel
        return OneVsRest(classifier=LinearSVC(maxIter=20, regParam=0.01))
    if name == "logreg":
        return LogisticRegression(maxIter=50, regParam=1e-3)
    if name == "rf":
        return RandomForestClassifier(numTrees=200, seed=seed)
    raise ValueError("classifier is 'svm', 'logreg' or 'rf'")


def cross_validate(rows: DataFrame, features: str, label: str = "y", cv: int = 5, classifier: str = "svm", scoring: str = "accuracy", seed: int = 42) -> list[float]:
    """Scores by fold of rows with array features and a fold column."""
    at = rows.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("raw"), F.col(label).cast("string").alias("name"), "fold").cache()
    steps = [StringIndexer(inputCol="name", outputCol="label", stringOrderType="alphabetAsc"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), classifier_of(classifier, seed)]
    score = MulticlassClassificationEvaluator(metricName=scoring)
    out = []
    for k in range(cv):
        train, test = at.where(F.col("fold") != k), at.where(F.col("fold") == k)
        if not test.isEmpty():
            out.append(score.evaluate(Pipeline(stages=steps).fit(train).transform(test)))
    at.unpersist()
    return out


def classify_curvature_vs_benchmarks(rows: DataFrame, sets: dict[str, str], label: str = "y", key: str = "id", group: str | None = None, cv: int = 5, classifier: str = "svm", scoring: str = "accuracy", seed: int = 42) -> DataFrame:
    """features, fold, score for each named set of features (its array column), on the same folds."""
    folded = with_folds(rows, label, key, group, cv, seed)
    found = [(name, k, float(s)) for name, column in sets.items() for k, s in enumerate(cross_validate(folded, column, label, cv, classifier, scoring, seed))]
    return rows.sparkSession.createDataFrame(found, "features string, fold int, score double")


def summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("features").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("*").alias("folds"))


def freq_features(rows: DataFrame, bands: list) -> DataFrame:
    """dyad, condition, trial and a column for each freq: the mean value over windows."""
    return rows.groupBy("dyad", "condition", "trial").pivot("freq", bands).agg(F.avg("value"))
