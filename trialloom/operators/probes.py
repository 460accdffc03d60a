"""Probe models on frozen features: distributed linear models, grouped cross-validation, held-out subjects."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from trialloom.operators import jointfits, metrics
from trialloom.operators.reshape import with_totals
from trialloom.session import cut

TIE = 1e-12
ITERATIONS = 3000  # at most; a fit that needs more is an error. Every step is a pass over the data
TOLERANCE = 1e-5  # relative decrease of the loss at which a fit has converged


def with_features(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))


def metadata_vectors(df: DataFrame, categories: list[str], numbers: list[str]) -> DataFrame:
    """``df`` with x: a 0/1 entry per value of each category, then the numbers. A value that a model's training rows lack has no
    spread there and so no weight: it counts as zeros."""
    values = {c: [r[0] for r in df.select(c).distinct().where(F.col(c).isNotNull()).orderBy(c).collect()] for c in categories}
    ones = [(F.col(c).eqNullSafe(F.lit(v))).cast("double") for c in categories for v in values[c]]
    return df.withColumn("x", F.array(*ones, *[F.col(n).cast("double") for n in numbers]))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = N / (classes present * class count)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))
    weights = with_totals(counts, totals).select(label, (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("weight"))
    return df.join(weights, label)


def fit_predict(train: DataFrame, test: DataFrame, kind: str, parameter: float, iterations: int = ITERATIONS) -> DataFrame:
    """The test rows with ``yhat``, by one MLlib model; ``left_out`` fits many at once. ``parameter`` is the inverse penalty C of a
    classifier, the penalty of a ridge.

    train and test: features, y. The penalty is stated per mean loss, hence the division by the row count.
    """
    rows = train.count()
    scaler = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True, withStd=True)
    if kind == "regression":
        model = LinearRegression(featuresCol="_scaled", labelCol="y", predictionCol="_p", elasticNetParam=0.0, standardization=False,
                                 regParam=parameter / rows, maxIter=iterations, tol=TOLERANCE)
        fitted = Pipeline(stages=[scaler, model]).fit(train.withColumn("y", F.col("y").cast("double")))
        return fitted.transform(test).withColumn("yhat", F.col("_p")).drop("_scaled", "_p")
    model = LogisticRegression(featuresCol="_scaled", labelCol="y", predictionCol="_p", weightCol="weight", elasticNetParam=0.0,
                               standardization=False, regParam=1.0 / (parameter * rows), maxIter=iterations, tol=TOLERANCE)
    fitted = Pipeline(stages=[scaler, model]).fit(balanced_weights(train, "y"))
    if fitted.stages[-1].summary.totalIterations >= iterations:
        raise ValueError(f"the classifier has not converged in {iterations} steps")
    return fitted.transform(test).withColumn("yhat", F.col("_p").cast("int")).drop("_scaled", "_p", "rawPrediction", "probability")


def utility(predicted: DataFrame, kind: str, classes: int) -> float:
    """Macro F1, or minus the mean absolute error (one number)."""
    weighted = predicted.withColumn("_one", F.lit(1.0))
    row = (metrics.weighted_error(weighted, "_one") if kind == "regression" else metrics.weighted_utility(weighted, classes, "_one")).first()
    return float(row["utility"])


def left_out(df: DataFrame, group: str, kind: str, parameters: list[float], classes: int, keep: list[str], test: DataFrame | None = None) -> DataFrame:
    """(keep, y, parameter, yhat): every row (of ``test``, if given) by models that did not see its group.

    df, test: the group, x (array<double>), y and keep. All groups and parameters are fitted together (``jointfits``).
    """
    kept = list(dict.fromkeys([*keep, "y"]))
    rows, names = jointfits.numbered_groups(df, group)
    asked = None
    if test is not None:
        index = rows.select(F.col(group).alias("_name"), "_g").distinct()
        asked = test.join(index, test[group].eqNullSafe(F.col("_name"))).drop("_name")
    if kind == "regression":
        rows = cut(rows.withColumn("y", F.col("y").cast("double")))
        return jointfits.ridge_left_out(rows, len(names), parameters, kept, asked)
    rows = jointfits.shaped(rows, F.col("x"), F.array("y"))
    return jointfits.classified_left_out(rows, len(names), parameters, 1, classes, kept, asked).drop("label")


def labels_left_out(df: DataFrame, group: str, key: str, labels: int, parameter: float) -> DataFrame:
    """One balanced classifier per label of a multi-hot ``y`` array and group: (key, class, truth, guess)."""
    rows, names = jointfits.numbered_groups(df, group)
    rows = jointfits.shaped(rows, F.col("x"), F.col("y"))
    out = jointfits.classified_left_out(rows, len(names), [parameter], labels, 2, [key, "ys"])
    return out.select(key, F.col("label").alias("class"), F.get("ys", "label").alias("truth"), F.col("yhat").alias("guess"))


def select_parameter(df: DataFrame, fold: str, kind: str, grid: list[float], classes: int) -> tuple[float, float]:
    """Best parameter by mean utility over grouped folds; the smaller one on ties. The whole grid is fitted together."""
    predicted = left_out(df, fold, kind, grid, classes, [fold])
    if kind == "regression":
        scored = predicted.groupBy("parameter", fold).agg((-F.avg(F.abs(F.col("y") - F.col("yhat")))).alias("utility"))
    else:
        cells = predicted.groupBy("parameter", fold, "y", "yhat").agg(F.count("*").alias("n"))
        per_class = cells.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))).groupBy("parameter", fold, "class").agg(*[
            F.sum(F.when(rule, F.col("n")).otherwise(0)).alias(name) for name, rule in (
                ("tp", (F.col("y") == F.col("class")) & (F.col("yhat") == F.col("class"))),
                ("off", (F.col("y") == F.col("class")) != (F.col("yhat") == F.col("class"))))])
        f1 = F.when(2 * F.col("tp") + F.col("off") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("off")))
        scored = per_class.groupBy("parameter", fold).agg(F.avg(f1).alias("utility"))
    best, best_score = grid[0], float("-inf")
    for row in scored.groupBy("parameter").agg(F.avg("utility").alias("score")).orderBy("parameter").collect():
        if row["score"] > best_score + TIE:
            best, best_score = row["parameter"], row["score"]
    return best, best_score


def point_gain(correct: float, metadata: float, wrong: float) -> bool:
    """The cheap screen before refits: the right signal beats both controls."""
    return correct > metadata and correct > wrong


def permuted_accuracies(df: DataFrame, fold: str, classes: int, shuffled: DataFrame, key: str, parameter: float = 1.0) -> DataFrame:
    """(balanced_accuracy) of every replicate of ``shuffled`` (replicate, key, y), out of fold; all folds and replicates together."""
    labels = shuffled.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("replicate", "y"))), lambda s: s["y"].cast("int")).alias("ys"))
    rows, names = jointfits.numbered_groups(df.select(key, fold, "x").join(labels, key), fold)
    rows = jointfits.shaped(rows, F.col("x"), F.col("ys"))
    models = rows.select(F.size("ys")).first()[0]
    total = jointfits.permuted_hits(rows, len(names), models, classes, parameter)
    share = np.where(total[:, 0] > 0, total[:, 1] / np.maximum(total[:, 0], 1), np.nan)  # classes x models
    return df.sparkSession.createDataFrame([(float(v),) for v in np.nanmean(share, axis=0)], "balanced_accuracy double")


def decodability(df: DataFrame, fold: str, classes: int, shuffled: DataFrame, key: str, parameter: float = 1.0) -> DataFrame:
    """One row: out-of-fold balanced accuracy, its label-permutation null and one-sided p.

    df: key, fold, x, y. shuffled: (replicate, key, y), whose replicates are fitted together.
    """
    from trialloom.operators.inference import permutation_p

    predicted = cut(left_out(df, fold, "multiclass", [parameter], classes, [key]))
    observed = metrics.multiclass_metrics(predicted, classes).select("balanced_accuracy")
    null = permuted_accuracies(df, fold, classes, shuffled, key, parameter)
    return permutation_p(null, observed, "balanced_accuracy").withColumn("chance", F.lit(1.0 / classes))
