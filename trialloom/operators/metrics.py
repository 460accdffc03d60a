"""Classification, multi-label and regression metrics from grouped counts and distributed orderings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from trialloom.functions import vectors
from trialloom.operators.ranking import average_ranks, value_prefix
from trialloom.operators.reshape import each, with_totals


def _n(condition: Column) -> Column:
    return F.sum(condition.cast("bigint"))


def confusion(df: DataFrame, classes: int) -> DataFrame:
    """(y, yhat, n) over the dense label grid, empty cells included."""
    counted = df.groupBy("y", "yhat").agg(F.count("*").alias("n"))
    grid = each(each(df.sparkSession.range(1).select(), "y", list(range(classes))), "yhat", list(range(classes)))
    return grid.join(counted, ["y", "yhat"], "left").na.fill(0, ["n"])


def class_counts(df: DataFrame, classes: int, weight: Column | None = None) -> DataFrame:
    """(class, tp, fp, fn), weighted if asked: from one grouping of the rows by (y, yhat)."""
    w = F.lit(1).cast("bigint") if weight is None else weight
    cells = df.groupBy("y", "yhat").agg(F.sum(w).alias("w"))
    long = each(cells, "class", list(range(classes)))
    y, guess, c = F.col("y"), F.col("yhat"), F.col("class")
    return long.groupBy("class").agg(
        F.sum(F.when((y == c) & (guess == c), F.col("w")).otherwise(0)).alias("tp"),
        F.sum(F.when((y != c) & (guess == c), F.col("w")).otherwise(0)).alias("fp"),
        F.sum(F.when((y == c) & (guess != c), F.col("w")).otherwise(0)).alias("fn"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 where undefined."""
    return F.when(2 * tp + fp + fn == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn))


def per_class(df: DataFrame, classes: int) -> DataFrame:
    counts = class_counts(df, classes)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "class", (tp + fn).alias("support"), F.when(tp + fp == 0, 0.0).otherwise(tp / (tp + fp)).alias("precision"),
        F.when(tp + fn == 0, 0.0).otherwise(tp / (tp + fn)).alias("recall"), f1(tp, fp, fn).alias("f1"))


def multiclass_metrics(df: DataFrame, classes: int) -> DataFrame:
    """One row: macro F1 over the full ontology, balanced accuracy over present classes, accuracy."""
    counts = class_counts(df, classes)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.agg(
        F.avg(f1(tp, fp, fn)).alias("macro_f1"), F.avg(F.when(tp + fn > 0, tp / (tp + fn))).alias("balanced_accuracy"),
        (F.sum("tp") / F.sum(tp + fn)).alias("accuracy"))


def auroc(scored: DataFrame) -> DataFrame:
    """(class, auroc) of long rows (class, score, positive), ties at mean rank; NULL for a one-sided class."""
    at = value_prefix(scored, ["class"], "score", {"n": F.lit(1), "p": F.col("positive")})
    rank = F.col("before_n") + (F.col("n") + 1) / 2.0
    sums = at.groupBy("class").agg(F.sum(F.col("p") * rank).alias("r"), F.sum("p").alias("pos"), F.sum("n").alias("all"))
    pos, neg = F.col("pos"), F.col("all") - F.col("pos")
    return sums.select("class", F.when((pos > 0) & (neg > 0), (F.col("r") - pos * (pos + 1) / 2.0) / (pos * neg)).alias("auroc"))


def average_precision(scored: DataFrame) -> DataFrame:
    """(class, average_precision): precision at every distinct score, weighted by the recall it adds."""
    at = value_prefix(scored, ["class"], "score", {"n": F.lit(1), "p": F.col("positive")}, descending=True)
    seen, hits = F.col("before_n") + F.col("n"), F.col("before_p") + F.col("p")
    sums = at.groupBy("class").agg(F.sum(F.col("p") * hits / seen).alias("s"), F.sum("p").alias("pos"))
    return sums.select("class", F.when(F.col("pos") > 0, F.col("s") / F.col("pos")).alias("average_precision"))


def multilabel_metrics(long: DataFrame, labels: int) -> DataFrame:
    """One row from (id, class, truth, guess, score): macro and micro F1, exact match, macro average precision."""
    t, g = F.col("truth") == 1, F.col("guess") == 1
    counts = long.groupBy("class").agg(_n(t & g).alias("tp"), _n(~t & g).alias("fp"), _n(t & ~g).alias("fn"))
    f = counts.agg(
        (F.sum(f1(F.col("tp"), F.col("fp"), F.col("fn"))) / labels).alias("macro_f1"),
        f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"))
    exact = long.groupBy("id").agg(F.bool_and(F.col("truth") == F.col("guess")).alias("same")).agg(
        F.avg(F.col("same").cast("double")).alias("exact_match"))
    ap = average_precision(long.withColumn("positive", F.col("truth"))).agg(
        F.avg("average_precision").alias("macro_average_precision"))
    return with_totals(with_totals(f, exact), ap)


def regression_metrics(df: DataFrame) -> DataFrame:
    """One row from (y, yhat): MAE, Spearman correlation on mean ranks, R2 with the variance taken around the mean."""
    ry = average_ranks(df, [], "y", "ry")
    rp = average_ranks(df, [], "yhat", "rp")
    ranked = df.groupBy("y", "yhat").agg(F.count("*").alias("n")).join(ry, "y").join(rp, "yhat")
    n = F.col("n")
    moments = ranked.agg(
        F.sum(n).alias("m"), F.sum(n * F.col("ry")).alias("a"), F.sum(n * F.col("rp")).alias("b"),
        F.sum(n * F.col("ry") * F.col("rp")).alias("ab"), F.sum(n * F.col("ry") * F.col("ry")).alias("aa"),
        F.sum(n * F.col("rp") * F.col("rp")).alias("bb"))
    m, a, b = F.col("m"), F.col("a"), F.col("b")
    spread = F.sqrt((m * F.col("aa") - a * a) * (m * F.col("bb") - b * b))
    spearman = moments.select(F.when(spread > 0, (m * F.col("ab") - a * b) / spread).alias("spearman_r"))
    y, p = F.col("y").cast("double"), F.col("yhat").cast("double")
    errors = df.agg(F.avg(F.abs(y - p)).alias("mae"), F.when(F.var_pop(y) > 0, 1 - F.sum((y - p) * (y - p)) / (F.var_pop(y) * F.count("*"))).alias("r2"))
    return with_totals(errors, spearman)


def weighted_utility(df: DataFrame, classes: int, weight: str) -> DataFrame:
    """One row: weighted macro F1 (NULL without weight)."""
    counts = class_counts(df, classes, F.col(weight))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.agg(F.when(F.sum(tp + fn) > 0, F.avg(f1(tp, fp, fn))).alias("utility"))


def weighted_error(df: DataFrame, weight: str) -> DataFrame:
    """One row: minus the weighted mean absolute error (NULL without weight)."""
    w = F.col(weight)
    return df.agg(F.when(F.sum(w) > 0, -F.sum(w * F.abs(F.col("y") - F.col("yhat"))) / F.sum(w)).alias("utility"))


def class_weights(df: DataFrame, label: str, classes: int) -> DataFrame:
    """(label, n, weight): N / (C * n)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    out = with_totals(counts, counts.agg(F.sum("n").alias("_all")))
    return out.select(label, "n", (F.col("_all") / (classes * F.col("n"))).alias("weight"))


def label_distribution(df: DataFrame, label: Column, known: list) -> DataFrame:
    """(label, n, percent); labels outside the known ones share the bucket 'unknown'."""
    counts = df.groupBy(F.when(label.isin(known), label).otherwise("unknown").alias("label")).agg(F.count("*").alias("n"))
    out = with_totals(counts, counts.agg(F.sum("n").alias("_all")))
    return out.select("label", "n", (100.0 * F.col("n") / F.col("_all")).alias("percent"))


def standardise(df: DataFrame, value: str, fit: Column) -> DataFrame:
    """Adds ``z`` by mean and population standard deviation of the fit rows, and ``restored`` = value again."""
    stats = df.where(fit).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    out = with_totals(df, stats).withColumn("z", (F.col(value) - F.col("_mean")) / F.col("_std"))
    return out.withColumn("restored", F.col("z") * F.col("_std") + F.col("_mean"))


def vector_agreement(joined: DataFrame, atol: float = 2e-2, rtol: float = 2e-3, min_cosine: float = 0.9995) -> DataFrame:
    """One row over (left_vector, right_vector): largest differences, cosines, closeness, match."""
    a, b = F.col("left_vector"), F.col("right_vector")
    diff = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    rel = F.zip_with(a, b, lambda x, y: F.abs(x - y) / F.greatest(F.abs(y), F.lit(1e-8)))
    close = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: ok)
    cosine = vectors.dot(a, b) / (F.greatest(vectors.norm(a), F.lit(1e-12)) * F.greatest(vectors.norm(b), F.lit(1e-12)))
    rows = joined.select(F.array_max(diff).alias("d"), F.array_max(rel).alias("r"), close.alias("c"), cosine.alias("cos"))
    out = rows.agg(
        F.count("*").alias("shared_count"), F.max("d").alias("max_abs_diff"), F.max("r").alias("max_rel_diff"),
        F.min("cos").alias("min_cosine"), F.avg("cos").alias("mean_cosine"), F.bool_and("c").alias("allclose"))
    return out.withColumn("match", F.col("allclose") & (F.col("min_cosine") >= min_cosine))


def frechet_distance(df: DataFrame, vector: str, side: str, width: int, epsilon: float = 1e-6) -> DataFrame:
    """One row: Frechet distance between the two sides' vectors.

    Every batch gives its count, sum and sum of outer products; these width*width partials are added up by Spark, and
    the eigenvalue step sees the two finished moment tables only.
    """
    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rows in batch.groupby("side"):
                x = np.stack([np.asarray(v, dtype=float) for v in rows["vector"]])
                cells = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                yield pd.DataFrame({"side": int(name), "cell": np.arange(len(cells)), "part": cells})

    cells = df.select(F.col(side).cast("int").alias("side"), F.col(vector).alias("vector")).mapInPandas(
        partials, "side int, cell int, part double")
    sums = cells.groupBy("side", "cell").agg(F.sum("part").alias("part"))
    table = sums.groupBy("side").agg(F.array_sort(F.collect_list(F.struct("cell", "part"))).alias("m"))
    both = table.agg(*[F.max(F.when(F.col("side") == s, F.transform("m", lambda x: x["part"]))).alias(f"m{s}") for s in (0, 1)])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for m0, m1 in zip(batch["m0"], batch["m1"]):
                means, covs = [], []
                for m in (np.asarray(m0), np.asarray(m1)):
                    n, s, q = m[0], m[1:1 + width], m[1 + width:].reshape(width, width)
                    means.append(s / n)
                    covs.append((q - np.outer(s, s) / n) / (n - 1) + np.eye(width) * epsilon)
                values, basis = np.linalg.eigh(covs[0])
                root = (basis * np.sqrt(np.clip(values, 0, None))) @ basis.T
                mixed = np.clip(np.linalg.eigvalsh(root @ covs[1] @ root), 0, None)
                gap = means[0] - means[1]
                out.append(max(0.0, float(gap @ gap + np.trace(covs[0]) + np.trace(covs[1]) - 2 * np.sqrt(mixed).sum())))
            yield pd.DataFrame({"frechet_distance": out})

    return both.mapInPandas(finish, "frechet_distance double")
