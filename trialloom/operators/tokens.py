"""Token-set diagnostics: redundancy, effective rank, position liveness, collapse report; adapters over vectors."""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from trialloom.operators.decisions import token_verdict
from trialloom.operators.reshape import with_totals

_SHAPES = StructType([StructField(n, DoubleType()) for n in (
    "redundancy", "centred_redundancy", "effective_rank", "norm_min", "norm_mean", "norm_max", "finite", "tokens")])


def _redundancy(x: np.ndarray) -> float:
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    n = len(x)
    return float((np.square(unit.sum(axis=0)).sum() - np.square(unit).sum()) / (n * (n - 1)))


@F.pandas_udf(_SHAPES)
def token_shape(tokens: pd.Series) -> pd.DataFrame:
    """Per trial: mean off-diagonal cosine (raw and centred), effective rank, token norms, finiteness."""
    out = []
    for item in tokens:
        x = np.stack([np.asarray(r, dtype=float) for r in item])
        norms = np.linalg.norm(x, axis=1)
        if not np.isfinite(x).all():
            out.append((None, None, None, None, None, None, 0.0, float(len(x))))
            continue
        s = np.linalg.svd(x, compute_uv=False)
        rank = s.sum() ** 2 / max(np.square(s).sum(), 1e-12)
        out.append((_redundancy(x), _redundancy(x - x.mean(axis=0)), rank, norms.min(), norms.mean(), norms.max(), 1.0, float(len(x))))
    return pd.DataFrame(out, columns=[f.name for f in _SHAPES.fields])


def trial_shapes(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, token_shape("tokens").alias("s")).select(key, "s.*")


def position_variance(df: DataFrame) -> DataFrame:
    """(position, variance): sample variance over trials of every token coordinate, averaged over coordinates."""
    rows = df.select(F.posexplode("tokens").alias("position", "_t")).select("position", F.posexplode("_t").alias("dim", "v"))
    cells = rows.groupBy("position", "dim").agg(F.var_samp("v").alias("var"))
    return cells.groupBy("position").agg(F.avg("var").alias("variance"))


def liveness(df: DataFrame, dead: float = 1e-4) -> DataFrame:
    return position_variance(df).agg(
        F.min("variance").alias("min_position_variance"), F.avg("variance").alias("mean_position_variance"),
        F.avg((F.col("variance") < dead).cast("double")).alias("fraction_dead_positions"))


def collapse_report(df: DataFrame, key: str) -> DataFrame:
    """One row: corpus means and extremes of the trial shapes, liveness, verdict."""
    shapes = trial_shapes(df, key)
    report = shapes.agg(
        F.count("*").alias("trials"), F.max("tokens").alias("tokens_per_trial"), F.avg("redundancy").alias("redundancy_mean"),
        F.max("redundancy").alias("redundancy_max"), F.avg("centred_redundancy").alias("centred_redundancy_mean"),
        F.avg("effective_rank").alias("effective_rank_mean"), F.min("norm_min").alias("norm_min"),
        F.avg("norm_mean").alias("norm_mean"), F.max("norm_max").alias("norm_max"), (F.min("finite") == 1).alias("finite"))
    full = with_totals(report, liveness(df))
    return full.withColumn("verdict", token_verdict(
        F.col("redundancy_mean"), F.col("effective_rank_mean"), F.col("tokens_per_trial"), F.col("finite"), F.col("norm_min")))


_ERF = np.vectorize(erf)


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1.0 + _ERF(x / sqrt(2.0)))


def residual_projection(df: DataFrame, key: str, down: np.ndarray, up: np.ndarray) -> DataFrame:
    """(key, vector + up(gelu(down(vector)))) with given weights; they are fixed by the model, not by the data."""
    return routed_projection(df.withColumn("_route", F.lit(0)), key, "_route", [(down, up)])


def route(task: Column, tasks: list[str], condition: str) -> Column:
    """Index of the adapter a row uses: its own task's, the next one's when shuffled, none when masked."""
    own = F.array_position(F.array(*[F.lit(x) for x in tasks]), task) - 1
    if condition == "masked":
        return F.lit(-1)
    return F.pmod(own + 1, F.lit(len(tasks))).cast("int") if condition == "shuffled" else own.cast("int")


def routed_projection(df: DataFrame, key: str, route_column: str, private: list[tuple[np.ndarray, np.ndarray]],
                      shared: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(key, vector): residual of the shared adapter plus that of the row's own adapter (route -1 uses none)."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, vector array<double>"

    def delta(x: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        down, up = weights
        return _gelu(x @ down.T) @ up.T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack([np.asarray(v, dtype=float) for v in batch["vector"]])
            out = x.copy() if shared is None else x + delta(x, shared)
            routes = batch[route_column].to_numpy()
            for i, weights in enumerate(private):
                rows = routes == i
                if rows.any():
                    out[rows] += delta(x[rows], weights)
            yield pd.DataFrame({key: batch[key].to_numpy(), "vector": list(out)})

    return df.select(key, "vector", route_column).mapInPandas(run, schema)
