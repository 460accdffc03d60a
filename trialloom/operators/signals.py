"""Signals as arrays (time x channel) or long rows: filters, resampling, padding, normalisation, statistics, controls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from trialloom.functions.fixed_values import MAX_SECONDS, MIN_SECONDS, SOURCE_RATE, STD_FLOOR, TARGET_RATE


def first_difference(df: DataFrame, by: list[str], step: str, value: str, decay: float) -> DataFrame:
    """y[t] = x[t] - decay * x[t-1] over steps 0, 1, ...; the first value stays. The past value comes by equi-join."""
    past = df.select(*by, (F.col(step) + 1).alias(step), F.col(value).alias("_past"))
    joined = df.join(past, [*by, step], "left")
    return joined.withColumn("whitened", F.col(value) - decay * F.coalesce("_past", F.lit(0.0))).drop("_past")


def difference_array(x: Column, decay: float) -> Column:
    """The same on one array: the array against itself shifted by one."""
    shifted = F.concat(F.array(F.lit(0.0)), F.slice(x, F.lit(1), F.size(x) - 1))
    return F.zip_with(x, shifted, lambda now, past: now - decay * past)


def finite_signal(signal: Column) -> Column:
    """All samples of a time x channel array are finite."""
    return F.forall(signal, lambda row: F.forall(row, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))))


def usable_length(samples: Column, rate: int = SOURCE_RATE) -> Column:
    return (samples >= MIN_SECONDS * rate) & (samples <= MAX_SECONDS * rate)


def screen(df: DataFrame, signal: str, low: int, high: int) -> DataFrame:
    """(key columns, signal without its last channel) of finite signals of usable length, and why others were dropped."""
    size = F.size(signal)
    reason = F.when(~finite_signal(F.col(signal)), "not_finite").when(size < low, "short").when(size > high, "long")
    trimmed = F.transform(F.col(signal), lambda row: F.slice(row, F.lit(1), F.size(row) - 1))
    return df.withColumns({"reason": reason, signal: trimmed})


def pad(signal: Column, samples: int, channels: int) -> Column:
    """Zero-padded to samples x channels."""
    wide = F.transform(signal, lambda row: F.concat(row, F.array_repeat(F.lit(0.0), F.lit(channels) - F.size(row))))
    blank = F.array_repeat(F.array_repeat(F.lit(0.0), channels), F.lit(samples) - F.size(signal))
    return F.concat(wide, blank)


def valid_mask(length: Column, samples: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: (i <= length).cast("tinyint"))


def normalise_masked(x: Column, clip: float = 10.0, epsilon: float = 1e-6) -> Column:
    """z-score over the non-zero entries of an array, clipped; zeros stay zero."""
    live = F.filter(x, lambda v: v != 0)
    n = F.size(live)
    count = F.greatest(n, F.lit(1))
    mean = F.aggregate(live, F.lit(0.0), lambda a, v: a + v) / count
    with_mean = F.zip_with(live, F.array_repeat(mean, n), lambda v, m: (v - m) * (v - m))
    std = F.sqrt(F.aggregate(with_mean, F.lit(0.0), lambda a, v: a + v) / count)
    size = F.size(x)
    centred = F.zip_with(x, F.array_repeat(mean, size), lambda v, m: F.when(v != 0, v - m))
    scaled = F.zip_with(centred, F.array_repeat(std + epsilon, size), lambda v, s: v / s)
    return F.transform(scaled, lambda v: F.when(v.isNull(), 0.0).when(v < -clip, -clip).when(v > clip, clip).otherwise(v))


def channel_stats(long: DataFrame, by: list[str]) -> DataFrame:
    """Mean, standard deviation (floored variance) and count per channel; long: by..., channel, value, valid.

    Spark's variance keeps count, mean and centred squares and merges them, so values far from zero lose no digits.
    """
    v = F.col("value").cast("double")
    return long.where("valid").groupBy(*by, "channel").agg(
        F.count("*").alias("samples"), F.avg(v).alias("mean"), F.sqrt(F.greatest(F.var_pop(v), F.lit(STD_FLOOR))).alias("std"))


def array_channel_stats(df: DataFrame, signal: str = "signal", mask: str = "mask") -> DataFrame:
    """(channel, samples, mean, std) of signal arrays under their masks, without a row per sample.

    A task merges the (count, mean, centred squares) of its batches and gives out one row per channel; Spark adds these up around a
    common point near them. Null samples and masked times take no part; records may differ in length and number of channels.
    """
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, float, float]] = {}
        for batch in batches:
            rows = batch.column(signal).flatten()  # one entry a time step
            live = np.asarray(pc.fill_null(batch.column(mask).flatten(), 0)) == 1
            sizes = np.asarray(pc.fill_null(pc.list_value_length(rows), 0), np.int64)
            values = np.asarray(pc.cast(rows.flatten(), pa.float64()))  # a null sample is a NaN
            channel = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            good = np.repeat(live, sizes) & ~np.isnan(values)
            for c in np.unique(channel[good]).tolist():
                v = values[good & (channel == c)]
                held[c] = _merged(held.get(c, (0, 0.0, 0.0)), (len(v), float(v.mean()), float(((v - v.mean()) ** 2).sum())))
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.int32()), *(pa.array([h[i] for h in held.values()], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.float64())))],
                ["channel", "n", "mean", "centred"])

    wide = df.select(signal, mask).where(F.col(signal).isNotNull() & F.col(mask).isNotNull())
    checked = wide.withColumn(mask, F.when(F.size(mask) != F.size(signal), F.raise_error(F.lit("mask and signal differ in length"))).otherwise(F.col(mask)))
    parts = checked.mapInArrow(moments, "channel int, n long, mean double, centred double")
    # means of parts, each weighted by its count, around a common point: the spread between parts joins the spread inside them
    totals = parts.groupBy("channel").agg(F.sum("n").alias("samples"), F.min("mean").alias("near"))
    around = parts.join(totals, "channel").groupBy("channel", "samples", "near").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("near"))).alias("shift"),
        F.sum(F.col("centred") + F.col("n") * (F.col("mean") - F.col("near")) ** 2).alias("q"))
    shift = F.col("shift") / F.col("samples")
    return around.select("channel", "samples", (F.col("near") + shift).alias("mean"), F.sqrt(F.greatest(
        F.col("q") / F.col("samples") - shift * shift, F.lit(STD_FLOOR))).alias("std"))


def _merged(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    """Count, mean and centred squares of two parts together."""
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * b[0] / n, a[2] + b[2] + step * step * a[0] * b[0] / n


def explode_signal(df: DataFrame, key: list[str]) -> DataFrame:
    """(key, time, channel, value, valid) of a signal array and its mask."""
    rows = df.select(*key, "mask", F.posexplode("signal").alias("time", "_row"))
    valid = F.element_at("mask", F.col("time") + 1) == 1
    return rows.select(*key, "time", valid.alias("valid"), F.posexplode("_row").alias("channel", "value"))


def resample(df: DataFrame, key: list[str], signal: str = "signal", source: int = SOURCE_RATE, target: int = TARGET_RATE) -> DataFrame:
    """Fourier resampling along time; one record at a time inside Arrow batches (a record is bounded by its duration limit)."""
    fields = [f for f in df.schema.fields if f.name in key]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + f", {signal} array<array<double>>"

    def fourier(x: np.ndarray) -> np.ndarray:
        n, m = x.shape[0], int(x.shape[0] * target / source)
        spectrum = np.fft.rfft(x, axis=0)
        keep = min(n, m) // 2 + 1
        out = np.zeros((m // 2 + 1, x.shape[1]), dtype=complex)
        out[:keep] = spectrum[:keep]
        if min(n, m) % 2 == 0:  # the middle frequency stands for both its signs
            out[keep - 1] *= 2.0 if m < n else (0.5 if m > n else 1.0)
        return np.fft.irfft(out, m, axis=0) * (m / n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[key].copy()
            out[signal] = [fourier(np.stack([np.asarray(r, dtype=float) for r in s])).tolist() for s in batch[signal]]
            yield out

    return df.select(*key, signal).mapInPandas(run, schema)


def _gaussian(seed: int, shape: tuple[int, int]) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal(shape)


def control_signal(df: DataFrame, key: str, kind: str, stats_column: str = "stats") -> DataFrame:
    """(key, signal): zeros, or seeded Gaussian noise by channel statistics, on the valid samples only.

    df: key, seed (bigint), mask, stats (array of struct mean, std by channel). The seed travels in the row.
    """
    if kind == "zero":
        blank = F.transform("mask", lambda m: F.transform(stats_column, lambda s: F.lit(0.0)))
        return df.select(key, blank.alias("signal"))

    @F.pandas_udf("array<array<double>>")
    def noise(seed: pd.Series, mask: pd.Series, mean: pd.Series, std: pd.Series) -> pd.Series:
        out = []
        for s, m, mu, sd in zip(seed, mask, mean, std):
            draw = _gaussian(int(s), (len(m), len(mu))) * np.asarray(sd) + np.asarray(mu)
            out.append((draw * np.asarray(m, dtype=float)[:, None]).tolist())
        return pd.Series(out)

    return df.select(key, noise("seed", "mask", F.transform(stats_column, lambda s: s["mean"]), F.transform(
        stats_column, lambda s: s["std"])).alias("signal"))


def replace_channels(df: DataFrame, key: str, share: float) -> DataFrame:
    """(key, signal, replaced): up to ``share`` of the channels replaced by uniform noise; the row's seed decides which.

    df: key, seed (bigint), signal as channel x time.
    """
    schema = f"{key} {df.schema[key].dataType.simpleString()}, signal array<array<double>>, replaced int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signals, counts = [], []
            for seed, signal in zip(batch["seed"], batch["signal"]):
                rng = np.random.default_rng(int(seed))
                x = np.stack([np.asarray(r, dtype=float) for r in signal])
                drop = int(rng.integers(0, int(len(x) * share) + 1))
                chosen = rng.permutation(len(x))[:drop]
                x[chosen] = rng.random((drop, x.shape[1]))
                signals.append(x.tolist())
                counts.append(drop)
            yield pd.DataFrame({key: batch[key], "signal": signals, "replaced": counts})

    return df.select(key, "seed", "signal").mapInPandas(run, schema)


def map_encode(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user-given encoder over Arrow batches (sub-batched by spark.sql.execution.arrow.maxRecordsPerBatch).

    Output rows must match input rows, and vectors must be finite; a breach fails the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = fn(batch)
            if len(out) != len(batch):
                raise ValueError(f"encoder returned {len(out)} rows for {len(batch)}")
            for column in out.columns:
                if len(out) and isinstance(out[column].iloc[0], (list, np.ndarray)):
                    if not all(np.isfinite(np.asarray(v, dtype=float)).all() for v in out[column]):
                        raise ValueError(f"encoder returned non-finite values in {column}")
            yield out

    return df.mapInPandas(run, schema)


def encode_distinct(df: DataFrame, text: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Labels every distinct text once and joins the labels back."""
    return df.join(map_encode(df.select(text).distinct(), fn, schema), text)
