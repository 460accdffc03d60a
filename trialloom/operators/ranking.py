"""Exact global ordering inside groups of any size.

A plain ``row_number() over (partition by key)`` sends a whole key to one task. Here every key is cut into
order-preserving buckets first: bucket totals give offsets, and the window runs per (key, bucket). The answer
is the same, no task sees more than one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialloom.functions.keys import hex_to_long
from trialloom.operators.reshape import with_totals
from trialloom.session import cut

HASH_BITS = 60


def ring_bucket(ring: Column, bits: int = 16) -> Column:
    """Order-preserving bucket of a 60-bit hash."""
    return F.shiftright(ring, HASH_BITS - bits)


def digest_bucket(digest: Column, digits: int = 4) -> Column:
    """Order-preserving bucket of a hex digest."""
    return hex_to_long(digest, digits)


def prefix_sum(df: DataFrame, keys: list[str], bucket: Column, order: list, measure: Column, out: str) -> DataFrame:
    """Adds ``out`` = sum of ``measure`` over the rows of the key before this one; ``bucket`` must follow ``order``.

    Bucket totals combine on the map side and read the ordering columns only; the rows move once, for the join and the
    window. Offsets may be as many as the rows, so they are never sent to the driver.
    """
    marked = df.withColumns({"_bucket": bucket, "_measure": measure.cast("bigint")})
    totals = marked.groupBy(*keys, "_bucket").agg(F.sum("_measure").alias("_total"))
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.join(offsets.hint("merge"), [*keys, "_bucket"])
        .withColumn(out, F.col("_offset") + F.coalesce(F.sum("_measure").over(inside), F.lit(0)))
        .drop("_bucket", "_measure", "_offset")
    )


def position_by_ring(df: DataFrame, keys: list[str], ring: str, ties: list[str], out: str) -> DataFrame:
    """0-based position in the key by a 60-bit hash column."""
    return prefix_sum(df, keys, ring_bucket(F.col(ring)), [ring, *ties], F.lit(1), out)


def position_by_digest(df: DataFrame, keys: list[str], digest: str, ties: list[str], out: str) -> DataFrame:
    """0-based position in the key by a hex digest column."""
    return prefix_sum(df, keys, digest_bucket(F.col(digest)), [digest, *ties], F.lit(1), out)


def value_bins(grouped: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """Adds ``_bin``, which follows ``_v``: edges are approximate quantiles of the key, so outliers and heavy tails do not
    crowd the rest into a few bins. Edges only steer the work; order and sums are exact whatever they are."""
    cuts = F.percentile_approx("_v", [i / bins for i in range(1, bins)], 20 * bins).alias("_edges")
    edged = grouped.join(grouped.groupBy(*keys).agg(cuts), keys) if keys else with_totals(grouped, grouped.agg(cuts))
    # the number of edges at or below the value, by halving
    edged = edged.withColumn("_bin", F.lit(0))
    for step in reversed(range(bins.bit_length())):
        reached = F.coalesce(F.get("_edges", F.col("_bin") + (1 << step) - 1) <= F.col("_v"), F.lit(False))
        edged = edged.withColumn("_bin", F.when(reached, F.col("_bin") + (1 << step)).otherwise(F.col("_bin")))
    return edged.drop("_edges")


def value_prefix(df: DataFrame, keys: list[str], value: str, measures: dict[str, Column], bins: int = 512,
                 descending: bool = False) -> DataFrame:
    """One row per (key, value): the measures summed, and ``before_<m>`` summed over all smaller values
    (larger ones when ``descending``). Equal values collapse before anything is ordered, so hot values are harmless;
    the distinct values are cut into bins of about equal count. The grouped table is written once, because edges, bin
    totals and the ordering all read it."""
    grouped = df.groupBy(*keys, value).agg(*[F.sum(c).alias(m) for m, c in measures.items()])
    sign = -1.0 if descending else 1.0
    grouped = cut(grouped.withColumn("_v", F.col(value).cast("double") * sign))
    binned = value_bins(grouped, keys, bins)
    totals = binned.groupBy(*keys, "_bin").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    before = Window.partitionBy(*keys or [F.lit(0)]).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bin", *[F.coalesce(F.sum(f"_t_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures])
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return binned.join(offsets, [*keys, "_bin"]).select(
        *keys, value, *measures,
        *[(F.col(f"_o_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0))).alias(f"before_{m}") for m in measures],
    )


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(key, value, out): 1-based rank of each value, ties sharing the mean rank."""
    ranked = value_prefix(df, keys, value, {"n": F.lit(1)})
    return ranked.select(*keys, value, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias(out))
