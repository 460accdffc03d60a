"""Joins with checks: counts, first match, positions, defaults, agreement of redundant columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialloom.operators.ranking import value_prefix


def fan_out(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: matched pairs, matched left rows and pairs per left row, from key counts alone (no pair is built)."""
    a = left.groupBy(*keys).agg(F.count("*").alias("a"))
    b = right.groupBy(*keys).agg(F.count("*").alias("b"))
    both = a.join(b, keys)
    return both.agg(F.sum(F.col("a") * F.col("b")).alias("pairs"), F.sum("a").alias("matched_rows"),
                    F.round(F.sum(F.col("a") * F.col("b")) / F.sum("a"), 6).alias("fan_out"))


def first_match(left: DataFrame, lookup: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Left rows with the values of the first lookup row of their key; ``matched`` tells a miss."""
    first = lookup.groupBy(*keys).agg(F.min(F.struct(*order, *[v for v in values if v not in order])).alias("_first"))
    return left.join(first, keys, "left").select(
        *left.columns, *[F.col(f"_first.{v}").alias(v) for v in values], F.col("_first").isNotNull().alias("matched"))


def positions(df: DataFrame, order: str, out: str = "position") -> DataFrame:
    """0-based position by a unique numeric column."""
    places = value_prefix(df, [], order, {"n": F.lit(1)}).select(order, F.col("before_n").alias(out))
    return df.join(places, order)


def positional_join(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Row i of the left with row i of the right, positions made explicit."""
    return positions(left, left_order).join(positions(right, right_order), "position")


def with_vector(df: DataFrame, vectors: DataFrame, key: str, width: int) -> DataFrame:
    """Vector by key; a miss gives the zero vector and ``found`` = false."""
    zero = F.array_repeat(F.lit(0.0), width)
    return df.join(vectors, key, "left").withColumn("found", F.col("vector").isNotNull()).withColumn(
        "vector", F.coalesce("vector", zero))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def one_to_one_mismatches(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field, left, right) for every redundant column that differs, and for keys on one side only."""
    a = left.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("a"))
    b = right.select(key, F.struct(*[F.col(c).cast("string").alias(c) for c in columns]).alias("b"))
    joined = a.join(b, key, "full_outer")
    cells = [F.struct(F.lit(c).alias("field"), F.col(f"a.{c}").alias("left_value"), F.col(f"b.{c}").alias("right_value"))
             for c in columns]
    cells.append(F.struct(
        F.lit("_row").alias("field"), F.when(F.col("a").isNotNull(), "present").alias("left_value"),
        F.when(F.col("b").isNotNull(), "present").alias("right_value")))
    long = joined.select(key, F.inline(F.array(*cells)))
    return long.where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by shared key, keys repeated on a side left out (see ``repeated`` for the report)."""
    one_left = left.groupBy(key).agg(F.count("*").alias("_n"), F.first("vector").alias("left_vector")).where("_n = 1").drop("_n")
    one_right = right.groupBy(key).agg(F.count("*").alias("_n"), F.first("vector").alias("right_vector")).where("_n = 1").drop("_n")
    return one_left.join(one_right, key)


def labelled_first(left: DataFrame, right: DataFrame, keys: list[str], expected: Column) -> DataFrame:
    """Left equi-join; rows that should have a match and have none are marked."""
    marked = right.withColumn("_hit", F.lit(True))
    return left.join(marked, keys, "left").withColumn(
        "missing_match", expected & F.col("_hit").isNull()).drop("_hit")
