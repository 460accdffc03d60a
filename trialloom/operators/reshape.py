"""Row multiplication and one-row totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_totals(df: DataFrame, row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row frame to every row, as a scalar subquery (no join, no shuffle of ``df``)."""
    value = row.select(F.struct(*row.columns)).scalar()
    return df.withColumn("_totals", value).select(*df.columns, "_totals.*")


def each(df: DataFrame, name: str, values: list) -> DataFrame:
    """Every row once per literal value: the product with a small fixed design axis, without a join."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def design_matrix(spark, axes: dict[str, list]) -> DataFrame:
    """All combinations of literal design axes."""
    df = spark.range(1).select()
    for name, values in axes.items():
        df = each(df, name, values)
    return df


def role_of_fold(text_fold: Column, outer_fold: Column, folds: int) -> Column:
    """confirmation, checkpoint (the next fold) or fit."""
    return (F.when(text_fold == outer_fold, "confirmation")
            .when(text_fold == F.pmod(outer_fold + 1, F.lit(folds)), "checkpoint").otherwise("fit"))


def outer_assignments(trials: DataFrame, folds: int) -> DataFrame:
    """Every trial once per outer fold with its role there."""
    grid = each(trials, "outer_fold", list(range(folds)))
    return grid.withColumn("role", role_of_fold(F.col("text_fold"), F.col("outer_fold"), folds))


def unpivot_variants(df: DataFrame, ids: list[str], variants: list[str], plain: str, train: Column) -> DataFrame:
    """Training rows once per text variant, all other rows once with the plain text."""
    long = df.where(train).unpivot(ids, variants, "variant", "target_text")
    same = df.where(~train).select(*ids, F.lit(plain).alias("variant"), F.col(plain).alias("target_text"))
    return long.unionByName(same)


def role_overlap(assignments: DataFrame, key: str) -> DataFrame:
    """Identities that have more than one role within an outer fold."""
    return assignments.groupBy("outer_fold", key).agg(
        F.min("role").alias("low_role"), F.max("role").alias("high_role")).where("low_role <> high_role")


def missing_and_extra(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Keys found on one side only."""
    both = expected.select(*key).distinct().withColumn("_e", F.lit(1)).unionByName(
        actual.select(*key).distinct().withColumn("_e", F.lit(2)))
    sides = both.groupBy(*key).agg(F.sum("_e").alias("_s"))
    return sides.where("_s < 3").select(*key, F.when(F.col("_s") == 1, "missing").otherwise("extra").alias("side"))
