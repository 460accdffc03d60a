"""Catalogues and identity audits over trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialloom.functions.text import fold_case
from trialloom.operators.reshape import with_totals


def candidate_catalog(trials: DataFrame) -> DataFrame:
    """One row per candidate id; the representative is the trial with the smallest id."""
    first = F.min_by(F.struct("dataset_version", "reading_task", "text_key", "length"), "trial_id")
    return trials.groupBy("candidate_id").agg(
        first.alias("_r"), F.min("trial_id").alias("first_trial_id"), F.count("*").alias("trial_count"),
    ).select("candidate_id", "_r.*", "first_trial_id", "trial_count")


def catalog_members(trials: DataFrame, attribute: Column, name: str) -> DataFrame:
    """(candidate_id, attribute), distinct: the long form of the catalogue's id lists."""
    return trials.select("candidate_id", attribute.alias(name)).distinct()


def catalog_collisions(trials: DataFrame) -> DataFrame:
    """Candidate ids that stand for more than one text, dataset or task."""
    return single_valued(trials, ["candidate_id"], ["text_key", "dataset_version", "reading_task"])


def single_valued(df: DataFrame, key: list[str], attributes: list[str]) -> DataFrame:
    """Keys with more than one value in one of the attributes: (key, attribute, values).

    min and max decide, so no set of values is ever built.
    """
    checks = [F.min(F.col(a).cast("string")).alias(f"lo_{a}") for a in attributes]
    checks += [F.max(F.col(a).cast("string")).alias(f"hi_{a}") for a in attributes]
    wide = df.groupBy(*key).agg(*checks)
    cells = [F.when(F.col(f"lo_{a}") < F.col(f"hi_{a}"), F.struct(
        F.lit(a).alias("attribute"), F.col(f"lo_{a}").alias("low"), F.col(f"hi_{a}").alias("high"))) for a in attributes]
    return wide.select(*key, F.inline(F.array_compact(F.array(*cells))))


def factorize(df: DataFrame, value: str, order: str, out: str = "uid") -> DataFrame:
    """(value, uid): dense ids by first appearance. First appearances are distinct, so a rank over them is the id."""
    from trialloom.operators.ranking import value_prefix

    first = df.groupBy(value).agg(F.min(order).alias("_first"))
    places = value_prefix(first, [], "_first", {"n": F.lit(1)}).select("_first", F.col("before_n").alias(out))
    return first.join(places, "_first").select(value, out)


def split_overlaps(trials: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that occur in more than one split, with their row count."""
    return trials.groupBy(key).agg(
        F.min("split").alias("first_split"), F.max("split").alias("last_split"), F.count("*").alias("rows"),
    ).where("first_split <> last_split")


def repeated(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def leakage_audit(trials: DataFrame, uid: str = "text_key") -> DataFrame:
    """One row: trial ids, repeated ids, and identities that cross splits."""
    ids = trials.groupBy("trial_id").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("unique_trial_ids"),
        F.coalesce(F.sum((F.col("n") > 1).cast("bigint")), F.lit(0)).alias("repeated_trial_ids"))
    crossing = split_overlaps(trials, uid).agg(
        F.count("*").alias("crossing_texts"), F.coalesce(F.sum("rows"), F.lit(0)).alias("crossing_rows"))
    return with_totals(ids, crossing)


def dependency_conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose value is not unique (a functional dependency that does not hold)."""
    pairs = df.select(key, value).distinct()
    return pairs.groupBy(key).agg(F.count("*").alias("values"), F.min(value).alias("low"),
                                  F.max(value).alias("high")).where("values > 1")


def text_dictionary(trials: DataFrame) -> DataFrame:
    """One row per text identity over all tasks: representative trial, tasks and trials counted."""
    by_task = trials.groupBy("text_key", "reading_task").agg(
        F.count("*").alias("n"), F.min_by(F.struct("trial_id", "text", "length"), "trial_id").alias("r"))
    return by_task.groupBy("text_key").agg(
        F.min_by("r", "r.trial_id").alias("r"), F.count("*").alias("tasks"), F.sum("n").alias("trials"),
    ).select("text_key", F.col("r.trial_id").alias("representative_trial_id"),
             F.col("r.text").alias("text"), F.col("r.length").alias("length"), "tasks", "trials")


def cross_context_duplicates(trials: DataFrame, key: str, context: str) -> DataFrame:
    """Identities that occur in two or more contexts: contexts (joined), rows, subjects, first and last split."""
    by_context = trials.groupBy(key, context).agg(
        F.count("*").alias("n"), F.min("split").alias("lo"), F.max("split").alias("hi"),
        F.min("trial_id").alias("first_trial"))
    return by_context.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list(context)), "|").alias("contexts"),
        F.count("*").alias("context_count"), F.sum("n").alias("trial_count"),
        F.min("lo").alias("first_split"), F.max("hi").alias("last_split"), F.min("first_trial").alias("first_trial_id"),
    ).where("context_count >= 2")


def label_conflicts(source: DataFrame, key: str, label: str) -> DataFrame:
    """(key, labels, rows) of identities with more than one label."""
    return source.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("_n")).groupBy(key).agg(
        F.array_sort(F.collect_list(label)).alias("labels"), F.sum("_n").alias("rows")).where(F.size("labels") > 1)


def propagate_labels(targets: DataFrame, source: DataFrame, key: str, label: str, conflicts: str = "error") -> DataFrame:
    """Label of the source by identity. An identity with several labels is an error; ``label_conflicts`` lists them all.

    With ``conflicts="report"`` it gives no label and ``label_conflict`` is true on its rows.
    """
    one = source.groupBy(key).agg(F.min(label).alias(label), F.max(label).alias("_hi"))
    several = F.coalesce(F.col(label) != F.col("_hi"), F.lit(False))
    if conflicts == "report":
        agreed = one.select(key, F.when(~several, F.col(label)).alias(label), several.alias("label_conflict"))
        return targets.join(agreed, key, "left").na.fill(False, ["label_conflict"])
    message = F.concat(F.lit("conflicting labels of "), F.col(key).cast("string"), F.lit(": "), F.col(label).cast("string"), F.lit(", "), F.col("_hi").cast("string"))
    agreed = one.withColumn(label, F.when(several, F.raise_error(message).cast(source.schema[label].dataType)).otherwise(F.col(label))).drop("_hi")
    return targets.join(agreed, key, "left")


def with_normal_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("norm", fold_case(F.col(column)))


def group_constant(df: DataFrame, group: str, label: str, neutral: str, conflicts: str = "error") -> DataFrame:
    """``df`` with ``group_label``, the group's single non-neutral label, on every row of the group.

    A group with several is an error; with ``conflicts="report"`` it has no label and ``group_conflict`` is true on its rows.
    """
    named = F.when(F.col(label) != neutral, F.col(label))
    found = df.groupBy(group).agg(F.min(named).alias("group_label"), F.max(named).alias("_hi"))
    several = F.coalesce(F.col("group_label") != F.col("_hi"), F.lit(False))
    if conflicts == "report":
        found = found.select(group, F.when(~several, F.col("group_label")).alias("group_label"), several.alias("group_conflict"))
    else:
        message = F.concat(F.lit("several labels in group "), F.col(group).cast("string"))
        found = found.select(group, F.when(several, F.raise_error(message).cast(df.schema[label].dataType)).otherwise(F.col("group_label")).alias("group_label"))
    return df.join(found, group)
