"""Raw labelled rows -> canonical trial records -> factor rows and their fold coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialloom.functions import keys, labels, text
from trialloom.functions.fixed_values import (
    INSTRUCTION_RELATIONS, NO_RELATION, READING_TASKS, RELATIONS, SENTIMENTS,
)
from trialloom.operators.canonical import propagate_labels
from trialloom.operators.joins import positions
from trialloom.operators.reshape import each, with_totals

# factor -> (target type, mask column or None, label column, task that owns it or None)
FACTORS = {
    "sr_sentiment_3": ("multiclass", "mask_sr_sentiment_3", "sr_sentiment_3", "SR"),
    "nr_relation_content": ("multilabel", "mask_nr_relation_content", "nr_relation_content", "NR"),
    "tsr_instruction_relation": (
        "multiclass", "mask_tsr_instruction_relation", "tsr_instruction_relation", "TSR"),
    "length_words_whitespace_v1": ("regression", None, "length_words_whitespace_v1", None),
}


def presence(value: Column) -> Column:
    return value.isNotNull().cast("int")


def canonical_records(frame: DataFrame, catalog_labels: DataFrame) -> DataFrame:
    """One contract row per source row.

    frame: row_idx, dataset, task, subject, phase, input_text, text_uid, sentiment_label, relation_label,
    semkey_sentiment_2, topic_label, surprisal. catalog_labels: norm_text, relation_types (content relations
    by repaired text; they apply to ZuCo1 task2 only). A text with several relations has none, and
    ``nr_relation_conflict`` is 1 on the rows they would apply to.
    """
    fields = ["dataset", "task", "subject", "phase", "text_uid", "semkey_sentiment_2", "topic_label", "surprisal"]
    base = frame.select(
        "row_idx", *[text.clean(F.col(c).cast("string")).alias(c) for c in fields],
        text.clean(F.col("input_text")).alias("raw_text"),
        F.when(F.col("task") == "task1", text.clean(F.col("sentiment_label"))).alias("sr_sentiment_3"),
        F.when(F.col("task") == "task3", labels.canonical_label(F.col("relation_label"))).alias(
            "tsr_instruction_relation"),
    ).withColumn("text", text.repair(F.col("raw_text")))
    joined = propagate_labels(base, catalog_labels.withColumnRenamed("norm_text", "text"), "text", "relation_types", "report")
    own = (F.col("dataset") == "ZuCo1") & (F.col("task") == "task2")
    scoped = F.when(own, F.col("relation_types"))
    return joined.select(
        F.col("dataset").alias("dataset_version"), labels.lookup(F.col("task"), READING_TASKS, "task").alias("reading_task"),
        F.col("task").alias("raw_task"), F.col("subject").alias("subject_id"), "text_uid",
        keys.trial_id(F.col("dataset"), F.col("task"), F.col("subject"), F.col("row_idx")).alias("trial_id"),
        F.col("phase").alias("split"), F.lit(None).cast("string").alias("session_block"),
        F.lit("unavailable_in_frozen_metadata").alias("session_block_status"),
        keys.cohort(F.col("dataset"), F.col("task")).alias("cohort"), "text",
        F.col("row_idx").alias("source_dataframe_row_index"),
        "sr_sentiment_3", scoped.alias("nr_relation_content"), "tsr_instruction_relation",
        presence(F.col("sr_sentiment_3")).alias("mask_sr_sentiment_3"),
        presence(scoped).alias("mask_nr_relation_content"),
        presence(F.col("tsr_instruction_relation")).alias("mask_tsr_instruction_relation"),
        F.coalesce(own & F.col("label_conflict"), F.lit(False)).cast("int").alias("nr_relation_conflict"),
        text.word_count(F.col("raw_text")).alias("length_words_whitespace_v1"),
        F.col("surprisal").alias("gpt2_mean_nll_v1"), presence(F.col("surprisal")).alias("mask_gpt2_mean_nll_v1"),
        "semkey_sentiment_2", presence(F.col("semkey_sentiment_2")).alias("mask_semkey_sentiment_2"),
        "topic_label", presence(F.col("topic_label")).alias("mask_topic_label"),
        F.lit("labels_for_supervision_only").alias("oracle_policy"),
    )


def with_provenance(records: DataFrame, source: str, digest: str, rows_per_shard: int) -> DataFrame:
    """``records`` with where each came from: ``source_dataframe_sha256``, ``eeg_locator`` (the source's row) and ``shard_locator``
    (shard and offset of a sharded copy in the order of the source's rows)."""
    placed = positions(records, "source_dataframe_row_index", "_at")
    shard = F.format_string("shards/shard_%05d.npz#offset=%d", F.floor(F.col("_at") / rows_per_shard), F.pmod(F.col("_at"), F.lit(rows_per_shard)))
    return placed.withColumns({
        "source_dataframe_sha256": F.lit(digest), "shard_locator": shard,
        "eeg_locator": F.concat(F.lit(f"{source}#row="), F.col("source_dataframe_row_index").cast("string"))}).drop("_at")


def record_problems(records: DataFrame) -> DataFrame:
    """(trial_id, problem): labels outside their domain, masks outside their task, empty texts."""
    checks = {
        "dataset": ~F.col("dataset_version").isin("ZuCo1", "ZuCo2"),
        "split": ~F.col("split").isin("train", "val", "test"),
        "subject": F.col("subject_id").isNull(),
        "text": F.coalesce(F.col("text"), F.lit("")) == "",
        "sentiment": (F.col("reading_task") == "SR") & ~F.coalesce(F.col("sr_sentiment_3").isin(SENTIMENTS), F.lit(False)),
        "relation": (F.col("reading_task") == "TSR") & ~F.coalesce(
            F.col("tsr_instruction_relation").isin(INSTRUCTION_RELATIONS), F.lit(False)),
        "sr_mask_scope": (F.col("mask_sr_sentiment_3") == 1) & (F.col("reading_task") != "SR"),
        "nr_mask_scope": (F.col("mask_nr_relation_content") == 1) & (F.col("reading_task") != "NR"),
        "tsr_mask_scope": (F.col("mask_tsr_instruction_relation") == 1) & (F.col("reading_task") != "TSR"),
    }
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks.items()]))
    return records.select("trial_id", F.explode(found).alias("problem"))


def factor_rows(records: DataFrame) -> DataFrame:
    """One row per (trial, factor the trial is eligible for); labels become ordered targets and atoms."""
    cells = []
    for name, (kind, mask, label, _) in FACTORS.items():
        value = F.col(label).cast("string")
        target = F.array_join(labels.label_atoms(value), ";") if kind == "multilabel" else (
            F.upper(value) if label == "tsr_instruction_relation" else value)
        atoms = F.lit("") if kind == "regression" else target
        eligible = F.lit(True) if mask is None else F.col(mask) == 1
        cells.append(F.when(eligible, F.struct(
            F.lit(name).alias("factor_id"), F.lit(kind).alias("target_type"),
            target.alias("target_value"), atoms.alias("target_atoms"))))
    return records.select(
        "trial_id", "split", "dataset_version", "reading_task", "subject_id", "text_uid", "cohort",
        F.inline(F.array_compact(F.array(*cells))))


def subject_folds(records: DataFrame) -> DataFrame:
    """Leave-one-subject-out counts: one pass of conditional sums, then totals minus the subject's own."""
    per = records.groupBy("subject_id").agg(
        F.sum((F.col("split") == "train").cast("bigint")).alias("training_rows_excluded"),
        F.sum((F.col("split") == "val").cast("bigint")).alias("evaluation_rows_eligible"))
    total = per.agg(F.sum("training_rows_excluded").alias("training_rows_total"),
                    F.sum("evaluation_rows_eligible").alias("evaluation_rows_total"))
    return with_totals(per.where("evaluation_rows_eligible > 0"), total).select(
        F.concat(F.lit("loso::"), "subject_id").alias("fold_id"), F.col("subject_id").alias("held_out_subject_id"),
        "training_rows_total", "training_rows_excluded",
        (F.col("training_rows_total") - F.col("training_rows_excluded")).alias("training_rows_eligible"),
        "evaluation_rows_total", "evaluation_rows_eligible")


def factor_fold_coverage(rows: DataFrame) -> DataFrame:
    """Rows and distinct target atoms per (factor, held-out subject).

    An atom is still seen in training when its total exceeds the subject's own count, so no fold is materialised:
    everything follows from the counts per (factor, subject, split, atom).
    """
    base = rows.select("factor_id", "target_type", "subject_id", "split",
                       F.explode_outer(F.when(F.col("target_atoms") != "", F.split("target_atoms", ";"))).alias("atom"),
                       F.col("trial_id")).where(F.col("split").isin("train", "val"))
    trial_counts = rows.where(F.col("split").isin("train", "val")).groupBy("factor_id", "target_type", "subject_id").agg(
        F.sum((F.col("split") == "train").cast("bigint")).alias("own_train"),
        F.sum((F.col("split") == "val").cast("bigint")).alias("own_val"))
    totals = trial_counts.groupBy("factor_id", "target_type").agg(
        F.sum("own_train").alias("all_train"), F.sum("own_val").alias("all_val"))
    atoms = base.where("atom is not null").groupBy("factor_id", "subject_id", "atom").agg(
        F.sum((F.col("split") == "train").cast("bigint")).alias("a_train"),
        F.sum((F.col("split") == "val").cast("bigint")).alias("a_val"))
    atom_totals = atoms.groupBy("factor_id", "atom").agg(F.sum("a_train").alias("t_train"), F.sum("a_val").alias("t_val"))
    ordinary_atoms = atom_totals.groupBy("factor_id").agg(
        F.sum((F.col("t_train") > 0).cast("bigint")).alias("train_atoms"),
        F.sum((F.col("t_val") > 0).cast("bigint")).alias("val_atoms"))
    own_atoms = atoms.join(atom_totals, ["factor_id", "atom"]).groupBy("factor_id", "subject_id").agg(
        F.sum(((F.col("t_train") > 0) & (F.col("t_train") == F.col("a_train"))).cast("bigint")).alias("lost_atoms"),
        F.sum((F.col("a_val") > 0).cast("bigint")).alias("own_val_atoms"))
    ordinary = totals.join(ordinary_atoms, "factor_id", "left").select(
        F.lit("ordinary").alias("fold_id"), F.lit("").alias("held_out_subject_id"), "factor_id", "target_type",
        F.col("all_train").alias("train_rows"), F.col("all_val").alias("val_rows"), "train_atoms", "val_atoms")
    evaluated = rows.where("split = 'val'").select("subject_id").distinct()
    grid = each(evaluated, "factor_id", list(FACTORS)).join(
        totals.join(ordinary_atoms, "factor_id", "left"), "factor_id")
    held = (grid.join(trial_counts.drop("target_type"), ["factor_id", "subject_id"], "left")
            .join(own_atoms, ["factor_id", "subject_id"], "left").na.fill(0, ["own_train", "own_val", "lost_atoms"]))
    has_atoms = F.col("target_type") != "regression"
    held = held.select(
        F.concat(F.lit("loso::"), "subject_id").alias("fold_id"), F.col("subject_id").alias("held_out_subject_id"),
        "factor_id", "target_type", (F.col("all_train") - F.col("own_train")).alias("train_rows"),
        F.col("own_val").alias("val_rows"),
        F.when(has_atoms, F.col("train_atoms") - F.col("lost_atoms")).alias("train_atoms"),
        F.when(has_atoms, F.coalesce("own_val_atoms", F.lit(0))).alias("val_atoms"))
    fit = F.when(has_atoms, F.col("train_atoms") >= 2).otherwise(F.col("train_rows") >= 2)
    return ordinary.unionByName(held).withColumns({
        "fit_viable": fit.cast("int"), "evaluation_available": (F.col("val_rows") > 0).cast("int"),
        "fold_included": (fit & (F.col("val_rows") > 0)).cast("int")})


def typed_targets(rows: DataFrame) -> DataFrame:
    """Class index, multi-hot string and number of each factor row, by target type."""
    kind = F.col("target_type")
    index = F.when(F.col("factor_id") == "sr_sentiment_3", labels.class_index(F.col("target_value"), SENTIMENTS)).when(
        F.col("factor_id") == "tsr_instruction_relation", labels.class_index(F.col("target_value"), INSTRUCTION_RELATIONS))
    hot = labels.multi_hot(F.split("target_value", ";"), [*RELATIONS, NO_RELATION])
    return rows.select(
        "trial_id", "factor_id", F.when(kind == "multiclass", index).alias("class_index"),
        F.when(kind == "multilabel", F.array_join(hot.cast("array<string>"), "")).alias("multi_hot"),
        F.when(kind == "regression", F.col("target_value").cast("double")).alias("number"))
