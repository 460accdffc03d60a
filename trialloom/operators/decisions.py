"""Gates: named requirements as rows, one decision row at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trialloom.functions.fixed_values import (
    SIGNAL_NONINFERIORITY_MARGIN, SUPERIORITY_MARGIN, TASK_NONINFERIORITY_MARGIN,
)


def gate(name: str, rows: DataFrame, passed: Column) -> DataFrame:
    """One row: does every row pass? No rows means no."""
    return rows.agg(F.coalesce(F.bool_and(passed), F.lit(False)).alias("passed"), F.count("*").alias("checks")).select(
        F.lit(name).alias("gate"), "passed", "checks")


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def decide(gates: DataFrame, yes: str, no: str) -> DataFrame:
    """Decision row: verdict and the gates that failed (gates are few and named in code)."""
    failed = F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("gate"))))
    return gates.agg(
        F.when(F.bool_and("passed"), yes).otherwise(no).alias("decision"), F.count("*").alias("gates"),
        F.count_if(F.col("passed")).alias("gates_passed"), F.array_join(failed, ",").alias("failed_gates"))


def continuation_gates(points: DataFrame, intervals: DataFrame, seedwise: DataFrame, model: str, chance: float) -> DataFrame:
    """The seven requirements for going on with a model.

    points: arm_id, macro. intervals: endpoint, reference, cluster, scope, lower_bound. seedwise: direction_positive.
    """
    own = points.where(F.col("arm_id") == model).select(F.col("macro").alias("_own")).scalar()
    others = points.where(F.col("arm_id") != model)

    def bounds(endpoint: str) -> DataFrame:
        return intervals.where(F.col("endpoint") == endpoint)

    low = F.col("lower_bound")
    return union_all([
        gate("headline_macro_exceeds_baselines", others, own > F.col("macro")),
        gate("superiority_bounds_positive", bounds("superiority"), low > 0),
        gate("deltas_positive_in_all_seeds", seedwise, F.col("direction_positive")),
        gate("task_bounds_above_margin", bounds("task_noninferiority"), low > -TASK_NONINFERIORITY_MARGIN),
        gate("macro_bound_above_chance", bounds("absolute"), low > chance),
        gate("signal_gap_bounds_positive", bounds("signal_gap"), low > 0),
        gate("signal_gap_noninferior", bounds("signal_gap_delta"), low > -SIGNAL_NONINFERIORITY_MARGIN),
    ])


def win_gates(deltas: DataFrame, controls: DataFrame, seedwise: DataFrame, subject_held: DataFrame, sweep: DataFrame) -> DataFrame:
    """The five conditions of a method win. deltas: metric, lower_bound (two-way); controls: control, passed."""
    low = F.col("lower_bound")
    both = seedwise.select(F.col("direction_positive").alias("ok")).unionByName(subject_held.select((low > 0).alias("ok")))
    return union_all([
        gate("mrr_lower_bound_at_margin", deltas.where("metric = 'mrr'"), low >= SUPERIORITY_MARGIN),
        gate("controls_pass", controls, F.col("passed")),
        gate("both_metrics_advantage", deltas, low > 0),
        gate("seed_and_subject_consistent", both, F.col("ok")),
        gate("pool_size_robust", sweep, low > 0),
    ])


def pilot_gates(points: DataFrame, gaps: DataFrame, comparisons: DataFrame, seedwise: DataFrame, model: str) -> DataFrame:
    """The seven requirements for selecting a pilot over its planned baselines.

    points: arm_id, macro; gaps: arm_id, gap; comparisons: contrast_type, lower_bound; seedwise: direction_positive.
    """
    own_point = points.where(F.col("arm_id") == model).select(F.col("macro").alias("_v")).scalar()
    own_gap = gaps.where(F.col("arm_id") == model).select(F.col("gap").alias("_v")).scalar()

    def kind(name: str) -> DataFrame:
        return comparisons.where(F.col("contrast_type") == name)

    low = F.col("lower_bound")
    return union_all([
        gate("mrr_above_baselines", points.where(F.col("arm_id") != model), own_point > F.col("macro")),
        gate("model_bounds_positive", kind("model_comparison"), low > 0),
        gate("model_positive_in_all_seeds", seedwise, F.col("direction_positive")),
        gate("signal_gap_positive", gaps.where(F.col("arm_id") == model), F.col("gap") > 0),
        gate("signal_bounds_positive", kind("signal_specificity"), low > 0),
        gate("signal_gap_not_below_baselines", gaps.where(F.col("arm_id") != model), own_gap >= F.col("gap")),
        gate("task_control_bounds_positive", kind("task_control"), low > 0),
    ])


def factor_admission(bounds: DataFrame, counts: DataFrame, held_out: DataFrame, min_rows: int, min_subjects: int) -> DataFrame:
    """Admitted factors: enough rows and subjects, all Holm bounds positive, the held-out direction agrees.

    bounds: factor_id, holm_adjusted_lower. counts: factor_id, rows, subjects. held_out: factor_id, delta (one row per contrast).
    """
    passed = bounds.groupBy("factor_id").agg(F.bool_and(F.col("holm_adjusted_lower") > 0).alias("bounds_positive"))
    held = held_out.groupBy("factor_id").agg(F.bool_and(F.col("delta") > 0).alias("same_direction"))
    joined = counts.join(passed, "factor_id", "left").join(held, "factor_id", "left").na.fill(
        False, ["bounds_positive", "same_direction"])
    enough = (F.col("rows") >= min_rows) & (F.col("subjects") >= min_subjects)
    return joined.withColumn("decision", F.when(
        enough & F.col("bounds_positive") & F.col("same_direction"), "admit").otherwise("reject_retain_null"))


def at_chance(value: Column, chance: Column | float, tolerance: float) -> Column:
    return F.abs(value - chance) <= tolerance


def token_verdict(redundancy: Column, rank: Column, tokens: Column, finite: Column, min_norm: Column) -> Column:
    share = rank / tokens
    return (F.when(~finite | (min_norm == 0), "INVALID")
            .when((redundancy > 0.97) & (share < 0.05), "COLLAPSED")
            .when((redundancy > 0.9) | (share < 0.15), "WEAK").otherwise("RICH"))
