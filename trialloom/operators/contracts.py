"""Data contracts: every check returns its violations; an empty frame means the contract holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from trialloom.operators.canonical import repeated, single_valued
from trialloom.operators.reshape import with_totals


class ContractError(ValueError):
    """A contract with violations, the first few of them in the message."""


def assert_empty(violations: DataFrame, what: str, show: int = 5) -> None:
    found = violations.limit(show).collect()
    if found:
        raise ContractError(f"{what}: " + "; ".join(str(row.asDict()) for row in found))


def check_columns(df: DataFrame, required: list[str], exact: bool = False) -> DataFrame:
    """(column, problem) from the schema alone; no job runs over the data."""
    have = df.columns
    problems = [(c, "missing") for c in required if c not in have]
    if exact:
        problems += [(c, "unexpected") for c in have if c not in required]
        problems += [(c, "misplaced") for i, c in enumerate(have) if c in required and required.index(c) != i and not problems]
    return df.sparkSession.createDataFrame(problems, "column string, problem string")


def count_mismatches(df: DataFrame, by: list[str], expected: DataFrame) -> DataFrame:
    """Groups whose row count is not the expected one (expected: by, expected_rows), missing groups included."""
    counted = df.groupBy(*by).agg(F.count("*").alias("rows"))
    both = counted.join(expected, by, "full_outer")
    return both.where(~F.col("rows").eqNullSafe(F.col("expected_rows")))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return repeated(df, key)


def outside_domain(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return df.where(~F.coalesce(F.col(column).isin(allowed), F.lit(False)))


def broken_implication(df: DataFrame, condition: Column, implied: Column) -> DataFrame:
    return df.where(condition & ~F.coalesce(implied, F.lit(False)))


def drifting_attributes(df: DataFrame, key: list[str], attributes: list[str]) -> DataFrame:
    return single_valued(df, key, attributes)


def matrix_problems(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Cells of the design that are missing, unexpected or repeated."""
    want = expected.select(*key).distinct().withColumn("_w", F.lit(1))
    have = actual.groupBy(*key).agg(F.count("*").alias("rows"))
    problem = F.when(F.col("rows").isNull(), "missing").when(F.col("_w").isNull(), "unexpected").when(
        F.col("rows") > 1, "repeated")
    return want.join(have, key, "full_outer").select(*key, problem.alias("problem")).where("problem is not null")


def rank_mismatches(declared: DataFrame, recomputed: DataFrame, key: list[str], columns: list[str], tolerance: float = 0.0) -> DataFrame:
    """Rows whose declared values differ from the recomputed ones, or that one side lacks."""
    cells = []
    for c in columns:
        close = F.abs(F.col(f"d.{c}") - F.col(f"r.{c}")) <= tolerance
        cells.append(F.when(~F.coalesce(close, F.col(f"d.{c}").isNull() & F.col(f"r.{c}").isNull()), F.struct(
            F.lit(c).alias("field"), F.col(f"d.{c}").cast("double").alias("declared"),
            F.col(f"r.{c}").cast("double").alias("recomputed"))))
    a = declared.select(*key, F.struct(*columns).alias("d"))
    b = recomputed.select(*key, F.struct(*columns).alias("r"))
    return a.join(b, key, "full_outer").select(*key, F.inline(F.array_compact(F.array(*cells))))


def provenance_violations(rows: DataFrame) -> DataFrame:
    """correct: the signal is the trial's own; matched_wrong: same subject, other trial, other text."""
    own = (F.col("signal_trial_id") == F.col("trial_id")) & (F.col("signal_text_key") == F.col("text_key"))
    wrong = ((F.col("signal_trial_id") != F.col("trial_id")) & (F.col("signal_text_key") != F.col("text_key"))
             & (F.col("signal_subject_id") == F.col("subject_id")))
    fine = F.when(F.col("signal_condition") == "correct", own).when(F.col("signal_condition") == "matched_wrong", wrong)
    return rows.where(~F.coalesce(fine, F.lit(False)))


def _pool_cell(candidate: Callable[[str], Column]) -> Column:
    return F.concat_ws(":", F.lpad(candidate("candidate_rank").cast("string"), 6, "0"), candidate("candidate_id"), candidate("is_positive"), candidate("is_donor_text"))


def _cells_digest(cells: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(cells), "\n"), 256).alias("pool_digest")


def pool_digest(scores: DataFrame, query: list[str]) -> DataFrame:
    """Digest of each query's pool (ranks, candidates, flags); a pool has a fixed small size."""
    return scores.groupBy(*query).agg(_cells_digest(F.collect_list(_pool_cell(F.col))))


def array_digest(pool: str) -> Column:
    """The digest of ``pool_digest`` for a whole pool in an array."""
    return _cells_digest(F.transform(pool, lambda c: _pool_cell(lambda name: c[name])))


def unbound_pools(scores: DataFrame, query: list[str], across: list[str]) -> DataFrame:
    """Queries that were not scored on one and the same pool across arms and seeds.

    ``scores`` has a row per candidate, or a row per scoring with its whole ``pool``: such rows move as digests only.
    """
    if "pool" in scores.columns:
        per = scores.select(*query, array_digest("pool"))
    else:
        per = pool_digest(scores, [*query, *across])
    return per.groupBy(*query).agg(F.size(F.collect_set("pool_digest")).alias("pools"), F.count("*").alias("scorings")).where("pools > 1")


def forbidden_split(df: DataFrame, sealed: str = "test") -> DataFrame:
    return df.where(F.col("split") == sealed)


def out_of_range(locators: DataFrame, shards: DataFrame) -> DataFrame:
    """Locators that point outside their shard (shards: shard, rows) or to no shard."""
    return locators.join(shards, "shard", "left").where(
        F.col("rows").isNull() | (F.col("offset") < 0) | (F.col("offset") >= F.col("rows")))


def dangling(df: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(parent.select(*keys), keys, "left_anti")


def donor_violations(donors: DataFrame, trials: DataFrame, same: list[str]) -> DataFrame:
    """Donors that are the target itself, share its text, or differ in one of the ``same`` columns."""
    fields = ["text_key", *same]
    t = trials.select(F.col("trial_id").alias("target_id"), F.struct(*fields).alias("t"))
    d = trials.select(F.col("trial_id").alias("donor_id"), F.struct(*fields).alias("d"))
    joined = donors.select("target_id", "donor_id").join(t, "target_id", "left").join(d, "donor_id", "left")
    fine = (F.col("t.text_key") != F.col("d.text_key")) & (F.col("target_id") != F.col("donor_id"))
    for c in same:
        fine = fine & (F.col(f"t.{c}") == F.col(f"d.{c}"))
    return joined.where(~F.coalesce(fine, F.lit(False))).select("target_id", "donor_id")


def vector_problems(df: DataFrame, key: str, width: int) -> DataFrame:
    from trialloom.functions.vectors import is_finite

    problem = F.when(F.size("vector") != width, "width").when(~is_finite(F.col("vector")), "not_finite").when(
        F.forall("vector", lambda x: x == 0), "zero")
    return df.select(key, problem.alias("problem")).where("problem is not null")


def chain_breaks(steps: DataFrame, run: list[str], order: str) -> DataFrame:
    """Steps (numbered 0, 1, ...) whose state before is not the state after the previous step of the run.

    The previous step is found by an equi-join on its number, so a long run is not ordered in one task.
    """
    previous = steps.select(*run, (F.col(order) + 1).alias(order), F.col("post_state").alias("_post"))
    marked = steps.where(F.col(order) > 0).join(previous, [*run, order], "left")
    return marked.where(~F.col("_post").eqNullSafe(F.col("pre_state"))).select(*run, order)


def contiguity_gaps(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Groups whose index is not exactly 0..n-1."""
    out = df.groupBy(*by).agg(F.min(index).alias("low"), F.max(index).alias("high"), F.count("*").alias("rows"),
                              F.count_distinct(index).alias("values"))
    return out.where((F.col("low") != 0) | (F.col("high") != F.col("rows") - 1) | (F.col("values") != F.col("rows")))


def incumbents(history: DataFrame, run: list[str], step: str, metric: str, block: int = 4096) -> DataFrame:
    """Strict improvements over everything before, and the earliest best step of the run.

    The running maximum is taken in blocks of steps: the best of earlier blocks is carried in.
    """
    blocked = history.withColumn("_block", F.floor(F.col(step) / block))
    tops = blocked.groupBy(*run, "_block").agg(
        F.max(metric).alias("_top"), F.max(F.struct(F.col(metric).alias("m"), (-F.col(step)).alias("s"))).alias("_best"))
    earlier = Window.partitionBy(*run).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*run, "_block", F.max("_top").over(earlier).alias("_carried"),
                       F.max("_best").over(Window.partitionBy(*run)).alias("_best"))
    inside = Window.partitionBy(*run, "_block").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    marked = blocked.join(tops, [*run, "_block"]).withColumn("_so_far", F.greatest("_carried", F.max(metric).over(inside)))
    return marked.withColumns({
        "is_best": F.col("_so_far").isNull() | (F.col(metric) > F.col("_so_far")),
        "selected": F.col(step) == -F.col("_best.s")}).drop("_so_far", "_best", "_carried", "_block")


#: most ids below a leaf of a hash tree (on average: ids are spread by their digests), digits a level goes up, and most levels
LEAF, DIGITS, LEVELS = 4096, 3, 4


def digest_of_set(df: DataFrame, by: list[str], key: str, leaf: int = LEAF) -> DataFrame:
    """(by, members, set_digest): SHA-256 of a multiset of ids of any size, the same whatever the order of the rows.

    A hash tree: an id and how often it occurs have a digest; digests with the same leading digits, sorted, make a leaf;
    leaves make a node ``DIGITS`` digits shorter, and so on up to the root. How many digits a leaf has follows from the number of
    different ids, so it is part of the set and not of the run; no group ever holds more than a leaf or 16^``DIGITS`` children.
    """
    ids = df.groupBy(*by, key).agg(F.count("*").alias("_times")).withColumn(
        "_digest", F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), "_times"), 256))
    sizes = ids.groupBy(*by).agg(F.sum("_times").alias("members"), F.count("*").alias("_n"))
    depth = sum((F.when(F.col("_n") > leaf * 16 ** i, 1).otherwise(0) for i in range(DIGITS * LEVELS)), F.lit(0))
    depths = sizes.select(*[F.col(c).alias(f"_of_{c}") for c in by], depth.alias("_depth"))
    same = [ids[c].eqNullSafe(F.col(f"_of_{c}")) for c in by]
    nodes = (ids.join(depths, same) if by else with_totals(ids, depths)).select(
        *by, F.expr("substring(_digest, 1, _depth)").alias("_node"), "_digest")
    nodes = nodes.groupBy(*by, "_node").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_digest")), "\n"), 256).alias("_digest"))
    for _ in range(LEVELS):
        above = nodes.withColumn("_above", F.expr(f"substring(_node, 1, greatest(length(_node) - {DIGITS}, 0))"))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("_node", "_digest"))), lambda x: F.concat(x["_node"], F.lit(" "), x["_digest"]))
        nodes = above.groupBy(*by, F.col("_above").alias("_node")).agg(
            F.when(F.max(F.length("_node")) == 0, F.max("_digest")).otherwise(F.sha2(F.array_join(lines, "\n"), 256)).alias("_digest"))
    roots = nodes.select(*[F.col(c).alias(f"_of_{c}") for c in by], "_digest")
    same = [sizes[c].eqNullSafe(F.col(f"_of_{c}")) for c in by]
    joined = sizes.join(roots, same) if by else with_totals(sizes, roots)
    return joined.select(*by, "members", F.sha2(F.concat_ws("\x1f", "members", "_digest"), 256).alias("set_digest"))


def sorted_digest(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """Digest of the sorted ids joined by newlines; only for groups of bounded size."""
    lines = F.concat(F.array_join(F.array_sort(F.collect_list(key)), "\n"), F.lit("\n"))
    return df.groupBy(*by).agg(F.count("*").alias("members"), F.sha2(lines, 256).alias("ids_digest"))
