"""Clustered bootstrap, multiplicity control, permutation tests.

A draw is ``hash(seed, scheme, attempt, j) mod K`` over the K clusters in digest order, so a replicate never depends on
partitioning. Replicates meet cluster sums only, never raw rows. Sums may differ in their last bits with the order of their
terms, so a replicate within ``ZERO`` of zero is zero: whether it counts as positive depends on the data alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialloom.functions.draws import weights
from trialloom.functions.keys import ring_hash
from trialloom.operators.ranking import position_by_ring
from trialloom.operators.reshape import each, with_totals
from trialloom.session import cut

ZERO = 1e-12
#: most attempts whose weights a task makes at a time, most weights it holds, and most clusters and cells of a tile
ATTEMPT_BLOCK = 64
HELD_WEIGHTS = 1 << 22
TILE_CLUSTERS = 1 << 18
TILE_CELLS = 1 << 18
#: tasks at least (where tiles are fewer, they share a tile's attempts), and most shuffle partitions
FEWEST_TASKS = 48
MOST_PARTITIONS = 4096
ROWS = 8192
MOST_TRIES = 1000


def cluster_index(cells: DataFrame, cluster: str) -> DataFrame:
    """(cluster, idx): dense index of the distinct clusters in hash order."""
    names = cells.select(cluster).distinct().withColumn("_r", ring_hash(F.col(cluster), "cluster"))
    return position_by_ring(names, [], "_r", [cluster], "idx").select(cluster, "idx")


def replicate_sums(rows: DataFrame, clusters: list[str], strata: list[str], measures: list[str], attempts: int, seed: int) -> DataFrame:
    """(attempt, strata, measures): the measures summed under resampled clusters, one-way or two-way (product weights).

    Rows collapse to one cell per combination of clusters and stratum. Cells are dealt to tiles, a block of each cluster's
    numbers times a slice of what stands there, and where they are few, several tasks share a tile's attempts. A task
    makes the weights of its blocks itself, some attempts at a time, from the seed: no draw is shuffled or broadcast, whatever
    the number of clusters, cells and attempts. It gives out strata x attempts partial sums. A stratum that no drawn cluster
    holds is left out.
    """
    cells = rows.groupBy(*clusters, *strata).agg(*[F.sum(m).cast("double").alias(m) for m in measures])
    sizes: dict[str, int] = {}
    for c in clusters:
        index = cut(cluster_index(rows.select(c), c))
        sizes[c] = index.count()
        cells = cells.join(index.withColumnRenamed("idx", f"_{c}"), c)
    numbers = [f"_{c}" for c in clusters]
    blocks = [F.floor(F.col(n) / TILE_CLUSTERS).cast("int").alias(f"{n}_block") for n in numbers]
    cells = cut(cells.select(*numbers, *blocks, *strata, *measures))
    tile = [f"{n}_block" for n in numbers]
    slices = cells.groupBy(*tile).agg(F.ceil(F.count("*") / F.lit(TILE_CELLS)).cast("int").alias("_slices"))
    tiles = slices.agg(F.sum("_slices")).first()[0] or 0
    share = -(-attempts // -(-FEWEST_TASKS // max(tiles, 1)))
    parts = -(-attempts // share)
    dealt = cells.join(slices, tile).withColumn("_slice", F.pmod(F.xxhash64(*numbers), F.col("_slices")))
    # A named number of partitions: the rows are few and the work on them long, so none must be joined by their size.
    dealt = each(dealt.drop("_slices"), "_part", list(range(parts))).repartition(
        max(1, min(2 * tiles * parts, MOST_PARTITIONS)), *tile, "_slice", "_part")
    kinds = {c: cells.schema[c].dataType.simpleString() for c in strata}

    def partial(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        stratum, keys = _strata(table, strata)
        order = np.argsort(stratum, kind="stable")
        values = np.stack([table.column(m).to_numpy() for m in measures], axis=1)[order]
        places = [table.column(n).to_numpy()[order] for n in numbers]
        first = [int(p.min()) for p in places]
        last = [int(p.max()) + 1 for p in places]
        bounds = np.searchsorted(stratum[order], np.arange(len(keys) + 1))
        out = []
        some_at_once = max(1, min(ATTEMPT_BLOCK, HELD_WEIGHTS // max(hi - lo for lo, hi in zip(first, last))))
        start = table.column("_part")[0].as_py() * share
        stop = min(start + share, attempts)
        for begin in range(start, stop, some_at_once):
            some = range(begin, min(begin + some_at_once, stop))
            made = [weights(seed, c, some, sizes[c], lo, hi) for c, lo, hi in zip(clusters, first, last)]
            for k, key in enumerate(keys):
                sums, weight = np.zeros((len(some), len(measures))), np.zeros(len(some))
                for at in range(int(bounds[k]), int(bounds[k + 1]), ROWS):
                    part = slice(at, min(at + ROWS, int(bounds[k + 1])))
                    w = made[0][places[0][part] - first[0]].astype(float)
                    for more, place, lo in zip(made[1:], places[1:], first[1:]):
                        w *= more[place[part] - lo]
                    sums += w.T @ values[part]
                    weight += w.sum(axis=0)
                seen = np.flatnonzero(weight > 0)
                out.append(pa.table(
                    [pa.array(begin + seen, pa.int64()), *(pa.repeat(pa.scalar(v, table.schema.field(c).type), len(seen)) for v, c in zip(key, strata)),
                     *(pa.array(sums[seen, m]) for m in range(len(measures)))], ["attempt", *strata, *measures]))
        return pa.concat_tables(out)

    schema = ", ".join(["attempt long", *(f"`{c}` {k}" for c, k in kinds.items()), *(f"`{m}` double" for m in measures)])
    out = dealt.groupBy(*tile, "_slice", "_part").applyInArrow(partial, schema)
    return out.groupBy("attempt", *strata).agg(*[F.sum(m).alias(m) for m in measures])


def _strata(table: pa.Table, strata: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """The number of each row's stratum, and the strata by number."""
    found: dict[tuple, int] = {}
    rows = zip(*(table.column(c).to_pylist() for c in strata))
    return np.array([found.setdefault(key, len(found)) for key in rows]), list(found)


def first_valid(values: DataFrame, by: list[str], valid: Column, replicates: int) -> DataFrame:
    """The first ``replicates`` valid attempts of each series, in attempt order (a redraw of the invalid ones)."""
    order = Window.partitionBy(*by).orderBy("attempt")
    return values.where(valid).withColumn("replicate", F.row_number().over(order) - 1).where(F.col("replicate") < replicates)


def bootstrap_macro(effects: DataFrame, clusters: list[str], replicates: int, seed: int, fixed: list[str] | None = None,
                    redraw: float = 1.2) -> DataFrame:
    """(contrast, replicate, macro, tasks...): task-macro mean of the effects per replicate.

    effects: contrast, reading_task, cluster columns, effect and the ``fixed`` strata (e.g. outer_fold): an attempt that
    leaves a (fixed, task) stratum empty is invalid. ``redraw`` x replicates attempts are made first and twice as many as
    long as a series is short; a series still short after ``MOST_TRIES`` x replicates attempts is an error.
    Attempts are numbered draws, so more of them never change the first ones.
    """
    strata = [*(fixed or []), "reading_task"]
    wanted = effects.select("contrast", *strata).distinct().groupBy("contrast").agg(F.count("*").alias("_strata"))
    names = [row["contrast"] for row in wanted.select("contrast").orderBy("contrast").collect()]
    series, attempts = len(names), int(replicates * redraw)
    if not names:
        return effects.sparkSession.createDataFrame([], f"contrast {effects.schema['contrast'].dataType.simpleString()}, replicate int, macro double, NR double, TSR double")
    # The contrasts of a cell are measures of one row: they share its weights.
    measures = [f"{m}_{i}" for i in range(series) for m in ("effect", "n")]
    own = [F.col("contrast").eqNullSafe(F.lit(name)) for name in names]
    cells = effects.groupBy(*clusters, *strata).agg(*[column for i, mine in enumerate(own) for column in (
        F.when(F.count_if(mine) == 0, 0.0).otherwise(F.sum(F.when(mine, F.col("effect")))).alias(f"effect_{i}"), F.count_if(mine).alias(f"n_{i}"))])
    long = F.inline(F.array(*[F.struct(F.lit(name).alias("contrast"), F.col(f"effect_{i}").alias("effect"), F.col(f"n_{i}").alias("n"))
                              for i, name in enumerate(names)]))
    while True:
        summed = replicate_sums(cells, clusters, strata, measures, attempts, seed)
        summed = summed.select("attempt", *strata, long).where("n > 0")
        per_task = summed.groupBy("contrast", "attempt", "reading_task").agg(
            (F.sum("effect") / F.sum("n")).alias("mean"), F.count("*").alias("_seen"))
        macro = per_task.groupBy("contrast", "attempt").agg(
            zeroed(F.avg("mean")).alias("macro"), F.sum("_seen").alias("_seen"),
            zeroed(F.max(F.when(F.col("reading_task") == "NR", F.col("mean")))).alias("NR"),
            zeroed(F.max(F.when(F.col("reading_task") == "TSR", F.col("mean")))).alias("TSR"))
        checked = macro.join(wanted, "contrast")
        kept = cut(first_valid(checked, ["contrast"], F.col("_seen") == F.col("_strata"), replicates)
                   .select("contrast", "replicate", "macro", "NR", "TSR"))
        if kept.groupBy("contrast").agg(F.count("*").alias("rows")).where(F.col("rows") >= replicates).count() == series:
            return kept
        if attempts >= MOST_TRIES * replicates:
            raise ValueError(f"no {replicates} valid replicates of {clusters} in {attempts} attempts")
        attempts = min(2 * attempts, MOST_TRIES * replicates)


def quantile_columns(value: str, points: dict[str, float]) -> list[Column]:
    """Exact linear-interpolation quantiles, named by their level."""
    return [F.percentile(value, q).alias(name) for name, q in points.items()]


def zeroed(value: Column) -> Column:
    """``value``, and exactly 0 where it is 0 but for rounding."""
    return F.when(F.abs(value) < ZERO, 0.0).otherwise(value)


def one_sided_p(value: str) -> Column:
    return (F.count_if(F.col(value) <= 0) + 1) / (F.count("*") + 1)


def observed_macro(effects: DataFrame) -> DataFrame:
    per_task = effects.groupBy("contrast", "reading_task").agg(F.avg("effect").alias("m"))
    return per_task.groupBy("contrast").agg(
        F.avg("m").alias("point"), F.max(F.when(F.col("reading_task") == "NR", F.col("m"))).alias("point_NR"),
        F.max(F.when(F.col("reading_task") == "TSR", F.col("m"))).alias("point_TSR"))


SCHEMES = {
    "subject_id": ["subject_id"],
    "text_key": ["text_key"],
    "two_way_subject_by_text": ["subject_id", "text_key"],
}


def clustered_delta(effects: DataFrame, replicates: int, seed: int, points: dict[str, float], fixed: list[str] | None = None,
                    scopes: tuple[str, ...] = ("macro",)) -> DataFrame:
    """(contrast, cluster, scope, point, quantiles, p): every series under every cluster scheme."""
    parts = []
    for name, clusters in SCHEMES.items():
        dist = bootstrap_macro(effects, clusters, replicates, seed, fixed)
        long = dist.unpivot(["contrast", "replicate"], list(scopes), "scope", "value")
        parts.append(long.groupBy("contrast", "scope").agg(
            *quantile_columns("value", points), one_sided_p("value").alias("p_one_sided"),
            F.count("value").alias("replicates")).withColumn("cluster", F.lit(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.join(observed_macro(effects), "contrast").withColumn(
        "point", F.when(F.col("scope") == "macro", F.col("point")).when(F.col("scope") == "NR", F.col("point_NR"))
        .otherwise(F.col("point_TSR"))).drop("point_NR", "point_TSR")


def holm(df: DataFrame, family: list[str], p: str, tie: list[str]) -> DataFrame:
    """Step-down adjustment within a family of tests: rank, rank alpha (at 5 %), adjusted p."""
    order = Window.partitionBy(*family).orderBy(p, *tie)
    size = F.count("*").over(Window.partitionBy(*family))
    ranked = df.withColumn("holm_rank", F.row_number().over(order)).withColumn("_m", size)
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("holm_rank") + 1) * F.col(p))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumns({
        "holm_rank_alpha": 0.05 / (F.col("_m") - F.col("holm_rank") + 1),
        "holm_adjusted_p": F.max(step).over(running)}).drop("_m")


def holm_bounds(distribution: DataFrame, family: list[str], test: list[str]) -> DataFrame:
    """Per test: one-sided p, Holm adjustment in its family, and the lower bound at the test's own rank alpha."""
    tested = distribution.groupBy(*family, *test).agg(one_sided_p("value").alias("p_one_sided"))
    adjusted = holm(tested, family, "p_one_sided", test)
    # The level differs per test, so the quantile is interpolated by hand between its two order statistics.
    inside = Window.partitionBy(*family, *test)
    placed = distribution.join(adjusted, [*family, *test]).withColumns({
        "_i": F.row_number().over(inside.orderBy("value")) - 1, "_n": F.count("*").over(inside)})
    at = F.col("holm_rank_alpha") * (F.col("_n") - 1)
    part = at - F.floor(at)
    weight = F.when(F.col("_i") == F.floor(at), 1 - part).when(F.col("_i") == F.floor(at) + 1, part)
    bounds = placed.groupBy(*family, *test).agg(F.sum(F.col("value") * weight).alias("holm_adjusted_lower"))
    return adjusted.join(bounds, [*family, *test])


def macro_f1_bootstrap(cells: DataFrame, clusters: list[str], classes: int, replicates: int, seed: int) -> DataFrame:
    """(replicate, delta): macro F1 of model a minus model b under resampled clusters.

    cells: cluster columns, class, tp/fp/fn of both models. A replicate without any weight falls back to unit weights.
    """
    measures = ["tp_a", "fp_a", "fn_a", "tp_b", "fp_b", "fn_b"]
    summed = replicate_sums(cells, clusters, ["class"], measures, replicates, seed)
    plain = cells.groupBy("class").agg(*[F.sum(m).alias(m) for m in measures])

    def f1(side: str) -> Column:
        tp, fp, fn = F.col(f"tp_{side}"), F.col(f"fp_{side}"), F.col(f"fn_{side}")
        return F.when(2 * tp + fp + fn == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn))

    weighted = summed.groupBy("attempt").agg(zeroed((F.sum(f1("a")) - F.sum(f1("b"))) / classes).alias("delta"))
    unit = plain.agg(((F.sum(f1("a")) - F.sum(f1("b"))) / classes).alias("_unit"))
    every = cells.sparkSession.range(replicates).withColumnRenamed("id", "attempt")
    return with_totals(every, unit).join(weighted, "attempt", "left").select(
        F.col("attempt").alias("replicate"), F.coalesce("delta", "_unit").alias("delta"))


def permutation_p(null: DataFrame, observed: DataFrame, value: str) -> DataFrame:
    """One row: observed value, mean and spread of the null, one-sided p."""
    joined = with_totals(null.select(F.col(value).alias("_null")), observed.select(F.col(value).alias("observed")))
    return joined.agg(
        F.max("observed").alias("observed"), F.avg("_null").alias("null_mean"), F.stddev_pop("_null").alias("null_sd"),
        ((F.count_if(F.col("_null") >= F.col("observed")) + 1) / (F.count("*") + 1)).alias("p_value"))
