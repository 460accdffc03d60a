"""Splits, folds, hold-outs, derangements and permutations; every choice comes from a seeded hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type as to_arrow

from trialloom.functions.keys import draw_hash, hash_parity, length_stratum, ring_hash, stable_hash
from trialloom.operators.ranking import digest_bucket, position_by_digest, position_by_ring, prefix_sum, ring_bucket
from trialloom.operators.reshape import each, with_totals
from trialloom.session import cut


def group_split(df: DataFrame, group: str, seed: int, train: float = 0.7, val: float = 0.1) -> DataFrame:
    """(group, split): exact shares of the distinct groups, by hash order."""
    groups = df.select(group).distinct().withColumn("_ring", ring_hash(seed, F.col(group), "group-split"))
    placed = with_totals(position_by_ring(groups, [], "_ring", [group], "_p"), groups.agg(F.count("*").alias("_n")))
    first = F.floor(F.col("_n") * train)
    second = first + F.floor(F.col("_n") * val)
    return placed.select(group, F.when(F.col("_p") < first, "train").when(F.col("_p") < second, "val")
                         .otherwise("test").alias("split"))


def balanced_folds(df: DataFrame, group: str, task: str, folds: int, seed: int) -> DataFrame:
    """(group, fold, rows, task_mix): serpentine assignment of groups ordered by task mix, size and hash.

    Groups of one mix are dealt out largest first, alternating direction, so folds even out in rows and groups.
    """
    per_task = df.groupBy(group, task).agg(F.count("*").alias("n"))
    stats = per_task.groupBy(group).agg(
        F.sum("n").alias("rows"), F.array_join(F.array_sort(F.collect_list(task)), "+").alias("task_mix"))
    stats = stats.withColumns({"_ring": ring_hash(seed, F.col(group), "group-order"), "_minus": -F.col("rows")})
    bucket = F.struct("_minus", ring_bucket(F.col("_ring"), 12).alias("b"))
    placed = prefix_sum(stats, ["task_mix"], bucket, ["_minus", "_ring", group], F.lit(1), "_p")
    turn, seat = F.floor(F.col("_p") / folds), F.pmod(F.col("_p"), F.lit(folds))
    fold = F.when(turn % 2 == 0, seat).otherwise(folds - 1 - seat).cast("int")
    return placed.select(group, fold.alias("fold"), "rows", "task_mix")


def greedy_folds(df: DataFrame, group: str, task: str, tasks: list[str], folds: int, seeds: list[int]) -> DataFrame:
    """(seed, group, fold, rows): each group in turn goes where it leaves the folds closest to even, exactly.

    The objective is the sum over folds and tasks of the squared relative deviations of rows and of identities from an even
    share. Groups come largest first, then those in more tasks, then by seeded digest; equal costs go by a seeded digest of
    group and fold. Every choice depends on all before it, so a seed's groups are one ordered stream through one task, which
    keeps folds x tasks counters and no rows; seeds run side by side. ``balanced_folds`` is the form without that order.
    """
    counted = df.groupBy(F.col(group).alias("_group")).agg(
        F.count("*").alias("rows"), *[F.count_if(F.col(task) == name).alias(f"_rows_{i}") for i, name in enumerate(tasks)])
    counted = cut(counted)
    per = [f"_rows_{i}" for i in range(len(tasks))]
    totals = counted.agg(*[F.sum(c) for c in per], *[F.count_if(F.col(c) > 0) for c in per]).first()
    even = np.array([[max((totals[i + len(per) * k] or 0) / folds, 1.0) for k in range(2)] for i in range(len(per))]).ravel()
    kind = counted.schema["_group"].dataType.simpleString()
    ties = [stable_hash(F.col("seed"), F.col("_group"), fold, "fold-tie") for fold in range(folds)]
    lanes = counted.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumns({
        "_tasks": sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in per), F.lit(0)),
        "_order": stable_hash(F.col("seed"), F.col("_group"), "group-order"), "_ties": F.array(*ties)})
    ordered = lanes.repartition(len(seeds), "seed").sortWithinPartitions("seed", F.desc("rows"), F.desc("_tasks"), "_order", "_group")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros((folds, len(even)))
        for batch in batches:
            found = []
            counts = np.stack([batch.column(c).to_numpy() for c in per], axis=1)
            added = np.stack([counts, counts > 0], axis=2).reshape(len(counts), -1).astype(float)
            for seed, ties_of, more in zip(batch.column("seed").to_pylist(), batch.column("_ties").to_pylist(), added):
                if seed != now:
                    now, held = seed, np.zeros((folds, len(even)))
                tried = np.repeat(held[None], folds, axis=0)
                tried[np.arange(folds), np.arange(folds)] += more
                # summed one after the other, as a plain loop does: the last bit decides between folds that look alike
                costs = np.cumsum((((tried - even) / even) ** 2).reshape(folds, -1), axis=1)[:, -1]
                best = min(range(folds), key=lambda f: (costs[f], ties_of[f]))
                held[best] += more
                found.append(best)
            yield pa.RecordBatch.from_arrays(
                [batch.column("seed"), batch.column("_group"), pa.array(found, pa.int32()), batch.column("rows")], ["seed", "_group", "fold", "rows"])

    out = cut(ordered.mapInArrow(assign, f"seed int, _group {kind}, fold int, rows long"))
    for row in out.groupBy("seed").agg(F.count_distinct("fold").alias("n")).where(F.col("n") < folds).collect():
        raise ValueError(f"seed {row['seed']} leaves folds empty: {row['n']} of {folds} are used")
    return out.withColumnRenamed("_group", group)


def fold_balance(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("fold", "task_mix").agg(F.count("*").alias("groups"), F.sum("rows").alias("rows"))


def hold_out(df: DataFrame, subject: str, fraction: float, seed: int) -> DataFrame:
    """(subject, held_out): half-to-even rounded share of the subjects, at least one."""
    names = df.select(subject).distinct().withColumn("_ring", ring_hash(seed, F.col(subject), "hold-out"))
    placed = with_totals(position_by_ring(names, [], "_ring", [subject], "_p"), names.agg(F.count("*").alias("_n")))
    held = F.greatest(F.lit(1), F.bround(F.col("_n") * fraction, 0).cast("bigint"))
    return placed.select(subject, (F.col("_p") < held).alias("held_out"))


def feasible_folds(df: DataFrame, label: str, group: str, wanted: int) -> DataFrame:
    """One row: how many group folds the rarest class allows, at least two (a class of one group is then missing from a fold)."""
    per_class = df.select(label, group).distinct().groupBy(label).agg(F.count("*").alias("groups"))
    return per_class.agg(F.min("groups").alias("rarest_class_groups"),
                         F.greatest(F.lit(2).cast("bigint"), F.least(F.lit(wanted).cast("bigint"), F.min("groups"))).alias("folds"))


def half_split(df: DataFrame, task: str, text: str, seed: int) -> DataFrame:
    """(task, text, partition): the first floor(n/2) texts of a task in hash order are 'checkpoint'."""
    texts = df.select(task, text).distinct().withColumn(
        "_digest", stable_hash(seed, F.col(task), F.col(text), "checkpoint-decision-partition"))
    sizes = texts.groupBy(task).agg(F.count("*").alias("_n"))
    placed = position_by_digest(texts, [task], "_digest", [text], "_p").join(sizes, task)
    return placed.select(task, text, F.when(F.col("_p") < F.floor(F.col("_n") / 2), "checkpoint")
                         .otherwise("decision").alias("partition"))


def pseudo_groups(df: DataFrame, task: str, text: str, length: str, seed: int) -> DataFrame:
    """(task, text, stratum, pseudo_group): alternating 0/1 in hash order within (task, length stratum)."""
    texts = df.groupBy(task, text).agg(F.min(length).alias("length")).withColumn(
        "stratum", length_stratum(F.col("length")))
    texts = texts.withColumn("_digest", stable_hash(seed, F.col(task), F.col(text), F.col("stratum"), "pseudo-order"))
    placed = position_by_digest(texts, [task, "stratum"], "_digest", [text], "_p")
    offset = hash_parity(seed, F.col(task), F.col("stratum"), "pseudo-offset")
    return placed.select(task, text, "length", "stratum",
                         F.pmod(F.col("_p") + offset, F.lit(2)).cast("int").alias("pseudo_group"))


def subject_fold_roles(df: DataFrame, subject: str) -> DataFrame:
    """Leave-one-subject-out roles as a rule per row: a row trains in every fold but its own subject's.

    Roles of a row follow from its subject alone, so the product of rows and folds is never written;
    this gives per held-out subject the row counts of both roles.
    """
    per = df.groupBy(subject).agg(F.count("*").alias("evaluation_rows"))
    return with_totals(per, per.agg(F.sum("evaluation_rows").alias("_all"))).select(
        subject, "evaluation_rows", (F.col("_all") - F.col("evaluation_rows")).alias("training_rows"))


def derangement(trials: DataFrame, seed: int) -> DataFrame:
    """(trial_id, text_key, wrong_text_key): nobody keeps its text.

    Trials are ordered by (text, hash) and every one takes the text ``largest group`` places ahead, which is another
    text; if one text holds more than half of the trials there is no such order and the run fails. Positions come from two levels (texts, then trials of a
    text), so a hot text is ordered in pieces.
    """
    texts = trials.groupBy("text_key").agg(F.count("*").alias("_size"))
    offsets = prefix_sum(texts, [], digest_bucket(F.col("text_key")), ["text_key"], F.col("_size"), "_before")
    members = trials.select("trial_id", "text_key", ring_hash(seed, F.col("trial_id"), "derange").alias("_ring"))
    placed = position_by_ring(members, ["text_key"], "_ring", ["trial_id"], "_p").join(offsets, "text_key")
    totals = texts.agg(F.sum("_size").alias("_n"), F.max("_size").alias("_shift"))
    placed = with_totals(placed.withColumn("_at", F.col("_before") + F.col("_p")), totals)
    donors = placed.select(F.col("_at").alias("_to"), F.col("text_key").alias("wrong_text_key"))
    shift = F.when(2 * F.col("_shift") > F.col("_n"), F.raise_error(F.lit("a text holds more than half of the trials")).cast("bigint")).otherwise(
        F.col("_shift"))
    taking = placed.withColumn("_to", F.pmod(F.col("_at") + shift, F.col("_n")))
    return taking.join(donors, "_to").select("trial_id", "text_key", "wrong_text_key")


def permuted_labels(df: DataFrame, key: str, label: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, key, label): labels shuffled within each replicate by two hash orders."""
    base = df.select(key, label)
    home = position_by_ring(base.withColumn("_ring", draw_hash(seed, "home", F.col(key))), [], "_ring", [key], "_p")
    copies = each(base.select(key), "replicate", list(range(replicates)))
    copies = copies.withColumn("_ring", draw_hash(seed, F.col("replicate"), F.col(key)))
    away = position_by_ring(copies, ["replicate"], "_ring", [key], "_p").select("replicate", key, "_p")
    return away.join(home.select("_p", label), "_p").select("replicate", key, label)


def sample_by_class(df: DataFrame, key: str, label: str, draws: int, seed: int) -> DataFrame:
    """(draw, key, label): with replacement, every row weighted by the inverse frequency of its class.

    With such weights all classes are equally likely, so a draw picks a class and then a position in it.
    """
    ringed = df.select(key, label).withColumn("_ring", draw_hash(seed, "member", F.col(key)))
    placed = position_by_ring(ringed, [label], "_ring", [key], "_p")
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    from trialloom.operators.ranking import value_prefix

    classes = value_prefix(sizes, [], label, {"one": F.lit(1)}).select(label, F.col("before_one").alias("_class"))
    classes = with_totals(classes.join(sizes, label), classes.agg(F.count("*").alias("_classes")))
    spark = df.sparkSession
    drawn = with_totals(spark.range(draws).withColumnRenamed("id", "draw"), classes.agg(F.max("_classes").alias("_c")))
    drawn = drawn.withColumn("_class", F.pmod(draw_hash(seed, "class", F.col("draw")), F.col("_c")))
    picked = drawn.join(classes.select("_class", label, "_n"), "_class").withColumn(
        "_p", F.pmod(draw_hash(seed, "row", F.col("draw")), F.col("_n")))
    return picked.join(placed.select(label, "_p", key), [label, "_p"]).select("draw", key, label)


HEAVY_SHARE = 1024


def sample_by_weight(df: DataFrame, key: str, weight: Column, draws: int, seed: int, units: float = 1.0) -> DataFrame:
    """(draw, key): with replacement, every row in proportion to its weight (at least 0, counted in whole 1/``units``).

    Rows stand in hash order on a line of their weights, by prefix sums over hash buckets; a draw is a hashed place on the line.
    At most ``HEAVY_SHARE`` rows hold more than that part of the line; draws that fall on them are answered in place, so a row with
    a third of all weight is no hot key. The others go to their bucket (65,536 of them, whose ends every task knows), where
    rows and draws are merged in order: the row is the last one that begins at or before the draw.
    """
    rows = df.select(key, F.round(weight * units).cast("bigint").alias("_units")).where("_units > 0")
    rows = rows.withColumn("_ring", draw_hash(seed, "member", F.col(key)))
    placed = cut(prefix_sum(rows, [], ring_bucket(F.col("_ring")), ["_ring", key], F.col("_units"), "_begin").withColumn(
        "_bucket", ring_bucket(F.col("_ring"))))
    buckets = placed.groupBy("_bucket").agg(F.min("_begin").alias("begin"), F.sum("_units").alias("units")).orderBy("begin").collect()
    if not buckets:
        raise ValueError("no row has a weight")
    total = buckets[-1]["begin"] + buckets[-1]["units"]
    heavy = placed.where(F.col("_units") > total / HEAVY_SHARE).select("_begin", "_units", key).orderBy("_begin").collect()
    numbers, begins = np.array([b["_bucket"] for b in buckets]), np.array([b["begin"] for b in buckets])
    starts = np.array([h["_begin"] for h in heavy], np.int64)
    ends = starts + np.array([h["_units"] for h in heavy], np.int64)
    names = [h[key] for h in heavy]
    kind = placed.schema[key].dataType.simpleString()

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("_at").to_numpy()
            on = np.searchsorted(starts, at, side="right") - 1
            hit = (on >= 0) & (at < ends[on]) if len(starts) else np.zeros(len(at), bool)
            bucket = numbers[np.searchsorted(begins, at, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("draw"), batch.column("_at"), pa.array(bucket, pa.int64()),
                 pa.array([names[i] if h else None for i, h in zip(on.tolist(), hit.tolist())], batch_type)], ["draw", "_at", "_bucket", key])

    batch_type = to_arrow(placed.schema[key].dataType)
    at = F.pmod(draw_hash(seed, "place", F.col("draw")), F.lit(total))
    located = df.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("_at", at).mapInArrow(
        locate, f"draw long, _at long, _bucket long, `{key}` {kind}")
    located = cut(located)
    asked = located.where(F.col(key).isNull()).select("_bucket", "_at", "draw", F.lit(None).cast(kind).alias("_row"))
    line = placed.select("_bucket", F.col("_begin").alias("_at"), F.lit(None).cast("long").alias("draw"), F.col(key).alias("_row"))
    so_far = Window.partitionBy("_bucket").orderBy("_at", F.col("draw").isNotNull())
    met = line.unionByName(asked).withColumn(key, F.last("_row", ignorenulls=True).over(so_far)).where("draw IS NOT NULL")
    return located.where(F.col(key).isNotNull()).select("draw", key).unionByName(met.select("draw", key))


def capped_sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """The ``size`` rows first in hash order (a sampling operator: TakeOrdered, no full sort)."""
    return df.orderBy(ring_hash(seed, F.col(key), "sample"), key).limit(size)


def n_way_draws(df: DataFrame, key: str, ways: int, draws: int, seed: int) -> DataFrame:
    """(draw, slot, key): ``ways`` distinct rows per draw; with fewer rows than ``ways`` there is no draw, an error.

    Positions are hashed, so a draw costs a few lookups and never a sort of the table; a repeated position is skipped.
    Draws that are not full yet go on with twice as many tries; a try has a number, so more of them keep the first slots.
    """
    from pyspark.sql import Window

    rows = df.count()
    if rows < ways:
        raise ValueError(f"{rows} rows, {ways} wanted in a draw")
    ringed = df.select(key).withColumn("_ring", draw_hash(seed, "place", F.col(key)))
    placed = position_by_ring(ringed, [], "_ring", [key], "_p").select(F.col("_p"), key)
    order = Window.partitionBy("draw").orderBy("try")
    open_draws, most, full = df.sparkSession.range(draws).withColumnRenamed("id", "draw"), 4 * ways + 15, None
    while True:
        tries = open_draws.withColumn("try", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn(
            "_p", F.pmod(draw_hash(seed, ways, F.col("draw"), F.col("try")), F.lit(rows)))
        fresh = tries.groupBy("draw", "_p").agg(F.min("try").alias("try"))
        chosen = cut(fresh.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= ways).select("draw", "slot", "_p"))
        done = chosen.groupBy("draw").agg(F.count("*").alias("n")).where(F.col("n") == ways).select("draw")
        part = chosen.join(done, "draw", "left_semi")
        full = part if full is None else full.unionByName(part)
        open_draws = cut(open_draws.join(done, "draw", "left_anti"))
        if open_draws.isEmpty():
            return full.join(placed, "_p").select("draw", "slot", key)
        most *= 2
