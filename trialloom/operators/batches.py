"""Batch plans: rounds of distinct texts, balanced cells, feasibility, negative masks, audits."""

from __future__ import annotations

import itertools
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialloom.functions.keys import draw_hash, ring_hash
from trialloom.operators.ranking import position_by_ring, ring_bucket
from trialloom.operators.reshape import each
from trialloom.session import cut

CELL_ROWS = 16
#: an epoch's ring is cut into pieces of about so many texts, each ordered by one call
PIECE_TEXTS = 16384


def distinct_text_batches(trials: DataFrame, batch: int, seed: int) -> DataFrame:
    """(trial_id, reading_task, text_key, round, batch): one trial per text and round, rounds cut into batches."""
    ringed = trials.select("trial_id", "reading_task", "text_key", ring_hash(seed, F.col("trial_id"), "cycle").alias("_r"))
    rounds = position_by_ring(ringed, ["reading_task", "text_key"], "_r", ["trial_id"], "round")
    rounds = rounds.withColumn("_r", ring_hash(seed, F.col("round"), F.col("text_key"), "slot"))
    placed = position_by_ring(rounds, ["reading_task", "round"], "_r", ["trial_id"], "_p")
    return placed.select("trial_id", "reading_task", "text_key", "round", F.floor(F.col("_p") / batch).alias("batch"))


def fit_cells(assignments: DataFrame) -> DataFrame:
    """Rows and texts per (outer_fold, task, pseudo group) of the fit role, and the batches an epoch needs."""
    texts = assignments.where("role = 'fit'").groupBy("outer_fold", "reading_task", "pseudo_group", "text_key").agg(
        F.count("*").alias("n"))
    cells = texts.groupBy("outer_fold", "reading_task", "pseudo_group").agg(
        F.sum("n").alias("fit_rows"), F.count("*").alias("fit_texts"))
    most = Window.partitionBy("outer_fold")
    return cells.withColumn("batches_per_epoch", F.max(F.ceil(F.col("fit_rows") / CELL_ROWS)).over(most))


def grid_feasibility(assignments: DataFrame, minimum: int = CELL_ROWS) -> DataFrame:
    """Can one batch of distinct texts fill all four cells? Hall's condition over the 15 subsets of cells.

    (outer_fold, cells, available, needed, feasible) per subset; ``cells`` is the subset as a bit mask.
    """
    bit = F.when(F.col("reading_task") == "NR", 0).otherwise(2) + F.col("pseudo_group")
    texts = assignments.where("role = 'fit'").groupBy("outer_fold", "text_key").agg(
        F.bit_or(F.element_at(F.array(*[F.lit(1 << i) for i in range(4)]), bit + 1)).alias("mask"))
    masks = texts.groupBy("outer_fold", "mask").agg(F.count("*").alias("n"))
    subsets = each(masks, "cells", list(range(1, 16)))
    counted = subsets.groupBy("outer_fold", "cells").agg(
        F.sum(F.when(F.col("mask").bitwiseAND(F.col("cells")) != 0, F.col("n")).otherwise(0)).alias("available"))
    needed = F.bit_count(F.col("cells")) * minimum
    return counted.withColumn("needed", needed).withColumn("feasible", F.col("available") >= F.col("needed"))


def _numbered_texts(fit: DataFrame) -> DataFrame:
    """(_t, text_key, _cells): the texts, numbered in their order, each with its numbered cells and how many trials it has there."""
    cell = ["outer_fold", "reading_task", "pseudo_group"]
    counted = fit.groupBy(*cell, "text_key").agg(F.count("*").alias("trials"))
    names = counted.select(*cell).distinct()
    names = names.select(F.row_number().over(Window.orderBy(*cell)).alias("cell"), *[F.col(c).alias(f"_{c}") for c in cell])
    same = F.lit(True)
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    known = counted.join(F.broadcast(names), same).select("text_key", F.struct("cell", *cell, "trials").alias("_cell"))
    texts = known.groupBy("text_key").agg(F.sort_array(F.collect_list("_cell")).alias("_cells"))
    ordered = texts.repartitionByRange("text_key").sortWithinPartitions("text_key")
    return cut(ordered.select(F.monotonically_increasing_id().alias("_t"), "text_key", "_cells"))


def _copies(texts: DataFrame, epochs: int, seed: int, bits: int) -> DataFrame:
    """(epoch, _bucket, _ring, _t, _cells, _playing): every text once an epoch; ``_playing`` has the numbers of its cells, -1 for
    those it does not play for, because a cell of the same fold was chosen by hash."""
    alone = F.size("_cells") == F.size(F.array_distinct("_cells.outer_fold"))
    copies = each(texts.withColumn("_alone", alone), "epoch", list(range(epochs)))
    copies = copies.withColumn("_ring", ring_hash(seed, F.col("epoch"), F.col("text_key"), "epoch-order"))
    vote = lambda c: F.struct(
        draw_hash(seed, F.col("epoch"), F.col("text_key"), c["reading_task"], c["pseudo_group"]).alias("vote"), c["reading_task"], c["pseudo_group"])
    votes = F.transform("_cells", lambda c: F.struct(c["outer_fold"].alias("fold"), vote(c).alias("vote")))
    copies = copies.withColumn("_votes", F.when(~F.col("_alone"), votes))
    beaten = lambda c, i: F.exists(
        "_votes", lambda v: v["fold"].eqNullSafe(c["outer_fold"]) & (v["vote"] < F.get("_votes", i)["vote"]))
    chosen = F.transform("_cells", lambda c, i: F.when(beaten(c, i), -1).otherwise(c["cell"]))
    return copies.select("epoch", ring_bucket(F.col("_ring"), bits).alias("_bucket"), "_ring", "_t", "_cells",
                         F.when(F.col("_alone"), F.col("_cells.cell")).otherwise(chosen).alias("_playing"))


def _seats(copies: DataFrame, offsets: DataFrame) -> DataFrame:
    """(epoch, _t, _seats): the place of each text in each of its cells, -1 where it does not play. A task orders one piece of an
    epoch's ring; ``offsets`` tells how many texts of a cell come before the piece."""

    def seated(rows: pa.Table, before: pa.Table) -> pa.Table:
        playing = rows.column("_playing").combine_chunks()
        ends = playing.offsets.to_numpy()
        cells, row = playing.flatten().to_numpy(), np.repeat(np.arange(len(rows)), np.diff(ends))
        ring, number = rows.column("_ring").to_numpy()[row], rows.column("_t").to_numpy()[row]
        order = np.lexsort((number, ring, cells))
        found, first, counts = np.unique(cells[order], return_index=True, return_counts=True)
        offset = dict(zip(before.column("cell").to_pylist(), before.column("_before").to_pylist()))
        starts = np.array([offset.get(c, 0) for c in found.tolist()], np.int64) - first
        places = np.empty(len(cells), np.int64)
        places[order] = np.arange(len(cells)) + np.repeat(starts, counts)
        places[cells < 0] = -1
        seats = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(places))
        return pa.table([rows.column("epoch"), rows.column("_t"), seats], ["epoch", "_t", "_seats"])

    piece = ["epoch", "_bucket"]
    moved = copies.select(*piece, "_ring", "_t", "_playing").groupBy(*piece)
    return moved.cogroup(offsets.groupBy(*piece)).applyInArrow(seated, "epoch int, _t long, _seats array<long>")


def _turns(fit: DataFrame, texts: DataFrame, needed: DataFrame, seed: int) -> DataFrame:
    """(_t, text_key, _own): per cell of a text the trials in the order of their turns, as far as ``needed`` has turns."""
    cell = ["outer_fold", "reading_task", "pseudo_group"]
    most = needed.agg(F.max("needed")).first()[0] or 0
    order = Window.partitionBy(*cell, "text_key").orderBy("_r", "trial_id")
    ringed = fit.withColumn("_r", ring_hash(seed, F.col("trial_id"), "turn"))
    # the bound holds in every task before rows move, so a text of very many trials is no hot key
    turns = ringed.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= most)
    turns = turns.groupBy(*cell, "text_key").agg(F.sort_array(F.collect_list(F.struct("turn", "trial_id"))).alias("_turns"))
    cells = texts.select("_t", "text_key", F.explode("_cells").alias("_c")).select("_t", "text_key", "_c.*")
    # cells without a key or a turn stay in line with their seats, and have no trials
    cells = cells.join(F.broadcast(needed), "cell", "left").join(turns.hint("merge"), [*cell, "text_key"], "left")
    own = F.struct("cell", *cell, "trials", F.slice("_turns.trial_id", F.lit(1), F.col("needed").cast("int")).alias("turns"))
    return cut(cells.groupBy("_t", "text_key").agg(F.sort_array(F.collect_list(own)).alias("_own")))


def epoch_plan(assignments: DataFrame, epochs: int, seed: int) -> DataFrame:
    """(outer_fold, epoch, batch, reading_task, pseudo_group, slot, text_key, trial_id).

    Within a cell the texts sit on a ring; a batch takes the next 16, so texts in a batch differ and exposures differ
    by one at most. A text with rows in both tasks plays for one cell per epoch, chosen by hash. The trial of a
    text rotates with every exposure.

    What the epochs multiply moves as numbers only, a text once an epoch for all folds: to its piece of the epoch's ring, where it is
    placed, and back to its text, where its keys and trials are; the slots are made there, one text after the other.
    """
    fit = assignments.where("role = 'fit'").select("outer_fold", "reading_task", "pseudo_group", "text_key", "trial_id")
    texts = _numbered_texts(fit)
    copies = _copies(texts, epochs, seed, max(0, (texts.count() // PIECE_TEXTS).bit_length()))
    totals = copies.select("epoch", "_bucket", F.inline(F.arrays_zip(F.col("_playing").alias("playing"), F.col("_cells").alias("c"))))
    totals = cut(totals.where("playing >= 0").groupBy("epoch", "_bucket", "c.cell", "c.outer_fold").agg(
        F.count("*").alias("texts"), F.sum("c.trials").alias("rows")))
    sizes = totals.groupBy("outer_fold", "epoch", "cell").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))
    fold_epoch = Window.partitionBy("outer_fold", "epoch")
    sizes = sizes.select("epoch", "cell", "texts", F.max(F.ceil(F.col("rows") / CELL_ROWS)).over(fold_epoch).alias("batches"))
    most = F.max(F.ceil(F.col("batches") * CELL_ROWS / F.col("texts")))
    needed = cut(sizes.groupBy("cell").agg((most + epochs).alias("needed")))
    before = Window.partitionBy("epoch", "cell").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("epoch", "_bucket", "cell", F.coalesce(F.sum("texts").over(before), F.lit(0)).alias("_before"))
    placed = _seats(copies, offsets).join(_turns(fit, texts, needed, seed).hint("merge"), "_t")
    seat = F.arrays_zip(F.col("_seats").alias("place"), F.col("_own").alias("c"))
    placed = placed.select("epoch", "text_key", F.inline(seat)).where("place >= 0 AND c.turns IS NOT NULL").select("epoch", "text_key", "place", "c.*")
    # Exposure k of the text at place p is slot p + k * texts; the last exposure falls short for some.
    exposures = F.floor((F.col("batches") * CELL_ROWS - F.col("place") - 1) / F.col("texts"))
    uses = placed.join(F.broadcast(sizes), ["epoch", "cell"]).where(F.col("place") < F.col("batches") * CELL_ROWS).withColumn(
        "use", F.explode(F.sequence(F.lit(0).cast("bigint"), exposures)))
    slot = F.col("place") + F.col("use") * F.col("texts")
    turn = F.pmod(F.col("use") + F.col("epoch"), F.col("trials"))
    return uses.select(
        "outer_fold", "epoch", "reading_task", "pseudo_group", F.floor(slot / CELL_ROWS).alias("batch"),
        F.pmod(slot, F.lit(CELL_ROWS)).alias("slot"), "text_key", F.get("turns", turn.cast("int")).alias("trial_id"))


def _short(known: DataFrame, columns: list[str]) -> tuple[Column, DataFrame]:
    """A 64-bit hash of ``columns`` under which no two of the values in ``known`` meet (null is a value), and these values.

    Should two of them meet, the next salt tells them apart: counts by the hash are counts by the values.
    """
    values = cut(known.select(*columns).distinct())
    parts = [*[F.col(c).isNull() for c in columns], *[F.col(c) for c in columns]]
    for salt in itertools.count():
        hashed = F.xxhash64(F.lit(salt), *parts)
        if values.groupBy(hashed.alias("_h")).agg(F.count("*").alias("n")).where(F.col("n") > 1).isEmpty():
            return hashed, values


def plan_violations(plan: DataFrame, cells: int = 4) -> DataFrame:
    """Batches with a wrong size, a repeated text or an unbalanced cell.

    The plan moves once, to its batches, with a hash for each text that is no other's.
    """
    key = ["outer_fold", "epoch", "batch"]
    text, _ = _short(plan, ["text_key"])
    rows = plan.dropna(subset=key).select(*key, "reading_task", "pseudo_group", text.alias("_text")).repartition(*key)
    rows = rows.withColumn("_same", F.count("*").over(Window.partitionBy(*key, "_text")))
    per_cell = rows.groupBy(*key, "reading_task", "pseudo_group").agg(F.count("*").alias("n"), F.max("_same").alias("_same"))
    checks = per_cell.groupBy(*key).agg(
        F.sum("n").alias("rows"), F.min("n").alias("smallest_cell"), F.max("n").alias("largest_cell"), F.count("*").alias("cells"),
        F.max("_same").alias("most_repeated_text"))
    wrong = ((F.col("rows") != cells * CELL_ROWS) | (F.col("smallest_cell") != CELL_ROWS) | (F.col("cells") != cells)
             | (F.col("largest_cell") != CELL_ROWS) | (F.col("most_repeated_text") != 1))
    return checks.where(wrong)


def exposure_audit(plan: DataFrame, assignments: DataFrame) -> DataFrame:
    """Per (fold, epoch, cell): how evenly the fit rows and texts of ``assignments`` are used, unused ones included.

    fit_rows and fit_texts of the cell; slots it got; least and most uses of a text and their gap; the largest gap between
    rows of one text; rows and texts never used; slots given to rows that are no fit rows of the cell.

    The plan moves once, by hashes for a cell's texts and for trials that are no others'; then a trial is one row with the epochs that
    use it. Fit rows are never multiplied by the epochs: what an epoch does not use is what the cell has less what it uses.
    """
    cells = ["outer_fold", "epoch", "reading_task", "pseudo_group"]
    cell = ["outer_fold", "reading_task", "pseudo_group"]
    names = [*cell, "text_key"]
    fit = assignments.where(F.col("role") == "fit").where(F.col("outer_fold").isNotNull()).select(*names, "trial_id")
    known = cut(plan.select(*names, "trial_id").distinct().unionByName(fit.distinct()))
    text, texts = _short(known, names)
    trial, _ = _short(known, ["trial_id"])
    bare = lambda columns, side: F.when(reduce(or_, [F.col(c).isNull() for c in columns]), side).otherwise(0)
    # a row without a key is not the same as one of the other side
    used = plan.select(text.alias("_text"), trial.alias("_trial"), bare([*names, "trial_id", "epoch"], 1).alias("_side"), "epoch", F.lit(0).alias("fit"))
    own = fit.select(text.alias("_text"), trial.alias("_trial"), bare([*names, "trial_id"], 2).alias("_side"),
                     F.lit(None).cast(plan.schema["epoch"].dataType).alias("epoch"), F.lit(1).alias("fit"))
    row = ["_text", "_trial", "_side"]
    met = used.unionByName(own).repartition("_text", "_trial").groupBy(*row, "epoch").agg(
        F.count_if(F.col("fit") == 0).alias("uses"), F.max("fit").alias("fit"))
    trials = cut(met.groupBy(*row).agg(F.max("fit").alias("fit"), F.collect_list(
        F.when(F.col("uses") > 0, F.struct("epoch", "uses"))).alias("_uses")).drop("_trial", "_side"))
    have = trials.groupBy("_text").agg(F.sum("fit").alias("rows"))
    texts = texts.select(text.alias("_text"), *cell).join(have.hint("merge"), "_text")
    turns = trials.where(F.size("_uses") > 0).join(texts.hint("merge"), "_text").select("_text", *cell, "rows", "fit", F.inline("_uses"))
    mine = F.when(F.col("fit") == 1, F.col("uses"))
    per_text = turns.groupBy("_text", *cells, "rows").agg(
        F.sum("uses").alias("uses"), F.count(mine).alias("used"), F.coalesce(F.max(mine), F.lit(0)).alias("most"), F.min(mine).alias("least"),
        F.sum(F.when(F.col("fit") == 0, F.col("uses")).otherwise(0)).alias("foreign"))
    inside = F.when(F.col("rows") > 0, F.col("uses"))
    row_gap = F.col("most") - F.when(F.col("used") < F.col("rows"), 0).otherwise(F.col("least"))
    per_cell = cut(per_text.groupBy(*cells).agg(
        F.sum("uses").alias("slots"), F.min(inside).alias("least"), F.max(inside).alias("most"), F.count(inside).alias("texts"),
        F.max(F.when(F.col("rows") > 0, row_gap)).alias("row_gap"), F.sum("used").alias("used"), F.sum("foreign").alias("foreign")))
    whole = texts.where(F.col("rows") > 0).groupBy(*cell).agg(F.sum("rows").alias("fit_rows"), F.count("*").alias("fit_texts"))
    whole = whole.join(per_cell.select("outer_fold", "epoch").distinct(), "outer_fold")
    met = whole.unionByName(per_cell, allowMissingColumns=True).groupBy(*cells).agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("fit_rows", "fit_texts", "slots", "texts", "used", "foreign")],
        *[F.max(c).alias(c) for c in ("least", "most", "row_gap")])
    fits = lambda value: F.when(F.col("fit_texts") > 0, F.coalesce(value, F.lit(0)))
    low = fits(F.when(F.col("texts") == F.col("fit_texts"), F.col("least")))
    high = fits(F.col("most"))
    return met.select(
        *cells, "fit_rows", "fit_texts", "slots", low.alias("min_uses"), high.alias("max_uses"), (high - low).alias("gap"),
        fits(F.col("row_gap")).alias("row_gap"), (F.col("fit_rows") - F.col("used")).alias("unused_rows"),
        (F.col("fit_texts") - F.col("texts")).alias("unused_texts"), F.col("foreign").alias("foreign_slots"))


def hash_negatives(plan: DataFrame, allowed: int, seed: int, direction: str) -> DataFrame:
    """(batch key, anchor, candidate): the anchor itself and the next ``allowed - 1`` rows of its batch on a hash ring.

    A batch has a fixed size (64 rows): its ring is one row. The plan moves once, row by row: the rows of a batch lie scattered, so
    rings begun before they meet would only add to what moves.
    """
    key = ["outer_fold", "epoch", "batch"]
    place = draw_hash(seed, direction, F.col("epoch"), F.col("batch"), F.col("trial_id"))
    rows = plan.select(*key, "trial_id").repartition(*key)
    rings = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(place.alias("_r"), "trial_id"))).alias("_ring"))
    ring = F.col("_ring.trial_id")
    turned = rings.select(*key, F.concat(ring, ring).alias("_twice"), F.posexplode(ring).alias("_p", "anchor"))
    reach = F.least(F.lit(allowed), F.floor(F.size("_twice") / 2).cast("int"))
    return turned.select(*key, "anchor", F.explode(F.slice("_twice", F.col("_p") + 1, reach)).alias("candidate"))


def mask_degrees(plan: DataFrame, group: str) -> DataFrame:
    """(batch key, anchor, degree): the size of each row's mask in ``group_masks``, without listing its pairs."""
    key = ["outer_fold", "epoch", "batch"]
    return plan.select(*key, F.col("trial_id").alias("anchor"), F.count("*").over(Window.partitionBy(*key, group)).alias("degree"))


def group_masks(plan: DataFrame, group: str) -> DataFrame:
    """(batch key, anchor, candidate) of equal group within a batch of fixed size (64 rows)."""
    key = ["outer_fold", "epoch", "batch", group]
    return plan.select(*key, F.col("trial_id").alias("anchor")).join(
        plan.select(*key, F.col("trial_id").alias("candidate")), key)
