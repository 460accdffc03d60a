"""Scores of (signal, candidate) pairs as blocked matrix products: vectors travel once per block, never with the pairs.

Pairs of targets that lie next to each other (same context, near length, near place on the ring that chose the candidates) share
most of their candidates. Targets are numbered in that order and cut into blocks of ``BLOCK`` targets; a block gets each vector that
its pairs name once, as an array of the input's own width, and its pairs, which hold ids only. The block's task
multiplies the rows of some signals with the columns of their candidates and picks the products that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialloom.functions.keys import HASH_SHIFT, ring_hash
from trialloom.operators.ranking import prefix_sum
from trialloom.session import cut

#: targets of a block, and signals of one product
BLOCK = 1024
STRIP = 256


def in_blocks(pool: DataFrame, context: list[str], target: list[str], near: list[Column] | None = None) -> DataFrame:
    """``pool`` with ``_block``: targets (the columns ``target``) in the order of ``near`` (a whole number and a 60-bit
    hash, say length and ring place) within their context, ``BLOCK`` to a block."""
    length, ring = near or [F.lit(0), ring_hash(*[F.col(c) for c in target])]
    marked = pool.withColumns({"_near": length.cast("bigint"), "_ring": ring})
    keys = [*context, *target]
    targets = marked.groupBy(*keys).agg(F.min("_near").alias("_near"), F.min("_ring").alias("_ring"))
    bucket = F.col("_near") * 256 + F.shiftright("_ring", HASH_SHIFT)
    placed = prefix_sum(targets, context, bucket, ["_near", "_ring", *target], F.lit(1), "_place")
    return pool.join(placed.select(*keys, F.floor(F.col("_place") / BLOCK).cast("int").alias("_block")), keys)


def pair_scores(pool: DataFrame, signals: DataFrame, candidates: DataFrame, context: list[str], target: list[str],
                near: list[Column] | None, out: str, kernel: Callable) -> DataFrame:
    """``pool`` (signal_id, candidate_id, any others) with ``out``, the kernel's score of each pair.

    signals: signal_id and ``payload``; candidates: candidate_id and ``payload``, one row per id. Pairs without one of the
    payloads are left out, as by an inner join. ``kernel(left, right, rows, columns)`` gets the payload columns of a block and the
    pairs' places in them.
    """
    block = [*context, "_block"]
    own = [f"_block_{i}" for i in range(len(block))]  # the same columns under names of their own: both sides stem from one table
    pairs = cut(in_blocks(pool, context, target, near))
    sides = [pairs.select(*block, F.col(i).alias("_id")).distinct().join(table.withColumnRenamed(i, "_id"), "_id").select(
        *[F.col(c).alias(n) for c, n in zip(block, own)], F.lit(side).alias("_side"), "_id", "payload") for side, (i, table) in enumerate(
            (("signal_id", signals), ("candidate_id", candidates)))]
    vectors = sides[0].unionByName(sides[1])
    wanted = pool.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema)

    def run(given: pa.Table, asked: pa.Table) -> pa.Table:
        side = given.column("_side").to_numpy()
        places, payloads = [], []
        for number, name in ((0, "signal_id"), (1, "candidate_id")):
            mine = given.filter(pa.array(side == number)).combine_chunks()
            where = {k: i for i, k in enumerate(mine.column("_id").to_pylist())}
            places.append(np.array([where.get(k, -1) for k in asked.column(name).to_pylist()], np.int64))
            payloads.append(mine.column("payload"))
        known = (places[0] >= 0) & (places[1] >= 0)
        asked = asked.filter(pa.array(known)).select(wanted)
        rows, columns = (p[known] for p in places)
        scores = kernel(*payloads, rows, columns) if len(rows) else np.zeros(0)
        return asked.append_column(out, pa.array(scores, pa.float64(), from_pandas=True))

    return vectors.groupBy(*own).cogroup(pairs.groupBy(*block)).applyInArrow(run, f"{fields}, `{out}` double")


def _matrix(payload: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as a matrix of doubles, rows normalised (norms floored)."""
    flat = payload.combine_chunks() if isinstance(payload, pa.ChunkedArray) else payload
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)
    return values / np.maximum(np.sqrt((values * values).sum(axis=1)), 1e-12)[:, None]


def strips(rows: np.ndarray):
    """Places of the pairs of ``STRIP`` signals at a time."""
    order = np.argsort(rows, kind="stable")
    bounds = np.searchsorted(rows[order], np.arange(0, rows.max() + STRIP + 1, STRIP))
    for lo, hi in zip(bounds, bounds[1:]):
        if hi > lo:
            yield order[lo:hi]


def cosine_kernel(left: pa.ChunkedArray, right: pa.ChunkedArray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Cosine of each pair: strips of signals times the candidates they name."""
    signals, candidates = _matrix(left), _matrix(right)
    out = np.empty(len(rows))
    for pairs in strips(rows):
        own, row = np.unique(rows[pairs], return_inverse=True)
        named, column = np.unique(columns[pairs], return_inverse=True)
        out[pairs] = (signals[own] @ candidates[named].T)[row, column]
    return out


def _token_rows(payload: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(unit tokens of all rows as one matrix, n + 1 bounds) of lists of vectors of one width."""
    lists = payload.combine_chunks() if isinstance(payload, pa.ChunkedArray) else payload
    counts = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
    tokens = lists.flatten()
    return (_matrix(tokens) if len(tokens) else np.zeros((0, 1))), np.concatenate([[0], np.cumsum(counts)])


def maxsim_kernel(left: pa.ChunkedArray, right: pa.ChunkedArray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Late interaction of each pair: mean over signal tokens of the best cosine with a candidate token.

    0 without signal tokens, null without candidate tokens. One product per signal with all its candidates' tokens.
    """
    signals, begins = _token_rows(left)
    candidates, bounds = _token_rows(right)
    out = np.full(len(rows), np.nan)
    order = np.argsort(rows, kind="stable")
    cuts = np.flatnonzero(np.diff(rows[order])) + 1
    for pairs in np.split(order, cuts):
        own = signals[begins[rows[pairs[0]]]:begins[rows[pairs[0]] + 1]]
        if not len(own):
            out[pairs] = 0.0
            continue
        lows, highs = bounds[columns[pairs]], bounds[columns[pairs] + 1]
        some = np.flatnonzero(highs > lows)
        if len(some):
            sizes = (highs - lows)[some]
            starts = np.cumsum(sizes) - sizes
            place = np.arange(sizes.sum()) + np.repeat(lows[some] - starts, sizes)
            best = np.maximum.reduceat(own @ candidates[place].T, starts, axis=1)
            out[pairs[some]] = best.mean(axis=0)
    return out
