"""Exact top-k search by inner product, column by column with branch and bound.

Vectors are turned into whole numbers, floor(64 x). Queries are a stated set (ids divisible by 20) and are taken in
blocks of ``BLOCK``; each block scans all candidates. A task keeps the k best of each query so far. It lays a
chunk of candidates out by dimension and adds up the products block of dimensions by block; what a candidate can still
gain is at most the product of the norms of the remaining parts (Cauchy-Schwarz), so candidates that cannot reach
any query's k-th score are compacted away. What is left at the end is exact. Spark merges the k of every task.

* Vectors that are null or hold null or non-finite components take no part, as query or candidate; neither do rows
  without vec_id. Vectors of another length than the query's are no candidates for it.
* A query never meets rows of its own vec_id. Repeated rows are candidates each; a query row that is repeated exactly is
  asked once. Equal scores go by the smaller vec_id. With fewer than k candidates all are returned; empty tables give
  empty results. Other columns are not read.
* Scores are exact while they fit a long; beyond that they stop at its limits.
* The driver holds one block of queries at a time, whose size is bounded; results are k rows a query and task.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from trialloom.session import cut, shared_dir

K = 20
SCALE = 64.0
BLOCK = 4096
DIMENSIONS = 16
GROUP = 256
CHUNK = 4096
_EXACT = float(1 << 52)
_LONG = (1 << 63) - 1


def usable(ids: pa.Array, vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole-number vectors by row) of the rows that take part, one pair for each vector length."""
    if pa.types.is_fixed_size_list(vectors.type):
        vectors = vectors.cast(pa.list_(vectors.type.value_type))
    keep = pc.and_(pc.is_valid(ids), pc.is_valid(vectors))
    ids, vectors = ids.filter(keep), vectors.filter(keep)
    if not len(ids):
        return []
    lengths = pc.list_value_length(vectors).to_numpy()
    flat = vectors.flatten()
    values = np.floor(SCALE * pc.fill_null(flat.cast(pa.float64()), math.nan).to_numpy())
    numbers = ids.to_numpy()
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out = []
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        block = values[(bounds[rows][:, None] + np.arange(length)[None, :]).astype(np.int64)]
        good = np.isfinite(block).all(axis=1)
        if good.any():
            out.append((numbers[rows[good]], block[good]))
    return out


def _tail_norms(rows: np.ndarray) -> np.ndarray:
    """Row i, column b: the norm of what row i has from block of dimensions b on."""
    blocks = range(0, max(rows.shape[1], 1), DIMENSIONS)
    squares = np.array([np.square(rows[:, b:b + DIMENSIONS]).sum(axis=1) for b in blocks]).T
    return np.sqrt(np.concatenate([np.cumsum(squares[:, ::-1], axis=1)[:, ::-1], np.zeros((len(rows), 1))], axis=1))


class Best:
    """The k best candidates of each query of one length so far."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.query_ids, self.queries, self.k = query_ids, queries, k
        self.tails = _tail_norms(queries)
        self.ids = [np.zeros(0, np.int64) for _ in query_ids]
        self.scores = [np.zeros(0, np.int64) for _ in query_ids]
        self.floor = np.full(len(query_ids), -np.inf)

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        tails = _tail_norms(rows)
        order = np.argsort(-tails[:, 0], kind="stable")  # long vectors first: high floors early
        for at in range(0, len(order), CHUNK):
            part = order[at:at + CHUNK]
            self._chunk(ids[part], np.ascontiguousarray(rows[part].T), tails[part].T)

    def _chunk(self, ids: np.ndarray, columns: np.ndarray, tails: np.ndarray) -> None:
        huge = self.tails[:, 0].max(initial=0) * tails[0].max(initial=0) >= _EXACT
        for at in range(0, len(self.query_ids), GROUP):
            group = slice(at, at + GROUP)
            floor = self.floor[group][:, None]
            alive = np.arange(len(ids))
            sums = np.zeros((len(self.query_ids[group]), len(ids)))
            for b, lo in enumerate(range(0, len(columns), DIMENSIONS)):
                sums += self.queries[group, lo:lo + DIMENSIONS] @ columns[lo:lo + DIMENSIONS, alive]
                reach = sums + self.tails[group, b + 1][:, None] * tails[b + 1, alive][None, :]
                reaching = (reach + 1e-9 * np.abs(reach) + 1 >= floor).any(axis=0)
                if huge:
                    continue
                if reaching.mean() < 0.75:
                    alive, sums = alive[reaching], sums[:, reaching]
            self._merge(at, ids, columns, alive, sums, huge)

    def _merge(self, at: int, ids: np.ndarray, columns: np.ndarray, alive: np.ndarray, sums: np.ndarray, huge: bool) -> None:
        for i in range(len(sums)):
            q = at + i
            if huge:
                whole = [int(x) for x in self.queries[q]]
                exact = [sum(a * int(b) for a, b in zip(whole, columns[:, c])) for c in alive]
                scores = np.array([max(-_LONG - 1, min(_LONG, x)) for x in exact], np.int64)
                found = np.arange(len(alive))
            else:
                found = np.flatnonzero(sums[i] >= self.floor[q])
                scores = sums[i, found].astype(np.int64)
            names = ids[alive[found]]
            other = names != self.query_ids[q]
            if not other.any():
                continue
            names = np.concatenate([self.ids[q], names[other]])
            scores = np.concatenate([self.scores[q], scores[other]])
            if len(scores) > 4 * self.k:  # the k-th score first, then only what reaches it is ordered
                least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                names, scores = names[scores >= least], scores[scores >= least]
            best = np.lexsort((names, ~scores))[:self.k]  # ~ turns the order round without overflow
            self.ids[q], self.scores[q] = names[best], scores[best]
            if len(best) == self.k and not huge:
                self.floor[q] = float(scores[best[-1]])


def _scan(candidates: DataFrame, block: Broadcast, k: int) -> DataFrame:
    """(q, query_id, vec_id, score): the k best of each task for the queries (q, query_id, vector) of one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length: dict[int, list] = {}
        for q, query_id, vector in block.value:
            by_length.setdefault(len(vector), []).append((q, query_id, vector))
        best = {n: Best(np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found]).reshape(len(found), n), k)
                for n, found in by_length.items()}
        for batch in batches:
            for ids, rows in usable(batch.column("vec_id"), batch.column("vector")):
                if rows.shape[1] in best:
                    best[rows.shape[1]].add(ids, rows)
        for n, found in by_length.items():
            counts = [len(x) for x in best[n].ids]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.array([x[0] for x in found], np.int64), counts)),
                pa.array(np.repeat(best[n].query_ids, counts)),
                pa.array(np.concatenate(best[n].ids)), pa.array(np.concatenate(best[n].scores))],
                ["q", "query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "q long, query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows that ``is_query`` selects against all rows of (vec_id, vector).

    Blocks of queries run one after the other, and each appends its rows to one table in the shared folder: however many queries
    there are, a plan knows one block, the driver and the executors hold one block, and the result is one scan.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "vector")
    queries = cut(vectors.where(is_query & F.col("vector").isNotNull()).dropDuplicates(["vec_id", "vector"]))
    blocks = max(1, math.ceil(1.1 * queries.count() / block))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    path, schema = f"{shared_dir(spark)}/trialloom-{uuid.uuid4().hex}", "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for number in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow()
        asked = []
        for ids, matrix in usable(rows.column("vec_id").combine_chunks(), rows.column("vector").combine_chunks()) if rows.num_rows else []:
            for query_id, vector in zip(ids.tolist(), matrix):
                asked.append((len(asked), query_id, vector))
        if not asked:
            continue
        shared = spark.sparkContext.broadcast(asked)  # BLOCK queries or about as many
        found = _scan(vectors, shared, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(schema).parquet(path)
