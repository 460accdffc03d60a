"""SimHash near-dedup with pigeonring filtering.

A fingerprint has a bit where more than half of a text's shingle hashes have it. Fingerprints with at most ``BITS`` (3)
differing bits are linked. They are cut into a ring of 8 segments of 8 bits. By the pigeonring principle two linked fingerprints
have a segment from which on every chain of consecutive segments stays within its share of the budget: the first l segments
differ in at most floor(3 l / 8) bits, that is 0, 0, 1, 1, 1, 2, 2, 3. So there is a start with five segments that differ
in one bit at most: the first two are equal, and of the next three at least two are.

1. Equal fingerprints are one node with the smallest doc_id, pre-aggregated in the map tasks: copies are never compared.
2. A node has 8 starts x 3 segments that may differ = 24 keys of 32 equal bits. Nodes of a key meet in one task.
3. There, chains longer and longer are checked against their budgets, and only what passes meets the full Hamming check. A breadth
   first walk compares each node with those not reached yet and gives out one link per node reached: no pairs are listed.
4. A key with over ``LIMIT`` nodes is not held: its nodes go to the next level. Four quarters of the bits not yet known to be equal
   hold at most three differences, so one quarter is equal: four narrower keys a node. Levels end when no key is over the limit,
   at the latest when 2^12 values are left; no node is left out and no key is compared as a whole when it is large.
5. Components of the links; documents get theirs by fingerprint, the few that many documents share by broadcast.

* Words: A-Z lower-cased, split at ASCII white space; shingles of three words, repeats included; fewer words are one shingle as
  a whole. Null, empty and wordless texts have fingerprint zero, which is linked like any other.
* Rows that repeat a text share its node. A row without doc_id takes part; its component is the smallest id it is linked
  to, else null. Empty tables give empty results. Other columns are not read. Long texts are hashed whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from trialloom.llm.graph import components, join_counted
from trialloom.llm.words import slices
from trialloom.session import cut

SHINGLE, SEED, BITS, SEGMENTS = 3, 42, 3, 8
WIDTH = 64 // SEGMENTS
#: most bits in which the first l segments of a chain may differ, for l = 1 to 8
BUDGET = [BITS * (n + 1) // SEGMENTS for n in range(SEGMENTS)]
LIMIT = 4096
_PIECE = 1 << 15
_UPPER = bytes(range(65, 91))
_FOLD = bytes.maketrans(_UPPER, _UPPER.lower())
_FULL = (1 << 64) - 1


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint, unsigned."""
    words = (text or "").encode().translate(_FOLD).split()  # bytes split at ASCII white space only
    if not words:
        return 0
    size = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    count, total = len(words) - size + 1, np.zeros(64, np.int64)
    for at in range(0, count, _PIECE):
        upto = min(at + _PIECE, count)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(
            starts[at:upto].tolist(), ends[at + size - 1:upto + size - 1].tolist())], np.uint64)
        total += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _masks() -> list[tuple[int, int]]:
    """(start, mask of the bits that are equal) of the 24 first keys."""
    def segment(start: int, i: int) -> int:
        return ((1 << WIDTH) - 1) << (64 - WIDTH * ((start + i) % SEGMENTS + 1))

    return [(start, sum(segment(start, i) for i in range(5) if i != free)) for start in range(SEGMENTS) for free in (2, 3, 4)]


def narrower(mask: int) -> list[int]:
    """The four masks of the next level: one more quarter of the free bits is equal."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // (BITS + 1) for i in range(BITS + 2)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def levels(limit: int) -> list[list[tuple[int, int]]]:
    """(start, mask) by level; the last level's keys leave at most ``limit`` (but no under 2^12) different fingerprints."""
    out = [_masks()]
    while 64 - min(m.bit_count() for _, m in out[-1]) > max(limit.bit_length() - 1, 12):
        out.append([(start, wider) for start, mask in out[-1] for wider in narrower(mask)])
    return out


def _rotated(fps: np.ndarray, start: int) -> np.ndarray:
    """The ring turned so that segment ``start`` comes first."""
    by = np.uint64(WIDTH * start)
    return fps if not start else (fps << by) | (fps >> np.uint64(64 - WIDTH * start))


def linked(one: np.uint64, others: np.ndarray) -> np.ndarray:
    """Places in ``others`` (rotated like ``one``) whose chains stay within every budget, at last the full one."""
    places = np.arange(len(others))
    different = others ^ one
    for n in range(5, SEGMENTS + 1):
        near = np.bitwise_count(different >> np.uint64(64 - WIDTH * n)) <= BUDGET[n - 1]
        places, different = places[near], different[near]
    return places


def spanning_links(fps: np.ndarray, start: int) -> tuple[list[int], list[int]]:
    """Links that join all of a key's nodes that chains from ``start`` join: at most one for each node."""
    turned = _rotated(fps, start)
    left, right = [], []
    unseen = np.arange(len(fps))
    while len(unseen) > 1:
        waiting, unseen = [unseen[0]], unseen[1:]
        while waiting and len(unseen):
            at = waiting.pop()
            near = linked(turned[at], turned[unseen])
            if len(near):
                found = unseen[near]
                left.extend([at] * len(found))
                right.extend(found.tolist())
                waiting.extend(found.tolist())
                unseen = np.delete(unseen, near)
    return left, right


def _keys(fps: np.ndarray, which: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Keys of fingerprints under their masks: a hash, so that keys of all masks share one column."""
    mixed = ((fps & masks) + which.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64)


def links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): enough links between the distinct fingerprints ``fp`` of ``nodes`` to join all that are linked."""
    plan = levels(limit)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "which int, key long, fp long"

    def spread(level: int, fps: np.ndarray, of: np.ndarray | None) -> pa.RecordBatch:
        """The nodes under the keys of a level: all of them, or those below the ``of``-th key of the level before."""
        masks = np.array([m for _, m in plan[level]], np.uint64)
        many = len(masks) if of is None else BITS + 1
        which = np.tile(np.arange(many), len(fps)) + (0 if of is None else np.repeat(of * many, many))
        again = np.repeat(fps, many)
        return pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int32()), pa.array(_keys(again, which, masks[which])), pa.array(again.view(np.int64))],
            ["which", "key", "fp"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                yield spread(0, batch.column("fp").slice(at, 1 << 14).to_numpy().view(np.uint64), None)

    def meet(level: int):
        last = level + 1 == len(plan)
        masks = np.array([m for _, m in plan[level]], np.uint64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint64))
            passed = None  # the key whose nodes go on to the next level
            for batch in [*_ended(batches)]:
                more = (batch.column("key").to_numpy(), batch.column("which").to_numpy(), batch.column("fp").to_numpy().view(np.uint64))
                key, which, fps = (np.concatenate([x, y]) for x, y in zip(held, more))
                bounds = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, int)
                a, b = [], []
                sizes = np.diff(bounds)
                final = not batch.num_rows
                whole = len(sizes) if final else len(sizes) - 1
                goes_on = key[bounds[:-1]] == passed if passed is not None else False
                for g in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == len(sizes) - 1) | goes_on).tolist():
                    lo, hi = int(bounds[g]), int(bounds[g + 1])
                    own = np.unique(fps[lo:hi])
                    if not last and (len(own) > limit or key[lo] == passed):
                        passed = key[lo]
                        for at in range(0, hi - lo, 1 << 14):
                            part = slice(lo + at, min(lo + at + (1 << 14), hi))
                            deeper = spread(level + 1, fps[part], which[part].astype(np.int64))
                            yield _rows(*(deeper.column(c) for c in ("which", "key", "fp")), None)
                        if g >= whole:
                            bounds[-2] = bounds[-1]  # sent on: nothing of it is held
                        continue
                    if g < whole and len(own) > 1:
                        for w in np.unique(which[lo:hi]).tolist():  # a hash may bring two masks together
                            of = np.unique(fps[lo:hi][which[lo:hi] == w])
                            for v in _same(of, masks[w]):
                                left, right = spanning_links(v, plan[level][w][0])
                                a.append(v[left])
                                b.append(v[right])
                if a:
                    one, two = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
                    yield _rows(None, None, pa.array(one), pa.array(two))
                rest = int(bounds[-2]) if len(bounds) > 1 and not final else len(key)
                held = (key[rest:], which[rest:], fps[rest:])

        return run

    met = nodes.select("fp").mapInArrow(first, schema)
    found = None
    for level in range(len(plan)):
        sorted_keys = met.repartition(parts, "key").sortWithinPartitions("key")
        out = cut(sorted_keys.mapInArrow(meet(level), "which int, key long, fp long, other long"))
        mine = out.where("other IS NOT NULL").select(F.col("fp").alias("a"), F.col("other").alias("b"))
        found = mine if found is None else found.unionByName(mine)
        met = out.where("other IS NULL").select("which", "key", "fp")
        if level + 1 == len(plan) or met.isEmpty():
            return found.distinct()


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, and an empty one that says that there are no more."""
    yield from (b for b in batches if b.num_rows)
    yield pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64())], ["key", "which", "fp"])


def _same(fps: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
    """Fingerprints of one key by their equal bits: one array, unless two values of them had one hash."""
    values = fps & mask
    return [fps[values == v] for v in np.unique(values)]


def _rows(which, key, fp: pa.Array, other) -> pa.RecordBatch:
    empty = pa.nulls(len(fp), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.nulls(len(fp), pa.int32()) if which is None else which, empty if key is None else key, fp, empty if other is None else other],
        ["which", "key", "fp", "other"])


def near_duplicates(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    rows = cut(fingerprints(docs))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    roots = components(links(nodes, limit))
    rooted = cut(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("fps")))
    by_fp = join_counted(rooted.select("fp", "n", "root"), least, "root", "fps").select("fp", "n", "component_id")
    return join_counted(rows, cut(by_fp), "fp", "n").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
