"""Near-duplicate groups with SetSketch registers.

A document's set holds its distinct shingles of ``k`` words. A register is the floor of 1 - log_b of the least of
exponentially distributed values, one per shingle: exponentially spaced, truncated minima. Registers of a union are
the maxima of the parts' registers, so sketches merge, and two sets agree in a register about as often as they are
similar. Bands of registers give candidates; from the registers that are larger, smaller and equal and the two set
sizes the similarity is estimated by likelihood; what may reach the threshold is confirmed on the full sets.

1. Equal sets become one class, by a digest of the set: copies are never compared, however many they are.
2. The classes of a band's bucket meet with their registers alone. A bucket is dealt into blocks of bounded size and pairs of
   blocks go to separate tasks, which tell the likely links with the bucket's first class and the members that have another likely
   partner; most meet by chance and have none. Only the sets of what is likely are read from the texts.
3. Links with first classes are confirmed on the full sets and give parts of components.
4. In buckets whose flagged members are in several parts, a member leaves if too many of its shingles are held by no other of
   these members to reach the threshold with a set of the bucket's sizes: it has no link there. The rest is linked with the bucket's
   most central member, the one with the least share of such shingles. What is still apart meets once more, with full sets: members outside a
   bucket's largest part with all others, those inside it not with each other. A link is given out only if it joins two
   parts. No group's pairs are ever listed, and no link is left out.
5. Components of all confirmed links; a document's component is the smallest doc_id in it.

Bands are set so that a pair at the threshold shares no bucket with a chance under ``MISS``; the likelihood test
rejects a pair at the threshold with a chance of about 1e-7. Both are per pair, and more similar pairs fare better.

* Words: A-Z lower-cased, split at ASCII white space. A text with fewer than ``k`` words is one shingle as a whole;
  null and wordless texts have an empty set, no link and themselves as component.
* Rows that repeat a text share its class, whatever their ids. A row without doc_id takes part; its component is the
  smallest id it is linked to, else null. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialloom.llm.graph import components, join_counted, with_ids
from trialloom.llm.words import VISIBLE, find_words, grams, mix, slices
from trialloom.session import cut, in_small_batches

BASE = 1.1
RATE = 20.0
MISS = 1e-6
SLACK = 14.0
SKETCH_BLOCK = 1024
BLOCK = 128
BLOCK_BYTES = 16 << 20
_ROWS = 2048
_rng = np.random.default_rng(19990101)
_FACTORS = (_rng.integers(0, 1 << 32, 4096, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_MASKS = _rng.integers(0, 1 << 32, 4096, dtype=np.uint64).astype(np.uint32)
_BAND_FACTORS = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def banding(threshold: float) -> tuple[int, int]:
    """(bands, registers in a band): bands selective enough, and so many that a pair at the threshold meets in one."""
    width = 1
    while threshold ** width > 0.45:
        width += 1
    return math.ceil(math.log(MISS) / math.log(1 - threshold ** width)), width


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    found = find_words(texts, VISIBLE)
    hashes = found.hashes()
    runs = grams(hashes, k)
    sets = []
    for lo, hi in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist()):
        if hi - lo >= k:
            sets.append(np.unique(runs[lo:hi - k + 1]))
        elif hi > lo:
            sets.append(mix(grams(hashes[lo:hi], hi - lo) + np.uint64(hi - lo)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def registers(items: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` registers of a set of 64-bit hashes."""
    folded = (items ^ (items >> np.uint64(32))).astype(np.uint32)
    most = np.zeros(m, np.uint32)
    for at in range(0, len(folded), _ROWS):
        values = folded[at:at + _ROWS, None] ^ _MASKS[:m]
        values *= _FACTORS[:m]
        np.maximum(most, values.max(axis=0), out=most)
    least = -np.log((most.astype(np.float64) + 0.5) / 4294967296.0) / RATE  # least of exponentials: most of uniforms
    return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, 255).astype(np.uint8)


def _collision(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def may_be_linked(above: np.ndarray, below: np.ndarray, equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray,
                  num: int, den: int) -> np.ndarray:
    """Whether pairs may have a similarity of num / den, by the joint likelihood of their registers.

    ``above``, ``below``, ``equal``: registers of a that are larger, smaller, the same; the sizes are exact.
    """
    ok = np.zeros(len(above), bool)
    fits = np.flatnonzero(den * np.minimum(size_a, size_b) >= num * np.maximum(size_a, size_b))
    grid = np.arange(0, 201) / 200.0
    for at in range(0, len(fits), _ROWS):
        part = fits[at:at + _ROWS]
        a = size_a[part].astype(float)
        b = size_b[part].astype(float)
        u, v = (a / (a + b))[:, None], (b / (a + b))[:, None]
        j = np.minimum(grid[None, :], np.minimum(u / v, v / u))
        more = np.clip(_collision(u - v * j), 1e-12, 1)
        less = np.clip(_collision(v - u * j), 1e-12, 1)
        same = np.clip(1 - more - less, 1e-12, 1)
        logs = above[part, None] * np.log(more) + below[part, None] * np.log(less) + equal[part, None] * np.log(same)
        reaching = np.where(grid[None, :] >= num / den - 0.0025, logs, -np.inf).max(axis=1)
        ok[part] = logs.max(axis=1) - reaching <= SLACK
    return ok


def signatures(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sketch); digest and sketch are null for an empty set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(part.column("text"), k)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.array([registers(s, m).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], ["doc_id", "n_shingles", "digest", "sketch"])

    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, sketch binary")


def _digest(items: np.ndarray) -> bytes | None:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest() if len(items) else None


def _sketch_rows(column: pa.Array, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), m)


def band_keys(classes: DataFrame, bands: int, width: int) -> DataFrame:
    """(band, number, node): one row per band, its key made of the band's number and registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _sketch_rows(batch.column("sketch"), bands * width).reshape(-1, bands, width)
            keys = np.zeros(rows.shape[:2], np.uint64)
            for j in range(width):
                keys += (rows[:, :, j].astype(np.uint64) + np.uint64(1)) * _BAND_FACTORS[j]
            keys = mix(keys + np.arange(bands, dtype=np.uint64)[None, :] * _BAND_FACTORS[63])
            yield pa.RecordBatch.from_arrays([
                pa.array(keys.astype(np.int64).ravel()), pa.array(np.tile(np.arange(bands, dtype=np.int32), batch.num_rows)),
                pa.array(np.repeat(batch.column("node").to_numpy(), bands))], ["band", "number", "node"])

    return classes.select("node", "sketch").mapInArrow(run, "band long, number int, node long")


def _shingle_table(docs: DataFrame, classes: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, items): the full sets of the classes in ``nodes``, read from the texts once more."""
    wanted = cut(classes.join(nodes.select("node").distinct(), "node").select("node", "digest", "first_id"))
    texts = with_ids(docs.select("doc_id", "text"), wanted.select("first_id").distinct(), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [s for s in shingle_sets(part.column("text"), k) if len(s)]
            yield pa.RecordBatch.from_arrays([
                pa.array([_digest(s) for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sets], pa.binary())], ["digest", "items"])

    # one row per digest first: the join then finds the sets where they are, and they move once
    sets = in_small_batches(texts).mapInArrow(run, "digest binary, items binary").dropDuplicates(["digest"])
    return sets.join(wanted.select("node", "digest").hint("merge"), "digest").select("node", "items")


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) whose full sets have den x intersection >= num x union."""
    joined = (pairs.join(sets.withColumnsRenamed({"node": "b", "items": "items_b"}), "b")
              .join(sets.withColumnsRenamed({"node": "a", "items": "items_a"}), "a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den)
                  for x, y in zip(batch.column("items_a"), batch.column("items_b"))]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return in_small_batches(joined.select("a", "b", "items_a", "items_b")).mapInArrow(run, "a long, b long")


def _dealt(rows: DataFrame, *extra: str) -> DataFrame:
    """``rows`` (band, number, node, leader, root, own, blocks, sketch), of the block ``own`` of their bucket, once for each of its first
    ``blocks`` blocks, in groups (band, p, q)."""
    dealt = (rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("band", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "own", "number", "node", "leader",
                     "root", "sketch", *extra))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_small_batches(dealt.repartition(parts, "band", "p", "q").sortWithinPartitions("band", "p", "q"))


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def _partners(group: pa.Table, bands: int, width: int, num: int, den: int, size: np.ndarray,
              open_pairs: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places behind i) of the likely pairs of a group, each in the first band where its pair meets.

    ``open_pairs(i, places)`` leaves out the places that need no look.
    """
    own, m = group.column("own").to_numpy(), bands * width
    number, crossing = group.column("number")[0].as_py(), group.column("p")[0].as_py() != group.column("q")[0].as_py()
    sketch = _sketch_rows(group.column("sketch").combine_chunks(), m)
    for i in range(len(own) - 1):
        rest = np.arange(i + 1, len(own))
        rest = open_pairs(i, rest[own[rest] != own[i]] if crossing else rest)
        if len(rest):
            shared = (sketch[rest] == sketch[i]).reshape(len(rest), bands, width).all(axis=2)
            rest = rest[shared.argmax(axis=1) == number]
        if len(rest):
            more, less = (sketch[i] > sketch[rest]).sum(axis=1), (sketch[i] < sketch[rest]).sum(axis=1)
            ok = may_be_linked(more, less, m - more - less, np.full(len(rest), size[i]), size[rest], num, den)
            if ok.any():
                yield i, rest[ok]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups (band, p, q) of sorted batches, whole."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([held.column(c).to_numpy() for c in ("band", "p", "q")])
        at = 0
        for upto in (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist():  # the last group may go on
            yield held.slice(at, upto - at)
            at = upto
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield held


def _likely(buckets: DataFrame, classes: DataFrame, bands: int, width: int, num: int, den: int) -> DataFrame:
    """What the registers do not rule out in the buckets (band, number, node, leader, blocks), their leaders included: (band, node) of
    members with a likely partner, and (a, b) of members that are likely linked with the leader a. The other columns are null."""
    members = buckets.unionByName(buckets.withColumn("node", F.col("leader")).distinct())
    candidates = members.join(classes.select("node", "n_shingles", "sketch"), "node").withColumn(
        "root", F.col("node")).withColumn("own", _block(F.col("blocks")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            node, leader, band = (group.column(c).to_numpy() for c in ("node", "leader", "band"))
            first = node == leader
            flagged = np.zeros(group.num_rows, bool)
            stars: list[int] = []

            def open_pairs(i: int, rest: np.ndarray) -> np.ndarray:  # a flagged member need not be looked at again, but for the leader
                return rest if first[i] else rest[~flagged[rest] | first[rest]] if flagged[i] else rest  # noqa: B023

            for i, rest in _partners(group, bands, width, num, den, group.column("n_shingles").to_numpy(), open_pairs):
                if first[i]:
                    stars += rest.tolist()
                else:
                    lead = first[rest]
                    stars += [i] if lead.any() else []
                    if not lead.all():
                        flagged[i] = flagged[rest[~lead]] = True
            some, stars = np.flatnonzero(flagged), np.unique(np.array(stars, int))
            if len(some) or len(stars):
                none = lambda n: pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([pa.array(band[some], pa.int64()), none(len(stars))]), pa.concat_arrays([pa.array(node[some], pa.int64()), none(len(stars))]),
                    pa.concat_arrays([none(len(some)), pa.array(leader[stars], pa.int64())]), pa.concat_arrays([none(len(some)), pa.array(node[stars], pa.int64())])],
                    ["band", "node", "a", "b"])

    return _dealt(candidates, "n_shingles").mapInArrow(run, "band long, node long, a long, b long")


def _lone(sets: DataFrame) -> DataFrame:
    """(node, lone): how many items of the sets (node, items) no other of them holds; nodes without such items are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, items in zip(batch.column("node"), batch.column("items")):
                held = np.frombuffer(items.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(np.full(len(held), node.as_py(), np.int64))], ["item", "node"])

    holders = in_small_batches(sets.select("node", "items")).mapInArrow(run, "item long, node long").groupBy("item").agg(
        F.count("*").alias("holders"), F.min("node").alias("node"))
    return holders.where("holders = 1").groupBy("node").agg(F.count("*").alias("lone"))


def _mixed(members: DataFrame) -> DataFrame:
    """The rows of ``members`` in buckets with several components."""
    several = members.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    return members.join(several.select("band"), "band")


def _linkable(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``members`` without those that cannot have a link in their bucket, with ``lone``.

    An intersection holds at most the items of a set that other members have. It must reach num / (num + den) of both sizes together,
    and the other size is at least num / den of the own one and the least of the bucket.
    """
    held = members.join(_lone(sets.join(members.select("node").distinct(), "node")), "node", "left").withColumn("lone", F.coalesce("lone", F.lit(0)))
    held = held.join(members.groupBy("band").agg(F.min("n_shingles").alias("least")), "band")
    return held.where(f"{den} * (n_shingles - lone) >= {num} * n_shingles AND {num + den} * (n_shingles - lone) >= {num} * (n_shingles + least)").drop("least")


def _with_roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _labels(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes in ``links`` (a, b): the node three steps down, each to the least neighbour. Nodes of one root
    are in one component; nodes of a component may have several roots."""
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("b")))
    steps = least
    for _ in range(2):
        steps = steps.join(least.select(F.col("a").alias("b"), F.col("b").alias("next")), "b").select("a", F.col("next").alias("b"))
    return steps.toDF("node", "root")


def _central(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members and the most central one of their bucket, where they are in different components."""
    hubs = members.groupBy("band").agg(F.min_by(F.struct("node", "root"), F.struct(F.col("lone") / F.col("n_shingles"), "node")).alias("hub"))
    return members.join(hubs, "band").where("root <> hub.root").select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def _in_blocks(members: DataFrame) -> DataFrame:
    """``members`` with their block and how many blocks they meet: the first ones hold what is outside a bucket's largest component and
    meet all, the others hold that component and meet the first ones only."""
    counted = members.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("items"))
    largest = counted.groupBy("band").agg(F.max(F.struct("n", "items", "root")).alias("main"), F.sum("n").alias("n"), F.sum("items").alias("items"))
    blocks = lambda n, items: F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(items * 8 / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")
    largest = largest.select("band", F.col("main.root").alias("main"), blocks(F.col("main.n"), F.col("main.items")).alias("inside"),
                             blocks(F.col("n") - F.col("main.n"), F.col("items") - F.col("main.items")).alias("outside"))
    main, inside, outside = F.col("root") == F.col("main"), F.col("inside"), F.col("outside")
    return members.join(largest, "band").withColumns({
        "own": F.when(main, outside + _block(inside)).otherwise(_block(outside)),
        "blocks": F.when(main, outside).otherwise(outside + inside)}).drop("main", "inside", "outside")


def _across(buckets: DataFrame, flagged: DataFrame, classes: DataFrame, sets: DataFrame, roots: DataFrame, bands: int, width: int,
            num: int, den: int) -> DataFrame:
    """Confirmed links (a, b) between components that share a bucket: enough of them to join what belongs together.

    Only members with a likely partner (``flagged``) meet again, with their full sets. A pair is passed over while a chain of links
    already joins it, so a task gives out fewer links than it has members.
    """
    members = _with_roots(flagged, roots).join(classes.select("node", "n_shingles"), "node")
    members = cut(_linkable(cut(_mixed(members)), sets, num, den))
    stars = cut(_confirmed(_central(members), sets, num, den))
    joined = roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(stars)
    apart = cut(_mixed(_with_roots(members.drop("root"), _labels(joined))))
    checked = (_in_blocks(apart).join(buckets.select("band", "number", "leader").distinct(), "band")
               .join(classes.select("node", "sketch"), "node").join(sets, "node"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches):
            node, part = group.column("node").to_numpy(), group.column("root").to_numpy().copy()  # part: the component, with the links found here
            items = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("items")]
            apart = lambda i, rest: rest[part[rest] != part[i]]  # noqa: B023, E731
            found = []
            for i, rest in _partners(group, bands, width, num, den, np.array([len(x) for x in items]), apart):
                for at in rest.tolist():
                    if part[i] != part[at] and similar(items[i], items[at], num, den):
                        part[part == part[at]] = part[i]
                        found.append((node[i], node[at]))
            if found:
                pairs = np.array(found, np.int64)
                yield _pairs(pairs[:, 0], pairs[:, 1])

    return stars.unionByName(_dealt(checked, "items").mapInArrow(confirm, "a long, b long").distinct())


def similar(left: np.ndarray, right: np.ndarray, num: int, den: int) -> bool:
    """den x intersection >= num x union of two sorted sets."""
    if not len(left) or not len(right):
        return False
    place = np.minimum(np.searchsorted(left, right), len(left) - 1)
    shared = int((left[place] == right).sum())
    return den * shared >= num * (len(left) + len(right) - shared)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: links have den x intersection >= num x union."""
    bands, width = banding(num / den)
    m = bands * width
    docs = docs.select("doc_id", "text")
    rows = cut(signatures(docs, k, m))
    classes = cut(rows.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch"),
        F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    keys = cut(band_keys(classes, bands, width))
    leaders = keys.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1").select(
        "band", "leader", F.ceil(F.col("size") / F.lit(SKETCH_BLOCK)).cast("int").alias("blocks"))
    buckets = cut(keys.join(leaders, "band").where("node <> leader"))

    likely = cut(_likely(buckets, classes, bands, width, num, den))
    flagged, stars = likely.where("a IS NULL").select("band", "node").distinct(), likely.where("a IS NOT NULL").select("a", "b").distinct()
    near = flagged.select("node").unionByName(stars.select(F.col("a").alias("node"))).unionByName(stars.select(F.col("b").alias("node")))
    sets = cut(_shingle_table(docs, classes, near, k))
    stars = cut(_confirmed(stars, sets, num, den))
    more = cut(_across(buckets, flagged, classes, sets, _labels(stars), bands, width, num, den))
    roots = components(stars.unionByName(more))

    rooted = cut(classes.select("node", "digest", "first_id", "copies").join(roots, "node", "left")
                 .withColumn("root", F.coalesce("root", "node")))
    firsts = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("classes")))
    by_class = cut(join_counted(rooted.select("digest", "copies", "root"), firsts, "root", "classes").select(
        "digest", "copies", "component_id"))
    return join_counted(rows, by_class, "digest", "copies").select(
        "doc_id", "n_shingles",
        F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose doc_id is the smallest of its group.

    Rows that repeat a kept doc_id stay together; rows without doc_id stay if one of them has no group with an id.
    """
    found = cut(near_duplicates(docs, k, num, den).groupBy("doc_id").agg(F.max("kept").alias("kept")))
    return with_ids(docs, found.where("NOT kept").select("doc_id"), "left_anti")
