"""What five document filters remove in every order they may run in, with exact duplicates found in radix text tries.

Four conditions read one document alone. The fifth, a text identical to that of a smaller doc_id, is table-wide:

1. Prefix weights. Bytes are added up for the prefixes of 4, 8, 16, ... bytes; only inside prefixes that are too heavy for one
   task are longer ones looked at. Heavy prefixes are few (their number is bounded by levels x total / limit).
2. A row's key is its shortest prefix that is not heavy. Keys are dealt to ranges along the prefix tree, by the weights found.
3. Full texts are inserted into compressed tries, with the smallest id at each terminal: first in every map task, which
   pre-aggregates copies in bounded memory, then in the task of the range, one trie per key.
4. A traversal gives the smallest id of each text. A row whose (doc_id, text) is not among them is a duplicate; that join is on
   doc_id, so a text that a third of all rows share is no hot key.

The five outcomes become a mask, masks are counted per part, and all 120 orders are read off the counts: every task before
that sees each text once.

* Null text: empty. Null lang: part "". Words are case-sensitive; the empty text has none and fails A only (and E as a copy).
* Null doc_id: never a duplicate and never a smaller id; such a row still counts. Rows with one doc_id and one text do not
  make each other duplicates; with different texts each is compared on its own.
* Repeated labels of a doc_id: one that says 1 is enough. No labels: neither good nor toxic. Other columns are not read.
* An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from trialloom.llm.words import slices

LETTERS = "ABCDE"
BIT = {letter: 1 << i for i, letter in enumerate(LETTERS)}
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 3, b"#$%&*|"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: most text bytes of one trie, in a map task and for one key
TRIE_BYTES = 32 << 20
ROW_BYTES = 64
ROUND = 5
_ROOT = 0


class Trie:
    """A compressed trie of byte strings; a terminal holds the smallest id inserted there."""

    __slots__ = ("edges", "least")

    def __init__(self, least: int | None = None):
        self.edges: dict[int, tuple[bytes, Trie]] = {}
        self.least = least

    def insert(self, text: bytes, doc_id: int) -> int:
        """Returns how many bytes the trie has grown by."""
        node, at, size = self, 0, len(text)
        while at < size:
            edge = node.edges.get(text[at])
            if edge is None:
                node.edges[text[at]] = (text[at:], Trie(doc_id))
                return size - at
            label, child = edge
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = _shared(label, text, at)
            middle = Trie()
            middle.edges[label[k]] = (label[k:], child)
            node.edges[text[at]] = (label[:k], middle)
            node, at = middle, at + k
        if node.least is None or doc_id < node.least:
            node.least = doc_id
        return 0

    def terminals(self) -> Iterator[tuple[bytes, int]]:
        """(text, smallest id) of everything inserted, in byte order."""
        waiting: list[tuple[int, bytes, Trie]] = [(0, b"", self)]
        path: list[bytes] = []
        while waiting:
            depth, label, node = waiting.pop()
            del path[depth:]
            path.append(label)
            if node.least is not None:
                yield b"".join(path), node.least
            for first in sorted(node.edges, reverse=True):
                waiting.append((depth + 1, *node.edges[first]))


def _shared(label: bytes, text: bytes, at: int) -> int:
    """How many bytes ``label`` and ``text`` from ``at`` on have in common: at least one, not all of the label."""
    low, high = 1, len(label) - 1
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[:middle], at):
            low = middle
        else:
            high = middle - 1
    return low


class PrefixTree:
    """Heavy prefixes and where the texts below them go: ``place`` gives a text's (key, position from 0 to 1)."""

    def __init__(self, total: int):
        self.total = max(total, 1)
        self.heavy: dict[int, tuple[int, int]] = {}  # prefix hash: its weight, the hash of the next shorter level
        self.deepest = 0
        self.spans: dict[int, tuple[float, float]] = {_ROOT: (0.0, 1.0)}

    def add(self, found: list[tuple[int, int, int]], deepest: int) -> None:
        self.heavy |= {key: (weight, parent) for key, weight, parent in found}
        self.deepest = deepest
        below: dict[int, list[int]] = {}
        for key, (_, parent) in self.heavy.items():
            below.setdefault(parent, []).append(key)
        rest = {_ROOT: self.total, **{key: weight for key, (weight, _) in self.heavy.items()}}
        for key, (weight, parent) in self.heavy.items():
            rest[parent] -= weight
        self.spans, begin, waiting = {}, 0, [_ROOT]
        while waiting:  # depth first: the part of a prefix that no heavier child has, then the children
            key = waiting.pop()
            own = max(rest[key], 0)
            self.spans[key] = (begin / self.total, own / self.total)
            begin += own
            waiting.extend(sorted(below.get(key, []), reverse=True))

    def levels(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(length, hash, hash one level shorter) of the prefixes of 4, 8, 16, ... bytes."""
        state, done, length, shorter = xxhash.xxh64(), 0, 4, _ROOT
        while length <= len(text):
            state.update(text[done:length])
            key = state.intdigest() >> 1
            yield length, key, shorter
            done, length, shorter = length, 2 * length, key

    def place(self, text: bytes) -> tuple[int, float]:
        under = _ROOT
        for _, key, _ in self.levels(text):
            if key not in self.heavy:
                break
            under = key
        else:  # the whole text stands inside a heavy prefix, or is shorter than any
            key = xxhash.xxh64_intdigest(text, 1) >> 1
        begin, own = self.spans[under]
        return key, begin + own * (key / (1 << 63))


def _prefixes(docs: DataFrame, tree: PrefixTree, limit: int) -> list[tuple[int, int, int]]:
    """(hash, weight, hash one level shorter) of prefixes over ``limit`` in the next ``ROUND`` levels."""
    least, most = max(tree.deepest, 2) * 2, max(tree.deepest, 2) << ROUND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sums: dict[tuple[int, int], int] = {}
            for text in part.column("text").to_pylist():
                text = (text or "").encode()
                for length, key, shorter in tree.levels(text[:most]):
                    if length >= least:
                        sums[key, shorter] = sums.get((key, shorter), 0) + len(text) + ROW_BYTES
                    elif key not in tree.heavy:
                        break
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.int64()), pa.array([s for _, s in keys], pa.int64()),
                 pa.array(list(sums.values()), pa.int64())], ["key", "shorter", "weight"])

    weights = docs.select("text").mapInArrow(run, "key long, shorter long, weight long")
    heavy = weights.groupBy("key", "shorter").agg(F.sum("weight").alias("weight")).where(F.col("weight") > limit)
    return [(r.key, r.weight, r.shorter) for r in heavy.collect()]


def prefix_tree(docs: DataFrame, limit: int | None = None) -> PrefixTree:
    """The prefixes of ``docs`` that hold more than ``limit`` bytes (a quarter of an even share, at most ``TRIE_BYTES``)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    limit = limit or min(max(total // (4 * parts), 1 << 16), TRIE_BYTES)
    tree = PrefixTree(total)
    while True:
        found = _prefixes(docs, tree, limit)
        deepest = max(tree.deepest, 2) << ROUND
        tree.add(found, deepest)
        if not found:
            return tree


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def first_ids(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, digest): the smallest doc_id of every distinct text, with the text's digest."""
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    kind = docs.schema["doc_id"].dataType.simpleString()
    tree = prefix_tree(docs, limit)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = 8 * parts

    def emptied(trie: Trie) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for text, least in trie.terminals():
            key, at = tree.place(text)
            rows.append((min(int(at * ranges), ranges - 1), key, text, least))
            size += len(text)
            if size > 4 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    def _batch(rows: list) -> pa.RecordBatch:
        stretch, key, text, least = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(stretch, pa.int32()), pa.array(key, pa.int64()), pa.array(text, pa.binary()), pa.array(least, pa.int64())],
            ["stretch", "key", "text", "least"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held = Trie(), 0
        for part in slices(batches, "text"):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                held += trie.insert((text or "").encode(), doc_id)
            if held > TRIE_BYTES:
                yield from emptied(trie)
                trie, held = Trie(), 0
        yield from emptied(trie)

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now = Trie(), None
        ids: list[int] = []
        digests: list[bytes] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary())], ["doc_id", "digest"])
            ids.clear()
            digests.clear()
            return out

        for batch in batches:
            for key, text, least in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "least"))):
                if key != now:
                    for full, first in trie.terminals():
                        ids.append(first)
                        digests.append(_digest(full))
                    trie, now = Trie(), key
                    if len(ids) > 1 << 16:
                        yield flush()
                trie.insert(text, least)
        for full, first in trie.terminals():
            ids.append(first)
            digests.append(_digest(full))
        yield flush()

    combined = docs.mapInArrow(combine, "stretch int, key long, text binary, least long")
    dealt = combined.repartition(parts, "stretch").sortWithinPartitions("stretch", "key")
    return dealt.mapInArrow(minima, "doc_id long, digest binary").select(F.col("doc_id").cast(kind), "digest")


def own_failures(text: str | None) -> int:
    """The mask of the conditions that one text decides alone."""
    text = text or ""
    data = text.encode()
    words = data.split()  # bytes split at ASCII white space only
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    return ((BIT["A"] if len(words) < LEAST_WORDS else 0)
            | (BIT["B"] if 100 * len(set(words)) < DISTINCT_PERCENT * len(words) else 0)
            | (BIT["C"] if 100 * capitals > CAPITAL_PERCENT * len(text) else 0)
            | (BIT["D"] if len(data.translate(None, MARKS)) < len(data) else 0))


def failures(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, part, mask) for every row of ``docs``: bits 0 to 4 are the conditions A to E."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("part"), pa.array([own_failures(t) for t in texts], pa.int32()),
                 pa.array([_digest((t or "").encode()) for t in texts], pa.binary())], ["doc_id", "part", "own", "digest"])

    own = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), "text").mapInArrow(
        run, f"doc_id {kind}, part string, own int, digest binary")
    firsts = first_ids(docs, limit).withColumn("is_first", F.lit(True))
    copied = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return own.join(firsts.hint("merge"), ["doc_id", "digest"], "left").select(
        "doc_id", "part", F.col("own").bitwiseOR(F.when(copied, BIT["E"]).otherwise(0)).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per part, order of the five filters and step; see the module's text for the conditions."""
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    judged = failures(docs, limit).join(marks.hint("merge"), "doc_id", "left")
    cells = judged.groupBy("part", "mask").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(LETTERS)])
    steps = cells.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    letter, earlier = F.expr("substring(filter_order, step, 1)"), F.expr("substring(filter_order, 1, step - 1)")
    bits = {k: F.when(F.contains(earlier, F.lit(k)), v).otherwise(0) for k, v in BIT.items()}
    own = sum((F.when(letter == k, v).otherwise(0) for k, v in BIT.items()), F.lit(0))
    steps = steps.select("*", letter.alias("letter"), own.alias("own"), sum(bits.values(), F.lit(0)).alias("before"))
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(condition, measure: str = "n"):
        return F.sum(F.when(condition, F.col(measure)).otherwise(0))

    table = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"), total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"))
    shares = table.groupBy("part", "letter").agg(F.sum("removed").alias("shapley"))
    return table.join(shares, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
