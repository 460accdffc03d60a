"""Best-fit packing planned on a histogram of lengths.

A document's ids end with an end id; only documents longer than a sequence are cut, into pieces of its size and a last
shorter one. The plan sees just how many pieces there are of each length (``capacity`` numbers at most): best-fit
decreasing over counts. It is a list of runs "pieces of length L with ranks a to b go, k to a sequence, into
consecutive sequences from s at offset o". Pieces get a rank within their length and take their slot by joining the plan.

* Nothing is dropped or padded: every id has one place, and a sequence is filled without gaps from 0.
* Null text is empty: just the end id. Empty tables give an empty plan and no piece. Repeated rows are packed each.
* The histogram and the plan have a bound that does not depend on the data: ``capacity`` lengths and 4 x ``capacity``
  runs. They are all that the driver sees. Ranks are counted per (length, hash bucket), so a length that most pieces
  share is not ranked by one task.
* Other columns are not read, whatever their names.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trialloom.llm.words import ALNUM, VISIBLE, Words, find_words, slices
from trialloom.session import cut, in_small_batches

CAPACITY = 2048
END_ID = 0
_CACHE = 2_000_000


@dataclass(frozen=True)
class Run:
    """``count`` pieces of ``length``, from rank ``first`` on: ``each`` to a sequence, from ``sequence`` at ``offset`` on."""

    length: int
    first: int
    count: int
    each: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Best-fit decreasing, a whole count at a time.

    Open sequences are kept as blocks (first sequence, how many) by the room they have left. The tightest block that
    still takes a length takes as many of it per sequence as fit, for what is left is tighter still.
    """
    runs: list[Run] = []
    rooms: list[int] = []  # sorted; blocks[room] is not empty
    blocks: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def put(room: int, first: int, many: int) -> None:
        if not many or not room:
            return
        if room not in blocks:
            bisect.insort(rooms, room)
            blocks[room] = []
        blocks[room].append((first, many))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = blocks[room].pop()
                if not blocks[room]:
                    del blocks[room]
                    rooms.pop(at)
            else:
                room, first = capacity, opened
                each = capacity // length
                many = -(-left // each)
                opened += many
            each = room // length
            taken = min(left, many * each)
            runs.append(Run(length, rank, taken, each, first, capacity - room))
            full, rest = divmod(taken, each)
            put(room - each * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), many - full - bool(rest))
            left, rank = left - taken, rank + taken
    return runs


_codes = np.arange(256)
#: 0 blank, 1 letter (also the bytes of Latin-1 letters), 2 digit, 3 any other visible byte
_CLASS = np.select([~VISIBLE, (ALNUM & (_codes > 57)), ALNUM], [0, 1, 2], 3).astype(np.uint8)
_APART = np.uint64(0x5851F42D4C957F2D)


class Encoder:
    """Token ids of whole texts, unit by unit; units met before are looked up.

    No token spans ASCII white space. Between blanks, a chunk of ASCII and Latin-1 letters without apostrophe and "<" is
    cut further, into runs of letters, single digits and runs of other signs, which the vocabulary never joins and which
    it lower-cases; every other chunk is one unit. The ids are those of encoding the whole text. Units are told apart by
    64 hash bits. The cache starts anew when it holds ``_CACHE`` units.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        ends = [(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)]
        self.ends_unit = np.array(ends, bool)
        self._forget()

    def _forget(self) -> None:
        self.known, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _encoded(self, units: Words, chosen: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chosen units one after another, and how many each has; plain ones are encoded as one text."""
        if plain and len(chosen):
            lengths = units.end[chosen] - units.start[chosen]
            begins = np.cumsum(lengths + 1) - lengths - 1
            text = np.full(int((lengths + 1).sum()), 32, np.uint8)
            step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            text[np.repeat(begins, lengths) + step] = units.data[np.repeat(units.start[chosen], lengths) + step]
            ids = np.array(self.tokenizer.encode(text.tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.ends_unit[ids]) + 1
            if len(ends) == len(chosen) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        texts = [units.text(i).decode("utf-8", "replace") for i in chosen]
        found = [np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, np.uint32) for x in texts]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def _learn(self, hashes: np.ndarray, first: np.ndarray, units: Words, plain: np.ndarray) -> None:
        """Adds units (sorted ``hashes``, one place of each) to the known ones."""
        begins, sizes = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for kind in (True, False):
            chosen = np.flatnonzero(plain[first] == kind)
            ids, counts = self._encoded(units, first[chosen], kind)
            begins[chosen], sizes[chosen] = len(self.pool) + np.cumsum(counts) - counts, counts
            self.pool = np.concatenate([self.pool, ids])
        at = np.searchsorted(self.known, hashes)
        self.begin, self.size = np.insert(self.begin, at, begins), np.insert(self.size, at, sizes)
        self.known = np.insert(self.known, at, hashes)

    def _lookup(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at, -1)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text followed by the end id, and the n + 1 bounds between texts."""
        units, plain = find_units(texts)
        n = len(texts)
        if len(units.start):
            hashes = units.hashes()
            if not plain.all():
                hashes = np.where(plain, hashes, units.hashes(fold=False) ^ _APART)
            unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            at = self._lookup(unique)
            if (at < 0).any():
                if len(self.known) + int((at < 0).sum()) > _CACHE:
                    self._forget()
                    at[:] = -1
                self._learn(unique[at < 0], first[at < 0], units, plain)
                at = self._lookup(unique)
            begins, lengths = self.begin[at][inverse], self.size[at][inverse]
        else:
            begins = lengths = np.zeros(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(lengths)])
        per_text = upto[units.bounds[1:]] - upto[units.bounds[:-1]]
        bounds = np.concatenate([[0], np.cumsum(per_text + 1)])
        out = np.full(int(bounds[-1]), end_id, np.uint32)
        if upto[-1]:
            text_of = np.repeat(np.arange(n), np.diff(units.bounds))
            step = np.arange(int(upto[-1])) - np.repeat(upto[:-1], lengths)
            to = upto[:-1] + text_of  # one end id stands after each text before
            out[np.repeat(to, lengths) + step] = self.pool[np.repeat(begins, lengths) + step]
        return out, bounds


def find_units(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """The units of each text, and which of them are plain (of letters, one digit or signs, freely lower-cased)."""
    chunks = find_words(texts, VISIBLE)
    data = chunks.data
    odd = (data == 39) | (data == 60)
    high = np.flatnonzero(data >= 128)
    if len(high):
        lead = data[high] == 0xC3
        after, before = data[np.minimum(high + 1, len(data) - 1)], data[np.maximum(high - 1, 0)]
        odd[high] = np.where(lead, (after == 0x97) | (after == 0xB7), ((data[high] & 0xC0) != 0x80) | (before != 0xC3))
    count = np.concatenate([[0], np.cumsum(odd)])
    whole = count[chunks.end] > count[chunks.start]
    kind = _CLASS[data]
    lengths = chunks.end - chunks.start
    inside = np.flatnonzero(kind)
    kind[inside[np.repeat(whole, lengths)]] = 4
    opens = kind > 0
    opens[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    opens[chunks.start] = True
    start = np.flatnonzero(opens)
    end = np.empty_like(start)
    if len(start):
        chunk_of = np.searchsorted(chunks.start, start, side="right") - 1
        end[:-1] = np.minimum(start[1:], chunks.end[chunk_of[:-1]])
        end[-1] = chunks.end[chunk_of[-1]]
    return Words(data, chunks.text_bounds, start, end, np.searchsorted(start, chunks.text_bounds)), kind[start] != 4


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                     keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of all documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(tokenizer)
        for part in slices(batches, "text"):
            ids, bounds = encoder.encode(part.column("text"), end_id)
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i in range(part.num_rows):
                lo, hi = int(bounds[i]), int(bounds[i + 1])
                for j, at in enumerate(range(lo, hi, capacity)):
                    upto = min(hi, at + capacity)
                    row.append(i)
                    piece.append(j)
                    start.append(at - lo)
                    length.append(upto - at)
                    crc.append(zlib.crc32(ids[at:upto].astype("<u4").tobytes()))
                    if keep_ids:
                        kept.append(ids[at:upto].astype(np.int32))
            columns = [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if keep_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)])

    return in_small_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 within each length: counts per (length, bucket) give a bucket's first rank."""
    buckets = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (dealt.withColumn("inside", F.row_number().over(inside) - 1)
            .join(firsts, ["length", "bucket"])
            .withColumn("rank", F.col("first") + F.col("inside")).drop("bucket", "first", "inside"))


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to (doc_id, piece, start, length, ids_crc32, ...)."""
    spark = pieces.sparkSession
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    runs = plan(histogram, capacity)
    by_length: dict[int, list] = {}
    for r in runs:
        by_length.setdefault(r.length, []).append((r.first, r.count, r.each, r.sequence, r.offset))
    slots = spark.createDataFrame(
        [(length, [x[0] for x in found], found) for length, found in by_length.items()],
        "length long, firsts array<long>, runs array<struct<first:long,count:long,each:long,sequence:long,at:long>>")
    slots = F.broadcast(slots)  # 4 x capacity runs at most
    # the run of a rank is the last one that begins at or before it: its number by halving
    steps = max((len(x) for x in by_length.values()), default=1).bit_length()
    number = F.lit(0)
    joined = ranked(pieces).join(slots, "length").withColumn("_run", number)
    for step in reversed(range(steps)):
        probe = F.col("_run") + (1 << step)
        joined = joined.withColumn("_run", F.when(
            F.coalesce(F.get("firsts", probe) <= F.col("rank"), F.lit(False)), probe).otherwise(F.col("_run")))
    run = F.get("runs", F.col("_run"))
    inside = F.col("rank") - run["first"]
    return joined.withColumn("_inside", inside).select(
        *pieces.columns,
        (run["sequence"] + F.floor(F.col("_inside") / run["each"])).cast("long").alias("sequence_id"),
        (run["at"] + F.pmod(F.col("_inside"), run["each"]) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents (doc_id, text) with their place in the sequences."""
    return place(cut(tokenized_pieces(docs, tokenizer, capacity, end_id, keep_ids)), capacity)
