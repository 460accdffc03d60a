"""Conversation structure: damage, faults, and the cheapest repair that gives turns their order back.

A repaired conversation's roles read, by their initials, ``(s?(ua)+)?``: an automaton of four states (nothing yet, after the
system turn, after a user turn, after an assistant turn). Keeping a row costs 0, giving it the role that fits 2, deleting it
3 (blank rows and duplicates must go), an inserted empty turn 2, a truncated row that stays 1 more. Of the cheapest edits
those are taken whose initials (D, I, K, R) come first in ASCII.

The repair is a dynamic program over (row, state), kept only at checkpoints:

1. Rows lose their text: one byte tells a row's role and fault. Rows of all conversations are put in order by range, so that a long
   conversation lies over many tasks, and cut into chunks of at most ``CHUNK`` bytes. A chunk's effect on the backward costs is
   a 4 x 4 table of least sums.
2. From the last chunk to the first the tables give the backward cost vector at every chunk's end, a checkpoint; nothing
   else of a conversation is held.
3. Chunks are repaired side by side. The backward costs inside are stored at every square-root-th row, recomputed block by block
   while walking forward; a walk is made for each state that the chunk may begin in.
4. One ordered pass over a conversation's texts takes, chunk by chunk, the walk of the state it is in, and digests what stays.
   SHA-256 needs all bytes in order, so this pass is a stream through one task; it holds one chunk and no texts.

* Nulls: conv_id and turn are one space in the damage key, role and text are one space as values (so such a text is blank, such
  a role fits nowhere). Null turns come first. Rows of a null conv_id are one conversation, returned with a null id.
* Rows of one turn stand in the order of role, then of a hash of the text; equal rows are adjacent and the later ones duplicates.
* Empty texts are blank. Long texts are read whole. Empty tables give empty results. Other columns are not read.
* Every conv_id of the input is returned, also when all its rows are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trialloom.llm.graph import join_counted
from trialloom.session import cut

START, SYSTEM, USER, ASSISTANT = range(4)
FITS = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: the user or assistant turn that may come next
NEXT = {state: AFTER[fit[-1]] for state, fit in FITS.items()}
ROLE = {USER: "user", ASSISTANT: "assistant"}
RETYPE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: what still has to be inserted at the end of a conversation, by state
ENDING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
END_COSTS = tuple(INSERT * len(ENDING[s]) for s in range(4))

FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
_INITIALS = "sua?"
CHUNK = 1 << 14
_FAR = 1 << 40
_SPACE = " \t\n\x0b\f\r"


def code(initial: str, fault: int) -> int:
    return (_INITIALS.index(initial) if initial in AFTER else len(AFTER)) * 4 + fault


@lru_cache(None)
def _steps(symbol: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(initial, cost, next state) of the edits that use up a row, in ASCII order."""
    initial, fault = _INITIALS[symbol >> 2], symbol & 3
    out = [("D", DELETE, state)]
    if fault in (FINE, TRUNCATED):
        more = CUT_OFF if fault == TRUNCATED else 0
        if initial in FITS[state]:
            out.append(("K", more, AFTER[initial]))
        out.append(("R", RETYPE + more, NEXT[state]))
    return tuple(out)


@lru_cache(1 << 16)
def before(symbol: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Backward costs in front of a row from those behind it, inserts in front of the row included."""
    own = [min(cost + costs[to] for _, cost, to in _steps(symbol, s)) for s in range(4)]
    for _ in range(3):  # an insert leads to a state of the same row
        own = [min(own[s], INSERT + own[NEXT[s]]) for s in range(4)]
    return tuple(_FAR if cost >= _FAR // 2 else cost for cost in own)


def backward(symbols: bytes, costs: tuple[int, ...]) -> tuple[int, ...]:
    """Backward costs in front of a run of rows. Only differences decide, so the rows work on costs less their least."""
    total = 0
    for symbol in reversed(symbols):
        costs = before(symbol, costs)
        least = min(costs)
        if least:
            total += least
            costs = tuple(c - least for c in costs)
    return tuple(c + total for c in costs)


def table(symbols: bytes) -> list[int]:
    """The run's effect on any backward costs: 16 least sums, by state in front and state behind."""
    columns = [backward(symbols, tuple(0 if s == to else _FAR for s in range(4))) for to in range(4)]
    return [min(columns[to][s], _FAR) for s in range(4) for to in range(4)]


def through(sums: list[int], costs: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(sums[4 * s + to] + costs[to] for to in range(4)) for s in range(4))


@lru_cache(1 << 18)
def _forward(symbol: int, state: int, costs: tuple[int, ...], behind: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least tight edits of a row from a state: its initials, inserts first, and the state behind."""
    out = ""
    while True:
        found = {"I": INSERT + costs[NEXT[state]], **{e: cost + behind[to] for e, cost, to in _steps(symbol, state)}}
        edit = min(e for e, cost in found.items() if cost == costs[state])
        out += edit
        if edit != "I":
            return out, next(to for e, _, to in _steps(symbol, state) if e == edit)
        state = NEXT[state]


def walks(symbols: bytes, end: tuple[int, ...]) -> list[tuple[str, int]]:
    """(edits, state behind) of a run for each state in front of it, given the backward costs behind it.

    The costs are stored at every square-root-th row on the way back; a block's others are recomputed on the way forward.
    """
    size = max(1, math.isqrt(len(symbols)))
    least = min(end)
    stored, costs = {}, tuple(c - least for c in end)
    for lo in reversed(range(0, len(symbols), size)):
        stored[lo] = costs  # behind the block that begins at lo
        costs = _level(backward(symbols[lo:lo + size], costs))
    states, edits = list(range(4)), [[] for _ in range(4)]
    for lo in range(0, len(symbols), size):
        block = symbols[lo:lo + size]
        after = [stored[lo]]
        for symbol in reversed(block):
            after.append(_lowered(symbol, after[-1]))
        after.reverse()  # after[i + 1]: behind row i
        for symbol, behind in zip(block, after[1:]):
            costs = before(symbol, behind)
            for k in range(4):
                done, states[k] = _forward(symbol, states[k], costs, behind)
                edits[k].append(done)
    return [("".join(e), s) for e, s in zip(edits, states)]


def _level(costs: tuple[int, ...]) -> tuple[int, ...]:
    least = min(costs)
    return tuple(c - least for c in costs)


@lru_cache(1 << 16)
def _lowered(symbol: int, costs: tuple[int, ...]) -> tuple[int, ...]:
    return _level(before(symbol, costs))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the rows dropped, emptied, cut, repeated and retyped by the hash of their place."""
    def or_space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(or_space("role")).alias("role"), text.alias("text"),
        F.explode(F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0)))).alias("copy")).drop("copy")


_ORDER = ["turn", "role", "h1", "h2"]


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("conversation"), "text")})


def marked(rows: DataFrame) -> DataFrame:
    """One row per distinct (conv_id, turn, role, text), without the text: ``times`` it stands there, its first fault, and
    ``later``: whether the same role and text stand at an earlier turn."""
    last = F.substring(F.rtrim("text", F.lit(_SPACE)), -1, 1)
    plain = _hashed(rows).select("conv_id", *_ORDER, F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(
        TRUNCATED).cast("int").alias("fault"))
    said = F.struct(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("conv_id").isNull(), "role", "h1", "h2")
    keyed = cut(plain.groupBy("conv_id", *_ORDER, "fault").agg(F.count("*").alias("times")).withColumn(
        "said", F.when(F.col("fault") != BLANK, said)))
    firsts = keyed.where("said IS NOT NULL").groupBy("said").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns"))
    return join_counted(keyed, cut(firsts.where("turns > 1")), "said", "turns").select(
        "conv_id", *_ORDER, "fault", "times",
        (F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))).alias("later"))


def chunks(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, h1, h2, nth, symbols, sums): the rows' symbols in order, cut into chunks of bounded size, with
    the place of the first row. ``nth`` orders chunks that begin with copies of one row."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    fields = ["conv_id", *_ORDER]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begin, nth, done = bytearray(), None, 0, []
        schema = None

        def close() -> None:
            nonlocal nth
            data = bytes(held)
            done.append((*begin, nth, data, table(data)))
            held.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * (len(fields) + 3)
            done.clear()
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, schema.field(f).type) for c, f in zip(columns, fields)), pa.array(columns[-3], pa.int64()),
                 pa.array(columns[-2], pa.binary()), pa.array(columns[-1], pa.list_(pa.int64()))], [*fields, "nth", "symbols", "sums"])

        for batch in batches:
            schema = batch.schema
            for *place, fault, times, later in zip(*(batch.column(c).to_pylist() for c in (*fields, "fault", "times", "later"))):
                if begin is not None and place[0] != begin[0]:
                    if held:
                        close()
                    begin = None
                initial = place[2][:1]
                left = times
                while left:
                    if begin is None or not held:
                        nth = nth + 1 if begin == place else 0
                        begin = place
                    if left == times:
                        held.append(code(initial, DUPLICATE if later else fault))
                        left -= 1
                    more = min(left, CHUNK - len(held))
                    held += bytes([code(initial, BLANK if fault == BLANK else DUPLICATE)]) * more
                    left -= more
                    if len(held) >= CHUNK:
                        close()
            if len(done) > 1024:
                yield out()
        if held:
            close()
        if schema is not None:
            yield out()

    # by range over the whole order: a conversation of any length lies over as many tasks as its share of the rows
    ordered = rows.repartitionByRange(parts, *fields).sortWithinPartitions(*fields)
    return ordered.mapInArrow(run, ", ".join([*(f"{f} {kinds[f]}" for f in fields), "nth long, symbols binary, sums array<long>"]))


def checkpoints(cut_up: DataFrame) -> DataFrame:
    """``cut_up`` with ``costs``, the backward cost vector behind each chunk, instead of the tables of sums."""
    parts = int(cut_up.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {f.name: f.dataType.simpleString() for f in cut_up.schema}
    fields = ["conv_id", *_ORDER, "nth", "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, costs = object(), END_COSTS
        for batch in batches:
            found = []
            for conv, sums in zip(batch.column("conv_id").to_pylist(), batch.column("sums").to_pylist()):
                if conv != now:
                    now, costs = conv, END_COSTS
                found.append(costs)
                costs = _level(through(sums, costs))
            yield pa.RecordBatch.from_arrays([*(batch.column(f) for f in fields), pa.array(found, pa.list_(pa.int64()))], [*fields, "costs"])

    backwards = [F.col(c).desc() for c in ("conv_id", *_ORDER, "nth")]
    return cut_up.repartition(parts, "conv_id").sortWithinPartitions(*backwards).mapInArrow(
        run, ", ".join([*(f"{f} {kinds[f]}" for f in fields), "costs array<long>"]))


def repaired_chunks(checked: DataFrame) -> DataFrame:
    """``checked`` with ``edits`` and ``ends``: the walk of each state in front of a chunk, and the state behind it."""
    parts = int(checked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = {f.name: f.dataType.simpleString() for f in checked.schema}
    fields = ["conv_id", *_ORDER, "nth", "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [walks(s, tuple(c)) for s, c in zip(batch.column("symbols").to_pylist(), batch.column("costs").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f) for f in fields), pa.array([[e for e, _ in w] for w in found], pa.list_(pa.string())),
                 pa.array([[s for _, s in w] for w in found], pa.list_(pa.int32()))], [*fields, "edits", "ends"])

    # chunks of one conversation part again here: they no longer depend on each other
    return checked.repartition(parts, "conv_id", *_ORDER, "nth").mapInArrow(
        run, ", ".join([*(f"{f} {kinds[f]}" for f in fields), "edits array<string>, ends array<int>"]))


class _Conversation:
    """What one ordered pass over a conversation keeps."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.last = conv_id, START, None
        self.blank = self.duplicate = self.illegal = self.cost = self.turns = 0
        self.least = self.most = None
        self.audit: list[str] = []
        self.rows: Iterator[tuple] = iter(())
        self.ahead: list[Iterator[tuple]] = []
        self.text, self.lines = hashlib.sha256(), 0
        self.truncated = 0

    def chunk(self, symbols: bytes, edits: list[str], ends: list[int]) -> None:
        done, begin = edits[self.state], self.state
        self.audit.append(done)
        self.cost += DELETE * done.count("D") + INSERT * done.count("I") + RETYPE * done.count("R")
        self.ahead.append(self._rows(symbols, done, begin))
        self.state = ends[begin]

    @staticmethod
    def _rows(symbols: bytes, done: str, state: int) -> Iterator[tuple[int, str, list[str], str | None]]:
        """(symbol, edit, roles inserted in front, new role) of each row."""
        at = 0
        for symbol in symbols:
            put = []
            while done[at] == "I":
                state = NEXT[state]
                put.append(ROLE[state])
                at += 1
            edit, at = done[at], at + 1
            if edit == "R":
                state = NEXT[state]
            elif edit == "K":
                state = AFTER[_INITIALS[symbol >> 2]]
            yield symbol, edit, put, ROLE[state] if edit == "R" else None

    def add(self, turn: int | None, role: str, text: str | None) -> None:
        while (found := next(self.rows, None)) is None:
            self.rows = self.ahead.pop(0)
        symbol, edit, put, new = found
        fault, initial = symbol & 3, role[:1]
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED
        self.cost += CUT_OFF if fault == TRUNCATED and edit != "D" else 0
        if self.last is not None and self.last[1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.most
            self.most = turn
        self.last = (turn, initial)
        for name in put:
            self._say(name, "")
        if edit != "D":
            self._say(new or role, text)

    def _say(self, role: str, text: str) -> None:
        if self.lines:
            self.text.update(b"\n")
        self.text.update(role.encode() + b":")
        self.text.update(text.encode())
        self.lines += 1

    def result(self) -> tuple:
        if self.last is not None:
            ending = ENDING[self.state]
            self.audit.append(ending)
            self.cost += INSERT * len(ending)
            for _ in ending:
                self.state = NEXT[self.state]
                self._say(ROLE[self.state], "")
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
                "".join(self.audit), self.text.hexdigest())


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conv_id, after damage."""
    return repair_rows(damaged(conversations), conversations.select("conv_id").distinct())


def repair_rows(rows: DataFrame, every: DataFrame) -> DataFrame:
    """As ``repair``, for (conv_id, turn, role, text) without nulls in role and text as they are; ``every`` lists the conv_ids."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = rows.schema["turn"].dataType.simpleString()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done = repaired_chunks(checkpoints(cut(chunks(marked(rows)))))
    none = {"role": F.lit(None).cast("string"), "h1": F.lit(None).cast("long"), "h2": F.lit(None).cast("long"),
            "turn": F.lit(None).cast(turn), "nth": F.lit(None).cast("long"), "symbols": F.lit(None).cast("binary"),
            "edits": F.lit(None).cast("array<string>"), "ends": F.lit(None).cast("array<int>"), "text": F.lit(None).cast("string")}

    def shaped(df: DataFrame, what: int) -> DataFrame:
        return df.select("conv_id", *[df[c] if c in df.columns else v.alias(c) for c, v in none.items()], F.lit(what).alias("what"))

    # a chunk stands in front of its rows: all three kinds of rows share one order
    texts = _hashed(rows).withColumn("text", F.when(F.rtrim("text", F.lit(_SPACE)) != "", F.col("text")))
    stream = shaped(every, 0).unionByName(shaped(done, 1)).unionByName(shaped(texts, 2))
    ordered = stream.repartition(parts, "conv_id").sortWithinPartitions(
        "conv_id", (F.col("what") > 0), *_ORDER, "what", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        done: list[tuple] = []
        for batch in batches:
            names = ("conv_id", "what", "turn", "role", "text")
            heavy = {c: batch.column(c) for c in ("symbols", "edits", "ends")}
            for i, (conv, what, at, role, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in names))):
                if what == 0:
                    if now is not None:
                        done.append(now.result())
                    now = _Conversation(conv)
                elif what == 1:
                    now.chunk(*(heavy[c][i].as_py() for c in ("symbols", "edits", "ends")))
                else:
                    now.add(at, role, text)
            if len(done) > 1 << 14:
                yield _results(done)
                done = []
        if now is not None:
            done.append(now.result())
        yield _results(done)

    return ordered.mapInArrow(run, f"conv_id {kind}, " + "".join(f"{c} long, " for c in COUNTS) + "audit string, repaired_sha256 string")


def _results(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done)) if done else [[]] * 9
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])
