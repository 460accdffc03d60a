"""Conversation repair against an exhaustive program with whole strings; chunks, awkward rows and long conversations."""

import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from fixtures import sha
from pyspark.sql import functions as F

from trialloom.llm import conversations

SPACE = " \t\n\x0b\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    """(role initial, fault, role, text) of a conversation's rows in order."""
    seen, out = set(), []
    for _, _, role, text in rows:
        fault = ("blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else
                 "fine" if text.rstrip(SPACE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
        out.append((role[:1], fault, role, text))
    return out


def cheapest(marked):
    """(cost, audit, turns) by all edits with their whole strings; states are what stands last."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(marked) and state in ("", "a"):
            found.append((0, "", ()))
        put = follows[state][-1]
        if inserted < 3:
            cost, audit, rest = best(i, put, inserted + 1)
            found.append((cost + 2, "I" + audit, (("user" if put == "u" else "assistant", ""), *rest)))
        if i < len(marked):
            initial, fault, role, text = marked[i]
            cost, audit, rest = best(i + 1, state, 0)
            found.append((cost + 3, "D" + audit, rest))
            if fault in ("fine", "truncated"):
                more = fault == "truncated"
                if initial and initial in follows[state]:
                    cost, audit, rest = best(i + 1, initial, 0)
                    found.append((cost + more, "K" + audit, ((role, text), *rest)))
                cost, audit, rest = best(i + 1, put, 0)
                found.append((cost + 2 + more, "R" + audit, (("user" if put == "u" else "assistant", text), *rest)))
        return min(found) if found else (10**9, "", ())

    for i in range(len(marked), 0, -50):  # from the end, so that no recursion is deep
        for state in follows:
            best(i, state, 0)
    return best(0, "", 0)


def brute(rows, every, order):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = []
    for conv in every:
        mine = sorted(by[conv], key=order)
        marked = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, kept = cheapest(tuple(marked))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        n = [sum(m[1] == k for m in marked) for k in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *n, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept))))
    return sorted(out, key=str)


def hash_order(spark, rows):
    """Rows of a turn stand by role and a hash of the text: the hash is Spark's."""
    texts = spark.createDataFrame([(t,) for t in sorted({r[3] for r in rows})], "text string")
    hashes = {r.text: (r.a, r.b) for r in texts.select(
        "text", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("conversation"), "text").alias("b")).collect()}
    return lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), *hashes[r[3]])


def rows(seed=1, convs=120):
    rng = random.Random(seed)
    out = []
    lines = ["Hello.", "How are you?", "Fine!", "cut off", "", " \n", "End.  ", "é.", "é", "A " * 50 + "."]
    for conv in range(convs):
        turn = 0
        for _ in range(rng.choice([1, 2, 4, 7, 12, 25])):
            turn += rng.choice([0, 1, 1, 1, 1, 3])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "unknown", ""])
            text = rng.choice(lines) if rng.random() < 0.5 else f"Line {rng.randrange(10**6)}{rng.choice(['.', '', '?'])}"
            out.append((conv, turn, role, text))
    out += [(None, 1, "user", "no id."), (None, None, "assistant", "no turn."), (7, None, None, "no role."), (8, None, "user", None)]
    out += [(9, 2, "user", "Hello."), (9, 2, "user", "Hello.")] * 3 + [(500, None, "user", "x.")]
    return out


def frame(spark, data):
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    for name in ("copy", "said", "first", "turns", "fault", "times", "h1", "h2", "nth", "symbols", "sums", "what", "costs"):
        df = df.withColumn(name, F.lit(name))
    return df.repartition(5)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk", [conversations.CHUNK, 3])
def test_matches_an_exhaustive_program(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    data = rows()
    kept = damage(data)
    assert collected(conversations.repair(frame(spark, data))) == brute(kept, {r[0] for r in data}, hash_order(spark, kept))


def test_one_conversation_over_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", 16)
    rng = random.Random(8)
    data = [(3, t, rng.choice(["user", "assistant", "system", "user", "assistant"]), rng.choice(["a.", "b", f"{t}.", f"{t}"]))
            for t in range(300)] + [(3, 40, "user", "40.")] * 70 + [(4, 1, "user", "One.")]
    kept = damage(data)
    got = collected(conversations.repair(frame(spark, data)))
    assert got == brute(kept, {3, 4}, hash_order(spark, kept))
    assert [r for r in got if r[0] == 3][0][6] > 100


def test_everything_dropped_and_nothing_given(spark):
    gone = [(c, t, "user", "x.") for c in range(200) for t in range(2) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert gone
    got = collected(conversations.repair(frame(spark, gone)))
    assert got == sorted(((c, 0, 0, 0, 0, 0, 0, "", sha("")) for c in {r[0] for r in gone}), key=str)
    assert conversations.repair(frame(spark, [])).collect() == []


def test_tables_of_sums_give_the_costs_of_the_rows():
    rng = random.Random(4)
    for _ in range(200):
        symbols = bytes(conversations.code(rng.choice("sua?"), rng.randrange(4)) for _ in range(rng.randrange(40)))
        k = rng.randrange(len(symbols) + 1)
        whole = conversations.backward(symbols, conversations.END_COSTS)
        behind = conversations.through(conversations.table(symbols[k:]), conversations.END_COSTS)
        assert conversations.through(conversations.table(symbols[:k]), behind) == whole


def test_walks_from_every_state_agree_with_the_exhaustive_program():
    rng = random.Random(6)
    names = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}
    kinds = ["fine", "truncated", "blank", "duplicate"]
    for _ in range(300):
        marks = [(rng.choice("sua?"), rng.randrange(4)) for _ in range(rng.randrange(14))]
        symbols = bytes(conversations.code(i, f) for i, f in marks)
        edits, end = conversations.walks(symbols, conversations.END_COSTS)[conversations.START]
        want = cheapest(tuple((i if i != "?" else "t", kinds[f], names[i], "x") for i, f in marks))
        assert edits + conversations.ENDING[end] == want[1]
        assert conversations.backward(symbols, conversations.END_COSTS)[conversations.START] == want[0]
