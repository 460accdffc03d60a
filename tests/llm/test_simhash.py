"""SimHash groups against brute force over all pairs; keys, levels and the heavy-key join on their own."""

import random
import re

import numpy as np
import pytest
import xxhash
from fixtures import frame, texts
from pyspark.sql import functions as F

from trialloom.llm import graph, simhash


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    runs = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """fingerprint: smallest fingerprint reachable, by all pairs."""
    own = sorted(set(prints))
    values = np.array(own, np.uint64)
    seen, out = set(), {}
    for first in range(len(own)):
        if first in seen:
            continue
        waiting, group = [first], {first}
        while waiting:
            near = np.flatnonzero(np.bitwise_count(values ^ values[waiting.pop()]) <= 3).tolist()
            waiting += [x for x in near if x not in group]
            group |= set(near)
        seen |= group
        out |= {own[x]: own[first] for x in group}
    return out


def expected(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    root = plain_groups([p for _, p in prints])
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted((str(i), f"{p:016x}", str(least.get(root[p]))) for i, p in prints)


@pytest.mark.parametrize("limit", [simhash.LIMIT, 3])
def test_matches_brute_force(spark, limit):
    rows = texts(4) + [(None, "lonely words"), (None, None), (3, "one id, another text"), (3, "one id, another text")]
    got = simhash.near_duplicates(frame(spark, rows).repartition(6), limit).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected(rows)


def test_empty_table_and_unhinged_ids(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    rows = [(7, None), (2, ""), (None, "  \n"), (5, "One"), (6, "one")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expected(rows)


def clouds(seed, centres, size, flips):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        base = rng.getrandbits(64)
        for _ in range(size):
            x = base
            for _ in range(rng.randrange(flips + 1)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("limit,shape", [(4096, (300, 4, 4)), (40, (3, 900, 5)), (2, (40, 30, 8))])
def test_links_join_what_is_within_three_bits(spark, limit, shape):
    prints = clouds(9, *shape)
    nodes = spark.createDataFrame([(int(np.array(p, np.uint64).view(np.int64)),) for p in prints], "fp long").repartition(5)
    found = graph.components(simhash.links(nodes, limit)).collect()
    got = {r.node & simhash._FULL: r.root & simhash._FULL for r in found}
    want = plain_groups(prints)
    parts = lambda of: sorted(sorted(p for p in prints if of.get(p, p) == r) for r in {of.get(p, p) for p in prints})
    assert parts(got) == parts(want)


def test_every_close_pair_shares_a_key_at_every_level():
    rng = random.Random(2)
    plan = simhash.levels(simhash.LIMIT)
    assert len(plan[0]) == 24 and all(m.bit_count() == 32 for _, m in plan[0])
    assert all(64 - m.bit_count() <= 12 for _, m in plan[-1])
    for _ in range(3000):
        one = rng.getrandbits(64)
        two = one
        for b in rng.sample(range(64), rng.randrange(4)):
            two ^= 1 << b
        chains = [s for s, m in plan[0] if not (one ^ two) & m and len(simhash.linked(
            simhash._rotated(np.array([one], np.uint64), s)[0], simhash._rotated(np.array([two], np.uint64), s)))]
        assert chains  # the ring principle: some start keeps within every budget
        below = {i for i, (s, m) in enumerate(plan[0]) if not (one ^ two) & m and s in chains}
        for level in plan[1:]:
            below = {4 * i + j for i in below for j in range(4) if not (one ^ two) & level[4 * i + j][1]}
            assert below


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "_PIECE", 7)
    for text in (" ".join(f"W{i % 9}" for i in range(100)), "a b", "É é É é", None):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_heavy_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(graph, "HEAVY_KEYS", 3)
    rows = [(i, "hot" if i % 2 else f"k{i % 40}" if i % 10 else None) for i in range(400)]
    left = spark.createDataFrame(rows, "id long, key string")
    keyed = left.where("key is not null and key <> 'k4'").groupBy("key").agg(F.count("*").alias("n")).withColumn("v", F.upper("key"))
    got = {r.id: r.v for r in graph.join_counted(left, keyed, "key", "n").collect()}
    assert got == {i: None if k in (None, "k4") else k.upper() for i, k in rows}
