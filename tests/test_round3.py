"""Blocked scores, hash trees, weighted draws, greedy folds, chunks by path."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.operators import blocks, contracts, retrieval, splits
from trialloom.streaming import incremental


@pytest.mark.parametrize("size", [1024, 3])
def test_blocked_scores_equal_pairwise_ones(spark, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK", size)
    rng = np.random.default_rng(3)
    signals = {f"s{i}": rng.normal(size=6).astype(np.float32) for i in range(25)} | {"zero": np.zeros(6, np.float32)}
    texts = {f"c{i}": rng.normal(size=6).astype(np.float32) for i in range(40)}
    pairs = [(s, f"c{c}", i % 3, i) for i, s in enumerate(signals) for c in rng.choice(40, 7, replace=False)]
    pairs += [("s1", "gone", 0, 1), ("gone", "c1", 0, 2), pairs[0]]
    pool = spark.createDataFrame(pairs, "signal_id string, candidate_id string, task int, length int").withColumn("payload", F.lit("kept"))
    kind = "array<float>"
    left = spark.createDataFrame([(k, v.tolist()) for k, v in signals.items()], f"signal_id string, vector {kind}")
    right = spark.createDataFrame([(k, v.tolist()) for k, v in texts.items()], f"candidate_id string, vector {kind}")
    out = retrieval.cosine_scores(pool, left, right, "score", ["task"], ["signal_id"], [F.col("length"), F.lit(0).cast("bigint")])
    assert out.columns == [*pool.columns, "score"]

    def cosine(a, b):
        a, b = a.astype(float), b.astype(float)
        return float(a @ b / max(np.linalg.norm(a), 1e-12) / max(np.linalg.norm(b), 1e-12))

    want = sorted((s, c, round(cosine(signals[s], texts[c]), 9) + 0.0) for s, c, *_ in pairs if s in signals and c in texts)
    assert sorted((r.signal_id, r.candidate_id, round(r.score, 9) + 0.0) for r in out.collect()) == want


def test_vectors_meet_pairs_without_a_vector_per_pair(spark):
    pool = spark.createDataFrame([("s", "c")], "signal_id string, candidate_id string")
    left = spark.createDataFrame([("s", [1.0])], "signal_id string, vector array<float>")
    right = spark.createDataFrame([("c", [2.0])], "candidate_id string, vector array<float>")
    plan = retrieval.cosine_scores(pool, left, right)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert len(joins) == 2 and all("_id" in line for line in joins)  # vectors join the ids of blocks only
    assert retrieval.cosine_scores(pool, left, right).first()["score"] == 1.0


def test_maxsim_in_blocks(spark):
    rng = np.random.default_rng(5)
    tokens = {k: rng.normal(size=(n, 4)) for k, n in (("a", 3), ("b", 1), ("c", 0))}
    rows = [(k, v.tolist(), [1] * len(v)) for k, v in tokens.items()]
    left = spark.createDataFrame(rows, "signal_id string, tokens array<array<double>>, mask array<int>")
    right = left.withColumnRenamed("signal_id", "candidate_id")
    pool = spark.createDataFrame([(x, y) for x in "abc" for y in "abc"], "signal_id string, candidate_id string")

    def best(q, c):
        if not len(q):
            return 0.0
        if not len(c):
            return None
        unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
        return round(float((unit(q) @ unit(c).T).max(axis=1).mean()), 9)

    got = {(r.signal_id, r.candidate_id): r.score if r.score is None else round(r.score, 9) for r in retrieval.maxsim_scores(pool, left, right).collect()}
    assert got == {(x, y): best(tokens[x], tokens[y]) for x in "abc" for y in "abc"}


def plain_tree(ids, leaf):
    times = Counter(ids)
    digests = sorted(hashlib.sha256(f"{k}\x1f{n}".encode()).hexdigest() for k, n in times.items())
    depth = sum(len(times) > leaf * 16 ** i for i in range(12))
    level = defaultdict(list)
    for d in digests:
        level[d[:depth]].append(d)
    level = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in level.items()}
    while "" not in level:
        above = defaultdict(list)
        for k in sorted(level):
            above[k[:max(len(k) - 3, 0)]].append(f"{k} {level[k]}")
        level = {k: hashlib.sha256("\n".join(v).encode()).hexdigest() for k, v in above.items()}
    return hashlib.sha256(f"{len(ids)}\x1f{level['']}".encode()).hexdigest()


@pytest.mark.parametrize("leaf", [1, 4, 4096])
def test_hash_trees_know_sets_and_not_orders(spark, leaf):
    rng = random.Random(2)
    ids = {"big": [f"id{i}" for i in range(700)], "small": ["x", "x", "y"], "one": ["z"]}

    def digests(groups, parts):
        rows = [(g, i) for g, v in groups.items() for i in rng.sample(v, len(v))]
        df = spark.createDataFrame(rows, "g string, id string").repartition(parts)
        return {r.g: r.set_digest for r in contracts.digest_of_set(df, ["g"], "id", leaf).collect()}

    first = digests(ids, 1)
    assert first == digests(ids, 7) == {g: plain_tree(v, leaf) for g, v in ids.items()}
    altered = digests({"big": [*ids["big"][:-1], "id0"], "small": ["x", "y", "y"], "one": ["z"]}, 3)
    assert altered["big"] != first["big"] and altered["small"] != first["small"] and altered["one"] == first["one"]
    whole = spark.createDataFrame([("z",)], "id string")
    assert contracts.digest_of_set(whole, [], "id", leaf).first()["set_digest"] == first["one"]


def test_draws_follow_the_given_weights(spark):
    weights = {i: w for i, w in enumerate([500.0, 0.0, 0.25, 100.5] + [1.0] * 400)}
    df = spark.createDataFrame(list(weights.items()), "id int, w double")
    drawn = splits.sample_by_weight(df, "id", F.col("w"), 40_000, 3, units=100.0).collect()
    seen = Counter(r["id"] for r in drawn)
    total = sum(weights.values())
    assert len({r["draw"] for r in drawn}) == len(drawn) == 40_000 and seen[1] == 0
    for i in (0, 2, 3):
        share = weights[i] / total
        assert abs(seen[i] / 40_000 - share) < 5 * (share / 40_000) ** 0.5
    assert abs(sum(seen[i] for i in range(4, 404)) / 40_000 - 400 / total) < 0.015
    again = splits.sample_by_weight(df.repartition(9), "id", F.col("w"), 40_000, 3, units=100.0).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))
    with pytest.raises(ValueError, match="weight"):
        splits.sample_by_weight(df.where("w = 0"), "id", F.col("w"), 10, 3)


def plain_greedy(rows, folds, seed):
    """The assignment as a loop: largest group first, to the fold where the summed squared deviations are least."""
    digest = lambda *p: hashlib.sha256("\x1f".join(map(str, p)).encode()).hexdigest()
    sizes = defaultdict(Counter)
    for group, task in rows:
        sizes[group][task] += 1
    tasks = ["NR", "TSR"]
    share = {}
    for t in tasks:
        share[t, "rows"] = max(sum(c[t] for c in sizes.values()) / folds, 1.0)
        share[t, "ids"] = max(sum(c[t] > 0 for c in sizes.values()) / folds, 1.0)
    state = [Counter() for _ in range(folds)]
    out = {}
    for group in sorted(sizes, key=lambda g: (-sum(sizes[g].values()), -sum(n > 0 for n in sizes[g].values()), digest(seed, g, "group-order"))):
        more = {(t, "rows"): sizes[group][t] for t in tasks} | {(t, "ids"): int(sizes[group][t] > 0) for t in tasks}
        options = []
        for fold in range(folds):
            cost = 0.0
            for f in range(folds):
                for t in tasks:
                    for what in ("rows", "ids"):
                        have = state[f][t, what] + (more[t, what] if f == fold else 0)
                        cost += ((have - share[t, what]) / share[t, what]) ** 2
            options.append((cost, digest(seed, group, fold, "fold-tie"), fold))
        best = min(options)[2]
        out[group] = best
        state[best].update(more)
    return out


def test_greedy_folds_equal_a_loop(spark):
    rng = random.Random(6)
    rows = [(f"g{rng.randrange(90)}", rng.choice(["NR", "TSR", "NR"])) for _ in range(600)] + [("hot", "NR")] * 150
    df = spark.createDataFrame(rows, "g string, task string").repartition(6)
    got = defaultdict(dict)
    for r in splits.greedy_folds(df, "g", "task", ["NR", "TSR"], 5, [1, 2]).collect():
        got[r.seed][r.g] = r.fold
    assert got == {s: plain_greedy(rows, 5, s) for s in (1, 2)}
    with pytest.raises(ValueError, match="empty"):
        splits.greedy_folds(df.where("g = 'hot'"), "g", "task", ["NR", "TSR"], 5, [1])


def test_equal_file_names_in_two_folders_are_two_chunks(spark, tmp_path):
    def put(folder, values):
        frame = spark.createDataFrame([(v,) for v in values], "v long").toPandas()
        (tmp_path / "in" / folder).mkdir(parents=True)
        frame.to_parquet(tmp_path / "in" / folder / "a.parquet")

    def run():
        incremental.process_new_files(spark, str(tmp_path / "in"), "v long", str(tmp_path / "out"), str(tmp_path / "state"), lambda b: b)
        return sorted((r.chunk, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put("p=1", [1, 2, 3])
    assert run() == [("p=1/a", 1), ("p=1/a", 2), ("p=1/a", 3)]
    put("p=2", [4, 5])
    want = [("p=1/a", 1), ("p=1/a", 2), ("p=1/a", 3), ("p=2/a", 4), ("p=2/a", 5)]
    assert run() == want
    assert run() == want
