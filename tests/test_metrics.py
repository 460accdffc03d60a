"""Ranks, metrics, text metrics, inference and signals against small closed forms or plain Python."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.functions import draws, labels, text, vectors
from trialloom.operators import contracts, decisions, inference, metrics, retrieval, signals, textmetrics, tokens


def test_two_tie_rules(spark):
    df = spark.createDataFrame([("q", 0, "a", 0, .75), ("q", 1, "b", 1, .75), ("q", 2, "c", 0, .1)],
                               "query string, candidate_rank int, candidate_id string, is_positive int, score double")
    row = retrieval.with_hits(retrieval.rank_positive(df, ["query"])).first()
    assert (row["positive_rank"], row["worst_rank"], row["reciprocal_rank"], row["top1"], row["top5"]) == (2, 2, 0.5, 0, 1)
    assert row["margin"] == 0.0 and row["top_candidate_id"] == "a"


def test_chance(spark):
    assert spark.range(1).select(retrieval.chance_mrr(F.lit(24))).first()[0] == pytest.approx(0.15733159073972944, abs=1e-15)


def test_maxsim_by_hand(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [.7071, .7071]])], "q array<array<double>>, c array<array<double>>")
    ready = df.select(*[F.transform(c, lambda x: vectors.unit(x)).alias(c) for c in ("q", "c")])
    assert ready.select(vectors.maxsim(F.col("q"), F.col("c"))).first()[0] == pytest.approx(0.85355, abs=1e-5)


def bleu_py(pred, refs, k):
    p = pred.split()
    value = 0.0
    for n in range(1, k + 1):
        def grams(w):
            return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
        own, best = grams(p), Counter()
        for r in refs:
            best |= grams(r.split())
        hit, total = sum((own & best).values()), sum(own.values())
        if not hit:
            return 0.0
        value += math.log(hit / total) / k
    r = min((len(x.split()) for x in refs), key=lambda x: abs(x - len(p)))
    return (1.0 if len(p) > r else math.exp(1 - r / len(p))) * math.exp(value)


PAIRS = [("a", "the cat sat on the mat today", "the cat sat on the mat"), ("b", "", "some words here"), ("c", "x y z", "p q r s"),
         ("d", "one two three four five", "one two three four six"), ("e", "the the the the", "the cat the")]


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(PAIRS, "id string, prediction string, target string").cache()


def test_bleu(spark, pairs):
    refs = pairs.select("id", F.posexplode(F.array("target", F.lit("the mat today on"))).alias("ref", "reference"))
    for r in textmetrics.bleu(pairs, refs).collect():
        pred, target = next((p, t) for i, p, t in PAIRS if i == r["id"])
        for k in range(1, 5):
            assert r[f"bleu{k}"] == pytest.approx(bleu_py(pred, [target, "the mat today on"], k), abs=1e-12)


def test_self_bleu(spark, pairs):
    kept = [(i, p) for i, p, _ in PAIRS if p]
    for r in textmetrics.self_bleu(spark.createDataFrame(kept, "id string, prediction string")).collect():
        own = dict(kept)[r["id"]]
        assert r["bleu2"] == pytest.approx(bleu_py(own, [p for i, p in kept if i != r["id"]], 2), abs=1e-12)


def test_word_error_rate(spark, pairs):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]
    got = textmetrics.word_error_rate(pairs).first()
    assert got["edits"] == sum(edits(p.split(), t.split()) for _, p, t in PAIRS)
    assert got["words"] == sum(len(t.split()) for _, _, t in PAIRS)


def test_cider(spark, pairs):
    grams = lambda s, n: Counter(tuple(s.split()[i:i + n]) for i in range(len(s.split()) - n + 1))
    df = Counter(g for _, _, t in PAIRS for n in range(1, 5) for g in grams(t, n))
    logn = math.log(len(PAIRS))
    for r in textmetrics.cider(pairs).collect():
        p, t = next((p, t) for i, p, t in PAIRS if i == r["id"])
        total = 0.0
        for n in range(1, 5):
            vp, vt = ({g: c * (logn - math.log(max(1, df[g]))) for g, c in grams(x, n).items()} for x in (p, t))
            size = math.sqrt(sum(v * v for v in vp.values())) * math.sqrt(sum(v * v for v in vt.values()))
            total += sum(min(vp[g], vt.get(g, 0.0)) * vt.get(g, 0.0) for g in vp) / size if size else 0.0
        gap = max(len(p.split()) - 1, 0) - max(len(t.split()) - 1, 0)
        assert r["cider"] == pytest.approx(10 * total / 4 * math.exp(-gap * gap / 72), abs=1e-9)


def test_rouge_and_recall(spark, pairs):
    r = {x["id"]: x for x in textmetrics.rouge1(pairs).collect()}
    assert r["a"]["recall"] == 1.0 and r["a"]["precision"] == pytest.approx(6 / 7) and r["b"]["fmeasure"] == 0.0
    assert {x["id"]: x["recall"] for x in textmetrics.content_recall(pairs).collect()}["a"] == 1.0


def test_frechet(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(200, 4)), rng.normal(1.0, 2.0, size=(150, 4))
    df = spark.createDataFrame([(0, x.tolist()) for x in a] + [(1, x.tolist()) for x in b], "side int, v array<double>")
    got = metrics.frechet_distance(df, "v", "side", 4).first()[0]
    s1, s2 = np.cov(a, rowvar=False) + np.eye(4) * 1e-6, np.cov(b, rowvar=False) + np.eye(4) * 1e-6
    want = np.sum((a.mean(0) - b.mean(0)) ** 2) + np.trace(s1 + s2) - 2 * np.sqrt(np.linalg.eigvals(s1 @ s2).real).sum()
    assert got == pytest.approx(want, abs=1e-8)
    same = df.where("side = 0").unionByName(df.where("side = 0").withColumn("side", F.lit(1)))
    assert metrics.frechet_distance(same, "v", "side", 4).first()[0] == pytest.approx(0, abs=1e-6)


def test_constant_predictions_give_null_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0)], "y double, yhat double")
    row = metrics.regression_metrics(df).first()
    assert row["spearman_r"] is None and row["mae"] == 0.5


def effects(spark):
    rng = np.random.default_rng(3)
    rows = [("c", "NR" if t % 2 else "TSR", f"S{s}", f"T{t}", 0.03 + 0.01 * float(rng.standard_normal()))
            for s in range(8) for t in range(12) for _ in range(2)]
    return spark.createDataFrame(rows, "contrast string, reading_task string, subject_id string, text_key string, effect double")


def test_bootstrap_is_reproducible_and_brackets_the_point(spark):
    df = effects(spark).cache()
    runs = [inference.clustered_delta(df.repartition(n), 60, 5, {"q05": 0.05, "q95": 0.95}).orderBy("cluster").collect() for n in (1, 5)]
    for a, b in zip(*runs):
        assert a["cluster"] == b["cluster"] and a["q05"] == pytest.approx(b["q05"], abs=1e-12)
        assert 0 < a["q05"] < a["point"] < a["q95"] and a["replicates"] == 60
    width = {r["cluster"]: r["q95"] - r["q05"] for r in runs[0]}
    assert width["two_way_subject_by_text"] > 0


def test_holm(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "family string, i int, p double")
    got = [r["holm_adjusted_p"] for r in inference.holm(df, ["family"], "p", ["i"]).orderBy("i").collect()]
    assert got == pytest.approx([0.04, 0.09, 0.09, 0.5])


def test_a_failed_gate_blocks_the_decision(spark):
    gates = spark.createDataFrame([("a", True), ("b", False)], "gate string, passed boolean")
    row = decisions.decide(gates, "yes", "no").first()
    assert (row["decision"], row["failed_gates"]) == ("no", "b")
    none = decisions.gate("empty", gates.where("false"), F.col("passed")).first()
    assert none["passed"] is False


def test_incumbents_keep_the_earliest_best(spark):
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate([.1, .3, .3, .2, .5, .5])], "run string, epoch int, m double")
    for block in (2, 4096):
        out = contracts.incumbents(df, ["run"], "epoch", "m", block).orderBy("epoch").collect()
        assert [r["is_best"] for r in out] == [True, True, False, False, True, False]
        assert [r["epoch"] for r in out if r["selected"]] == [4]


def test_contracts_name_their_violations(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    with pytest.raises(contracts.ContractError, match="two values"):
        contracts.assert_empty(contracts.drifting_attributes(df, ["k"], ["v"]), "two values")
    contracts.assert_empty(contracts.duplicate_keys(df, ["k", "v"]), "fine")
    problems = {(r["column"], r["problem"]) for r in contracts.check_columns(df, ["k", "w"], exact=True).collect()}
    assert problems == {("w", "missing"), ("v", "unexpected")}


def test_resampling_keeps_a_tone(spark):
    t = np.arange(200) / 500
    wave = [[float(math.sin(2 * math.pi * 5 * x)), 1.0] for x in t]
    df = spark.createDataFrame([(1, wave)], "k long, signal array<array<double>>")
    out = np.array(signals.resample(df, ["k"]).first()["signal"])
    assert out.shape == (51, 2)
    assert np.allclose(out[:, 1], 1.0) and np.allclose(out[:, 0], np.sin(2 * math.pi * 5 * np.arange(51) * (200 / 51) / 500), atol=0.05)


def test_pad_mask_and_normalise(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [0.0, 1.0, 3.0, 0.0])], "s array<array<double>>, x array<double>")
    row = df.select(signals.pad(F.col("s"), 3, 3).alias("p"), signals.valid_mask(F.size("s"), 3).alias("m"),
                    signals.normalise_masked(F.col("x")).alias("z")).first()
    assert row["p"] == [[1, 2, 0], [3, 4, 0], [0, 0, 0]] and row["m"] == [1, 1, 0]
    assert row["z"] == pytest.approx([0, -1, 1, 0], abs=1e-5)


def test_control_signals_depend_on_the_seed_only(spark):
    df = spark.createDataFrame([(1, 7, [1, 1, 0], [(2.0, 0.5), (0.0, 1.0)])], "k long, seed long, mask array<int>, stats array<struct<mean: double, std: double>>")
    a, b = (signals.control_signal(df.repartition(n), "k", "gaussian").first()["signal"] for n in (1, 3))
    assert a == b and a[2] == [0.0, 0.0] and a[0][0] != 0
    assert signals.control_signal(df, "k", "zero").first()["signal"] == [[0.0, 0.0]] * 3


def test_collapsed_and_rich_tokens(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=64)
    flat = [(i, [(base + 0.001 * rng.normal(size=64)).tolist() for _ in range(32)]) for i in range(6)]
    rich = [(i, rng.normal(size=(32, 64)).tolist()) for i in range(6)]
    schema = "k int, tokens array<array<double>>"
    assert tokens.collapse_report(spark.createDataFrame(flat, schema), "k").first()["verdict"] == "COLLAPSED"
    assert tokens.collapse_report(spark.createDataFrame(rich, schema), "k").first()["verdict"] == "RICH"


def test_labels_and_text(spark):
    raw = ["awarding", "Job Title", "WIFE", "political-affiliation", " nan ", "painter"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(labels.canonical_label(F.col("x"))).collect()]
    assert got == ["AWARD", "JOB_TITLE", "WIFE", "POLITICAL_AFFILIATION", None, None]
    one = spark.createDataFrame([("\t A  b\nC ",)], "x string")
    assert one.select(text.fold_case(F.col("x")), text.word_count(F.col("x"))).first() == ("a b c", 3)
    with pytest.raises(Exception, match="unknown label"):
        df.select(labels.class_index(F.col("x"), ["WIFE"], unknown="raise")).collect()


def test_a_rare_task_never_shortens_a_series(spark, monkeypatch):
    rows = [("c", "NR", f"s{i % 12}", f"x{i % 30}", float(i % 5)) for i in range(120)] + [("c", "TSR", "s3", "x3", 1.0)]
    df = spark.createDataFrame(rows, "contrast string, reading_task string, subject_id string, text_key string, effect double")
    for clusters in (["subject_id"], ["subject_id", "text_key"]):
        assert inference.bootstrap_macro(df, clusters, 60, 3).count() == 60
    monkeypatch.setattr(inference, "MOST_TRIES", 1)
    with pytest.raises(ValueError, match="valid replicates"):
        inference.bootstrap_macro(df, ["subject_id", "text_key"], 60, 3)


def plain_weights(spark, df, clusters, attempts, seed):
    """(cluster, attempt, name): how often it is drawn, one draw at a time."""
    out = {}
    for c in clusters:
        names = {r["idx"]: r[c] for r in inference.cluster_index(df, c).collect()}
        for a in range(attempts):
            for idx in draws.drawn(seed, c, a, len(names)).tolist():
                out[(c, a, names[idx])] = out.get((c, a, names[idx]), 0) + 1
    return out


@pytest.mark.parametrize("tile", [(1 << 16, 1 << 20), (3, 4)])
def test_tiles_agree_with_single_draws(spark, monkeypatch, tile):
    monkeypatch.setattr(inference, "TILE_CLUSTERS", tile[0])
    monkeypatch.setattr(inference, "TILE_CELLS", tile[1])
    rows = [("a" if i % 3 else "b", f"s{i % 4}", f"x{i % 7}", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "stratum string, s string, x string, v double")
    attempts = 150  # more than a block
    for clusters in (["s", "x"], ["x"]):
        got = {(r["attempt"], r["stratum"]): r["v"] for r in inference.replicate_sums(df, clusters, ["stratum"], ["v"], attempts, 5).collect()}
        weights = plain_weights(spark, df, clusters, attempts, 5)
        want = {}
        for stratum, s, x, v in rows:
            for a in range(attempts):
                w = weights.get(("s", a, s), 0) if "s" in clusters else 1
                w *= weights.get(("x", a, x), 0)
                if w:
                    want[(a, stratum)] = want.get((a, stratum), 0.0) + w * v
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_few_cells_are_resampled_by_several_tasks(spark, monkeypatch, tmp_path):
    """F32, F33: one tile's attempts are shared by tasks, and contrasts are measures of the same cells."""
    made = draws.weights

    def noted(seed, scheme, attempts, *rest):
        from pathlib import Path

        from pyspark import TaskContext

        Path(tmp_path, f"{TaskContext.get().partitionId()}-{attempts.start}-{attempts.stop}").touch()
        return made(seed, scheme, attempts, *rest)

    monkeypatch.setattr(inference, "weights", noted)
    rows = [(f"c{c}", "NR" if i % 2 else "TSR", f"s{i % 7}", float(i % 5 - c)) for c in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "contrast string, reading_task string, s string, effect double")
    got = {(r["attempt"], r["reading_task"]): r["effect"] for r in inference.replicate_sums(
        df, ["s"], ["reading_task"], ["effect"], 300, 3).collect()}
    seen = [tuple(map(int, f.name.split("-"))) for f in tmp_path.iterdir()]
    assert len({task for task, *_ in seen}) > 8
    assert sorted(a for _, lo, hi in seen for a in range(lo, hi)) == list(range(300))
    weights = plain_weights(spark, df, ["s"], 300, 3)
    for a in range(300):
        for task in ("NR", "TSR"):
            want = sum(e * weights.get(("s", a, s), 0) for _, t, s, e in rows if t == task)
            assert abs(got.get((a, task), 0.0) - want) < 1e-9
    both = inference.bootstrap_macro(df, ["s"], 40, 3).collect()
    for c in ("c0", "c1"):
        alone = inference.bootstrap_macro(df.where(F.col("contrast") == c), ["s"], 40, 3).collect()
        assert {r["replicate"]: round(r["macro"], 9) for r in both if r["contrast"] == c} == {r["replicate"]: round(r["macro"], 9) for r in alone}
    assert inference.bootstrap_macro(df.limit(0), ["s"], 40, 3).count() == 0


def test_draws_are_the_same_in_sql():
    import duckdb

    sql = draws.sql_drawn(17, "text_key", "(SELECT a AS attempt, j, 1000003::UBIGINT AS k FROM range(40) t(a), range(500) u(j))", "k")
    got = {(a, j): i for a, j, i in duckdb.sql(f"SELECT attempt, j, idx FROM {sql}").fetchall()}
    assert len(got) == 20_000
    for a in range(40):
        assert [got[a, j] for j in range(500)] == draws.drawn(17, "text_key", a, 500, 0, 1000003).tolist()
    spread = draws.weights(3, "s", range(2000), 10, 0, 10)
    assert (spread.sum(axis=0) == 10).all() and abs(spread.mean(axis=1) - 1).max() < 0.1


@pytest.mark.parametrize("partitions", [1, 4, 211])
def test_zero_replicates_are_zero_under_any_partitioning(spark, partitions):
    """Effects whose replicates cancel exactly on paper: rounding must not decide the one-sided p."""
    thirds = [1 / 3, -1 / 3, 1 / 7, -1 / 7, 0.1, -0.1]
    rows = [(f"c{c}", task, f"s{s}", f"x{c}-{task}-{s}", e) for c in range(3) for task in ("NR", "TSR") for s in range(5) for e in thirds]
    df = spark.createDataFrame(rows, "contrast string, reading_task string, subject_id string, text_key string, effect double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = inference.bootstrap_macro(df.repartition(partitions), ["subject_id"], 50, 3)
        assert {(r["macro"], r["NR"], r["TSR"]) for r in found.collect()} == {(0.0, 0.0, 0.0)}
        p = found.groupBy("contrast").agg(inference.one_sided_p("macro").alias("p")).collect()
        assert {r["p"] for r in p} == {1.0}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_whole_pools_rank_and_bind_as_their_rows_do(spark):
    rows = [(q, s, f"c{i}", i, int(i == q % 4), int(i == 3), [0.5, 0.5, 0.25, -1.0][(i * (q + s)) % 4]) for q in range(9) for s in (1, 2) for i in range(4 if q < 8 else 1)]
    scores = spark.createDataFrame(rows, "q int, seed int, candidate_id string, candidate_rank int, is_positive int, is_donor_text int, score double")
    pools = retrieval.pool_rows(scores, ["q", "seed"], "score")
    plain, ranked = retrieval.rank_positive(scores, ["q", "seed"]), retrieval.rank_pools(pools, ["q", "seed"])
    assert plain.dtypes == ranked.dtypes and sorted(plain.collect()) == sorted(ranked.collect())
    moved = (F.col("q") == 2) & (F.col("seed") == 2)
    other = scores.withColumn("candidate_rank", F.when(moved, 3 - F.col("candidate_rank")).otherwise(F.col("candidate_rank")))
    found = [contracts.unbound_pools(s, ["q"], ["seed"]).collect() for s in (other, retrieval.pool_rows(other, ["q", "seed"], "score"))]
    assert [tuple(r) for r in found[0]] == [tuple(r) for r in found[1]] == [(2, 2, 2)]


def test_bleu_counts_grams_without_rows_of_their_own(spark):
    one = spark.createDataFrame([(1, "a b a b c"), (2, None), (3, "x")], "id int, prediction string")
    refs = spark.createDataFrame([(1, 0, "a b a"), (1, 1, "b c"), (2, 0, "y"), (4, 0, "z")], "id int, ref int, reference string")
    scored = textmetrics.bleu(one, refs)
    got = {r.id: (r.bleu1, r.bleu2) for r in scored.collect()}
    assert got == {1: (pytest.approx(4 / 5), pytest.approx(math.sqrt(4 / 5 * 3 / 4))), 2: (0.0, 0.0), 3: (0.0, 0.0)}
    assert "Generate" not in scored._jdf.queryExecution().optimizedPlan().toString()
