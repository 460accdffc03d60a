"""Pools, donors, splits and plans against brute force, on skewed fixtures."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Window, functions as F

from trialloom.operators import batches, pools, ranking, reshape, splits
from trialloom.session import cut

RING = 1 << 60


def ring(*parts):
    return int(hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def text_key(i):
    return hashlib.sha256(f"text {i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def trials():
    """One text is read by a third of the trials, one length is shared by half of the texts."""
    rows = []
    for i in range(240):
        text = 0 if i % 3 == 0 else 1 + i % 60
        length = 9 if text % 2 == 0 else 5 + text % 17
        rows.append((f"t{i:04d}", "D", "NR" if text % 4 < 3 else "TSR", f"S{i % 7}", text_key(text), length))
    return rows


COLUMNS = "trial_id string, dataset_version string, reading_task string, subject_id string, text_key string, length int"


def brute_pool(rows, size, seed):
    texts = {}
    for _, _, task, _, text, length in rows:
        texts[(task, text)] = length
    out = {}
    for trial, _, task, _, text, length in rows:
        others = [(abs(n - length), (ring(seed, c, "pool-select") - ring(seed, trial, "pool-select")) % RING, c)
                  for (k, c), n in texts.items() if k == task and c != text]
        out[trial] = {text} | {c for _, _, c in sorted(others)[: size - 1]}
    return out


def spark_pool(spark, rows, size, seed, partitions):
    df = spark.createDataFrame(rows, COLUMNS).repartition(partitions)
    catalog = df.groupBy("dataset_version", "reading_task", F.col("text_key").alias("candidate_id")).agg(F.min("length").alias("candidate_length"))
    targets = df.select(F.col("trial_id").alias("target_id"), F.col("text_key").alias("positive_id"), "dataset_version", "reading_task",
                        F.col("length").alias("target_length"))
    return pools.candidate_pools(targets, catalog, ["dataset_version", "reading_task"], size, seed).collect()


def test_pools_equal_brute_force_and_do_not_depend_on_partitions(spark, trials):
    want = brute_pool(trials, 6, 11)
    results = [spark_pool(spark, trials, 6, 11, n) for n in (1, 7)]
    assert sorted(map(str, results[0])) == sorted(map(str, results[1]))
    got, ranks, positives = defaultdict(set), defaultdict(list), Counter()
    for r in results[0]:
        got[r["target_id"]].add(r["candidate_id"])
        ranks[r["target_id"]].append(r["candidate_rank"])
        positives[r["target_id"]] += r["is_positive"]
    assert dict(got) == want
    assert all(sorted(v) == list(range(6)) for v in ranks.values())
    assert set(positives.values()) == {1}


def test_forced_donor_is_in_the_pool(spark, trials):
    df = spark.createDataFrame(trials, COLUMNS)
    donors = pools.matched_donors(df, ["dataset_version", "reading_task"], 3, "donor")
    targets = df.select(F.col("trial_id").alias("target_id"), F.col("text_key").alias("positive_id"), "reading_task",
                        F.col("length").alias("target_length")).join(
        donors.select("target_id", F.col("donor_text_key").alias("donor_candidate_id")), "target_id", "left")
    catalog = df.groupBy("reading_task", F.col("text_key").alias("candidate_id")).agg(F.min("length").alias("candidate_length"))
    out = pools.candidate_pools(targets, catalog, ["reading_task"], 6, 3, F.lit("x"))
    per = out.groupBy("target_id").agg(F.count("*").alias("n"), F.sum("is_donor_text").alias("d"), F.sum("is_positive").alias("p"),
                                       F.count_distinct("candidate_id").alias("u")).collect()
    assert len(per) == len(trials)
    assert all((r["n"], r["d"], r["p"], r["u"]) == (6, 1, 1, 6) for r in per)


@pytest.mark.parametrize("by_length", [True, False])
def test_donors_equal_brute_force(spark, trials, by_length):
    df = spark.createDataFrame(trials, COLUMNS)
    context = ["reading_task", "subject_id"] if by_length else []
    got = {r["target_id"]: r["donor_id"] for r in pools.matched_donors(df, context, 5, "rule", by_length).collect()}
    want = {}
    for trial, _, task, subject, text, length in trials:
        best = None
        for donor, _, k, s, other, n in trials:
            if other == text or (by_length and (k, s) != (task, subject)):
                continue
            scope = [f"{k}|{s}"] if by_length else []
            key = (abs(n - length) if by_length else 0, (ring(5, *scope, other, "rule", "text") - ring(5, trial, "rule")) % RING,
                   (ring(5, donor, "rule") - ring(5, trial, "rule")) % RING)
            best = min(best, (key, donor)) if best else (key, donor)
        if best:
            want[trial] = best[1]
    assert got == want


def test_sweep_places_the_positive_in_the_middle(spark):
    rows = [("t0", 10), ("t1", 11), ("t2", 9), ("t3", 15), ("t4", 30)]
    cat = spark.createDataFrame([("NR", f"{i}{t}", n) for i, (t, n) in enumerate(rows)], "reading_task string, candidate_id string, candidate_length int")
    target = spark.createDataFrame([("x", "0t0", "NR", 10)], "target_id string, positive_id string, reading_task string, target_length int")
    out = pools.pool_sweep(target, cat, ["reading_task"], [4]).orderBy("candidate_rank").collect()
    assert {r["candidate_id"] for r in out} == {"0t0", "1t1", "2t2", "3t3"}
    assert [r["is_positive"] for r in out] == [0, 0, 1, 0]


def test_positions_and_prefix_sums_of_a_hot_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id"),
                                  F.pmod(F.xxhash64("id"), F.lit(RING)).alias("r"))
    out = ranking.position_by_ring(df, ["k"], "r", ["id"], "p").collect()
    groups = defaultdict(list)
    for row in out:
        groups[row["k"]].append((row["r"], row["id"], row["p"]))
    assert len(out) == 5000
    assert all([p for *_, p in sorted(v)] == list(range(len(v))) for v in groups.values())


def test_average_ranks(spark):
    values = [3.0, 1.0, 3.0, 2.0, 3.0, -7.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["rank"] for r in ranking.average_ranks(df, [], "v", "rank").collect()}
    assert got == {-7.5: 1.0, 1.0: 2.0, 2.0: 3.0, 3.0: 5.0}


def test_derangement_that_cannot_be_fails(spark):
    rows = [(f"t{i}", "D", "NR", "S", text_key(0 if i < 4 else i), 5) for i in range(6)]
    with pytest.raises(Exception, match="more than half"):
        splits.derangement(spark.createDataFrame(rows, COLUMNS), 4).collect()


def test_draws_are_always_full(spark):
    ids = spark.range(20).withColumnRenamed("id", "key")
    drawn = splits.n_way_draws(ids, "key", 20, 50, 3).collect()
    by_draw = defaultdict(set)
    for r in drawn:
        by_draw[r["draw"]].add(r["key"])
    assert len(by_draw) == 50 and all(len(v) == 20 for v in by_draw.values()) and len(drawn) == 1000
    with pytest.raises(ValueError):
        splits.n_way_draws(ids, "key", 21, 1, 3)


def test_an_outlier_does_not_fill_one_bin(spark):
    values = spark.range(10_000).select((F.col("id") % 10).alias("k"), F.when(F.col("id") == 77, 1e12).otherwise(F.col("id").cast("double")).alias("_v"))
    for keys in ([], ["k"]):
        counts = [r["count"] for r in ranking.value_bins(values, keys, 64).groupBy(*keys, "_bin").count().collect()]
        total = 10_000 if not keys else 1_000
        assert max(counts) <= total * 0.05


def test_exposure_counts_what_is_never_used(spark):
    fit = spark.createDataFrame([(0, "fit", "NR", 0, f"x{i // 2}", f"t{i}") for i in range(6)] + [(0, "held", "NR", 0, "x9", "t9")],
                                "outer_fold int, role string, reading_task string, pseudo_group int, text_key string, trial_id string")
    plan = spark.createDataFrame([(0, 1, 0, "NR", 0, "x0", "t0"), (0, 1, 1, "NR", 0, "x0", "t0"), (0, 1, 1, "NR", 0, "x1", "t2"), (0, 1, 1, "NR", 0, "x9", "t9")],
                                 "outer_fold int, epoch int, batch int, reading_task string, pseudo_group int, text_key string, trial_id string")
    r = batches.exposure_audit(plan, fit).first()
    assert (r["fit_rows"], r["fit_texts"], r["slots"], r["min_uses"], r["max_uses"], r["gap"], r["row_gap"], r["unused_rows"], r["unused_texts"], r["foreign_slots"]) == (
        6, 3, 4, 0, 2, 2, 2, 4, 1, 1)


def test_derangement_never_keeps_a_text(spark, trials):
    rows = splits.derangement(spark.createDataFrame(trials, COLUMNS), 4).collect()
    assert len(rows) == len(trials)
    assert all(r["text_key"] != r["wrong_text_key"] for r in rows)
    assert Counter(r["wrong_text_key"] for r in rows) == Counter(r["text_key"] for r in rows)


def test_folds_are_balanced_and_keep_texts_whole(spark, trials):
    out = splits.balanced_folds(spark.createDataFrame(trials, COLUMNS), "text_key", "reading_task", 3, 1).collect()
    assert len({r["text_key"] for r in out}) == len(out)
    sizes = Counter((r["fold"], r["task_mix"]) for r in out)
    for mix in {r["task_mix"] for r in out}:
        per = [sizes[(f, mix)] for f in range(3)]
        assert max(per) - min(per) <= 1


def test_permuted_labels_keep_the_counts(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(90)], "id int, y int")
    out = splits.permuted_labels(df, "id", "y", 4, 9).collect()
    for rep in range(4):
        part = [r for r in out if r["replicate"] == rep]
        assert sorted(r["id"] for r in part) == list(range(90))
        assert Counter(r["y"] for r in part) == Counter({0: 30, 1: 30, 2: 30})


def fold_rows(spark):
    rows = [(f"{task}{g}{i:02d}r{j}", task, f"S{i % 4}", f"{task}{g}text{i:02d}", g, i % 5)
            for task in ("NR", "TSR") for g in (0, 1) for i in range(40) for j in range(2)]
    df = spark.createDataFrame(rows, "trial_id string, reading_task string, subject_id string, text_key string, pseudo_group int, text_fold int")
    return reshape.outer_assignments(df, 5)


def test_epoch_plan_is_balanced_and_audited(spark):
    roles = fold_rows(spark)
    plan = batches.epoch_plan(roles, 2, 7).cache()
    assert plan.count() > 0
    assert batches.plan_violations(plan).count() == 0
    assert all(r["gap"] <= 1 for r in batches.exposure_audit(plan, roles).collect())
    broken = plan.where("not (batch = 0 and slot = 3 and pseudo_group = 1)")
    assert batches.plan_violations(broken).count() == 10
    degrees = batches.hash_negatives(plan, 32, 1, "d").groupBy("outer_fold", "epoch", "batch", "anchor").agg(
        F.count_distinct("candidate").alias("n"), F.max((F.col("anchor") == F.col("candidate")).cast("int")).alias("own")).collect()
    assert {(r["n"], r["own"]) for r in degrees} == {(32, 1)}


def test_epoch_plans_send_nothing_that_grows_to_the_driver(spark):
    roles = fold_rows(spark)
    built = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert built(batches.epoch_plan(roles, 2, 7)).count("BroadcastExchange") == 1  # the sizes of folds x epochs x cells
    plan = spark.createDataFrame(batches.epoch_plan(roles, 2, 7).collect())
    assert "Join" not in built(batches.hash_negatives(plan, 32, 1, "d"))
    degrees = batches.mask_degrees(plan, "reading_task")
    assert "Join" not in built(degrees)
    listed = batches.group_masks(plan, "reading_task").groupBy("outer_fold", "epoch", "batch", "anchor").agg(F.count("*").alias("degree"))
    assert sorted(degrees.collect()) == sorted(listed.select(*degrees.columns).collect())


def brute_plan(rows, epochs, seed):
    """The plan as the SQL has it: fit rows (fold, task, group, text, trial); rows without a key take part and are not listed."""
    null = lambda v: (v is not None, v if v is not None else 0)
    joined = lambda *parts: "\x1f".join(str(p) for p in parts if p is not None)
    draw = lambda *parts: int(hashlib.md5(joined(*parts).encode()).hexdigest()[:15], 16)
    sha = lambda *parts: int(hashlib.sha256(joined(*parts).encode()).hexdigest()[:15], 16)
    trials = defaultdict(list)
    for fold, task, group, text, trial in rows:
        trials[fold, task, group, text].append((sha(seed, trial, "turn"), trial))
    out = []
    for epoch in range(epochs):
        owner = {}
        for fold, task, group, text in trials:
            vote = (draw(seed, epoch, text, task, group), null(task), null(group), (fold, task, group, text))
            owner[fold, text] = min(owner.get((fold, text), vote), vote)
        cells = defaultdict(list)
        for *_, key in owner.values():
            cells[key[:3]].append((sha(seed, epoch, key[3], "epoch-order"), null(key[3]), key))
        batches_of = defaultdict(int)
        for cell, texts in cells.items():
            batches_of[cell[0]] = max(batches_of[cell[0]], -(-sum(len(trials[key]) for *_, key in texts) // 16))
        for cell, texts in cells.items():
            for place, (*_, key) in enumerate(sorted(texts)):
                if None in key:
                    continue
                turns = [trial for _, trial in sorted(trials[key])]
                for use, slot in enumerate(range(place, batches_of[cell[0]] * 16, len(texts))):
                    out.append((cell[0], epoch, *cell[1:], slot // 16, slot % 16, key[3], turns[(use + epoch) % len(turns)]))
    return out


def test_epoch_plan_equals_brute_force_however_the_rings_are_cut(spark, monkeypatch):
    """One text in all cells, one with most trials, one cell with few texts, rows that repeat and rows without a key."""
    rows = []
    for fold in (0, 1):
        for i in range(150):
            rows.append((fold, "NR" if i % 3 else "TSR", i % 2, text_key(i % 61), f"t{i % 140:03d}"))
        rows += [(fold, task, group, text_key(900), f"u{task}{group}{i}") for task in ("NR", "TSR") for group in (0, 1) for i in range(3)]
        rows += [(fold, "NR", 0, text_key(901), f"v{i:03d}") for i in range(200 * fold)]
        rows += [(fold, "SR", 0, text_key(902), "w0"), (fold, "SR", 0, text_key(902), "w1")]
        rows += [(fold, "NR", None, text_key(3), "n0"), (fold, "NR", 1, None, "n1"), (fold, None, 0, text_key(903), "n2")]
    df = spark.createDataFrame(rows, "outer_fold int, reading_task string, pseudo_group int, text_key string, trial_id string")
    want = Counter(brute_plan(rows, 3, 7))
    for texts in (4, 16384):
        monkeypatch.setattr(batches, "PIECE_TEXTS", texts)
        plan = batches.epoch_plan(df.withColumn("role", F.lit("fit")).repartition(5), 3, 7)
        assert Counter(map(tuple, plan.collect())) == want


def moved(df):
    """The columns that each exchange of the plan moves."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted").split("== Initial Plan ==")[0]
    nodes = re.findall(r"\(\d+\) Exchange\n.*?Input \[\d+\]: \[([^\n]*)\]", text)
    return [{re.sub(r"#\d+L?$", "", c) for c in node.split(", ")} for node in nodes]


def test_epochs_multiply_no_keys_that_move(spark):
    found = moved(batches.epoch_plan(fold_rows(spark), 2, 7))
    assert any("epoch" in columns for columns in found)
    assert not [columns for columns in found if "epoch" in columns and columns & {"text_key", "trial_id", "reading_task"}]


def test_files_of_a_shuffle_go_with_the_write(spark):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
    shuffles = lambda: set(re.findall(r"/shuffle_(\d+)", files()))
    before = shuffles()
    kept = spark.range(1000).repartition(3, "id")
    assert len(kept.collect()) == 1000 and len(shuffles() - before) == 1
    before |= shuffles()
    written = cut(spark.range(1000).repartition(3, "id"))
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert sorted(r.id for r in written.collect()) == list(range(1000))


def test_a_written_plan_has_each_text_in_one_place(spark):
    """Its file then holds a key once, not once for each of its slots: what the audits and masks read is small."""
    plan = cut(batches.epoch_plan(fold_rows(spark).repartition(3, "trial_id"), 8, 7))
    order = Window.partitionBy("part").orderBy("at")
    lined = plan.select(F.input_file_name().alias("part"), F.monotonically_increasing_id().alias("at"), "text_key")
    begins = lined.withColumn("last", F.lag("text_key").over(order)).where("last IS NULL OR last <> text_key").count()
    assert begins == plan.select("text_key").distinct().count()
    degrees = batches.mask_degrees(plan, "reading_task")
    assert moved(degrees) == [{"outer_fold", "epoch", "batch", "reading_task", "anchor"}]
    assert {r.degree for r in degrees.collect()} == {32}


PLAN_ROWS = "outer_fold int, epoch int, batch long, reading_task string, pseudo_group int, text_key string, trial_id string"


def odd_plan():
    """A plan with batches of any size, repeated rows, rows of no fit row and missing keys."""
    pick = lambda i, salt, of: ring(i, salt) % of
    gap = lambda i, salt, value: None if ring(i, salt, "gap") % 17 == 0 else value
    return [(gap(i, "f", pick(i, "f", 2)), gap(i, "e", pick(i, "e", 3)), gap(i, "b", pick(i, "b", 3)), gap(i, "t", "NR TSR".split()[pick(i, "t", 2)]),
             gap(i, "g", pick(i, "g", 2)), gap(i, "x", f"x{pick(i, 'x', 12)}"), gap(i, "r", f"t{pick(i, 'r', 30)}")) for i in range(500)]


def test_violations_count_by_text_and_move_no_text(spark):
    rows = odd_plan() + [(5, 0, 0, task, group, f"y{i}{k if k < 2 else 0}", "t") for k, (task, group) in enumerate(
        [("NR", 0), ("NR", 1), ("TSR", 0), ("TSR", 1)]) for i in range(16)]  # a batch of the right size with texts in two cells
    want = {}
    for key in {r[:3] for r in rows if None not in r[:3]}:
        batch = [r for r in rows if r[:3] == key]
        cells, texts = Counter(r[3:5] for r in batch), Counter(r[5] for r in batch)
        want[key] = (len(batch), min(cells.values()), max(cells.values()), len(cells), max(texts.values()))
    found = batches.plan_violations(spark.createDataFrame(rows, PLAN_ROWS))
    assert {tuple(r[:3]): tuple(r[3:]) for r in found.collect()} == want
    assert want[5, 0, 0] == (64, 16, 16, 4, 3)
    assert not [columns for columns in moved(found) if "text_key" in columns]


def test_hashes_that_meet_are_told_apart(spark, monkeypatch):
    whole, salts = F.xxhash64, []

    def poor(salt, *parts):
        salts.append(salt)
        return whole(salt, *parts) if len(salts) > 2 else F.pmod(whole(salt, *parts), F.lit(7))

    values = spark.createDataFrame([(f"x{i}", None if i % 5 == 0 else i % 3) for i in range(60)] + [(None, 1), (None, None), ("x1", 1)], "a string, b int")
    monkeypatch.setattr(batches.F, "xxhash64", poor)
    hashed, known = batches._short(values, ["a", "b"])
    assert len(salts) == 3
    assert known.select(hashed.alias("h")).distinct().count() == values.distinct().count() == known.count()


def test_exposure_audit_equals_brute_force_and_multiplies_no_fit_rows(spark):
    plan = odd_plan()
    fit = [(f, task, g, f"x{ring(i, 'x') % 14}" if i % 19 else None, f"t{ring(i, 'r') % 32}", "fit" if i % 7 else "checkpoint")
           for i, (f, task, g) in enumerate((f, task, g) for f in (0, 1, 2, None) for task in ("NR", "TSR", "SR") for g in (0, 1, None) for _ in range(12))]
    own = {r[:5] for r in fit if r[5] == "fit" and r[0] is not None}
    uses = Counter((*r[:2], *r[3:]) for r in plan)
    want = {}
    cells = {(f, e, *r[1:3]) for r in own for f, e in {r[:2] for r in plan} if f == r[0]} | {(r[0], r[1], r[3], r[4]) for r in plan}
    for f, e, task, g in cells:
        rows = {r: 0 for r in own if r[:3] == (f, task, g)}
        texts, foreign = defaultdict(int), 0
        for (f2, e2, task2, g2, text, trial), n in uses.items():
            if (f2, e2, task2, g2) == (f, e, task, g):
                texts[text] += n
                if None not in (f, e, task, g, text, trial) and (f, task, g, text, trial) in rows:
                    rows[f, task, g, text, trial] += n
                else:
                    foreign += n
        per = defaultdict(list)
        for r, n in rows.items():
            per[r[3]].append(n)
        all_uses = [texts.get(text, 0) for text in per]
        low, high = (min(all_uses), max(all_uses)) if per else (None, None)
        want[f, e, task, g] = (len(rows), len(per), sum(texts.values()), low, high, high - low if per else None,
                               max(max(n) - min(n) for n in per.values()) if per else None,
                               sum(n == 0 for n in rows.values()), sum(n == 0 for n in all_uses), foreign)
    got = batches.exposure_audit(spark.createDataFrame(plan, PLAN_ROWS),
                                 spark.createDataFrame(fit, "outer_fold int, reading_task string, pseudo_group int, text_key string, trial_id string, role string"))
    assert {tuple(r[:4]): tuple(r[4:]) for r in got.collect()} == want
    assert not [columns for columns in moved(got) if "epoch" in columns and columns & {"text_key", "trial_id"}]


def test_rings_move_row_by_row(spark):
    plan = spark.createDataFrame([(0, 0, i % 2, f"t{i}") for i in range(9)], "outer_fold int, epoch int, batch long, trial_id string")
    assert moved(batches.hash_negatives(plan, 3, 1, "d")) == [{"outer_fold", "epoch", "batch", "trial_id"}]


def test_a_short_batch_is_a_ring_of_its_own(spark):
    plan = spark.createDataFrame([(0, 0, 0, f"t{i}") for i in range(5)] + [(0, 0, 1, "u")], "outer_fold int, epoch int, batch long, trial_id string")
    got = batches.hash_negatives(plan, 3, 1, "d").collect()
    assert Counter((r.batch, r.anchor) for r in got) == Counter({(0, f"t{i}"): 3 for i in range(5)} | {(1, "u"): 1})
    assert Counter(r.candidate for r in got if r.batch == 0) == Counter({f"t{i}": 3 for i in range(5)})


def test_roles_and_overlap(spark):
    roles = fold_rows(spark)
    assert roles.count() == 5 * 320
    assert reshape.role_overlap(roles, "text_key").count() == 0
    assert reshape.role_overlap(roles, "subject_id").count() > 0
    assert all(r["feasible"] for r in batches.grid_feasibility(roles, 16).collect())
    assert not all(r["feasible"] for r in batches.grid_feasibility(roles, 30).collect())
