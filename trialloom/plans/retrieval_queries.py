"""Scores, ranks, retrieval metrics, paired effects, bootstrap, decisions."""

from pyspark.sql import functions as F

from trialloom.functions import keys, vectors
from trialloom.operators import batches, contracts, decisions, inference, joins, reshape, retrieval
from trialloom.plans.registry import query
from trialloom.plans.score_views import (
    ARMS, BASELINES, MODEL, PREDICTION, REPLICATES, SEEDS, SIGNALS, TRIAL, arm_scores, base_scores, build_arm_scores, effects, preds,
    seed_avg, sql_macro_draws,
)
from trialloom.plans.tables import POOL, SEED, VIEWS, sql_draw, sql_ring
from trialloom.plans.xfit_views import vec_donors, vec_pools


def rounded(df, *columns, digits=10, nudge=0.0):
    """Rounded columns; ``nudge`` moves values off exact half-way points, where the last bit of a sum would decide."""
    return df.withColumns({c: F.round(F.col(c) + nudge if nudge else F.col(c), digits) for c in columns})


NUDGE = 1e-13


@query("X01_unit_vectors", """
SELECT vec_id, round(v[1] / n, 10) AS first, round(v[64] / n, 10) AS last, round(n, 10) AS norm
FROM (SELECT vec_id, vector AS v, sqrt(list_sum(list_transform(vector, lambda x: x * x))) AS n FROM vec_trials)""")
def x01(t):
    unit = vectors.unit(F.col("vector"))
    return rounded(t.vec_trials.select("vec_id", vectors.norm(F.col("vector")).alias("norm"), unit.alias("u")).select(
        "vec_id", F.element_at("u", 1).alias("first"), F.element_at("u", 64).alias("last"), "norm"), "first", "last", "norm")


@query("X02_pool_cosine", "SELECT trial_id, signal_condition, candidate_id, base FROM base_scores")
def x02(t):
    return base_scores(t).select("trial_id", "signal_condition", "candidate_id", "base")


@query("J18_signal_substitution", """
SELECT trial_id, candidate_id, signal_id, base, is_donor_text FROM base_scores WHERE signal_condition = 'matched_wrong'""")
def j18(t):
    return base_scores(t).where("signal_condition = 'matched_wrong'").select(
        "trial_id", "candidate_id", "signal_id", "base", "is_donor_text")


@query("X16_mean_score_ensemble", """
SELECT arm_id, trial_id, signal_condition, candidate_id, round(avg(score), 10) AS score, count(*) AS members FROM arm_scores GROUP BY 1, 2, 3, 4""")
def x16(t):
    return rounded(retrieval.mean_scores(arm_scores(t), ["arm_id", "trial_id", "signal_condition", "candidate_id"]), "score")


@query("W01_rank_by_candidate_order", """
SELECT arm_id, training_seed, signal_condition, trial_id, positive_rank, candidate_pool_size, top_candidate_id FROM preds""")
def w01(t):
    return retrieval.rank_positive(build_arm_scores(t), PREDICTION).select(
        "arm_id", "training_seed", "signal_condition", "trial_id", "positive_rank", "candidate_pool_size", "top_candidate_id")


@query("W02_worst_rank", """
SELECT trial_id, signal_condition, CAST(count(*) FILTER (score >= ps) AS INTEGER) AS worst_rank
FROM (SELECT *, round(base, 1) AS score, max(CASE WHEN is_positive = 1 THEN round(base, 1) END) OVER (PARTITION BY trial_id, signal_condition) AS ps FROM base_scores)
GROUP BY 1, 2""")
def w02(t):
    coarse = base_scores(t).withColumn("score", F.round("base", 1))
    return retrieval.rank_positive(coarse, ["trial_id", "signal_condition"]).select("trial_id", "signal_condition", "worst_rank")


@query("P25_hits", """
SELECT arm_id, training_seed, signal_condition, trial_id, round(reciprocal_rank, 10) AS reciprocal_rank, top1, top5 FROM preds""")
def p25(t):
    return rounded(preds(t).select("arm_id", "training_seed", "signal_condition", "trial_id", "reciprocal_rank", "top1", "top5"), "reciprocal_rank")


@query("P26_margin", "SELECT arm_id, training_seed, signal_condition, trial_id, round(margin, 10) AS margin FROM preds")
def p26(t):
    return rounded(preds(t).select("arm_id", "training_seed", "signal_condition", "trial_id", "margin"), "margin")


@query("P27_chance_mrr", """
SELECT p_size, round(list_sum(list_transform(range(1, p_size + 1), lambda k: 1.0::DOUBLE / k)) / p_size, 9) AS chance
FROM (SELECT DISTINCT p_size FROM part)""")
def p27(t):
    sizes = t.raw("part").select("p_size").distinct()
    return sizes.select("p_size", F.round(retrieval.chance_mrr(F.col("p_size")), 9).alias("chance"))


_METRICS = """count(*) AS rows, round(avg(top1) + 1e-13, 10) AS top1, round(avg(top5) + 1e-13, 10) AS top5, round(avg(reciprocal_rank) + 1e-13, 10) AS mrr,
 round(avg(positive_rank) + 1e-13, 10) AS mean_positive_rank, round(avg(margin) + 1e-13, 10) AS mean_margin"""


def metric_table(t):
    out = retrieval.retrieval_metrics(preds(t), ["arm_id", "training_seed", "signal_condition", "reading_task"])
    return rounded(out, "top1", "top5", "mrr", "mean_positive_rank", "mean_margin", nudge=NUDGE)


@query("A12_retrieval_metrics", f"SELECT arm_id, training_seed, signal_condition, reading_task, {_METRICS} FROM preds GROUP BY 1, 2, 3, 4")
def a12(t):
    return metric_table(t)


@query("A13_task_macro", """
SELECT arm_id, training_seed, signal_condition, round(avg(m), 10) AS macro, count(*) AS tasks
FROM (SELECT arm_id, training_seed, signal_condition, reading_task, avg(reciprocal_rank) AS m FROM preds GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def a13(t):
    return rounded(retrieval.task_macro(preds(t), ["arm_id", "training_seed", "signal_condition"], "reciprocal_rank"), "macro")


@query("A14_seed_average", """
SELECT arm_id, signal_condition, trial_id, round(avg(reciprocal_rank), 10) AS reciprocal_rank, count(*) = 2 AS complete,
       CAST(avg(reciprocal_rank) >= 1 - 1e-9 AS DOUBLE) AS top1 FROM preds GROUP BY 1, 2, 3""")
def a14(t):
    out = seed_avg(t).select("arm_id", "signal_condition", "trial_id", "reciprocal_rank", "complete")
    return rounded(out.withColumn("top1", retrieval.top1_of(F.col("reciprocal_rank"))), "reciprocal_rank")


@query("A15_paired_effects", "SELECT trial_id, contrast, round(effect, 10) AS effect FROM effects WHERE contrast LIKE 'superiority%'")
def a15(t):
    return rounded(effects(t).where("contrast like 'superiority%'").select("trial_id", "contrast", "effect"), "effect")


@query("A16_signal_gaps", "SELECT trial_id, contrast, round(effect, 10) + 0.0 AS effect FROM effects WHERE contrast LIKE 'signal_gap%'")
def a16(t):
    return rounded(effects(t).where("contrast like 'signal_gap%'").select("trial_id", "contrast", "effect"), "effect")


VIEWS["seedwise"] = f"""
SELECT o.arm_id AS reference_id, o.training_seed, m.macro - o.macro AS macro_mrr_delta, m.macro > o.macro AS direction_positive
FROM (SELECT arm_id, training_seed, avg(m) AS macro FROM (SELECT arm_id, training_seed, reading_task, avg(reciprocal_rank) AS m FROM preds
      WHERE signal_condition = 'correct' GROUP BY 1, 2, 3) GROUP BY 1, 2) o
JOIN (SELECT training_seed, avg(m) AS macro FROM (SELECT training_seed, reading_task, avg(reciprocal_rank) AS m FROM preds
      WHERE signal_condition = 'correct' AND arm_id = '{MODEL}' GROUP BY 1, 2) GROUP BY 1) m USING (training_seed)
WHERE o.arm_id <> '{MODEL}'
"""


@query("A17_seedwise_deltas", "SELECT reference_id, training_seed, round(macro_mrr_delta, 10) AS macro_mrr_delta, direction_positive FROM seedwise")
def a17(t):
    return rounded(retrieval.seedwise_deltas(preds(t), MODEL, BASELINES), "macro_mrr_delta")


@query("A34_macro_report", """
, m AS (SELECT arm_id, signal_condition, avg(m) AS macro FROM (SELECT arm_id, signal_condition, reading_task, avg(reciprocal_rank) AS m FROM preds GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT arm_id, round(max(CASE WHEN signal_condition = 'correct' THEN macro END), 10) AS correct,
       round(max(CASE WHEN signal_condition = 'matched_wrong' THEN macro END), 10) AS matched_wrong,
       round(max(CASE WHEN signal_condition = 'correct' THEN macro END) - max(CASE WHEN signal_condition = 'matched_wrong' THEN macro END), 10) AS signal_gap
FROM m GROUP BY 1""")
def a34(t):
    macro = retrieval.task_macro(preds(t), ["arm_id", "signal_condition"], "reciprocal_rank")
    wide = macro.groupBy("arm_id").pivot("signal_condition", SIGNALS).agg(F.first("macro"))
    return rounded(wide.withColumn("signal_gap", F.col("correct") - F.col("matched_wrong")), "correct", "matched_wrong", "signal_gap")


@query("A34_donor_attraction", """
SELECT arm_id, round(avg(CASE WHEN top_candidate_id = donor_text_key THEN 1.0 ELSE 0.0 END), 10) AS donor_share
FROM preds WHERE signal_condition = 'matched_wrong' GROUP BY 1""")
def a34b(t):
    return rounded(retrieval.donor_attraction(preds(t)), "donor_share")


@query("A29_trace_summary", """
, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, count(*) AS steps, arg_min(value, step) AS first, arg_max(value, step) AS last, min(value) AS min,
       round(avg(value) FILTER (step > n - 50), 10) AS tail_mean,
       round(avg(value) FILTER (step > greatest(0, n // 2 - 25) AND step <= n // 2 + 25), 10) AS mid_mean FROM r GROUP BY 1""")
def a29(t):
    return rounded(trace_summary(run_steps(t), ["user_id"], "step", "value"), "tail_mean", "mid_mean")


def run_steps(t):
    from trialloom.plans.contract_queries import history

    return history(t).withColumn("step", F.col("epoch") + 1)


def trace_summary(trace, run, step, value):
    """Steps, first, last and least value of a trace, means of its last 50 and middle 50 steps."""
    sizes = trace.groupBy(*run).agg(F.count("*").alias("n"))
    half = F.floor(F.col("n") / 2)
    middle = (F.col(step) > F.greatest(F.lit(0), half - 25)) & (F.col(step) <= half + 25)
    return trace.join(sizes, run).groupBy(*run).agg(
        F.count("*").alias("steps"), F.min_by(value, step).alias("first"), F.max_by(value, step).alias("last"),
        F.min(value).alias("min"), F.avg(F.when(F.col(step) > F.col("n") - 50, F.col(value))).alias("tail_mean"),
        F.avg(F.when(middle, F.col(value))).alias("mid_mean"))


@query("A30_grid_best_cell", """
, m AS (SELECT arm_id, training_seed, avg(reciprocal_rank) AS mrr FROM preds WHERE signal_condition = 'correct' GROUP BY 1, 2),
r AS (SELECT avg(mrr) AS reference FROM m WHERE arm_id = 'generic_global')
SELECT arg_max(arm_id, mrr) AS arm_id, arg_max(training_seed, mrr) AS training_seed, round(max(mrr), 10) AS mrr, round(max(mrr) - max(reference), 10) AS delta,
  CASE WHEN max(mrr) >= max(reference) THEN 'PARITY_REACHABLE' ELSE 'NULL_ROBUST' END AS verdict FROM m, r""")
def a30(t):
    grid = preds(t).where("signal_condition = 'correct'").groupBy("arm_id", "training_seed").agg(F.avg("reciprocal_rank").alias("mrr"))
    bar = grid.where("arm_id = 'generic_global'").agg(F.avg("mrr").alias("reference"))
    best = reshape.with_totals(grid, bar).agg(F.max_by(F.struct("arm_id", "training_seed"), "mrr").alias("c"), F.max("mrr").alias("mrr"), F.max("reference").alias("reference"))
    return rounded(best.select("c.*", "mrr", (F.col("mrr") - F.col("reference")).alias("delta"), F.when(
        F.col("mrr") >= F.col("reference"), "PARITY_REACHABLE").otherwise("NULL_ROBUST").alias("verdict")), "mrr", "delta")


TREE_LEAF = 16
_DEPTH = " + ".join(f"(count(*) > {TREE_LEAF * 16 ** i})::INTEGER" for i in range(3))


@query("A31_set_digest", f"""
, ids AS (SELECT subject_id, trial_id, count(*) AS times, sha256(concat_ws(chr(31), trial_id, count(*))) AS digest FROM trials GROUP BY 1, 2),
sizes AS (SELECT subject_id, sum(times)::BIGINT AS members, {_DEPTH} AS depth FROM ids GROUP BY 1),
leaves AS (SELECT subject_id, any_value(depth) AS depth, substr(digest, 1, depth) AS node, sha256(string_agg(digest, chr(10) ORDER BY digest)) AS digest
  FROM ids JOIN sizes USING (subject_id) GROUP BY subject_id, substr(digest, 1, depth)),
roots AS (SELECT subject_id, CASE WHEN max(depth) = 0 THEN max(digest) ELSE sha256(string_agg(node || ' ' || digest, chr(10) ORDER BY node)) END AS root
  FROM leaves GROUP BY 1)
SELECT subject_id, members, sha256(concat_ws(chr(31), members, root)) AS set_digest FROM sizes JOIN roots USING (subject_id)""")
def a31(t):
    """Hash trees of one to four levels (a small leaf, so that small tables have more than a leaf as well)."""
    return contracts.digest_of_set(t.trial_keys, ["subject_id"], "trial_id", TREE_LEAF)


@query("A31_sorted_digest", """
SELECT trial_id AS query, count(*) AS members, sha256(string_agg(candidate_id, chr(10) ORDER BY candidate_id) || chr(10)) AS ids_digest
FROM base_scores WHERE signal_condition = 'correct' GROUP BY 1""")
def a31b(t):
    pool = vec_pools(t).where("partition = 'confirmation' and donor_id is not null")
    return contracts.sorted_digest(pool.select(F.col("target_id").alias("query"), "candidate_id"), ["query"], "candidate_id")


@query("A33_contrastive_loss", """
, p AS (SELECT trial_id AS anchor, candidate_id, is_positive, base / 0.05 AS l FROM base_scores WHERE signal_condition = 'correct'),
f AS (SELECT anchor, ln(sum(exp(l - m))) + max(m) - max(CASE WHEN is_positive = 1 THEN l END) AS loss
      FROM (SELECT *, max(l) OVER (PARTITION BY anchor) AS m FROM p) GROUP BY 1)
SELECT round(avg(loss), 10) AS loss, count(*) AS anchors FROM f""")
def a33(t):
    pairs = base_scores(t).where("signal_condition = 'correct'").select(
        F.lit(0).alias("batch"), F.col("trial_id").alias("anchor"),
        F.when(F.col("is_positive") == 1, F.col("trial_id")).otherwise(F.col("candidate_id")).alias("candidate"),
        F.col("base").alias("score"), F.lit(True).alias("forward"), F.lit(False).alias("backward"))
    return loss_rows(pairs)


def loss_rows(pairs):
    from pyspark.sql import Window

    logit = F.col("score") / 0.05
    shifted = pairs.withColumn("_l", logit).withColumn("_m", F.max("_l").over(Window.partitionBy("batch", "anchor")))
    per = shifted.groupBy("batch", "anchor").agg(
        (F.max("_m") + F.log(F.sum(F.exp(F.col("_l") - F.col("_m")))) - F.max(F.when(F.col("anchor") == F.col("candidate"), F.col("_l")))).alias("loss"))
    return per.agg(F.round(F.avg("loss"), 10).alias("loss"), F.count("*").alias("anchors"))


LOSS_BATCH = 16
VIEWS["vec_batches"] = f"""
SELECT trial_id, text_key, vector, reading_task || '|' || round || '|' || CAST(floor((row_number() OVER (PARTITION BY reading_task, round ORDER BY
   {sql_ring(SEED, "round", "text_key", "'slot'")}, trial_id) - 1) / {LOSS_BATCH}) AS BIGINT) AS batch
FROM (SELECT *, row_number() OVER (PARTITION BY reading_task, text_key ORDER BY {sql_ring(SEED, "trial_id", "'cycle'")}, trial_id) - 1 AS round FROM vec_trials)
"""


def _one_way_sql(anchor, mask):
    return f"""(SELECT batch, avg(loss) AS loss FROM (SELECT batch, {anchor}, max(m) + ln(sum(exp(l - m))) - max(CASE WHEN anchor = candidate THEN l END) AS loss
  FROM (SELECT *, max(l) OVER (PARTITION BY batch, {anchor}) AS m FROM p WHERE {mask}) GROUP BY 1, 2) GROUP BY 1)"""


@query("A33_symmetric_loss", f"""
, p AS (SELECT a.batch, a.trial_id AS anchor, b.trial_id AS candidate, list_cosine_similarity(a.vector, x.text_vector) / 0.05 AS l,
    a.trial_id = b.trial_id OR {sql_draw(SEED, "'f'", "a.trial_id", "b.trial_id")} % 2 = 0 AS forward,
    a.trial_id = b.trial_id OR {sql_draw(SEED, "'b'", "a.trial_id", "b.trial_id")} % 2 = 0 AS backward
  FROM vec_batches a JOIN vec_batches b USING (batch) JOIN vec_texts x ON x.text_key = b.text_key)
SELECT batch, round(f.loss, 8) AS forward_loss, round(b.loss, 8) AS backward_loss, round((f.loss + b.loss) / 2, 8) AS loss
FROM {_one_way_sql("anchor", "forward")} f JOIN {_one_way_sql("candidate", "backward")} b USING (batch)""")
def a33b(t):
    """Pairs within batches of sixteen distinct texts, each direction under its own hashed mask."""
    plan = batches.distinct_text_batches(t.vec_trials, LOSS_BATCH, SEED).select(
        "trial_id", "text_key", F.concat_ws("|", "reading_task", "round", "batch").alias("batch"))
    anchors = plan.select("batch", F.col("trial_id").alias("anchor"))
    members = plan.select("batch", F.col("trial_id").alias("candidate"), F.col("text_key").alias("candidate_id"))
    signals = t.vec_trials.select(F.col("trial_id").alias("signal_id"), "vector")
    texts = t.vec_texts.select(F.col("text_key").alias("candidate_id"), F.col("text_vector").alias("vector"))
    pairs = anchors.join(members, "batch").withColumn("signal_id", F.col("anchor"))
    same = F.col("anchor") == F.col("candidate")
    scored = retrieval.cosine_scores(pairs, signals, texts, context=["batch"], target=["anchor"]).withColumns({
        "forward": same | (keys.draw_hash(SEED, "f", F.col("anchor"), F.col("candidate")) % 2 == 0),
        "backward": same | (keys.draw_hash(SEED, "b", F.col("anchor"), F.col("candidate")) % 2 == 0)})
    return rounded(retrieval.contrastive_loss(scored, 0.05), "forward_loss", "backward_loss", "loss", digits=8)


# --- inference ---------------------------------------------------------------------------------------------------

_DRAW_COLUMNS = "contrast, replicate, round(macro + 1e-13, 10) AS macro, round(nr + 1e-13, 10) AS \"NR\", round(tsr + 1e-13, 10) AS \"TSR\""


@query("I01_one_way_bootstrap", f"""
SELECT 'subject_id' AS cluster, {_DRAW_COLUMNS} FROM boot_subject UNION ALL SELECT 'text_key', {_DRAW_COLUMNS} FROM boot_text""")
def i01(t):
    parts = [inference.bootstrap_macro(effects(t), [c], REPLICATES, SEED).withColumn("cluster", F.lit(c)) for c in ("subject_id", "text_key")]
    return as_long(rounded(parts[0].unionByName(parts[1]), "macro", "NR", "TSR", nudge=NUDGE))


def as_long(df):
    return df.withColumn("replicate", F.col("replicate").cast("bigint"))


@query("I02_two_way_bootstrap", f"SELECT {_DRAW_COLUMNS} FROM boot_both")
def i02(t):
    return as_long(rounded(inference.bootstrap_macro(effects(t), ["subject_id", "text_key"], REPLICATES, SEED), "macro", "NR", "TSR", nudge=NUDGE))


@query("I03_stratified_bootstrap", f"SELECT {_DRAW_COLUMNS} FROM boot_fixed_text")
def i03(t):
    return as_long(rounded(inference.bootstrap_macro(effects(t), ["text_key"], REPLICATES, SEED, fixed=["outer_fold"]), "macro", "NR", "TSR", nudge=NUDGE))


LEVELS = {"q01_25": 0.0125, "q02_5": 0.025, "q05": 0.05, "q97_5": 0.975}
_LEVEL_SQL = ", ".join(f"round(quantile_cont(macro, {q}) + 1e-13, 10) AS {n}" for n, q in LEVELS.items())


@query("I04_quantiles", f"SELECT contrast, {_LEVEL_SQL} FROM boot_text GROUP BY 1")
def i04(t):
    dist = inference.bootstrap_macro(effects(t), ["text_key"], REPLICATES, SEED)
    return rounded(dist.groupBy("contrast").agg(*inference.quantile_columns("macro", LEVELS)), *LEVELS, nudge=NUDGE)


VIEWS["boot_long"] = " UNION ALL ".join(
    f"SELECT contrast, replicate, '{name}' AS cluster, '{scope}' AS scope, {col} AS value FROM {view}"
    for name, view in (("subject_id", "boot_subject"), ("text_key", "boot_text"), ("two_way_subject_by_text", "boot_both"))
    for scope, col in (("macro", "macro"), ("NR", "nr"), ("TSR", "tsr")))
VIEWS["intervals"] = """
SELECT contrast, cluster, scope, split_part(contrast, '|', 1) AS endpoint, split_part(contrast, '|', 2) AS reference,
       quantile_cont(value, 0.0125) AS q01_25, quantile_cont(value, 0.025) AS q02_5, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.975) AS q97_5,
       (count(*) FILTER (value <= 0) + 1) / (count(*) + 1) AS p_one_sided, count(*) AS replicates
FROM boot_long GROUP BY 1, 2, 3
"""


def intervals(t):
    return t.shared("intervals", lambda: inference.clustered_delta(
        effects(t), REPLICATES, SEED, LEVELS, scopes=("macro", "NR", "TSR")).withColumns({
            "endpoint": F.split_part("contrast", F.lit("|"), F.lit(1)), "reference": F.split_part("contrast", F.lit("|"), F.lit(2))}))


_POINT_SQL = """SELECT contrast, 'macro' AS scope, avg(m) AS point FROM (SELECT contrast, reading_task, avg(effect) AS m FROM effects GROUP BY 1, 2) GROUP BY 1"""


@query("I05_clustered_delta", f"""
SELECT i.contrast, i.cluster, round(p.point + 1e-13, 10) AS point, round(i.q05 + 1e-13, 10) AS lower_bound FROM intervals i JOIN ({_POINT_SQL}) p USING (contrast, scope)""")
def i05(t):
    out = intervals(t).where("scope = 'macro'").select("contrast", "cluster", "point", F.col("q05").alias("lower_bound"))
    return rounded(out, "point", "lower_bound", nudge=NUDGE)


@query("I07_one_sided_p", "SELECT contrast, cluster, scope, round(p_one_sided, 10) AS p_one_sided FROM intervals")
def i07(t):
    return rounded(intervals(t).select("contrast", "cluster", "scope", "p_one_sided"), "p_one_sided")


VIEWS["holm_rows"] = """
SELECT *, 0.05 / (m - holm_rank + 1) AS holm_rank_alpha, max(least(1.0, (m - holm_rank + 1) * p_one_sided)) OVER (PARTITION BY cluster ORDER BY holm_rank) AS holm_adjusted_p
FROM (SELECT cluster, contrast, p_one_sided, row_number() OVER (PARTITION BY cluster ORDER BY p_one_sided, contrast) AS holm_rank,
             count(*) OVER (PARTITION BY cluster) AS m FROM intervals WHERE scope = 'macro')
"""


@query("W07_holm_step_down", """
SELECT cluster, contrast, CAST(holm_rank AS INTEGER) AS holm_rank, round(p_one_sided, 10) AS p_one_sided, round(holm_rank_alpha, 10) AS holm_rank_alpha,
       round(holm_adjusted_p, 10) AS holm_adjusted_p FROM holm_rows""")
def w07(t):
    tests = intervals(t).where("scope = 'macro'").select("cluster", "contrast", "p_one_sided")
    return rounded(inference.holm(tests, ["cluster"], "p_one_sided", ["contrast"]), "p_one_sided", "holm_rank_alpha", "holm_adjusted_p")


@query("I08_holm_bounds", """
SELECT h.cluster, h.contrast, CAST(any_value(holm_rank) AS INTEGER) AS holm_rank, round(any_value(holm_adjusted_p), 10) AS holm_adjusted_p,
       round(list_sum(list_transform([floor(any_value(holm_rank_alpha) * (count(*) - 1)), floor(any_value(holm_rank_alpha) * (count(*) - 1)) + 1],
         lambda i: list_sort(list(value))[CAST(i AS INTEGER) + 1] * (1 - abs(any_value(holm_rank_alpha) * (count(*) - 1) - i)))), 10) AS holm_adjusted_lower
FROM holm_rows h JOIN boot_long b ON b.cluster = h.cluster AND b.contrast = h.contrast AND b.scope = 'macro' GROUP BY 1, 2""")
def i08(t):
    parts = [inference.bootstrap_macro(effects(t), c, REPLICATES, SEED).select(
        F.lit(n).alias("cluster"), "contrast", F.col("macro").alias("value")) for n, c in inference.SCHEMES.items()]
    out = inference.holm_bounds(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["cluster"], ["contrast"])
    return rounded(out.select("cluster", "contrast", "holm_rank", "holm_adjusted_p", "holm_adjusted_lower"), "holm_adjusted_p", "holm_adjusted_lower")


CHANCE = sum(1.0 / k for k in range(1, POOL + 1)) / POOL
VIEWS["battery"] = """
SELECT 'superiority' AS endpoint, reference, cluster, scope, q01_25 AS lower_bound FROM intervals WHERE endpoint = 'superiority' AND scope = 'macro'
UNION ALL SELECT 'task_noninferiority', reference, cluster, scope, q01_25 FROM intervals WHERE endpoint = 'superiority' AND scope <> 'macro'
UNION ALL SELECT 'signal_gap_delta', reference, cluster, scope, q01_25 FROM intervals WHERE endpoint = 'signal_gap_delta' AND scope = 'macro'
UNION ALL SELECT 'absolute', reference, cluster, scope, q02_5 FROM intervals WHERE endpoint = 'absolute' AND scope = 'macro'
UNION ALL SELECT 'signal_gap', reference, cluster, scope, q02_5 FROM intervals WHERE endpoint = 'signal_gap' AND scope = 'macro'
"""


def battery(t):
    rows = intervals(t)
    endpoint = F.when((F.col("endpoint") == "superiority") & (F.col("scope") != "macro"), "task_noninferiority").otherwise(F.col("endpoint"))
    level = F.when(F.col("endpoint").isin("absolute", "signal_gap"), F.col("q02_5")).otherwise(F.col("q01_25"))
    kept = rows.where((F.col("scope") == "macro") | (F.col("endpoint") == "superiority"))
    return kept.select(endpoint.alias("endpoint"), "reference", "cluster", "scope", level.alias("lower_bound"))


@query("I10_interval_battery", "SELECT endpoint, reference, cluster, scope, round(lower_bound + 1e-13, 10) AS lower_bound FROM battery")
def i10(t):
    return rounded(battery(t), "lower_bound", nudge=NUDGE)


VIEWS["arm_macro"] = """
SELECT arm_id, signal_condition, avg(m) AS macro FROM (SELECT arm_id, signal_condition, reading_task, avg(reciprocal_rank) AS m FROM seed_avg GROUP BY 1, 2, 3) GROUP BY 1, 2
"""


def arm_macro(t):
    return retrieval.task_macro(seed_avg(t), ["arm_id", "signal_condition"], "reciprocal_rank")


_MACRO_OF = "(SELECT macro FROM arm_macro WHERE arm_id = '{}' AND signal_condition = '{}')"
_OWN = _MACRO_OF.format(MODEL, "correct")
VIEWS["continuation"] = f"""
SELECT 'headline_macro_exceeds_baselines' AS gate, bool_and({_OWN} > macro) AS passed, count(*) AS checks FROM arm_macro WHERE signal_condition = 'correct' AND arm_id <> '{MODEL}'
UNION ALL SELECT 'superiority_bounds_positive', bool_and(lower_bound > 0), count(*) FROM battery WHERE endpoint = 'superiority'
UNION ALL SELECT 'deltas_positive_in_all_seeds', bool_and(direction_positive), count(*) FROM seedwise
UNION ALL SELECT 'task_bounds_above_margin', bool_and(lower_bound > -0.01), count(*) FROM battery WHERE endpoint = 'task_noninferiority'
UNION ALL SELECT 'macro_bound_above_chance', bool_and(lower_bound > {CHANCE!r}), count(*) FROM battery WHERE endpoint = 'absolute'
UNION ALL SELECT 'signal_gap_bounds_positive', bool_and(lower_bound > 0), count(*) FROM battery WHERE endpoint = 'signal_gap'
UNION ALL SELECT 'signal_gap_noninferior', bool_and(lower_bound > -0.005), count(*) FROM battery WHERE endpoint = 'signal_gap_delta'
"""


def continuation(t):
    points = arm_macro(t).where("signal_condition = 'correct'")
    return decisions.continuation_gates(points, battery(t), retrieval.seedwise_deltas(preds(t), MODEL, BASELINES), MODEL, CHANCE)


@query("I11_continuation_gates", "SELECT gate, passed, checks FROM continuation")
def i11(t):
    return continuation(t)


_DECIDE = """SELECT CASE WHEN bool_and(passed) THEN '{}' ELSE '{}' END AS decision, count(*) AS gates, count(*) FILTER (passed) AS gates_passed,
 coalesce(string_agg(gate, ',' ORDER BY gate) FILTER (NOT passed), '') AS failed_gates FROM ({})"""


@query("I11_continuation_decision", _DECIDE.format("continue", "stop", "SELECT * FROM continuation"))
def i11b(t):
    return decisions.decide(continuation(t), "continue", "stop")


_WIN = f"""
SELECT 'mrr_lower_bound_at_margin' AS gate, bool_and(q05 >= 0.02) AS passed FROM intervals WHERE contrast = 'superiority|generic_global' AND cluster = 'two_way_subject_by_text' AND scope = 'macro'
UNION ALL SELECT 'controls_pass', bool_and(ok) FROM (SELECT abs({_MACRO_OF.format(MODEL, "matched_wrong")} - {CHANCE!r}) <= 0.05 AS ok
  UNION ALL SELECT {_OWN} - {_MACRO_OF.format(MODEL, "matched_wrong")} > 0)
UNION ALL SELECT 'both_metrics_advantage', bool_and(q05 > 0) FROM intervals WHERE endpoint = 'superiority' AND cluster = 'two_way_subject_by_text' AND scope = 'macro'
UNION ALL SELECT 'seed_and_subject_consistent', (SELECT bool_and(direction_positive) FROM seedwise) AND (SELECT bool_and(q05 > 0) FROM intervals WHERE endpoint = 'superiority' AND cluster = 'subject_id' AND scope = 'macro')
UNION ALL SELECT 'pool_size_robust', bool_and(q05 > 0) FROM intervals WHERE endpoint = 'superiority' AND cluster = 'text_key' AND scope = 'macro'
"""


@query("I12_win_rule", _DECIDE.format("method_win", "null_or_insufficient", _WIN))
def i12(t):
    rows = intervals(t).where("scope = 'macro'").withColumn("lower_bound", F.col("q05"))
    both = rows.where("endpoint = 'superiority' and cluster = 'two_way_subject_by_text'").withColumn(
        "metric", F.when(F.col("reference") == "generic_global", "mrr").otherwise("top1"))
    macro = arm_macro(t).where(F.col("arm_id") == MODEL).groupBy("arm_id").pivot("signal_condition", SIGNALS).agg(F.first("macro"))
    controls = macro.select(F.explode(F.array(
        decisions.at_chance(F.col("matched_wrong"), CHANCE, 0.05), F.col("correct") > F.col("matched_wrong"))).alias("passed"))
    gates = decisions.win_gates(both, controls, retrieval.seedwise_deltas(preds(t), MODEL, BASELINES),
                                rows.where("endpoint = 'superiority' and cluster = 'subject_id'"),
                                rows.where("endpoint = 'superiority' and cluster = 'text_key'"))
    return decisions.decide(gates, "method_win", "null_or_insufficient")


_GAPS = "(SELECT arm_id, max(CASE WHEN signal_condition = 'correct' THEN macro END) - max(CASE WHEN signal_condition = 'matched_wrong' THEN macro END) AS gap FROM arm_macro GROUP BY 1)"
_PILOT = f"""
SELECT 'mrr_above_baselines' AS gate, bool_and({_OWN} > macro) AS passed FROM arm_macro WHERE signal_condition = 'correct' AND arm_id <> '{MODEL}'
UNION ALL SELECT 'model_bounds_positive', bool_and(lower_bound > 0) FROM battery WHERE endpoint = 'superiority'
UNION ALL SELECT 'model_positive_in_all_seeds', bool_and(direction_positive) FROM seedwise
UNION ALL SELECT 'signal_gap_positive', bool_and(gap > 0) FROM {_GAPS} WHERE arm_id = '{MODEL}'
UNION ALL SELECT 'signal_bounds_positive', bool_and(lower_bound > 0) FROM battery WHERE endpoint = 'signal_gap'
UNION ALL SELECT 'signal_gap_not_below_baselines', bool_and((SELECT gap FROM {_GAPS} WHERE arm_id = '{MODEL}') >= gap) FROM {_GAPS} WHERE arm_id <> '{MODEL}'
UNION ALL SELECT 'task_control_bounds_positive', bool_and(lower_bound > 0) FROM battery WHERE endpoint = 'signal_gap_delta'
"""


def arm_gaps(t):
    wide = arm_macro(t).groupBy("arm_id").pivot("signal_condition", SIGNALS).agg(F.first("macro"))
    return wide.select("arm_id", (F.col("correct") - F.col("matched_wrong")).alias("gap"))


@query("I13_pilot_selection", _DECIDE.format("selected", "not_selected", _PILOT))
def i13(t):
    kind = F.when(F.col("endpoint") == "superiority", "model_comparison").when(
        F.col("endpoint") == "signal_gap", "signal_specificity").when(F.col("endpoint") == "signal_gap_delta", "task_control")
    rows = battery(t).withColumn("contrast_type", kind)
    gates = decisions.pilot_gates(arm_macro(t).where("signal_condition = 'correct'"), arm_gaps(t), rows,
                                  retrieval.seedwise_deltas(preds(t), MODEL, BASELINES), MODEL)
    return decisions.decide(gates, "selected", "not_selected")


@query("I14_factor_admission", """
, c AS (SELECT split_part(contrast, '|', 1) AS factor_id, count(DISTINCT trial_id) AS rows, count(DISTINCT subject_id) AS subjects, FROM effects GROUP BY 1),
b AS (SELECT endpoint AS factor_id, bool_and(q05 > 0) AS bounds_positive FROM intervals WHERE scope = 'macro' GROUP BY 1),
h AS (SELECT split_part(contrast, '|', 1) AS factor_id, bool_and(point > 0) AS same_direction FROM (SELECT contrast, avg(effect) AS point FROM effects GROUP BY 1) GROUP BY 1)
SELECT factor_id, rows, subjects, bounds_positive, same_direction, CASE WHEN rows >= 100 AND subjects >= 5 AND bounds_positive AND same_direction THEN 'admit' ELSE 'reject_retain_null' END AS decision
FROM c JOIN b USING (factor_id) JOIN h USING (factor_id)""")
def i14(t):
    rows = effects(t).withColumn("factor_id", F.split_part("contrast", F.lit("|"), F.lit(1)))
    counts = rows.groupBy("factor_id").agg(F.count_distinct("trial_id").alias("rows"), F.count_distinct("subject_id").alias("subjects"))
    bounds = intervals(t).where("scope = 'macro'").select(F.col("endpoint").alias("factor_id"), F.col("q05").alias("holm_adjusted_lower"))
    held = rows.groupBy("factor_id", "contrast").agg(F.avg("effect").alias("delta"))
    return decisions.factor_admission(bounds, counts, held, 100, 5)


@query("I15_control_predicates", f"""
SELECT arm_id, round(macro, 10) AS macro, abs(macro - {CHANCE!r}) <= 0.05 AS at_chance FROM arm_macro WHERE signal_condition = 'matched_wrong'""")
def i15(t):
    wrong = arm_macro(t).where("signal_condition = 'matched_wrong'")
    return rounded(wrong.select("arm_id", "macro", decisions.at_chance(F.col("macro"), CHANCE, 0.05).alias("at_chance")), "macro")
