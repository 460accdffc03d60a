"""Joins with checks, reshaping, running values, and contract violations over tables with planted faults."""

from pyspark.sql import functions as F

from trialloom.functions import keys, vectors
from trialloom.functions.fixed_values import INSTRUCTION_RELATIONS
from trialloom.operators import contracts, joins, records, reshape, retrieval
from trialloom.plans.record_views import record_table, source_frame
from trialloom.plans.registry import query
from trialloom.plans.retrieval_queries import metric_table, rounded
from trialloom.plans.score_views import ARMS, BASELINES, MODEL, PREDICTION, SEEDS, SIGNALS, arm_pools, arm_scores, preds, seed_avg
from trialloom.plans.tables import FOLDS, POOL, SEED, VIEWS
from trialloom.plans.xfit_views import doc_rows, vec_donors, vec_pools, xfit_roles

# --- joins -------------------------------------------------------------------------------------------------------


@query("J01_left_join_checked", """
SELECT u.conv_id, u.turn, a.text AS reply, u.role = 'user' AND a.text IS NULL AS missing_match
FROM conversations u LEFT JOIN (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant') a USING (conv_id, turn)""")
def j01(t):
    turns = t.raw("conversations")
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    out = joins.labelled_first(turns, replies, ["conv_id", "turn"], F.col("role") == "user")
    return out.select("conv_id", "turn", "reply", "missing_match")


@query("J02_three_key_join", """
SELECT l.l_orderkey, l.l_linenumber, p.p_name, s.s_name, o.o_orderstatus FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN part p ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey""")
def j02(t):
    line = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return (line.join(t.raw("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
            .join(t.raw("part"), F.col("p_partkey") == F.col("l_partkey"))
            .join(t.raw("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
            .select("l_orderkey", "l_linenumber", "p_name", "s_name", "o_orderstatus"))


@query("J02_merge_on_three_keys", """
SELECT a.trial_id, b.doc_id AS label_doc FROM trials a JOIN trials b ON a.reading_task = b.reading_task AND a.dataset_version = b.dataset_version AND a.text_key = b.text_key""")
def j02b(t):
    labels = t.trials.select(F.col("doc_id").alias("label_doc"), F.col("reading_task").alias("task"),
                             F.col("dataset_version").alias("dataset"), F.col("text_key").alias("input_text"))
    a = t.trials.select("trial_id", "reading_task", "dataset_version", "text_key")
    return a.join(labels, (a.reading_task == labels.task) & (a.dataset_version == labels.dataset) & (a.text_key == labels.input_text)).select(
        "trial_id", "label_doc")


@query("J02_fan_out", """
SELECT CAST(sum(n * n) AS BIGINT) AS pairs, CAST(sum(n) AS BIGINT) AS matched_rows, round(sum(n * n) / sum(n), 6) AS fan_out
FROM (SELECT count(*) AS n FROM trials GROUP BY text_key)""")
def j02c(t):
    return joins.fan_out(t.trial_keys, t.trial_keys, ["text_key"])


@query("J03_first_match_lookup", """
SELECT o_orderkey, l_partkey, l_quantity, l_partkey IS NOT NULL AS matched FROM orders LEFT JOIN
 (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) = 1) ON l_orderkey = o_orderkey""")
def j03(t):
    lookup = t.raw("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.first_match(t.raw("orders").select("o_orderkey"), lookup, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"],
                             ["l_partkey", "l_quantity"])


@query("J04_positional_join", """
SELECT position, doc_id, vec_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents)
JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings) USING (position)""")
def j04(t):
    return joins.positional_join(t.raw("documents").select("doc_id"), "doc_id", t.raw("embeddings").select("vec_id"), "vec_id")


@query("J05_vector_lookup", """
SELECT doc_id, vec_id IS NOT NULL AS found, CASE WHEN vec_id IS NULL THEN 0.0 ELSE round(list_sum(CAST(embedding AS DOUBLE[])), 6) END AS total
FROM documents LEFT JOIN embeddings ON vec_id = doc_id""")
def j05(t):
    store = t.raw("embeddings").select(F.col("vec_id").alias("doc_id"), vectors.as_double(F.col("embedding")).alias("vector"))
    out = joins.with_vector(t.raw("documents").select("doc_id"), store, "doc_id", 64)
    return out.select("doc_id", "found", F.round(vectors.total(F.col("vector")), 6).alias("total"))


def drifted(t):
    """A copy of the customer table with planted differences and a lost row in every hundred."""
    k = F.col("c_custkey")
    return t.raw("customer").where(k % 100 != 99).withColumns({
        "c_mktsegment": F.when(k % 50 == 7, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")),
        "c_nationkey": F.when(k % 70 == 3, F.lit(None).cast("int")).otherwise(F.col("c_nationkey"))})


_DRIFTED = """(SELECT * EXCLUDE (c_mktsegment, c_nationkey), CASE WHEN c_custkey % 50 = 7 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment,
 CASE WHEN c_custkey % 70 <> 3 THEN c_nationkey END AS c_nationkey FROM customer WHERE c_custkey % 100 <> 99)"""
_MISMATCHES = f"""SELECT c_custkey, field, left_value, right_value FROM (SELECT a.c_custkey, unnest([
 {{'field': 'c_nationkey', 'left_value': CAST(a.c_nationkey AS VARCHAR), 'right_value': CAST(b.c_nationkey AS VARCHAR)}},
 {{'field': 'c_mktsegment', 'left_value': a.c_mktsegment, 'right_value': b.c_mktsegment}},
 {{'field': '_row', 'left_value': 'present', 'right_value': CASE WHEN b.c_custkey IS NOT NULL THEN 'present' END}}], recursive := true)
 FROM customer a LEFT JOIN {_DRIFTED} b USING (c_custkey)) WHERE left_value IS DISTINCT FROM right_value"""


@query("J06_one_to_one_recheck", _MISMATCHES)
def j06(t):
    return joins.one_to_one_mismatches(t.raw("customer"), drifted(t), "c_custkey", ["c_nationkey", "c_mktsegment"])


@query("J17_frozen_table_diff", _MISMATCHES)
def j17(t):
    """Every difference; a report that shows a few orders and limits it itself."""
    return joins.one_to_one_mismatches(t.raw("customer"), drifted(t), "c_custkey", ["c_nationkey", "c_mktsegment"])


@query("J07_intersection_alignment", """
SELECT a.vec_id AS id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS product
FROM embeddings a JOIN (SELECT vec_id + 100 AS id, embedding FROM embeddings) b ON b.id = a.vec_id""")
def j07(t):
    store = t.raw("embeddings").select("vec_id", vectors.as_double(F.col("embedding")).alias("vector"))
    left = store.select(F.col("vec_id").alias("id"), "vector")
    right = store.select((F.col("vec_id") + 100).alias("id"), "vector")
    return joins.aligned(left, right, "id").select("id", F.round(vectors.dot(F.col("left_vector"), F.col("right_vector")), 6).alias("product"))


# --- set operations and running values --------------------------------------------------------------------------


@query("U01_union_parts", """
SELECT role, text, conv_id FROM conversations WHERE role = 'user' UNION ALL SELECT role, text, conv_id FROM conversations WHERE role <> 'user'""")
def u01(t):
    turns = t.raw("conversations").select("role", "text", "conv_id")
    return turns.where("role = 'user'").unionByName(turns.where("role <> 'user'").select("conv_id", "text", "role"))


@query("U02_unpivot_variants", """
SELECT item_id, variant, target_text FROM (SELECT item_id, text, unnest(['upper', 'lower', 'title']) AS variant,
       unnest(['> ' || text, lower(text), text || '.']) AS target_text FROM benchmark) WHERE item_id % 4 <> 0
UNION ALL SELECT item_id, 'text', text FROM benchmark WHERE item_id % 4 = 0""")
def u02(t):
    wide = t.raw("benchmark").withColumns({"upper": F.concat(F.lit("> "), "text"), "lower": F.lower("text"), "title": F.concat("text", F.lit("."))})
    return reshape.unpivot_variants(wide, ["item_id"], ["upper", "lower", "title"], "text", F.col("item_id") % 4 != 0)


@query("U05_missing_and_extra", """
SELECT c_nationkey, 'missing' AS side FROM (SELECT n_nationkey AS c_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT s_nationkey, 'extra' FROM (SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation)""")
def u05(t):
    return reshape.missing_and_extra(t.raw("nation").select(F.col("n_nationkey").alias("c_nationkey")),
                                     t.raw("supplier").select(F.col("s_nationkey").alias("c_nationkey")), ["c_nationkey"])


_ARM_LIST = "[" + ", ".join(f"'{a}'" for a in ARMS) + "]"


@query("U06_design_matrix", f"""
SELECT arm_id, training_seed, text_fold FROM (SELECT unnest({_ARM_LIST}) AS arm_id), (SELECT CAST(unnest({SEEDS}) AS INTEGER) AS training_seed),
 (SELECT DISTINCT text_fold FROM vec_trials)""")
def u06(t):
    folds = t.vec_trials.select("text_fold").distinct()
    return reshape.each(reshape.each(folds, "arm_id", list(ARMS)), "training_seed", SEEDS)


VIEWS["history"] = """
SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS epoch FROM events
"""


def history(t):
    from trialloom.operators.ranking import prefix_sum

    rows = t.raw("events").select("user_id", "event_id", "value", "ts")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    return prefix_sum(rows, ["user_id"], hour, ["ts", "event_id"], F.lit(1), "epoch").drop("ts")


@query("W06_running_incumbent", """
SELECT user_id, epoch, value, coalesce(value > max(value) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best,
       epoch = arg_max(epoch, (value, -epoch)) OVER (PARTITION BY user_id) AS selected FROM history""")
def w06(t):
    return contracts.incumbents(history(t), ["user_id"], "epoch", "value").select("user_id", "epoch", "value", "is_best", "selected")


@query("W09_first_difference", """
SELECT user_id, epoch, round(value - 0.95 * coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY epoch), 0), 6) AS whitened FROM history""")
def w09(t):
    from trialloom.operators.signals import first_difference

    return rounded(first_difference(history(t), ["user_id"], "epoch", "value", 0.95).select("user_id", "epoch", "whitened"), "whitened", digits=6)


@query("W11_contiguity", """
SELECT l_orderkey, min(l_linenumber) AS low, max(l_linenumber) AS high, count(*) AS rows, count(DISTINCT l_linenumber) AS "values" FROM lineitem
GROUP BY 1 HAVING min(l_linenumber) <> 0 OR max(l_linenumber) <> count(*) - 1 OR count(DISTINCT l_linenumber) <> count(*)""")
def w11(t):
    return contracts.contiguity_gaps(t.raw("lineitem"), ["l_orderkey"], "l_linenumber")


@query("W12_total_sort", "SELECT c_nationkey, c_custkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def w12(t):
    return t.raw("customer").select("c_nationkey", "c_custkey", "c_acctbal").orderBy("c_nationkey", F.desc("c_acctbal"), "c_custkey")


# --- contracts ---------------------------------------------------------------------------------------------------


@query("V01_required_columns", """
SELECT "column", 'missing' AS problem FROM (SELECT unnest(['event_id', 'trial_id', 'subject_id']) AS "column")
WHERE "column" NOT IN (SELECT column_name FROM (DESCRIBE SELECT * FROM events))""")
def v01(t):
    return contracts.check_columns(t.raw("events"), ["event_id", "trial_id", "subject_id"])


@query("V02_exact_counts", """
SELECT text_fold, count(*) AS rows, 100 AS expected_rows FROM vec_trials GROUP BY 1 HAVING count(*) <> 100
UNION ALL SELECT 7, NULL, 100""")
def v02(t):
    expected = t.vec_trials.select("text_fold").distinct().unionByName(t.vec_trials.select(F.lit(7).alias("text_fold")).distinct())
    return contracts.count_mismatches(t.vec_trials, ["text_fold"], expected.withColumn("expected_rows", F.lit(100)))


@query("V03_unique_key", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def v03(t):
    return contracts.duplicate_keys(t.raw("lineitem"), ["l_orderkey", "l_linenumber"])


@query("V04_domain", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def v04(t):
    return contracts.outside_domain(t.raw("events").select("event_id", "event_type"), "event_type", ["view", "click", "purchase"])


@query("V05_implication", """
SELECT trial_id, reading_task, mask_semkey_sentiment_2 FROM records WHERE mask_semkey_sentiment_2 = 1 AND reading_task <> 'SR'""")
def v05(t):
    out = contracts.broken_implication(record_table(t), F.col("mask_semkey_sentiment_2") == 1, F.col("reading_task") == "SR")
    return out.select("trial_id", "reading_task", "mask_semkey_sentiment_2")


@query("V05_record_problems", """
SELECT trial_id, 'relation' AS problem FROM records WHERE reading_task = 'TSR' AND tsr_instruction_relation IS NULL
UNION ALL SELECT trial_id, 'sentiment' FROM records WHERE reading_task = 'SR' AND sr_sentiment_3 IS NULL""")
def v05b(t):
    return records.record_problems(record_table(t))


@query("V06_single_valued", """
SELECT o_custkey, 'o_orderstatus' AS attribute, min(o_orderstatus) AS low, max(o_orderstatus) AS high FROM orders GROUP BY 1 HAVING min(o_orderstatus) < max(o_orderstatus)
UNION ALL SELECT o_custkey, 'o_orderpriority', min(o_orderpriority), max(o_orderpriority) FROM orders GROUP BY 1 HAVING min(o_orderpriority) < max(o_orderpriority)""")
def v06(t):
    return contracts.drifting_attributes(t.raw("orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


_MATRIX_KEY = ["arm_id", "training_seed", "signal_condition", "trial_id"]
VIEWS["broken_log"] = """
SELECT * FROM preds WHERE CAST(right(trial_id, 6) AS BIGINT) % 40 <> 3 UNION ALL SELECT * FROM preds WHERE CAST(right(trial_id, 6) AS BIGINT) % 60 = 1
"""


def broken_log(t):
    row = F.substring("trial_id", -6, 6).cast("bigint")
    return preds(t).where(row % 40 != 3).unionByName(preds(t).where(row % 60 == 1))


@query("V07_complete_matrix", f"""
, want AS (SELECT arm_id, training_seed, signal_condition, trial_id FROM (SELECT DISTINCT trial_id FROM preds), (SELECT unnest({_ARM_LIST}) AS arm_id),
  (SELECT CAST(unnest({SEEDS}) AS INTEGER) AS training_seed), (SELECT unnest(['correct', 'matched_wrong']) AS signal_condition)),
have AS (SELECT arm_id, training_seed, signal_condition, trial_id, count(*) AS n FROM broken_log GROUP BY ALL)
SELECT arm_id, training_seed, signal_condition, trial_id, CASE WHEN n IS NULL THEN 'missing' ELSE 'repeated' END AS problem
FROM want LEFT JOIN have USING (arm_id, training_seed, signal_condition, trial_id) WHERE n IS NULL OR n > 1""")
def v07(t):
    want = preds(t).select("trial_id").distinct()
    for name, values in (("arm_id", list(ARMS)), ("training_seed", SEEDS), ("signal_condition", SIGNALS)):
        want = reshape.each(want, name, values)
    return contracts.matrix_problems(want, broken_log(t), _MATRIX_KEY)


@query("V08_recomputed_ranks", f"""
SELECT arm_id, training_seed, signal_condition, trial_id, 'positive_rank' AS field, CAST(positive_rank + 1 AS DOUBLE) AS declared, CAST(positive_rank AS DOUBLE) AS recomputed
FROM preds WHERE CAST(right(trial_id, 6) AS BIGINT) % 50 = 2""")
def v08(t):
    row = F.substring("trial_id", -6, 6).cast("bigint")
    declared = preds(t).withColumn("positive_rank", F.col("positive_rank") + (row % 50 == 2).cast("int"))
    fresh = retrieval.rank_positive(arm_scores(t), PREDICTION)
    return contracts.rank_mismatches(declared, fresh, _MATRIX_KEY, ["positive_rank"])


VIEWS["provenance"] = """
SELECT d.target_id AS trial_id, v.subject_id, v.text_key, c AS signal_condition, s.trial_id AS signal_trial_id, s.subject_id AS signal_subject_id, s.text_key AS signal_text_key
FROM vec_donors d JOIN vec_trials v ON v.trial_id = d.target_id, (SELECT unnest(['correct', 'matched_wrong']) AS c)
JOIN vec_trials s ON s.trial_id = CASE WHEN c = 'correct' OR v.vec_id % 30 = 4 THEN d.target_id ELSE d.donor_id END
"""


@query("V09_signal_provenance", "SELECT trial_id, signal_condition, signal_trial_id FROM provenance WHERE (signal_condition = 'correct') <> (signal_trial_id = trial_id)")
def v09(t):
    trials = t.vec_trials.select("trial_id", "vec_id", "subject_id", "text_key")
    rows = reshape.each(vec_donors(t).select(F.col("target_id").alias("trial_id"), "donor_id").join(trials, "trial_id"), "signal_condition", SIGNALS)
    own = (F.col("signal_condition") == "correct") | (F.col("vec_id") % 30 == 4)
    rows = rows.withColumn("signal_trial_id", F.when(own, F.col("trial_id")).otherwise(F.col("donor_id")))
    signal = trials.select(F.col("trial_id").alias("signal_trial_id"), F.col("subject_id").alias("signal_subject_id"),
                           F.col("text_key").alias("signal_text_key"))
    return contracts.provenance_violations(rows.join(signal, "signal_trial_id")).select("trial_id", "signal_condition", "signal_trial_id")


@query("V10_pool_binding", """
SELECT trial_id, signal_condition, 2 AS pools, 6 AS scorings FROM (SELECT DISTINCT trial_id, signal_condition FROM preds) WHERE CAST(right(trial_id, 6) AS BIGINT) % 25 = 6""")
def v10(t):
    row = F.substring("trial_id", -6, 6).cast("bigint")
    moved = (row % 25 == 6) & (F.col("arm_id") == MODEL) & (F.col("training_seed") == 2)
    scores = arm_pools(t).withColumn("pool", F.when(moved, F.transform("pool", lambda c: c.withField(
        "candidate_rank", F.lit(POOL - 1) - c["candidate_rank"]))).otherwise(F.col("pool")))
    out = contracts.unbound_pools(scores, ["trial_id", "signal_condition"], ["arm_id", "training_seed"])
    return out.withColumns({"pools": F.col("pools").cast("int"), "scorings": F.col("scorings").cast("int")})


@query("V11_sealed_split", "SELECT trial_id, split FROM split_trials WHERE split = 'test'")
def v11(t):
    return contracts.forbidden_split(t.split_trials).select("trial_id", "split")


@query("V12_locator_range", """
SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber >= 6
UNION ALL SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def v12(t):
    shards = t.raw("orders").select(F.col("o_orderkey").alias("shard"), F.lit(6).alias("rows"))
    locators = t.raw("lineitem").select(F.col("l_orderkey").alias("shard"), F.col("l_linenumber").alias("offset"), "l_partkey", "l_suppkey")
    return contracts.out_of_range(locators, shards).select(
        F.col("shard").alias("l_orderkey"), "l_partkey", F.col("offset").alias("l_linenumber"), "l_suppkey")


@query("V13_referential_integrity", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def v13(t):
    return contracts.dangling(t.raw("documents").select("doc_id"), t.raw("labels"), ["doc_id"])


@query("V14_count_identities", f"""
SELECT (SELECT count(*) FROM xfit_roles) AS assignments, (SELECT count(*) FROM trials) AS trials,
       (SELECT count(*) FROM xfit_roles) = (SELECT count(*) FROM trials) * {FOLDS} AS assignments_match,
       (SELECT count(*) FROM vec_pools) AS pool_rows, (SELECT count(*) FROM vec_pools) = 2 * (SELECT count(*) FROM vec_trials) * {POOL} AS pools_match""")
def v14(t):
    n = xfit_roles(t).agg(F.count("*").alias("assignments"))
    for frame, name in ((t.trial_keys, "trials"), (vec_pools(t), "pool_rows"), (t.vec_trials, "vec_rows")):
        n = reshape.with_totals(n, frame.agg(F.count("*").alias(name)))
    return n.select("assignments", "trials", (F.col("assignments") == F.col("trials") * FOLDS).alias("assignments_match"), "pool_rows",
                    (F.col("pool_rows") == 2 * F.col("vec_rows") * POOL).alias("pools_match"))


@query("V15_donor_audit", """
SELECT target_id, target_id AS donor_id FROM vec_donors WHERE CAST(right(target_id, 6) AS BIGINT) % 20 = 5""")
def v15(t):
    row = F.substring("target_id", -6, 6).cast("bigint")
    donors = vec_donors(t).withColumn("donor_id", F.when(row % 20 == 5, F.col("target_id")).otherwise(F.col("donor_id")))
    return contracts.donor_violations(donors, t.vec_trials, ["dataset_version", "reading_task", "subject_id", "text_fold"])


@query("V16_vector_checks", """
SELECT vec_id, CASE WHEN vec_id % 90 = 1 THEN 'width' WHEN vec_id % 90 = 2 THEN 'not_finite' ELSE 'zero' END AS problem FROM embeddings WHERE vec_id % 90 IN (1, 2, 3)""")
def v16(t):
    v, k = vectors.as_double(F.col("embedding")), F.col("vec_id") % 90
    broken = F.when(k == 1, F.slice(v, 1, 63)).when(k == 2, F.transform(v, lambda x: F.lit(float("nan")))).when(
        k == 3, F.transform(v, lambda x: F.lit(0.0))).otherwise(v)
    return contracts.vector_problems(t.raw("embeddings").select("vec_id", broken.alias("vector")), "vec_id", 64)


@query("V18_chain_continuity", """
SELECT user_id, epoch FROM (SELECT user_id, epoch, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY epoch) AS prev FROM history)
WHERE epoch > 0 AND event_id % 37 = 0""")
def v18(t):
    steps = history(t).withColumn("post_state", F.md5(F.col("event_id").cast("string")))
    before = steps.select("user_id", (F.col("epoch") + 1).alias("epoch"), F.col("post_state").alias("pre_state"))
    steps = steps.join(before, ["user_id", "epoch"], "left").withColumn(
        "pre_state", F.when(F.col("event_id") % 37 == 0, "lost").otherwise(F.col("pre_state")))
    return contracts.chain_breaks(steps, ["user_id"], "epoch")


VIEWS["declared_history"] = """
SELECT arm_id, training_seed AS epoch, avg(m) AS macro FROM (SELECT arm_id, training_seed, reading_task, avg(reciprocal_rank) AS m FROM preds
WHERE signal_condition = 'correct' GROUP BY 1, 2, 3) GROUP BY 1, 2
"""


@query("V19_recomputed_history", """
SELECT arm_id, epoch, 'macro' AS field, round(macro + 0.5, 10) AS declared, round(macro, 10) AS recomputed FROM declared_history WHERE epoch = 2 AND arm_id = 'generic_global'""")
def v19(t):
    fresh = retrieval.task_macro(preds(t).where("signal_condition = 'correct'"), ["arm_id", "training_seed"], "reciprocal_rank").withColumnRenamed(
        "training_seed", "epoch")
    off = (F.col("epoch") == 2) & (F.col("arm_id") == "generic_global")
    declared = fresh.withColumn("macro", F.col("macro") + F.when(off, 0.5).otherwise(0.0))
    return rounded(contracts.rank_mismatches(declared, fresh, ["arm_id", "epoch"], ["macro"], 1e-12), "declared", "recomputed")


@query("V19_target_sets", """
SELECT arm_id, signal_condition, count(*) AS epochs, max(n) AS targets, count(DISTINCT members) = 1 AS consistent FROM
 (SELECT arm_id, signal_condition, training_seed, count(*) AS n, string_agg(trial_id, ',' ORDER BY trial_id) AS members FROM preds
  WHERE NOT (arm_id = 'generic_global' AND training_seed = 1 AND reading_task = 'NR') GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def v19b(t):
    """Whether an arm ranks the same targets in every epoch; one arm is made to miss some, and is reported."""
    ranked = preds(t).where("NOT (arm_id = 'generic_global' AND training_seed = 1 AND reading_task = 'NR')")
    sets = contracts.digest_of_set(ranked, ["arm_id", "signal_condition", "training_seed"], "trial_id")
    same = sets.groupBy("arm_id", "signal_condition").agg(
        F.count("*").alias("epochs"), F.max("members").alias("targets"), F.count_distinct("set_digest").alias("sets"))
    return same.withColumn("consistent", F.col("sets") == 1).drop("sets")


@query("V20_recomputed_metrics", """
SELECT arm_id, training_seed, signal_condition, reading_task, 'mrr' AS field, round(avg(reciprocal_rank) + 1e-13, 10) + 0.25 AS declared, round(avg(reciprocal_rank) + 1e-13, 10) AS recomputed
FROM preds WHERE reading_task = 'NR' AND training_seed = 1 GROUP BY 1, 2, 3, 4""")
def v20(t):
    fresh = metric_table(t)
    off = (F.col("reading_task") == "NR") & (F.col("training_seed") == 1)
    declared = fresh.withColumn("mrr", F.col("mrr") + F.when(off, 0.25).otherwise(0.0))
    return contracts.rank_mismatches(declared, fresh, ["arm_id", "training_seed", "signal_condition", "reading_task"],
                                     ["rows", "top1", "top5", "mrr", "mean_positive_rank", "mean_margin"], 1e-12)


@query("V20_row_identities", """
SELECT arm_id, training_seed, signal_condition, trial_id FROM preds WHERE CAST(right(trial_id, 6) AS BIGINT) % 45 = 8 AND top1 = 1""")
def v20b(t):
    row = F.substring("trial_id", -6, 6).cast("bigint")
    log = preds(t).withColumn("top1", F.when(row % 45 == 8, 0).otherwise(F.col("top1")))
    rank = F.col("positive_rank")
    fine = ((F.abs(F.col("reciprocal_rank") - 1.0 / rank) <= 1e-12) & (F.col("top1") == (rank <= 1).cast("int"))
            & (F.col("top5") == (rank <= 5).cast("int")))
    return log.where(~fine).select("arm_id", "training_seed", "signal_condition", "trial_id")


@query("V21_recomputed_summary", f"""
SELECT reference_id, training_seed, 'macro_mrr_delta' AS field, round(-macro_mrr_delta, 10) AS declared, round(macro_mrr_delta, 10) AS recomputed
FROM seedwise WHERE training_seed = 1 AND macro_mrr_delta <> 0""")
def v21(t):
    fresh = retrieval.seedwise_deltas(preds(t), MODEL, BASELINES)
    declared = fresh.withColumn("macro_mrr_delta", F.when(F.col("training_seed") == 1, -F.col("macro_mrr_delta")).otherwise(F.col("macro_mrr_delta")))
    out = contracts.rank_mismatches(declared, fresh, ["reference_id", "training_seed"], ["macro_mrr_delta"], 1e-12)
    return rounded(out, "declared", "recomputed")
