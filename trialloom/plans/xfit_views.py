"""Cross-fitted worlds: documents read under two tasks (``xfit``), and the vector trials with donors and pools."""

from pyspark.sql import DataFrame, functions as F

from trialloom.functions import keys
from trialloom.operators import pools, reshape, splits
from trialloom.plans.tables import FOLDS, POOL, SEED, VIEWS, Tables, sql_hash, sql_ring, sql_ring_gap

SQL_STRATUM = """CASE WHEN length <= 5 THEN '0-5' WHEN length <= 10 THEN '6-10' WHEN length <= 15 THEN '11-15'
 WHEN length <= 20 THEN '16-20' WHEN length <= 30 THEN '21-30' ELSE '31+' END"""

VIEWS["doc_rows"] = """
SELECT trial_id, subject_id, text_key, length, CASE WHEN doc_id % 2 = 0 THEN 'NR' ELSE 'TSR' END AS reading_task FROM trials
"""
VIEWS["doc_folds"] = f"""
SELECT text_key, CAST(CASE WHEN (p // {FOLDS}) % 2 = 0 THEN p % {FOLDS} ELSE {FOLDS} - 1 - p % {FOLDS} END AS INTEGER) AS fold, rows, task_mix
FROM (SELECT *, row_number() OVER (PARTITION BY task_mix ORDER BY rows DESC, {sql_ring(SEED, "text_key", "'group-order'")}, text_key) - 1 AS p
      FROM (SELECT text_key, count(*) AS rows, array_to_string(list_sort(list(DISTINCT reading_task)), '+') AS task_mix
            FROM doc_rows GROUP BY text_key))
"""
VIEWS["doc_pseudo"] = f"""
SELECT reading_task, text_key, length, stratum, CAST((row_number() OVER (PARTITION BY reading_task, stratum ORDER BY
         {sql_hash(SEED, "reading_task", "text_key", "stratum", "'pseudo-order'")}, text_key) - 1
       + CAST(('0x' || substr({sql_hash(SEED, "reading_task", "stratum", "'pseudo-offset'")}, 1, 8)) AS BIGINT) % 2) % 2 AS INTEGER) AS pseudo_group
FROM (SELECT *, {SQL_STRATUM} AS stratum FROM (SELECT reading_task, text_key, min(length) AS length FROM doc_rows GROUP BY 1, 2))
"""
VIEWS["xfit"] = """
SELECT r.*, f.fold AS text_fold, p.pseudo_group FROM doc_rows r JOIN doc_folds f USING (text_key)
JOIN doc_pseudo p USING (reading_task, text_key)
"""
VIEWS["xfit_roles"] = f"""
SELECT x.*, outer_fold, CASE WHEN text_fold = outer_fold THEN 'confirmation'
       WHEN text_fold = (outer_fold + 1) % {FOLDS} THEN 'checkpoint' ELSE 'fit' END AS role
FROM xfit x, (SELECT CAST(unnest(range({FOLDS})) AS INTEGER) AS outer_fold)
"""


def doc_rows(t: Tables) -> DataFrame:
    task = F.when(F.col("doc_id") % 2 == 0, "NR").otherwise("TSR")
    return t.trial_keys.select("trial_id", "subject_id", "text_key", "length", task.alias("reading_task"))


def doc_folds(t: Tables) -> DataFrame:
    return splits.balanced_folds(doc_rows(t), "text_key", "reading_task", FOLDS, SEED)


def doc_pseudo(t: Tables) -> DataFrame:
    return splits.pseudo_groups(doc_rows(t), "reading_task", "text_key", "length", SEED)


def xfit(t: Tables) -> DataFrame:
    folds = doc_folds(t).select("text_key", F.col("fold").alias("text_fold"))
    pseudo = doc_pseudo(t).select("reading_task", "text_key", "pseudo_group")
    return doc_rows(t).join(folds, "text_key").join(pseudo, ["reading_task", "text_key"])


def xfit_roles(t: Tables) -> DataFrame:
    return reshape.outer_assignments(t.shared("xfit", lambda: xfit(t)), FOLDS)


# --- vector trials: donors and pools inside the confirmation and checkpoint partitions ---------------------------

_DONOR_SCOPE = "text_fold || '|' || dataset_version || '|' || reading_task || '|' || subject_id"
VIEWS["vec_scoped"] = f"""
SELECT *, {sql_ring(SEED, "trial_id", "'donor'")} AS trial_ring,
       {sql_ring(SEED, _DONOR_SCOPE, "text_key", "'donor'", "'text'")} AS text_ring FROM vec_trials
"""
VIEWS["vec_donors"] = f"""
SELECT t.text_fold AS outer_fold, t.dataset_version, t.reading_task, t.subject_id, t.trial_id AS target_id, d.trial_id AS donor_id,
       t.text_key AS target_text_key, d.text_key AS donor_text_key, t.length AS target_length, d.length AS donor_length, abs(d.length - t.length) AS gap
FROM vec_scoped t JOIN vec_scoped d ON d.text_fold = t.text_fold AND d.dataset_version = t.dataset_version
     AND d.reading_task = t.reading_task AND d.subject_id = t.subject_id AND d.text_key <> t.text_key
QUALIFY row_number() OVER (PARTITION BY t.trial_id ORDER BY abs(d.length - t.length), {sql_ring_gap("d.text_ring", "t.trial_ring")},
        d.text_key, {sql_ring_gap("d.trial_ring", "t.trial_ring")}, d.trial_id) = 1
"""


def vec_donors(t: Tables) -> DataFrame:
    return t.shared("vec_donors", lambda: _vec_donors(t))


def _vec_donors(t: Tables) -> DataFrame:
    trials = t.vec_trials.select("trial_id", "text_key", "length", "text_fold", "dataset_version", "reading_task", "subject_id")
    found = pools.matched_donors(trials, ["text_fold", "dataset_version", "reading_task", "subject_id"], SEED, "donor")
    own = trials.select(F.col("trial_id").alias("target_id"), F.col("text_key").alias("target_text_key"))
    return found.withColumnRenamed("text_fold", "outer_fold").join(own, "target_id")


VIEWS["vec_partitions"] = f"""
SELECT 'confirmation' AS partition, text_fold AS outer_fold, v.* FROM vec_trials v
UNION ALL SELECT 'checkpoint', (text_fold + {FOLDS - 1}) % {FOLDS}, v.* FROM vec_trials v
"""
VIEWS["vec_targets"] = f"""
SELECT p.partition, p.outer_fold, p.trial_id AS target_id, p.text_key AS positive_id, p.dataset_version, p.reading_task, p.subject_id,
       p.length AS target_length, CASE WHEN p.partition = 'confirmation' THEN d.donor_text_key END AS donor_candidate_id,
       CASE WHEN p.partition = 'confirmation' THEN d.donor_id END AS donor_id, p.outer_fold || '|' || p.partition AS scope
FROM vec_partitions p LEFT JOIN vec_donors d ON d.target_id = p.trial_id
"""
VIEWS["vec_pools"] = f"""
SELECT *, CAST(row_number() OVER (PARTITION BY outer_fold, partition, target_id ORDER BY
       {sql_hash(SEED, "scope", "target_id", "candidate_id", "'pool-order'")}, candidate_id) - 1 AS INTEGER) AS candidate_rank
FROM (SELECT t.*, c.candidate_id, c.candidate_length, abs(c.candidate_length - t.target_length) AS gap,
             CAST(c.candidate_id = t.positive_id AS INTEGER) AS is_positive,
             CAST(coalesce(c.candidate_id = t.donor_candidate_id, false) AS INTEGER) AS is_donor_text
      FROM vec_targets t JOIN (SELECT DISTINCT partition, outer_fold, reading_task, text_key AS candidate_id, length AS candidate_length
                               FROM vec_partitions) c
           ON c.partition = t.partition AND c.outer_fold = t.outer_fold AND c.reading_task = t.reading_task
      QUALIFY row_number() OVER (PARTITION BY t.outer_fold, t.partition, t.target_id ORDER BY
              (c.candidate_id = t.positive_id OR coalesce(c.candidate_id = t.donor_candidate_id, false)) DESC,
              abs(c.candidate_length - t.target_length),
              {sql_ring_gap(sql_ring(SEED, "t.scope", "c.candidate_id", "'pool-select'"),
                            sql_ring(SEED, "t.scope", "t.target_id", "'pool-select'"))}, c.candidate_id) <= {POOL})
"""


def vec_partitions(t: Tables) -> DataFrame:
    trials = t.vec_trials.drop("vector")
    parts = reshape.each(trials, "partition", ["confirmation", "checkpoint"])
    return parts.withColumn("outer_fold", F.when(F.col("partition") == "confirmation", F.col("text_fold")).otherwise(
        F.pmod(F.col("text_fold") + FOLDS - 1, F.lit(FOLDS))))


def vec_targets(t: Tables) -> DataFrame:
    donors = vec_donors(t).select("target_id", "donor_id", F.col("donor_text_key").alias("donor_candidate_id"),
                                  F.lit("confirmation").alias("partition"))
    targets = vec_partitions(t).select(
        "partition", "outer_fold", F.col("trial_id").alias("target_id"), F.col("text_key").alias("positive_id"),
        "dataset_version", "reading_task", "subject_id", F.col("length").alias("target_length"))
    return targets.join(donors, ["partition", "target_id"], "left")


def vec_pools(t: Tables) -> DataFrame:
    return t.shared("vec_pools", lambda: _vec_pools(t))


def _vec_pools(t: Tables) -> DataFrame:
    catalog = vec_partitions(t).groupBy("outer_fold", "partition", "reading_task", F.col("text_key").alias("candidate_id")).agg(
        F.min("length").alias("candidate_length"))
    scope = F.concat_ws("|", "outer_fold", "partition")
    return pools.candidate_pools(t.shared("vec_targets", lambda: vec_targets(t)), catalog, ["outer_fold", "partition", "reading_task"], POOL, SEED, scope)
