"""Projections, label handling, canonical records, audits."""

import hashlib

from pyspark.sql import functions as F

from trialloom.functions import keys, labels, text
from trialloom.functions.fixed_values import (
    INSTRUCTION_RELATIONS, NO_RELATION, RELATIONS, SENTIMENTS, TASK_PROMPTS, TYPO_BOOK,
)
from trialloom.operators import canonical, records
from trialloom.plans.record_views import (
    CONTENT_LABELS, RELATION_LABELS, factor_table, label_catalog, pick, record_table, source_frame, sql_clean,
    sql_list, sql_repair, sql_strip,
)
from trialloom.plans.registry import query
from trialloom.plans.tables import SEED, sql_hash, sql_ring


@query("S10_prediction_text", f"""
SELECT id, {sql_strip("list_extract(string_split(coalesce(p, ''), 'Target:'), -1)")} AS prediction, target
FROM (SELECT id, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE 'Length 5. Target: no. Target: ' || prediction END AS p, target
      FROM pairs)""")
def s10(t):
    raw = F.when(F.col("conv_id") % 7 != 0, F.concat(F.lit("Length 5. Target: no. Target: "), "prediction"))
    return t.pairs.select("id", text.after_marker(raw).alias("prediction"), "target")


@query("P01_rename_reorder", """
SELECT o_custkey AS subject, 'tpch' AS dataset, o_orderkey AS trial, o_totalprice AS score FROM orders""")
def p01(t):
    return t.raw("orders").withColumnsRenamed({"o_custkey": "subject", "o_orderkey": "trial", "o_totalprice": "score"}).drop(
        "o_orderstatus").select("subject", F.lit("tpch").alias("dataset"), "trial", "score")


_REPLACED = "text || ' emp11111ty 1839 ? May Maria '"
for _a, _b in TYPO_BOOK:
    _REPLACED = "replace({}, '{}', '{}')".format(_REPLACED, _a.replace("'", "''"), _b.replace("'", "''"))


@query("P02_ordered_replacement", f"SELECT doc_id, {_REPLACED} AS text FROM documents")
def p02(t):
    raw = F.concat("text", F.lit(" emp11111ty 1839 ? May Maria "))
    return t.raw("documents").select("doc_id", text.replace_in_order(raw, TYPO_BOOK).alias("text"))


@query("P03_clean_missing", f"SELECT row_idx, {sql_clean('surprisal')} AS surprisal, {sql_clean('semkey_sentiment_2')} AS sentiment FROM source_frame")
def p03(t):
    return source_frame(t).select("row_idx", text.clean(F.col("surprisal")).alias("surprisal"),
                                  text.clean(F.col("semkey_sentiment_2")).alias("sentiment"))


@query("P04_normalise_identity", "SELECT doc_id, norm, text_key FROM trials")
def p04(t):
    return t.trials.select("doc_id", "norm", "text_key")


@query("P05_normalise_display", f"SELECT row_idx, {sql_repair('input_text')} AS text FROM source_frame")
def p05(t):
    return source_frame(t).select("row_idx", text.repair(F.col("input_text")).alias("text"))


@query("P06_word_count", "SELECT doc_id, length FROM trials")
def p06(t):
    return t.raw("documents").select("doc_id", text.word_count(F.col("text")).alias("length")).where("length > 0")


@query("P07_canonical_label", """
SELECT trial_id, tsr_instruction_relation FROM records WHERE reading_task = 'TSR'""")
def p07(t):
    frame = source_frame(t).where("task = 'task3'")
    return frame.select(keys.trial_id(F.col("dataset"), F.col("task"), F.col("subject"), F.col("row_idx")).alias("trial_id"),
                        labels.canonical_label(F.col("relation_label")).alias("tsr_instruction_relation"))


@query("P08_merge_answer", """
SELECT id, CASE WHEN conv_id % 3 = 0 THEN replace(target || '...', '...', ' ' || prediction)
                WHEN conv_id % 3 = 1 THEN target || '? ' || prediction END AS label FROM pairs""")
def p08(t):
    question = F.when(F.col("conv_id") % 3 == 0, F.concat("target", F.lit("..."))).when(
        F.col("conv_id") % 3 == 1, F.concat("target", F.lit("?")))
    return t.pairs.select("id", text.merge_answer(question, F.col("prediction")).alias("label"))


@query("P09_control_flag", """
SELECT event_id, event_type = 'error' AS control FROM events""")
def p09(t):
    label = F.when(F.col("event_type") == "error", "CONTROL").otherwise("AWARD")
    checked = F.when(label.isin(INSTRUCTION_RELATIONS), label == "CONTROL").otherwise(
        F.raise_error(F.lit("label outside its domain")).cast("boolean"))
    return t.raw("events").select("event_id", checked.alias("control"))


@query("P10_trial_id", """
SELECT CASE WHEN c_custkey % 9 = 0 THEN 'given-' || c_custkey
            ELSE format('{}::{}::{}::row{:06d}', c_mktsegment, 'task1', 'n' || c_nationkey, c_custkey) END AS trial_id
FROM customer""")
def p10(t):
    given = F.when(F.col("c_custkey") % 9 == 0, F.concat(F.lit("given-"), F.col("c_custkey").cast("string")))
    made = keys.trial_id(F.col("c_mktsegment"), F.lit("task1"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")),
                         F.col("c_custkey"))
    return t.raw("customer").select(F.coalesce(given, made).alias("trial_id"))


SOURCE, SHARD_ROWS = "documents.parquet", 128
SOURCE_DIGEST = hashlib.sha256(SOURCE.encode()).hexdigest()


@query("P10_record_provenance", f"""
SELECT trial_id, '{SOURCE_DIGEST}' AS source_dataframe_sha256, '{SOURCE}#row=' || source_dataframe_row_index AS eeg_locator,
       format('shards/shard_{{:05d}}.npz#offset={{}}', p // {SHARD_ROWS}, p % {SHARD_ROWS}) AS shard_locator
FROM (SELECT *, row_number() OVER (ORDER BY source_dataframe_row_index) - 1 AS p FROM records)""")
def p10b(t):
    """The digest stands for the one that a source manifest names."""
    return records.with_provenance(record_table(t), SOURCE, SOURCE_DIGEST, SHARD_ROWS).select(
        "trial_id", "source_dataframe_sha256", "eeg_locator", "shard_locator")


@query("P11_cohort", "SELECT trial_id, cohort FROM records")
def p11(t):
    return source_frame(t).select(
        keys.trial_id(F.col("dataset"), F.col("task"), F.col("subject"), F.col("row_idx")).alias("trial_id"),
        keys.cohort(F.col("dataset"), F.col("task")).alias("cohort"))


@query("P12_scoped_labels", """
SELECT trial_id, reading_task, sr_sentiment_3, nr_relation_content, tsr_instruction_relation FROM records""")
def p12(t):
    return record_table(t).select("trial_id", "reading_task", "sr_sentiment_3", "nr_relation_content",
                                  "tsr_instruction_relation")


@query("P13_availability_masks", """
SELECT trial_id, mask_sr_sentiment_3, mask_nr_relation_content, mask_tsr_instruction_relation, mask_gpt2_mean_nll_v1,
       mask_semkey_sentiment_2, mask_topic_label FROM records""")
def p13(t):
    return record_table(t).select(
        "trial_id", "mask_sr_sentiment_3", "mask_nr_relation_content", "mask_tsr_instruction_relation",
        "mask_gpt2_mean_nll_v1", "mask_semkey_sentiment_2", "mask_topic_label")


@query("P14_stable_hash", f"""
SELECT l_orderkey, l_linenumber, l_partkey, {sql_hash(SEED, "l_orderkey", "l_partkey", "'row'")} AS digest FROM lineitem""")
def p14(t):
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", keys.stable_hash(
        SEED, F.col("l_orderkey"), F.col("l_partkey"), "row").alias("digest"))


@query("P15_hash_seed", f"""
SELECT o_orderkey, CAST(('0x' || substr(h, 1, 8)) AS BIGINT) AS prefix8, {sql_ring(SEED, "o_orderkey", "'seed'")} AS prefix15,
       CAST(CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 2 AS INTEGER) AS parity
FROM (SELECT o_orderkey, {sql_hash(SEED, "o_orderkey", "'seed'")} AS h FROM orders)""")
def p15(t):
    parts = (SEED, F.col("o_orderkey"), "seed")
    return t.raw("orders").select(
        "o_orderkey", keys.hex_to_long(keys.stable_hash(*parts), 8).alias("prefix8"),
        keys.ring_hash(*parts).alias("prefix15"), keys.hash_parity(*parts).alias("parity"))


SQL_STRATUM = """CASE WHEN length <= 5 THEN '0-5' WHEN length <= 10 THEN '6-10' WHEN length <= 15 THEN '11-15'
 WHEN length <= 20 THEN '16-20' WHEN length <= 30 THEN '21-30' ELSE '31+' END"""


@query("P16_length_stratum", f"SELECT doc_id, {SQL_STRATUM} AS stratum FROM trials")
def p16(t):
    return t.trials.select("doc_id", keys.length_stratum(F.col("length")).alias("stratum"))


@query("P17_task_prompts", """
SELECT row_idx, CASE WHEN task = 'task3' THEN '<TSR>' ELSE '<NR>' END AS released,
       CASE task WHEN 'task1' THEN '<SR>' WHEN 'task2' THEN '<NR>' ELSE '<TSR>' END AS canonical, dataset, subject
FROM source_frame""")
def p17(t):
    task = F.col("task")
    return source_frame(t).select(
        "row_idx", labels.lookup(task, TASK_PROMPTS["released"], "task").alias("released"),
        labels.lookup(task, TASK_PROMPTS["canonical"], "task").alias("canonical"), "dataset", "subject")


@query("P18_prompt_template", """
SELECT trial_id, 'System: Based on the following EEG signals, reconstruct the text. The length of the sentence is ' ||
 length_words_whitespace_v1 || '.0 words. The average surprisal value is ' || (length_words_whitespace_v1 % 10) || '.50. Sentiment: ' ||
 coalesce(sr_sentiment_3, 'neutral') || '. Topic: ' || topic_label || '. This EEG signal comes from ' || dataset_version || ' ' ||
 raw_task || ' subject ' || subject_id || '. Target: ' AS prompt_all,
 'System: Based on the following EEG signals, reconstruct the text. Topic: ' || topic_label || '. Target: ' AS prompt_topic
FROM records""")
def p18(t):
    length, sentiment = F.col("length_words_whitespace_v1"), F.coalesce("sr_sentiment_3", F.lit("neutral"))
    surprisal = length % 10 + 0.5
    return record_table(t).select(
        "trial_id", text.prompt("default", length, surprisal, sentiment, F.col("topic_label"), F.col("dataset_version"),
                                F.col("raw_task"), F.col("subject_id")).alias("prompt_all"),
        text.prompt("topic", length, surprisal, sentiment, F.col("topic_label")).alias("prompt_topic"))


_KNOWN = "(" + ", ".join(f"'{x}'" for x in [*RELATIONS, NO_RELATION]) + ")"
RAW_SETS = [*CONTENT_LABELS, "wife;WIFE", "no-relation; award", "painter", " ; "]


@query("P19_multi_label_parse", f"""
SELECT row_idx, array_to_string(atoms, ';') AS atoms,
       CASE WHEN len(atoms) = 0 THEN 'empty' WHEN len(list_distinct(atoms)) < len(atoms) THEN 'repeated'
            WHEN list_contains(atoms, 'NO-RELATION') AND len(atoms) > 1 THEN 'exclusive'
            WHEN len(list_filter(atoms, lambda x: x NOT IN {_KNOWN})) > 0 THEN 'unknown' END AS problem
FROM (SELECT row_idx, list_sort(list_filter(list_transform(string_split(({sql_list(RAW_SETS)})[1 + row_idx % {len(RAW_SETS)}], ';'),
      lambda x: upper(trim(x))), lambda x: x <> '')) AS atoms FROM source_frame)""")
def p19(t):
    atoms = labels.label_atoms(pick(RAW_SETS, F.col("row_idx") % len(RAW_SETS)))
    return source_frame(t).select("row_idx", atoms.alias("a")).select(
        "row_idx", F.array_join("a", ";").alias("atoms"), labels.atoms_problem(F.col("a"), RELATIONS).alias("problem"))


@query("P20_typed_targets", f"""
SELECT trial_id, factor_id,
 CAST(CASE factor_id WHEN 'sr_sentiment_3' THEN list_position({sql_list(SENTIMENTS)}, target_value) - 1
      WHEN 'tsr_instruction_relation' THEN list_position({sql_list(INSTRUCTION_RELATIONS)}, target_value) - 1 END AS INTEGER) AS class_index,
 CASE WHEN target_type = 'multilabel' THEN array_to_string(list_transform({sql_list([*RELATIONS, NO_RELATION])},
      lambda x: CASE WHEN list_contains(string_split(target_value, ';'), x) THEN '1' ELSE '0' END), '') END AS multi_hot,
 CASE WHEN target_type = 'regression' THEN CAST(target_value AS DOUBLE) END AS number FROM factor_table""")
def p20(t):
    return records.typed_targets(factor_table(t))


@query("P21_class_index", f"""
SELECT event_id, CAST(coalesce(list_position(['Click', 'view', 'SIGNUP'], event_type), list_position(['click', 'view', 'signup'], event_type), 0) - 1 AS INTEGER) AS idx FROM events""")
def p21(t):
    return t.raw("events").select("event_id", labels.class_index(F.col("event_type"), ["Click", "view", "SIGNUP"]).alias("idx"))


def preferred(df, name: str):
    """The predicted column if the table has one, else the plain one."""
    return F.col(f"pred_{name}" if f"pred_{name}" in df.columns else name)


@query("P22_preferred_column", """
SELECT doc_id, 1 - quality AS quality, toxic FROM labels""")
def p22(t):
    table = t.raw("labels").withColumn("pred_quality", 1 - F.col("quality"))
    return table.select("doc_id", *[preferred(table, c).alias(c) for c in ("quality", "toxic")])


@query("P23_cohort_filter", """
SELECT trial_id, cohort, split FROM records
WHERE split = 'train' AND cohort = 'primary_zuco2_nr_tsr' AND dataset_version = 'ZuCo2' AND reading_task IN ('NR', 'TSR')""")
def p23(t):
    return record_table(t).where(
        (F.col("split") == "train") & (F.col("cohort") == "primary_zuco2_nr_tsr") & (F.col("dataset_version") == "ZuCo2")
        & F.col("reading_task").isin("NR", "TSR")).select("trial_id", "cohort", "split")


@query("P24_strict_casts", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id END AS number,
       CASE WHEN event_id % 3 = 0 THEN true WHEN event_id % 3 = 1 THEN false END AS flag,
       CASE WHEN event_id % 5 <> 0 THEN value END AS finite, event_id % 2 = 0 AS digest_ok FROM events""")
def p24(t):
    e = F.col("event_id")
    raw_int = F.when(e % 4 == 0, "12.5").otherwise(e.cast("string"))
    raw_flag = F.when(e % 3 == 0, " TRUE").when(e % 3 == 1, "0").otherwise("yes")
    raw_float = F.when(e % 5 == 0, "Infinity").otherwise(F.col("value").cast("string"))
    raw_digest = F.when(e % 2 == 0, F.sha2(e.cast("string"), 256)).otherwise(F.md5(e.cast("string")))
    return t.raw("events").select(
        "event_id", labels.parse_int(raw_int).alias("number"), labels.parse_bool(raw_flag).alias("flag"),
        labels.parse_finite(raw_float).alias("finite"), labels.parse_digest(raw_digest).isNotNull().alias("digest_ok"))


@query("P28_json_digest", """
SELECT doc_id, sha256(to_json({'n_chars': CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END, 'reading_task': lang, 'subject_id': source})::VARCHAR) AS digest
FROM documents""")
def p28(t):
    """Fields in name order; a missing value is written as null, so it differs from a field that is not there."""
    payload = F.to_json(F.struct("n_chars", "reading_task", "subject_id"), {"ignoreNullFields": "false"})
    frame = t.raw("documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("n_chars"), F.col("lang").alias("reading_task"),
                                      F.col("source").alias("subject_id"))
    return frame.select("doc_id", F.sha2(payload, 256).alias("digest"))


@query("A01_factorize", """
SELECT doc_id, dense_rank() OVER (ORDER BY first_doc) - 1 AS uid
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc FROM documents)""")
def a01(t):
    docs = t.raw("documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return docs.join(canonical.factorize(docs, "key", "doc_id"), "key").select("doc_id", "uid")


@query("A02_grouped_counts", """
SELECT split, reading_task, cohort, count(*) AS rows FROM records GROUP BY CUBE (split, reading_task, cohort)""")
def a02(t):
    return record_table(t).cube("split", "reading_task", "cohort").agg(F.count("*").alias("rows"))


@query("A03_leakage_audit", """
SELECT (SELECT count(DISTINCT trial_id) FROM leaky_trials) AS unique_trial_ids,
       (SELECT count(*) FROM (SELECT trial_id FROM leaky_trials GROUP BY 1 HAVING count(*) > 1)) AS repeated_trial_ids,
       count(*) AS crossing_texts, CAST(coalesce(sum(n), 0) AS BIGINT) AS crossing_rows
FROM (SELECT text_key, count(*) AS n FROM leaky_trials GROUP BY text_key HAVING count(DISTINCT split) > 1)""")
def a03(t):
    return canonical.leakage_audit(t.leaky_trials)


@query("A03_leaking_texts", """
SELECT text_key, min(split) AS first_split, max(split) AS last_split, count(*) AS rows
FROM leaky_trials GROUP BY text_key HAVING count(DISTINCT split) > 1""")
def a03b(t):
    return canonical.split_overlaps(t.leaky_trials, "text_key")


@query("A04_catalog_members", """SELECT DISTINCT candidate_id, substr(text_key, 1, 12) AS text_uid FROM trials""")
def a04b(t):
    return canonical.catalog_members(t.trials, F.substring("text_key", 1, 12), "text_uid")


@query("A04_catalog_collisions", """
SELECT candidate_id, 'text_key' AS attribute, min(text_key) AS low, max(text_key) AS high
FROM (SELECT substr(text_key, 1, 3) AS candidate_id, text_key FROM trials) GROUP BY 1 HAVING count(DISTINCT text_key) > 1""")
def a04c(t):
    return canonical.single_valued(t.trials.withColumn("candidate_id", F.substring("text_key", 1, 3)), ["candidate_id"], ["text_key"])


@query("A05_dependency_conflicts", """
SELECT text_key, count(DISTINCT subject_id) AS "values", min(subject_id) AS low, max(subject_id) AS high
FROM trials GROUP BY text_key HAVING count(DISTINCT subject_id) > 1""")
def a05(t):
    return canonical.dependency_conflicts(t.trials, "text_key", "subject_id")


@query("A06_text_dictionary", """
SELECT text_key, min(trial_id) AS representative_trial_id, arg_min(text, trial_id) AS text, arg_min(length, trial_id) AS length,
       count(DISTINCT reading_task) AS tasks, count(*) AS trials FROM trials GROUP BY text_key""")
def a06(t):
    return canonical.text_dictionary(t.trials)


@query("A06_trial_map", "SELECT trial_id, text_key FROM trials")
def a06b(t):
    return t.trials.select("trial_id", "text_key")


@query("A07_cross_context_duplicates", """
SELECT text_uid, array_to_string(list_sort(list(DISTINCT reading_task)), '|') AS contexts,
       count(DISTINCT reading_task) AS context_count, count(*) AS trial_count, min(split) AS first_split, max(split) AS last_split,
       min(trial_id) AS first_trial_id FROM records GROUP BY text_uid HAVING count(DISTINCT reading_task) >= 2""")
def a07(t):
    out = canonical.cross_context_duplicates(record_table(t), "text_uid", "reading_task")
    return out.withColumn("trial_count", F.col("trial_count").cast("bigint"))


@query("A08_subject_folds", """
SELECT 'loso::' || subject_id AS fold_id, subject_id AS held_out_subject_id, tt AS training_rows_total, ex AS training_rows_excluded,
       tt - ex AS training_rows_eligible, vt AS evaluation_rows_total, ev AS evaluation_rows_eligible
FROM (SELECT subject_id, count(*) FILTER (split = 'train') AS ex, count(*) FILTER (split = 'val') AS ev,
             CAST(sum(count(*) FILTER (split = 'train')) OVER () AS BIGINT) AS tt,
             CAST(sum(count(*) FILTER (split = 'val')) OVER () AS BIGINT) AS vt
      FROM records GROUP BY subject_id) WHERE ev > 0""")
def a08(t):
    return records.subject_folds(record_table(t))


@query("A09_factor_fold_coverage", """
, folds AS (SELECT 'ordinary' AS fold_id, '' AS s UNION ALL SELECT DISTINCT 'loso::' || subject_id, subject_id FROM factor_table WHERE split = 'val'),
f AS (SELECT fold_id, s, factor_id, target_type, a.split, a.trial_id, a.target_atoms FROM folds
      JOIN factor_table a ON (a.split = 'train' AND a.subject_id <> s) OR (a.split = 'val' AND (s = '' OR a.subject_id = s))),
grid AS (SELECT fold_id, s, factor_id, target_type FROM folds, (SELECT DISTINCT factor_id, target_type FROM factor_table WHERE split IN ('train', 'val'))),
n AS (SELECT fold_id, factor_id, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'val') AS va FROM f GROUP BY 1, 2),
atm AS (SELECT fold_id, factor_id, count(DISTINCT atom) FILTER (split = 'train') AS ta, count(DISTINCT atom) FILTER (split = 'val') AS va
       FROM (SELECT *, unnest(string_split(target_atoms, ';')) AS atom FROM f WHERE target_type <> 'regression') GROUP BY 1, 2),
c AS (SELECT g.fold_id, g.s AS held_out_subject_id, g.factor_id, g.target_type, coalesce(n.tr, 0) AS train_rows, coalesce(n.va, 0) AS val_rows,
      CASE WHEN g.target_type <> 'regression' THEN coalesce(atm.ta, 0) END AS train_atoms,
      CASE WHEN g.target_type <> 'regression' THEN coalesce(atm.va, 0) END AS val_atoms,
      FROM grid g LEFT JOIN n USING (fold_id, factor_id) LEFT JOIN atm USING (fold_id, factor_id))
SELECT *, CAST(coalesce(train_atoms, train_rows) >= 2 AS INTEGER) AS fit_viable, CAST(val_rows > 0 AS INTEGER) AS evaluation_available,
       CAST(coalesce(train_atoms, train_rows) >= 2 AND val_rows > 0 AS INTEGER) AS fold_included FROM c""")
def a09(t):
    return records.factor_fold_coverage(factor_table(t))


@query("J20_label_propagation", """
SELECT trial_id, nr_relation_content FROM records WHERE raw_task = 'task2' AND dataset_version = 'ZuCo1'""")
def j20(t):
    frame = source_frame(t).where("task = 'task2' and dataset = 'ZuCo1'").select(
        keys.trial_id(F.col("dataset"), F.col("task"), F.col("subject"), F.col("row_idx")).alias("trial_id"),
        text.repair(F.col("input_text")).alias("norm_text"))
    return canonical.propagate_labels(frame, label_catalog(t), "norm_text", "relation_types", "report").select(
        "trial_id", F.col("relation_types").alias("nr_relation_content"))


@query("U03_factor_rows", "SELECT * FROM factor_table")
def u03(t):
    return factor_table(t)


@query("W08_group_constant", """
SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, CASE WHEN lo = hi THEN lo END AS group_label, coalesce(lo <> hi, false) AS group_conflict FROM
 (SELECT *, min(l_returnflag) FILTER (l_returnflag <> 'N') OVER (PARTITION BY l_orderkey) AS lo,
         max(l_returnflag) FILTER (l_returnflag <> 'N') OVER (PARTITION BY l_orderkey) AS hi FROM lineitem)""")
def w08(t):
    out = canonical.group_constant(t.raw("lineitem"), "l_orderkey", "l_returnflag", "N", conflicts="report")
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "group_label", "group_conflict")
