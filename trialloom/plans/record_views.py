"""A labelled source frame (and its canonical records) derived from ``documents``."""

from pyspark.sql import DataFrame, functions as F

from trialloom.functions import keys, text
from trialloom.functions.fixed_values import INSTRUCTION_RELATIONS, RELATION_ALIASES, TYPO_BOOK
from trialloom.operators import records
from trialloom.plans.tables import SEED, VIEWS, Tables, sql_ring

SENTIMENT_LABELS = [" neutral", "positive ", "negative"]
RELATION_LABELS = ["awarding", "job title", "WIFE", "CONTROL", "political-affiliation", "marriage", "Visit"]
CONTENT_LABELS = ["education; award", "NO-RELATION", "FOUNDER", "job_title;wife; Visited", "nan"]


def pick(options: list[str], position) -> "F.Column":
    return F.element_at(F.array(*[F.lit(o) for o in options]), (position + 1).cast("int"))


def sql_list(options) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def sql_clean(x: str) -> str:
    return f"CASE WHEN lower({sql_strip(x)}) NOT IN ('', 'nan', 'none', 'null', 'na') THEN {sql_strip(x)} END"


def sql_repair(x: str) -> str:
    out = f"replace({sql_clean(x)}, chr(65279), '')"
    for a, b in TYPO_BOOK:
        out = "replace({}, '{}', '{}')".format(out, a.replace("'", "''"), b.replace("'", "''"))
    return f"array_to_string(list_filter(string_split_regex({out}, '\\s+'), lambda w: w <> ''), ' ')"


def source_frame(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    third = F.floor(doc / 3)
    norm = text.fold_case(F.col("text"))
    place = F.pmod(keys.ring_hash(SEED, F.sha2(norm, 256), "split"), F.lit(100))
    return t.raw("documents").select(
        doc.alias("row_idx"), F.when(doc % 2 == 0, "ZuCo1").otherwise("ZuCo2").alias("dataset"),
        F.concat(F.lit("task"), (1 + doc % 3).cast("string")).alias("task"), F.col("source").alias("subject"),
        F.when(place < 70, "train").when(place < 80, "val").otherwise("test").alias("phase"),
        F.concat(F.lit(" Maria "), F.col("text"), F.lit(" film.1 – ")).alias("input_text"),
        F.substring(F.sha2(norm, 256), 1, 12).alias("text_uid"),
        pick(SENTIMENT_LABELS, third % 3).alias("sentiment_label"),
        pick(RELATION_LABELS, third % 7).alias("relation_label"),
        F.when(doc % 4 == 0, "none").otherwise("positive").alias("semkey_sentiment_2"),
        F.col("lang").alias("topic_label"),
        F.when(doc % 5 == 0, "NaN").otherwise(F.col("n_chars").cast("string")).alias("surprisal"))


VIEWS["source_frame"] = f"""
SELECT doc_id AS row_idx, CASE WHEN doc_id % 2 = 0 THEN 'ZuCo1' ELSE 'ZuCo2' END AS dataset,
       'task' || (1 + doc_id % 3) AS task, source AS subject,
       CASE WHEN sp < 70 THEN 'train' WHEN sp < 80 THEN 'val' ELSE 'test' END AS phase,
       ' Maria ' || text || ' film.1 – ' AS input_text, substr(dig, 1, 12) AS text_uid,
       ({sql_list(SENTIMENT_LABELS)})[1 + (doc_id // 3) % 3] AS sentiment_label,
       ({sql_list(RELATION_LABELS)})[1 + (doc_id // 3) % 7] AS relation_label,
       CASE WHEN doc_id % 4 = 0 THEN 'none' ELSE 'positive' END AS semkey_sentiment_2, lang AS topic_label,
       CASE WHEN doc_id % 5 = 0 THEN 'NaN' ELSE CAST(n_chars AS VARCHAR) END AS surprisal
FROM (SELECT *, {sql_ring(SEED, "dig", "'split'")} % 100 AS sp FROM
      (SELECT *, sha256(array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''), ' '))
       AS dig FROM documents))
"""


def label_catalog(t: Tables) -> DataFrame:
    """Content relations by repaired text; some texts carry conflicting ones."""
    frame = source_frame(t).where("task = 'task2' and dataset = 'ZuCo1'")
    return frame.select(
        text.repair(F.col("input_text")).alias("norm_text"),
        text.clean(pick(CONTENT_LABELS, F.floor(F.col("row_idx") / 6) % 5)).alias("relation_types")).distinct()


VIEWS["label_catalog"] = f"""
SELECT DISTINCT norm_text, {sql_clean("rel")} AS relation_types FROM
  (SELECT {sql_repair("input_text")} AS norm_text, ({sql_list(CONTENT_LABELS)})[1 + (row_idx // 6) % 5] AS rel
   FROM source_frame WHERE task = 'task2' AND dataset = 'ZuCo1')
"""
VIEWS["agreed_labels"] = """
SELECT norm_text, min(relation_types) AS relation_types FROM label_catalog GROUP BY norm_text
HAVING min(relation_types) = max(relation_types)
"""
_ALIAS_CASE = "CASE lower(rl) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RELATION_ALIASES.items()) + " END"
_IN_ONTOLOGY = "(" + ", ".join(f"'{x}'" for x in INSTRUCTION_RELATIONS) + ")"
VIEWS["records"] = f"""
SELECT dataset AS dataset_version, CASE task WHEN 'task1' THEN 'SR' WHEN 'task2' THEN 'NR' ELSE 'TSR' END AS reading_task,
       task AS raw_task, subject AS subject_id, text_uid, format('{{}}::{{}}::{{}}::row{{:06d}}', dataset, task, subject, row_idx) AS trial_id,
       phase AS split, CASE WHEN dataset = 'ZuCo2' AND task IN ('task2', 'task3') THEN 'primary_zuco2_nr_tsr'
            WHEN task = 'task1' THEN 'auxiliary_sr' ELSE 'zuco1_nr_tsr_noncausal' END AS cohort,
       text, row_idx AS source_dataframe_row_index,
       sr_sentiment_3, nr_relation_content, tsr_instruction_relation,
       CAST(sr_sentiment_3 IS NOT NULL AS INTEGER) AS mask_sr_sentiment_3,
       CAST(nr_relation_content IS NOT NULL AS INTEGER) AS mask_nr_relation_content,
       CAST(tsr_instruction_relation IS NOT NULL AS INTEGER) AS mask_tsr_instruction_relation,
       CAST(len(list_filter(string_split_regex(raw_text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS length_words_whitespace_v1,
       surprisal AS gpt2_mean_nll_v1, CAST(surprisal IS NOT NULL AS INTEGER) AS mask_gpt2_mean_nll_v1,
       semkey_sentiment_2, CAST(semkey_sentiment_2 IS NOT NULL AS INTEGER) AS mask_semkey_sentiment_2,
       topic_label, CAST(topic_label IS NOT NULL AS INTEGER) AS mask_topic_label
FROM (SELECT f.* EXCLUDE (text_uid, topic_label, surprisal, semkey_sentiment_2), {sql_clean("f.text_uid")} AS text_uid,
             {sql_clean("f.topic_label")} AS topic_label, {sql_clean("f.surprisal")} AS surprisal,
             {sql_clean("f.semkey_sentiment_2")} AS semkey_sentiment_2, {sql_clean("f.input_text")} AS raw_text,
             f.norm_text AS text,
             CASE WHEN task = 'task1' THEN {sql_clean("sentiment_label")} END AS sr_sentiment_3,
             CASE WHEN dataset = 'ZuCo1' AND task = 'task2' THEN l.relation_types END AS nr_relation_content,
             CASE WHEN task = 'task3' THEN CASE WHEN replace(upper(rl), '-', '_') IN {_IN_ONTOLOGY}
                  THEN replace(upper(rl), '-', '_') ELSE {_ALIAS_CASE} END END AS tsr_instruction_relation
      FROM (SELECT *, {sql_repair("input_text")} AS norm_text, {sql_clean("relation_label")} AS rl FROM source_frame) f
      LEFT JOIN agreed_labels l ON l.norm_text = f.norm_text)
"""


def record_table(t: Tables) -> DataFrame:
    return t.shared("records", lambda: records.canonical_records(source_frame(t), label_catalog(t)))


VIEWS["factor_table"] = """
SELECT trial_id, split, dataset_version, reading_task, subject_id, text_uid, cohort, factor_id, target_type, target_value,
       CASE WHEN target_type = 'regression' THEN '' ELSE target_value END AS target_atoms
FROM (SELECT *, 'sr_sentiment_3' AS factor_id, 'multiclass' AS target_type, sr_sentiment_3 AS target_value
      FROM records WHERE mask_sr_sentiment_3 = 1
      UNION ALL
      SELECT *, 'nr_relation_content', 'multilabel', array_to_string(list_sort(list_filter(list_transform(
             string_split(nr_relation_content, ';'), lambda x: upper(trim(x))), lambda x: x <> '')), ';')
      FROM records WHERE mask_nr_relation_content = 1
      UNION ALL
      SELECT *, 'tsr_instruction_relation', 'multiclass', upper(tsr_instruction_relation)
      FROM records WHERE mask_tsr_instruction_relation = 1
      UNION ALL
      SELECT *, 'length_words_whitespace_v1', 'regression', CAST(length_words_whitespace_v1 AS VARCHAR) FROM records)
"""


def factor_table(t: Tables) -> DataFrame:
    return t.shared("factor_rows", lambda: records.factor_rows(record_table(t)))
