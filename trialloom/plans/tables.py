"""The engine inputs derived from the given tables, each as a DataFrame and as the equal SQL view."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialloom.functions import keys, text
from trialloom.operators.canonical import candidate_catalog
from trialloom.session import cut

SEED = 17
FOLDS = 5
POOL = 24
RING_SQL = 1 << 60


def sql_hash(*parts) -> str:
    return "sha256(concat_ws(chr(31), " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def sql_ring(*parts) -> str:
    return f"CAST(('0x' || substr({sql_hash(*parts)}, 1, 15)) AS BIGINT)"


def sql_draw(*parts) -> str:
    inner = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5(concat_ws(chr(31), {inner})), 1, 15)) AS BIGINT)"


def sql_ring_gap(candidate: str, target: str) -> str:
    return f"(({candidate} - {target} + {RING_SQL}) % {RING_SQL})"


VIEWS: dict[str, str] = {}

VIEWS["trials"] = f"""
SELECT doc_id, format('docs::{{}}::{{}}::row{{:06d}}', lang, source, doc_id) AS trial_id, 'docs' AS dataset_version,
       lang AS reading_task, source AS subject_id, text, norm, sha256(norm) AS text_key,
       CAST(len(string_split(norm, ' ')) AS INTEGER) AS length,
       'docs::' || lang || '::' || substr(sha256(norm), 1, 20) AS candidate_id
FROM (SELECT *, array_to_string(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''), ' ') AS norm
      FROM documents) WHERE norm <> ''
"""
VIEWS["split_trials"] = f"""
SELECT *, CASE WHEN sp < 70 THEN 'train' WHEN sp < 80 THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, {sql_ring(SEED, "text_key", "'split'")} % 100 AS sp FROM trials)
"""
VIEWS["leaky_trials"] = f"""
SELECT *, CASE WHEN sp < 70 THEN 'train' WHEN sp < 80 THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, {sql_ring(SEED, "doc_id", "'leaky'")} % 100 AS sp FROM trials)
"""
VIEWS["catalog"] = """
SELECT candidate_id, any_value(reading_task) AS reading_task, any_value(dataset_version) AS dataset_version,
       any_value(text_key) AS text_key, any_value(length) AS length, min(trial_id) AS first_trial_id,
       count(*) AS trial_count FROM trials GROUP BY candidate_id
"""
VIEWS["vec_trials"] = f"""
SELECT vec_id, format('emb::{{}}::S{{}}::row{{:06d}}', reading_task, vec_id % 10, vec_id) AS trial_id,
       'emb' AS dataset_version, reading_task, 'S' || (vec_id % 10) AS subject_id, text_idx, text_key,
       CAST(5 + text_idx % 23 AS INTEGER) AS length, CAST(text_idx % {FOLDS} AS INTEGER) AS text_fold, vector, label
FROM (SELECT vec_id, vec_id // 5 AS text_idx, {sql_hash("'text'", "vec_id // 5")} AS text_key,
             CASE WHEN (vec_id // 10) % 2 = 0 THEN 'NR' ELSE 'TSR' END AS reading_task,
             CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings)
"""
VIEWS["vec_texts"] = """
SELECT text_key, arg_min(reading_task, vec_id) AS reading_task, arg_min(length, vec_id) AS length,
       arg_min(text_fold, vec_id) AS text_fold, arg_min(vector, vec_id) AS text_vector
FROM vec_trials GROUP BY text_key
"""
VIEWS["pairs"] = """
SELECT format('c{:06d}t{:04d}', u.conv_id, u.turn) AS id, a.text AS prediction, u.text AS target, u.conv_id
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'
"""


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prefixes the views the statement uses (directly or through each other) as common table expressions."""
    known = {**VIEWS, **(extra or {})}
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in known:
            if name not in needed and re.search(rf"\b{name}\b", body):
                visit(known[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    ctes = [f"{name} AS ({known[name].strip()})" for name in needed]
    stripped = sql.strip()
    if stripped.upper().startswith("WITH RECURSIVE"):
        raise ValueError("recursive statements are not supported")
    if stripped.startswith(","):
        return "WITH " + (",\n".join(ctes) + stripped if ctes else stripped[1:])
    if stripped.upper().startswith("WITH "):
        return "WITH " + ",\n".join([*ctes, stripped[5:]]) if ctes else stripped
    return ("WITH " + ",\n".join(ctes) + "\n" + stripped) if ctes else stripped


_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def forget_shared() -> None:
    """Drops the references to tables written for several queries, so the next query builds its own."""
    _SHARED.clear()


class Tables:
    """Lazy access to the given tables and the inputs derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def shared(self, name: str, build) -> DataFrame:
        """A derived table that several queries read: written once per application and input folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _SHARED:
            _SHARED[key] = cut(build())
        return _SHARED[key]

    @cached_property
    def trials(self) -> DataFrame:
        base = self.raw("documents").select(
            "doc_id", "lang", "source", "text", text.fold_case(F.col("text")).alias("norm")).where(
                F.col("text").rlike(r"\S"))  # cheaper than testing the folded text, which would fold it twice
        return base.select(
            "doc_id",
            keys.trial_id(F.lit("docs"), F.col("lang"), F.col("source"), F.col("doc_id")).alias("trial_id"),
            F.lit("docs").alias("dataset_version"), F.col("lang").alias("reading_task"),
            F.col("source").alias("subject_id"), "text", "norm", F.sha2("norm", 256).alias("text_key"),
            text.collapsed_word_count(F.col("norm")).alias("length"),
        ).withColumn("candidate_id", keys.candidate_id(
            F.col("dataset_version"), F.col("reading_task"), F.col("text_key")))

    @staticmethod
    def _split(position) -> "F.Column":
        return F.when(position < 70, "train").when(position < 80, "val").otherwise("test")

    @cached_property
    def split_trials(self) -> DataFrame:
        """Splits by text identity: no text is in two splits."""
        return self.trials.withColumn("split", self._split(
            F.pmod(keys.ring_hash(SEED, F.col("text_key"), "split"), F.lit(100))))

    @cached_property
    def leaky_trials(self) -> DataFrame:
        """Splits by trial: repeated texts leak."""
        return self.trials.withColumn("split", self._split(
            F.pmod(keys.ring_hash(SEED, F.col("doc_id"), "leaky"), F.lit(100))))

    @cached_property
    def trial_keys(self) -> DataFrame:
        """The trials without their texts, normalised once and written: what designs work on."""
        return self.shared("trial_keys", lambda: self.trials.drop("text", "norm"))

    @cached_property
    def catalog(self) -> DataFrame:
        return candidate_catalog(self.trial_keys)

    @cached_property
    def vec_trials(self) -> DataFrame:
        vec = F.col("vec_id")
        text_idx = F.floor(vec / 5)
        task = F.when(F.pmod(F.floor(vec / 10), F.lit(2)) == 0, "NR").otherwise("TSR")
        subject = F.concat(F.lit("S"), F.pmod(vec, F.lit(10)).cast("string"))
        return self.raw("embeddings").select(
            "vec_id", keys.trial_id(F.lit("emb"), task, subject, vec).alias("trial_id"),
            F.lit("emb").alias("dataset_version"), task.alias("reading_task"), subject.alias("subject_id"),
            text_idx.alias("text_idx"), keys.stable_hash("text", text_idx).alias("text_key"),
            (F.lit(5) + F.pmod(text_idx, F.lit(23))).cast("int").alias("length"),
            F.pmod(text_idx, F.lit(FOLDS)).cast("int").alias("text_fold"),
            F.col("embedding").cast("array<double>").alias("vector"), "label")

    @cached_property
    def vec_texts(self) -> DataFrame:
        """One row per text: the vector of its first trial stands for the text."""
        first = F.min_by(F.struct("reading_task", "length", "text_fold", F.col("vector").alias("text_vector")), "vec_id")
        return self.vec_trials.groupBy("text_key").agg(first.alias("r")).select("text_key", "r.*")

    @cached_property
    def pairs(self) -> DataFrame:
        """(id, prediction, target): an assistant turn predicts the user turn before it."""
        turns = self.raw("conversations")
        user = turns.where("role = 'user'").select(
            "conv_id", "turn", F.col("text").alias("target"), (F.col("turn") + 1).alias("next"))
        reply = turns.where("role = 'assistant'").select(
            "conv_id", F.col("turn").alias("next"), F.col("text").alias("prediction"))
        return user.join(reply, ["conv_id", "next"]).select(
            F.format_string("c%06dt%04d", "conv_id", "turn").alias("id"), "prediction", "target", "conv_id")
