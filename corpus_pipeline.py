"""The corpus pipeline: documents through five operators, each stage written and read again by the next.

Language ID (what it rejects goes), line dedup, MinHash near-dedup (one document of a group stays), benchmark
decontamination, best-fit packing. The first four keep the columns of documents; packing returns its pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialloom.llm import decontam, langid, linededup, packing, setsketch
from trialloom.llm.queries import tokenizer_path
from trialloom.session import cut

SHINGLE_WORDS = 5
SIMILARITY = (80, 100)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a known language, however close the next one; learns from the rows whose crc32(doc_id) mod 4 is not 2."""
    return langid.keep_identified(docs, langid.train(langid.training_rows(docs)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later three-line repeats; a document that consists of them goes."""
    return linededup.keep_unrepeated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    return setsketch.keep_one_of_each(docs, SHINGLE_WORDS, *SIMILARITY)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Trained models and token ids cannot be had in SQL; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
