"""Arrow batches of the corpus operators are bounded by bytes, not only by rows."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialloom.llm import langid, packing, setsketch
from trialloom.llm.queries import tokenizer_path

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
MODEL = langid.build_model([("en", b"the", 3), ("de", b"der", 3)])
OPERATORS = {
    "count_words": langid.count_words,
    "identify": lambda docs: langid.identify(docs, MODEL),
    "keep_identified": lambda docs: langid.keep_identified(docs, MODEL),
    "tokenized_pieces": lambda docs: packing.tokenized_pieces(docs, tokenizer_path()),
    "signatures": lambda docs: setsketch.signatures(docs, 5, 60),
}


@pytest.fixture
def docs(spark):
    spark.conf.unset(SETTING)
    yield spark.range(0, 2000, 1, 1).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("the der "), 1250).alias("text"), F.lit("en").alias("lang"))
    spark.conf.unset(SETTING)


def largest_batch(docs):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["bytes"])

    return docs.mapInArrow(run, "bytes long").agg(F.max("bytes")).first()[0]


@pytest.mark.parametrize("name", OPERATORS)
def test_long_rows_come_in_small_batches(docs, name):
    OPERATORS[name](docs)
    assert largest_batch(docs) < 5 << 20  # 20 MB of text


def test_a_bound_of_the_session_stays(spark, docs):
    spark.conf.set(SETTING, str(1 << 20))
    assert langid.identify(docs, MODEL).count() == 2000
    assert largest_batch(docs) < 2 << 20
