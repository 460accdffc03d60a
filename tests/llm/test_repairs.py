"""Clashing names, ties at a model's bound, repeated ids, small languages, held-out marks and whole scores."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import crc, frame, sentence, texts
from pyspark.sql import functions as F

from trialloom.llm import langid, linededup, quality
from trialloom.llm.queries import op9_language_id, op10_quality_classifier

SF_DIR = "/root/testdata/sf0.001"


def test_line_dedup_beside_columns_of_its_own_names(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, None)]
    names = ["_lines", "_removed", "_spans", "_every", "_starts", "_places", "_later_id", "_Later_Body", "_lines_"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    out = linededup.dedup_lines(docs)
    lines, removed, spans = linededup.added_names(docs)
    assert out.columns == [*docs.columns, lines, removed, spans] and lines == "_lines__"
    assert {r.doc_id: r.text for r in out.collect()} == plain == {1: "a\nb\nc\nd", 2: "x", 3: None}
    assert all(r[name] == name for r in out.collect() for name in names)
    assert [r[removed] for r in out.orderBy("doc_id").collect()] == [0, 3, 0]
    kept = linededup.keep_unrepeated(docs)
    assert kept.columns == docs.columns and kept.count() == 3


def test_language_rows_that_tie_at_the_bound(spark):
    rows = [(None, f"der die das {i % 3}", "de") for i in range(30)] + [(None, "the of and", "en")] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.sampled(df, 20).count() == 20 and langid.sampled(df, 100).count() == 60
    assert langid.train(df, max_train=20).languages  # null ids tie; the text decides then
    same = spark.createDataFrame([(7, "the of and", "en")] * 60, "doc_id long, text string, lang string")
    model = langid.train(same, max_train=20)
    assert model.languages == ["en"] and langid.sampled(same, 20).count() == 20
    assert langid.Scorer(model).predict(pa.array(["of the"]))[0] == ["en"]


def test_a_small_language_keeps_its_words(spark):
    big = [(i, " ".join(f"big{(i * 7 + j) % 300}" for j in range(60)), "xx") for i in range(80)]
    small = [(1000 + i, f"klein{i % 4} wenig{i % 3}", "yy") for i in range(6)]
    df = spark.createDataFrame(big + small, "doc_id long, text string, lang string")
    model = langid.train(df, max_words=20, max_grams=40)
    assert len(model.words) <= 20
    scorer = langid.Scorer(model)
    assert scorer.predict(pa.array(["klein1 wenig2 klein0", "big1 big2 big299"]))[0] == ["yy", "xx"]


def plain_score(model_rows, text):
    """Known words only: exp of the mean smoothed log frequency, sharpened, as a share."""
    langs = sorted({r[0] for r in model_rows})
    words = {r[1] for r in model_rows}
    table = {(la, w): n for la, w, n in model_rows}
    total = {la: sum(n for x, _, n in model_rows if x == la) for la in langs}
    means = []
    for la in langs:
        logs = [math.log((table.get((la, w.encode()), 0) + 0.1) / (total[la] + 0.1 * len(words))) for w in text.split()]
        means.append(sum(logs) / len(logs) * langid.SHARPNESS)
    shares = [math.exp(m - max(means)) for m in means]
    return langs[int(np.argmax(means))], 1.0 / sum(shares)


def test_language_scores_of_known_words_by_hand():
    rows = [("a", b"one", 5), ("a", b"two", 3), ("b", b"two", 9), ("b", b"three", 2), ("c", b"one", 1)]
    scorer = langid.Scorer(langid.build_model(rows))
    for text in ("one two", "two two three", "three", "one one one two three"):
        label, score = plain_score(rows, text)
        got = scorer.predict(pa.array([text]))
        assert got[0] == [label] and got[1][0] == pytest.approx(score, rel=1e-5)


def test_repeated_ids_stay_within_the_bound(spark):
    ids = [i for i in range(2, 60) if crc(i) % 3 != 1]
    docs = spark.createDataFrame([(ids[0], f"some text number {i}") for i in range(400)] + [(ids[1], "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids] + [(ids[0], 1)] * 5, "doc_id long, quality int")
    assert quality.training_features(docs, labels, 10).count() <= 10
    assert quality.training_features(docs, labels).count() >= 400


def test_quality_scores_are_sums_of_bins(spark):
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(400, len(quality.NAMES)))
    marks = (rows[:, 0] + rows[:, 1] * rows[:, 2] > 0).astype(float)
    model = quality.fit(rows, marks)
    got = model.score(rows[:50])
    for row, score in zip(rows[:50], got):
        total = model.intercept
        for edges, table, value in zip(model.edges, model.tables, row):
            total += table[sum(value >= e for e in edges)]
        for a, b, grid in model.pairs:
            total += grid[sum(row[a] >= e for e in model.pair_edges[a]), sum(row[b] >= e for e in model.pair_edges[b])]
        assert score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-6)


@pytest.mark.parametrize("query,ways,rest", [(op9_language_id, 4, 2), (op10_quality_classifier, 3, 1)])
def test_held_out_marks(spark, query, ways, rest):
    out = query(spark, SF_DIR).collect()
    assert out and all(r.held_out == (crc(r.doc_id) % ways == rest) and 0 <= r.score <= 1 for r in out)
