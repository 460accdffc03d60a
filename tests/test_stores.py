"""Digests in pieces, published versions, bucketed stores, moments, id ranges, conflicts."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.operators import canonical, pools, signals, splits
from trialloom.operators.contracts import ContractError
from trialloom.sources import scans, sinks
from trialloom.streaming import incremental


def test_large_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scans, "PIECE_BYTES", 1000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits of a file
    rng = np.random.default_rng(1)
    bodies = {
        "random bytes": rng.integers(0, 256, 50_000, dtype=np.uint8).tobytes(), "sub/ended.txt": b"line\r\n" * 3000,
        "sub/open+x.txt": b"\n\n" + b"y" * 9000 + b"\nlast", "mark.csv": b"\xef\xbb\xbfa,b\n" + b"1,2\n" * 2000, "mark open": b"\xef\xbb\xbf" + b"q\n" * 900 + b"q",
        "feeds": b"\n" * 700, "one line": b"z" * 20_000, "small": b"abc", "empty": b"",
    }
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    try:
        got = {r.file: (r.bytes, r.sha256) for r in scans.file_digests(spark, str(tmp_path), whole=500).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in bodies.items() if v}


def test_readers_see_the_old_set_or_the_new_one(spark, tmp_path, monkeypatch):
    target = str(tmp_path / "set")
    frame = lambda n: spark.range(n)
    with pytest.raises(ContractError, match="nothing"):
        sinks.published(spark, target, "a")
    sinks.publish({"a": frame(1), "b": frame(2)}, target)
    old = sinks.published(spark, target, "a")

    plain, seen = sinks._pointers, []

    def between(session, where):  # the tables of the new set are written, its pointer is not
        if not seen:
            seen.append(spark.read.parquet(f"{where}/versions/{plain(session, where)[-1][1]}/a").count())
        return plain(session, where)

    monkeypatch.setattr(sinks, "_pointers", between)
    sinks.publish({"a": frame(10), "b": frame(20)}, target)
    monkeypatch.setattr(sinks, "_pointers", plain)
    assert seen == [1] and sinks.published(spark, target, "a").count() == 10 and sinks.published(spark, target, "b").count() == 20
    assert old.count() == 1  # a reader of the version before goes on

    class Broken(Exception):
        pass

    def fail(*_):
        raise Broken

    bad = frame(5).withColumn("x", F.raise_error(F.lit("no")).cast("int"))
    with pytest.raises(Exception, match="no"):
        sinks.publish({"a": frame(3), "b": bad}, target)
    assert sinks.published(spark, target, "a").count() == 10  # half a set is never seen
    for n in (30, 40):
        sinks.publish({"a": frame(n)}, target)
    assert len(os.listdir(tmp_path / "set" / "versions")) == 3  # two are kept, and the one that was never published


def test_lookups_move_the_wanted_keys_only(spark):
    rows = [(i, [float(i)] * 4) for i in range(300)]
    store = sinks.bucketed_store(spark.createDataFrame(rows, "k int, vector array<double>"), ["k"])
    wanted = spark.createDataFrame([(7,), (7,), (299,), (1000,)], "k int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = scans.store_lookup(store, wanted, ["k"])
        assert sorted((r.k, r.vector[0]) for r in found.collect()) == [(7, 7.0), (7, 7.0), (299, 299.0)]
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Bucketed: true" in plan
    lines = plan.split("== Initial Plan ==")[0].split("\n")
    depth = [len(line) - len(line.lstrip(" :+-*")) for line in lines]
    shuffles = [i for i, line in enumerate(lines) if "Exchange" in line]
    assert len(shuffles) == 2  # the wanted keys, once for each join
    for i in shuffles:
        end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
        assert not any("FileScan" in line for line in lines[i:end])


def test_moments_far_from_zero_keep_their_digits(spark):
    rng = np.random.default_rng(4)
    x = 1e9 + rng.normal(size=(40, 25, 3)) * 1e-3
    mask = (rng.random((40, 25)) < 0.8).astype(int)
    df = spark.createDataFrame([(x[i].tolist(), mask[i].tolist()) for i in range(40)], "signal array<array<double>>, mask array<int>").repartition(7)
    live = x[mask == 1]
    for r in signals.array_channel_stats(df).collect():
        assert r.samples == len(live) and r["mean"] == pytest.approx(live[:, r.channel].mean(), rel=1e-15)
        assert r["std"] == pytest.approx(live[:, r.channel].std(), rel=1e-3)
    long = signals.explode_signal(df.withColumn("id", F.lit(1)), ["id"])
    for r in signals.channel_stats(long, []).collect():
        assert r["std"] == pytest.approx(live[:, r.channel].std(), rel=1e-3)
    ragged = spark.createDataFrame([([[1.0, None], [3.0]], [1, 1]), (None, None), ([], [])], "signal array<array<double>>, mask array<int>")
    assert [(r.channel, r.samples, r["mean"]) for r in signals.array_channel_stats(ragged).collect()] == [(0, 2, 2.0)]


def test_running_statistics_equal_those_of_the_union(spark, tmp_path):
    rng = np.random.default_rng(8)
    values = 1e9 + rng.normal(size=300) * 1e-3
    for part in range(3):
        rows = [(["a", "b"][i % 2], float(values[i])) for i in range(part * 100, part * 100 + 100)]
        spark.createDataFrame(rows, "g string, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.running_statistics(spark, str(tmp_path / "in"), "g string, v double", ["g"], "v", str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.g: r for r in sinks.published(spark, str(tmp_path / "out"), "statistics").collect()}
    for g, own in (("a", values[0::2]), ("b", values[1::2])):
        assert got[g].n == 150 and got[g]["mean"] == pytest.approx(own.mean(), rel=1e-15)
        assert got[g].centred == pytest.approx(((own - own.mean()) ** 2).sum(), rel=1e-3)


def test_ids_with_one_prefix_spread_over_ranges_in_order(spark):
    ids = [f"the-same-long-prefix-{i:05d}" for i in range(4000)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    rows = sorted((r.id, r._range) for r in pools.with_id_bucket(df, [], "id").collect())
    ranges = [r for _, r in rows]
    assert ranges == sorted(ranges) and len(set(ranges)) > 500
    assert max(np.bincount(ranges)) < 60


def test_conflicting_labels_are_an_error_or_a_report(spark):
    source = spark.createDataFrame([("t1", "A"), ("t1", "B"), ("t2", "A"), ("t2", "A"), ("t3", None)], "key string, label string")
    targets = spark.createDataFrame([("t2",), ("t3",), ("t4",)], "key string")
    agreed = source.where("key <> 't1'")
    assert sorted((r.key, r.label) for r in canonical.propagate_labels(targets, agreed, "key", "label").collect()) == [("t2", "A"), ("t3", None), ("t4", None)]
    with pytest.raises(Exception, match="conflicting labels of t1"):
        canonical.propagate_labels(targets, source, "key", "label").collect()
    assert [(r.key, r.labels, r.rows) for r in canonical.label_conflicts(source, "key", "label").collect()] == [("t1", ["A", "B"], 2)]
    rows = spark.createDataFrame([(1, "N"), (1, "X"), (2, "X"), (2, "Y"), (3, "N")], "g int, label string")
    with pytest.raises(Exception, match="several labels in group 2"):
        canonical.group_constant(rows, "g", "label", "N").collect()
    got = {(r.g, r.group_label, r.group_conflict) for r in canonical.group_constant(rows, "g", "label", "N", "report").collect()}
    assert got == {(1, "X", False), (2, None, True), (3, None, False)}


def test_at_least_two_folds(spark):
    rows = spark.createDataFrame([("a", "s1"), ("a", "s2"), ("b", "s1")], "label string, subject string")
    assert tuple(splits.feasible_folds(rows, "label", "subject", 5).first()) == (1, 2)


def test_conflicting_labels_can_be_reported_with_every_row(spark):
    source = spark.createDataFrame([("t1", "A"), ("t1", "B"), ("t2", "A"), ("t3", None)], "key string, label string")
    targets = spark.createDataFrame([("t1",), ("t1",), ("t2",), ("t3",), ("t4",)], "key string")
    got = canonical.propagate_labels(targets, source, "key", "label", "report").collect()
    assert sorted((r.key, r.label or "", r.label_conflict) for r in got) == [
        ("t1", "", True), ("t1", "", True), ("t2", "A", False), ("t3", "", False), ("t4", "", False)]


def test_records_of_texts_with_several_relations_have_none(spark):
    from trialloom.operators import records

    row = lambda i, dataset, task, words: (i, dataset, task, "s", "train", words, "u", "positive", "award", "x", "t", "1.0")
    frame = spark.createDataFrame(
        [row(0, "ZuCo1", "task2", "one  text"), row(1, "ZuCo2", "task2", "one text"), row(2, "ZuCo1", "task2", "other")],
        "row_idx long, dataset string, task string, subject string, phase string, input_text string, text_uid string, sentiment_label string,"
        " relation_label string, semkey_sentiment_2 string, topic_label string, surprisal string")
    catalog = spark.createDataFrame([("one text", "award"), ("one text", "wife"), ("other", "wife")], "norm_text string, relation_types string")
    got = records.canonical_records(frame, catalog).orderBy("source_dataframe_row_index").collect()
    assert [(r.nr_relation_content, r.mask_nr_relation_content, r.nr_relation_conflict) for r in got] == [(None, 0, 1), (None, 0, 0), ("wife", 1, 0)]


def test_hashed_files_grow_in_number_not_in_size(spark):
    from trialloom.plans import load_all
    from trialloom.plans.registry import QUERIES

    load_all()
    wanted = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.shuffle.partitions": "16",
              "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        assert QUERIES["S15_file_digests"](spark, "/root/testdata/sf0.001").count() > 4
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
