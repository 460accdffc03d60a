"""Round trips, tampering, resumption, and probe worlds."""

import io
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialloom.operators import metrics, probes, splits
from trialloom.operators.contracts import ContractError
from trialloom.sources import scans, sinks


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_strict_csv_rejects_other_headers(spark, folder):
    spark.createDataFrame([(1, "a")], "k int, v string").write.option("header", True).csv(f"{folder}/x")
    assert scans.strict_csv(spark, f"{folder}/x", ["v"]).collect()[0]["v"] == "a"
    with pytest.raises(ContractError):
        scans.strict_csv(spark, f"{folder}/x", ["k"], exact=True)
    with pytest.raises(ContractError):
        scans.strict_csv(spark, f"{folder}/x", ["w"])


def test_projected_csv_keeps_commas_quotes_and_line_breaks(spark, folder):
    rows = [(1, 'a "quoted", line\nbreak'), (2, "plain")]
    sinks.projected_csv(spark.createDataFrame(rows, "k int, v string"), f"{folder}/x", ["v", "k"])
    got = scans.strict_csv(spark, f"{folder}/x", ["v", "k"], exact=True, multi_line=True).collect()
    assert sorted((int(r["k"]), r["v"]) for r in got) == rows


def test_every_part_needs_the_same_header(spark, folder):
    import os

    os.mkdir(f"{folder}/x")
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "y,x\n20,10\n")):
        with open(f"{folder}/x/{name}", "w") as handle:
            handle.write(text)
    with pytest.raises(Exception, match="(?i)header"):
        scans.strict_csv(spark, f"{folder}/x", ["x", "y"]).collect()


def test_equal_file_names_in_two_folders(spark, folder):
    import os

    for part, text in (("p=1", "one"), ("p=2", "two")):
        os.makedirs(f"{folder}/x/{part}")
        with open(f"{folder}/x/{part}/same.bin", "w") as handle:
            handle.write(text)
    got = scans.file_digests(spark, f"{folder}/x").collect()
    assert {r["file"] for r in got} == {"p=1/same.bin", "p=2/same.bin"} and len({r["sha256"] for r in got}) == 2


def test_chunks_that_return_lose_output_or_leave(spark, folder):
    def work(df):
        return df.withColumn("twice", F.col("v") * 2)

    def run(rows):
        df = spark.createDataFrame(rows, "chunk string, k int, v int")
        found = {r["chunk"]: r["action"] for r in sinks.resumable_chunks(df, "chunk", "k", folder, work, "v1").collect()}
        stored = spark.read.schema("k int, v int, twice int, chunk string").parquet(f"{folder}/data")
        return found, {(r["chunk"], r["twice"]) for r in stored.collect()}

    one, two = [("01", 1, 1), ("b", 2, 5)], [("01", 1, 2), ("b", 2, 5)]
    assert run(one) == ({"01": "written", "b": "written"}, {("01", 2), ("b", 10)})
    assert run(two) == ({"01": "written", "b": "kept"}, {("01", 4), ("b", 10)})
    assert run(one) == ({"01": "written", "b": "kept"}, {("01", 2), ("b", 10)})  # the old log entry does not count
    import glob
    import os

    os.remove(glob.glob(f"{folder}/data/chunk=b/*.parquet")[0])  # output lost
    assert run(one) == ({"01": "kept", "b": "written"}, {("01", 2), ("b", 10)})
    spark.createDataFrame([(2, 5, 99)], "k int, v int, twice int").write.mode("overwrite").parquet(f"{folder}/data/chunk=b")  # altered
    assert run(one) == ({"01": "kept", "b": "written"}, {("01", 2), ("b", 10)})
    assert run(one[:1]) == ({"01": "kept", "b": "dropped"}, {("01", 2)})
    assert run(one) == ({"01": "kept", "b": "written"}, {("01", 2), ("b", 10)})


def test_tampered_index_is_rejected(spark, folder):
    spark.range(10).write.parquet(f"{folder}/index")
    parts = scans.file_digests(spark, f"{folder}/index").where("file like '%.parquet'")
    info = parts.agg(F.collect_list(F.struct("file", "sha256")).alias("parts")).withColumns(
        {"schema_version": F.lit(2), "index": F.lit(f"{folder}/index"), "row_count": F.lit(10)})
    info.write.json(f"{folder}/m")
    assert scans.bound_index(spark, f"{folder}/m").count() == 10
    spark.range(3).write.mode("append").parquet(f"{folder}/index")
    with pytest.raises(ContractError):
        scans.bound_index(spark, f"{folder}/m")


def test_npz_import(spark, folder):
    buffer = io.BytesIO()
    eeg = np.arange(24, dtype=np.float32).reshape(2, 4, 3)
    np.savez(buffer, eeg=eeg, mask=np.ones((2, 4), dtype=np.int8))
    with open(f"{folder}/shard_00000.npz", "wb") as handle:
        handle.write(buffer.getvalue())
    rows = scans.npz_shards(spark, folder).orderBy("offset").collect()
    assert [r["offset"] for r in rows] == [0, 1] and rows[1]["signal"] == eeg[1].tolist() and rows[0]["mask"] == [1, 1, 1, 1]


def test_store_lookup_fails_on_repeated_keys(spark):
    store = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeated key"):
        scans.store_lookup(store, store.select("k").distinct(), ["k"]).collect()


def test_resumed_run_touches_changed_chunks_only(spark, folder):
    def work(df):
        return df.withColumn("twice", F.col("v") * 2)

    rows = [("a", 1, 1), ("a", 2, 2), ("b", 3, 3)]
    df = spark.createDataFrame(rows, "chunk string, k int, v int")
    sinks.resumable_chunks(df, "chunk", "k", folder, work, "v1")
    again = sinks.resumable_chunks(df, "chunk", "k", folder, work, "v1")
    assert {r["action"] for r in again.collect()} == {"kept"}
    changed = df.withColumn("v", F.when(F.col("chunk") == "b", 30).otherwise(F.col("v")))
    third = {r["chunk"]: r["action"] for r in sinks.resumable_chunks(changed, "chunk", "k", folder, work, "v1").collect()}
    assert third == {"a": "kept", "b": "written"}
    got = {(r["chunk"], r["twice"]) for r in spark.read.parquet(f"{folder}/data").collect()}
    assert got == {("a", 2), ("a", 4), ("b", 60)}


def test_probe_finds_signal_and_no_noise(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        y = i % 3
        rows.append((i, y, f"g{i // 3 % 12}", (rng.normal(size=4) + 2.0 * np.eye(4)[y]).tolist(), rng.normal(size=4).tolist()))
    df = spark.createDataFrame(rows, "id int, y int, grp string, signal array<double>, noise array<double>").withColumn("fold", F.col("id") % 2)
    permuted = splits.permuted_labels(df.select("id", "y"), "id", "y", 2, 1).cache()
    good = probes.decodability(df.withColumnRenamed("signal", "x").select("id", "fold", "x", "y"), "fold", 3, permuted, "id").first()
    assert good["observed"] > 0.7 > good["null_mean"] and good["p_value"] == pytest.approx(1 / 3)
    bad = probes.utility(probes.left_out(df.withColumnRenamed("noise", "x"), "fold", "multiclass", [1.0], 3, ["id"]), "multiclass", 3)
    assert bad < 0.5


def test_all_permutations_are_fitted_and_as_one_by_one(spark):
    from trialloom.plans import metric_queries, probe_queries

    assert probe_queries.PERMUTATIONS == metric_queries.PERMUTATIONS == 200  # as in the reference, which decides at p < 0.05
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, i % 2, (rng.normal(size=4) + 2.0 * np.eye(4)[i % 3]).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, y int, fold int, signal array<double>")
    df = df.withColumnRenamed("signal", "x").cache()
    permuted = splits.permuted_labels(df.select("id", "y"), "id", "y", 60, 1).cache()
    together = [r[0] for r in probes.permuted_accuracies(df, "fold", 3, permuted, "id").collect()]
    assert len(together) == 60
    for i in range(2):
        one = df.drop("y").join(permuted.where(F.col("replicate") == i).select("id", "y"), "id")
        predicted = probes.left_out(one, "fold", "multiclass", [1.0], 3, ["id"])
        assert together[i] == pytest.approx(metrics.multiclass_metrics(predicted, 3).first()["balanced_accuracy"], abs=1e-9)
    assert probes.decodability(df, "fold", 3, permuted, "id").first()["p_value"] == pytest.approx(1 / 61)
