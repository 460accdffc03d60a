"""Readers and writers: tables go out to the shared folder in one format and come back in another query's shape."""

import uuid

from pyspark.sql import functions as F

from trialloom.functions import vectors
from trialloom.plans.registry import query
from trialloom.session import shared_dir
from trialloom.sources import scans, sinks
from trialloom.streaming import incremental


def scratch(t, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("S01_delimited_scan", "SELECT CAST(c_custkey AS VARCHAR) AS custkey, c_name AS name, c_mktsegment AS segment FROM customer")
def s01(t):
    path = scratch(t, "s01")
    note = t.raw("customer").select(F.col("c_custkey").cast("string").alias("custkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    second = note.limit(1).select(F.lit("(key)").alias("custkey"), F.lit("(text)").alias("name"), F.lit("(text)").alias("segment"))
    second.unionByName(note).write.option("sep", ";").option("header", True).csv(path)
    return scans.delimited(t.spark, path, ["custkey", "name", "segment"], sep=";", drop=F.col("custkey") == "(key)")


@query("S02_numbered_parts", "SELECT n_nationkey AS key, n_name AS name, CAST(n_regionkey AS INTEGER) AS part FROM nation")
def s02(t):
    path = scratch(t, "s02")
    regions = [r["n_regionkey"] for r in t.raw("nation").select("n_regionkey").distinct().collect()]
    t.raw("nation").select("n_nationkey", "n_name", F.concat(F.lit("nr_"), F.col("n_regionkey").cast("string"), F.lit(".csv")).alias("f")).write.partitionBy(
        "f").option("sep", ";").csv(path)
    out = scans.numbered(t.spark, path + "/f=nr_{}.csv", regions, ["key", "name"])
    return out.select(F.col("key").cast("int").alias("key"), "name", "part")


@query("S03_strict_csv", "SELECT CAST(doc_id AS BIGINT) AS doc_id, lang, source FROM documents")
def s03(t):
    path = scratch(t, "s03")
    t.raw("documents").select(F.col("doc_id").alias(scans.BOM + "doc_id"), "lang", "source", "n_chars").write.option("header", True).csv(path)
    out = scans.strict_csv(t.spark, path, ["doc_id", "lang", "source"])
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


@query("S04_manifest_bound_index", "SELECT trial_id, text_key FROM trials")
def s04(t):
    path = scratch(t, "s04")
    t.trial_keys.select("trial_id", "text_key").write.parquet(f"{path}/index")
    parts = scans.file_digests(t.spark, f"{path}/index").where("file like '%.parquet'")
    info = parts.agg(F.collect_list(F.struct("file", "sha256")).alias("parts")).withColumns({
        "schema_version": F.lit(2), "index": F.lit(f"{path}/index"), "row_count": t.trial_keys.agg(F.count("*").alias("n")).scalar()})
    info.write.json(f"{path}/manifest")
    return scans.bound_index(t.spark, f"{path}/manifest")


@query("S05_split_scan", "SELECT trial_id, reading_task FROM split_trials WHERE split = 'val'")
def s05(t):
    path = scratch(t, "s05")
    t.split_trials.select("trial_id", "reading_task", "dataset_version", "split").write.partitionBy("split").parquet(path)
    return scans.split_scan(t.spark, path, "val", "docs").select("trial_id", "reading_task")


@query("S06_vector_store", """
SELECT condition, vec_id, round(list_sum(v), 6) AS total FROM (SELECT 'correct' AS condition, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
UNION ALL SELECT 'negated', vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: -x) FROM embeddings) WHERE vec_id IN (SELECT doc_id FROM labels)""")
def s06(t):
    base = t.raw("embeddings").select(F.lit("correct").alias("condition"), "vec_id", vectors.as_double(F.col("embedding")).alias("vector"))
    both = base.unionByName(base.withColumns({"condition": F.lit("negated"), "vector": F.transform("vector", lambda x: -x)}))
    store = sinks.bucketed_store(both, ["condition", "vec_id"])
    wanted = t.raw("labels").select(F.col("doc_id").alias("vec_id"), F.explode(F.array(F.lit("correct"), F.lit("negated"))).alias("condition"))
    found = scans.store_lookup(store, wanted, ["condition", "vec_id"])
    return found.select("condition", "vec_id", F.round(vectors.total(F.col("vector")), 6).alias("total"))


@query("S07_token_lookup", """
SELECT vec_id, "offset", round(list_sum(CAST(embedding AS DOUBLE[])[8 * "offset" + 1 : 8 * "offset" + 8]), 6) AS total FROM embeddings, (SELECT unnest(range(8)) AS "offset")""")
def s07(t):
    toks = t.raw("embeddings").select("vec_id", F.posexplode(vectors.fold_rows(vectors.as_double(F.col("embedding")), 8, 8)).alias("offset", "token"))
    wanted = t.raw("embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("offset"))
    return scans.store_lookup(sinks.bucketed_store(toks, ["vec_id", "offset"]), wanted, ["vec_id", "offset"]).select(
        "vec_id", F.col("offset").cast("bigint").alias("offset"), F.round(vectors.total(F.col("token")), 6).alias("total"))


ROWS_PER_SHARD = 64
_SHARDED = f"""SELECT vec_id, format('shard_{{:05d}}', p // {ROWS_PER_SHARD}) AS shard, p % {ROWS_PER_SHARD} AS "offset" FROM
 (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS p FROM embeddings)"""


def written_shards(t, name):
    path = scratch(t, name)
    sinks.sharded(t.raw("embeddings").select("vec_id", "embedding"), path, "vec_id", ROWS_PER_SHARD)
    return t.spark.read.parquet(path)


@query("S08_array_shards", f"SELECT vec_id, shard, \"offset\" FROM ({_SHARDED})")
def s08(t):
    shards = written_shards(t, "s08")
    locators = sinks.with_locator(t.raw("embeddings").select("vec_id"), "vec_id", ROWS_PER_SHARD)
    return scans.shard_lookup(shards.select("shard", "offset", F.col("vec_id").alias("stored")), locators).where("stored = vec_id").select(
        "vec_id", "shard", "offset")


@query("S12_sharded_sink", f"SELECT shard, count(*) AS rows, min(\"offset\") AS low, max(\"offset\") AS high FROM ({_SHARDED}) GROUP BY 1")
def s12(t):
    return written_shards(t, "s12").groupBy("shard").agg(F.count("*").alias("rows"), F.min("offset").alias("low"), F.max("offset").alias("high"))


@query("S09_json_manifest", "SELECT lang AS name, count(*) AS rows, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def s09(t):
    path = scratch(t, "s09")
    t.raw("documents").groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("rows"), F.sum("n_chars").alias("chars")).write.json(path)
    return scans.manifest(t.spark, path, "name string, rows long, chars long", one_document=False)


@query("S11_projected_csv", "SELECT item_id, text FROM benchmark")
def s11(t):
    path = scratch(t, "s11")
    sinks.projected_csv(t.raw("benchmark"), path, ["text", "item_id"])
    return scans.strict_csv(t.spark, path, ["text", "item_id"], exact=True, multi_line=True).select(F.col("item_id").cast("bigint").alias("item_id"), "text")


@query("S13_resumable_chunks", """
SELECT event_type, count(*) AS members, CASE WHEN event_type = 'error' THEN 'written' ELSE 'kept' END AS action FROM events GROUP BY 1""")
def s13(t):
    path = scratch(t, "s13")
    rows = t.raw("events").select("event_id", "event_type", "value")

    def work(df):
        return df.withColumn("value", F.col("value") * 2)

    first = rows.withColumn("value", F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")))
    sinks.resumable_chunks(first, "event_type", "event_id", path, work, "v1")
    return sinks.resumable_chunks(rows, "event_type", "event_id", path, work, "v1").select("event_type", "members", "action")


@query("S14_published_set", "SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def s14(t):
    path = scratch(t, "s14")
    sinks.publish({"nation": t.raw("region"), "region": t.raw("region")}, path)
    sinks.publish({"nation": t.raw("nation"), "region": t.raw("region")}, path)
    parts = [sinks.published(t.spark, path, n).agg(F.count("*").alias("rows")).withColumn("name", F.lit(n)) for n in ("nation", "region")]
    return parts[0].unionByName(parts[1])


@query("S15_artifact_manifest", """
SELECT 'part-' || lang || '.json' AS file, 'changed' AS problem FROM (SELECT DISTINCT lang FROM documents) WHERE lang = 'de'
UNION ALL SELECT 'part-' || lang || '.json', 'missing' FROM (SELECT DISTINCT lang FROM documents) WHERE lang = 'fr'""")
def s15(t):
    digests = t.raw("documents").groupBy("lang").agg(F.min(F.sha2("text", 256)).alias("sha256"))
    declared = digests.select(F.concat(F.lit("part-"), "lang", F.lit(".json")).alias("file"), "sha256")
    actual = declared.where("file <> 'part-fr.json'").withColumn(
        "sha256", F.when(F.col("file") == "part-de.json", F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return sinks.manifest_differences(declared, actual)


@query("S15_file_digests")
def s15b(t):
    path = scratch(t, "s15")
    t.raw("documents").hint("rebalance").write.parquet(path)
    return sinks.artifact_manifest(t.spark, path).where("file like '%.parquet'").select("bytes", "sha256")


EVENT_SCHEMA = "event_id long, user_id long, event_type string, value double"


def event_files(t, name):
    path = scratch(t, name)
    t.raw("events").select("event_id", "user_id", "event_type", "value").repartition(4, "user_id").write.parquet(path)
    return path


@query("R01_incremental_chunks", "SELECT event_id, round(value * 2, 6) AS doubled FROM events")
def r01(t):
    source, out = event_files(t, "r01"), scratch(t, "r01-out")
    checkpoint = scratch(t, "r01-state")
    for _ in range(2):  # the second run finds nothing new
        incremental.process_new_files(t.spark, source, EVENT_SCHEMA, out, checkpoint, lambda b: b.withColumn("doubled", F.round(F.col("value") * 2, 6)))
    return t.spark.read.parquet(out).select("event_id", "doubled")


@query("R02_running_statistics", """
SELECT event_type, count(*) AS n, round(sum(value), 4) AS "sum", min(value) AS "min", max(value) AS "max", round(avg(value), 6) AS mean,
       round(var_pop(value) * count(*), 4) AS centred FROM events GROUP BY 1""")
def r02(t):
    source, out = event_files(t, "r02"), scratch(t, "r02-out")
    incremental.running_statistics(t.spark, source, EVENT_SCHEMA, ["event_type"], "value", out, scratch(t, "r02-state"))
    return sinks.published(t.spark, out, "statistics").withColumns(
        {"sum": F.round("sum", 4), "mean": F.round("mean", 6), "centred": F.round("centred", 4)})
