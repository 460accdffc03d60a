"""Writers: projected CSV, sharded arrays, resumable chunks, published result sets, artifact manifests."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from trialloom.operators.contracts import ContractError, digest_of_set
from trialloom.operators.joins import positions
from trialloom.session import cut, shared_dir
from trialloom.sources.scans import file_digests


def projected_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The fields in fixed order with a header; missing values become empty."""
    df.select(*fields).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def with_locator(df: DataFrame, order: str, rows_per_shard: int) -> DataFrame:
    """Adds (shard, offset): N rows per shard by the order of a unique numeric column."""
    placed = positions(df, order, "_at")
    name = F.format_string("shard_%05d", F.floor(F.col("_at") / rows_per_shard))
    return placed.withColumns({"shard": name, "offset": F.pmod(F.col("_at"), F.lit(rows_per_shard))}).drop("_at")


def sharded(df: DataFrame, path: str, order: str, rows_per_shard: int) -> None:
    """One folder per shard; rows are range-partitioned so that a shard is written by one task."""
    out = with_locator(df, order, rows_per_shard)
    out.repartitionByRange("shard").sortWithinPartitions("shard", "offset").write.mode("overwrite").partitionBy("shard").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _row_digest(df: DataFrame) -> DataFrame:
    return df.withColumn("_row", F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256))


def resumable_chunks(df: DataFrame, chunk: str, key: str, path: str, work: Callable[[DataFrame], DataFrame], version: str) -> DataFrame:
    """Chunks that still need work are processed and written; finished ones are kept.

    A chunk is finished when the latest log entry of the chunk has its present identity (row digests of its content and the
    version of the work) and the rows that now stand in its output have the digest that was logged when they were written.
    Older entries do not count, and output that was lost or altered is made anew. Chunks that left the input lose their output.
    Writing overwrites the chunk's own partition, so a run that died can simply be repeated.
    Returns the chunk table of this run: chunk, members, set_digest, version, action (written, kept or dropped).
    """
    spark = df.sparkSession
    now = cut(digest_of_set(_row_digest(df), [chunk], "_row").withColumn("version", F.lit(version)))
    schema = work(df.limit(0)).schema
    data, log = f"{path}/data", f"{path}/_log"
    todo, left, run = now, None, 1
    if _exists(spark, log):
        logged = spark.read.parquet(log)
        run = logged.agg(F.max("run")).first()[0] + 1
        entry = ["members", "set_digest", "version", "out_members", "out_digest"]
        last = cut(logged.groupBy(chunk).agg(F.max_by(F.struct(*entry), "run").alias("e")).select(chunk, "e.*"))
        found = _output(spark, data, schema, chunk)
        sound = last.join(found.withColumnsRenamed({"out_members": "_n", "out_digest": "_d"}), chunk, "left").where(
            F.col("out_members").eqNullSafe(F.coalesce("_n", F.lit(0))) & F.col("out_digest").eqNullSafe(F.col("_d")))
        todo = now.join(sound, [chunk, "members", "set_digest", "version"], "left_anti")
        left = cut(last.join(now, chunk, "left_anti").where("members > 0"))
    todo = cut(todo)
    work(df.join(todo.select(chunk), chunk, "left_semi")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(data)
    if left is not None:
        _drop(spark, data, schema, chunk, left)
    entries = todo.join(_output(spark, data, schema, chunk), chunk, "left").withColumn("out_members", F.coalesce("out_members", F.lit(0).cast("bigint")))
    if left is not None:
        gone = left.withColumns({"members": F.lit(0).cast("bigint"), "set_digest": F.lit(""), "out_members": F.lit(0).cast("bigint"), "out_digest": F.lit(None).cast("string")})
        entries = entries.unionByName(gone)
    entries.withColumn("run", F.lit(run).cast("bigint")).write.mode("append").parquet(log)
    actions = now.join(todo.select(chunk, F.lit("written").alias("action")), chunk, "left").na.fill("kept", ["action"])
    return actions if left is None else actions.unionByName(left.select(*now.columns).withColumn("action", F.lit("dropped")))


def _output(spark: SparkSession, data: str, schema: StructType, chunk: str) -> DataFrame:
    """(chunk, out_members, out_digest) of the rows that stand in the output."""
    if not _exists(spark, data):
        return spark.createDataFrame([], StructType([schema[chunk]])).withColumns(
            {"out_members": F.lit(0).cast("bigint"), "out_digest": F.lit(None).cast("string")})
    rows = spark.read.schema(schema).parquet(data)
    return digest_of_set(_row_digest(rows), [chunk], "_row").withColumnsRenamed({"members": "out_members", "set_digest": "out_digest"})


def _drop(spark: SparkSession, data: str, schema: StructType, chunk: str, left: DataFrame) -> None:
    """Deletes the folders of chunks that left the input."""
    if not _exists(spark, data):
        return
    stored = spark.read.schema(schema).parquet(data).select(chunk, F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder"))
    path = spark._jvm.org.apache.hadoop.fs.Path
    for row in stored.join(left.select(chunk), chunk, "left_semi").select("folder").distinct().toLocalIterator():
        folder = path(row["folder"])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


POINTERS, VERSIONS = "_pointers", "versions"


def publish(tables: dict[str, DataFrame], target: str, keep: int = 2) -> str:
    """All tables or none: written to a folder of their own that never changes again; then one pointer names it.

    The pointer is an empty object whose name holds a number and the version, so it is there as a whole or not at all, on file systems
    and object stores alike. Readers take the pointer with the largest number (``published``): before it is created they see the
    old set, afterwards the new one. Versions beyond the last ``keep`` are deleted, so a reader has that long to finish.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{target}/{VERSIONS}/{version}/{name}")
    fs, path = _files(spark, target)
    known = _pointers(spark, target)
    number = known[-1][0] + 1 if known else 1
    fs.create(path(f"{target}/{POINTERS}/{number:012d}-{version}"), False).close()
    # the number may have been taken by another writer meanwhile: all see the same last one, which is kept
    for _, old in _pointers(spark, target)[:-keep]:
        fs.delete(path(f"{target}/{VERSIONS}/{old}"), True)
    return version


def _files(spark: SparkSession, target: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(target).getFileSystem(spark._jsc.hadoopConfiguration()), path


def _pointers(spark: SparkSession, target: str) -> list[tuple[int, str]]:
    """(number, version) of all pointers, in order."""
    fs, path = _files(spark, target)
    folder = path(f"{target}/{POINTERS}")
    if not fs.exists(folder):
        return []
    names = sorted(status.getPath().getName() for status in fs.listStatus(folder))
    return [(int(n[:12]), n[13:]) for n in names if not n.startswith(".")]


def published(spark: SparkSession, target: str, name: str) -> DataFrame:
    """A table of the set that is published now; the whole frame reads that version, whatever is published later."""
    known = _pointers(spark, target)
    if not known:
        raise ContractError(f"nothing is published at {target}")
    return spark.read.parquet(f"{target}/{VERSIONS}/{known[-1][1]}/{name}")


def bucketed_store(df: DataFrame, key: list[str], name: str | None = None, buckets: int | None = None) -> DataFrame:
    """``df`` as a table that is bucketed and sorted by ``key``: lookups and joins by the key move the other side only.

    At least as many buckets as the session shuffles into; with fewer, Spark would rather shuffle both sides.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many, name = max(buckets or 0, parts), name or f"trialloom_store_{uuid.uuid4().hex}"
    placed = df.repartition(many, *key)  # one file a bucket
    placed.write.format("parquet").bucketBy(many, *key).sortBy(*key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def artifact_manifest(spark: SparkSession, path: str) -> DataFrame:
    return file_digests(spark, path)


def manifest_differences(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(file, problem) for files that are missing, unexpected or changed."""
    a = declared.select("file", F.col("sha256").alias("want"))
    b = actual.select("file", F.col("sha256").alias("have"))
    problem = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(
        F.col("want") != F.col("have"), "changed")
    return a.join(b, "file", "full_outer").select("file", problem.alias("problem")).where("problem is not null")
