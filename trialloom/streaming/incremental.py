"""Incremental runs over arriving files: idempotent chunk output, running statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trialloom.sources.sinks import publish

#: how much new input a micro-batch takes; single larger files still come whole
BYTES_PER_BATCH = 16 << 30


def process_new_files(spark: SparkSession, source: str, schema: str, output: str, checkpoint: str,
                      work: Callable[[DataFrame], DataFrame], bytes_per_batch: int = BYTES_PER_BATCH) -> None:
    """Every input file becomes one output partition named after its path below ``source``, so equal names in two folders are two
    chunks.

    A file belongs to one micro-batch, and a batch overwrites only its own partitions: replaying a batch after a failure
    gives the same output. The checkpoint remembers finished files, so a later call handles only new ones.
    """
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(source)
    root = spark._jvm.org.apache.hadoop.fs.Path(source)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    path = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B")), r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    named = stream.withColumn("chunk", F.regexp_replace(F.substr(path, F.lit(len(root) + 2)), r"\.parquet$", ""))

    def write(batch: DataFrame, _: int) -> None:
        work(batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(output)

    run = named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()


def running_statistics(spark: SparkSession, source: str, schema: str, by: list[str], value: str, output: str, checkpoint: str,
                       bytes_per_batch: int = BYTES_PER_BATCH) -> None:
    """Count, sum, extremes, mean and centred squares per group, kept up to date batch by batch.

    The state of a group is (count, mean, centred squares), merged part by part, so values far from zero lose no digits. Each batch
    publishes its table as a new version (``sinks.published(spark, output, "statistics")`` reads the last one); readers never see a
    folder that is being written.
    """
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(source)
    v = F.col(value).cast("double")
    stats = stream.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("centred"))

    def write(batch: DataFrame, _: int) -> None:
        publish({"statistics": batch}, output)

    run = stats.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    run.awaitTermination()
