"""Session set-up, lineage cuts and the size of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benches on one machine. On a cluster the submitter configures it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("trialloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a scratch one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later uses neither recompute it nor depend on the executors that made it, and the columnar copy keeps
    column pruning and size statistics (which a plain checkpoint loses). Shuffle files of the write go once it is done;
    left to the driver's garbage collection, those of every step would pile up.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/trialloom-{uuid.uuid4().hex}"
    named = spark.conf.get(_CLEANUP_SETTING, None)
    spark.conf.set(_CLEANUP_SETTING, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP_SETTING, named) if named is not None else spark.conf.unset(_CLEANUP_SETTING)
    return spark.read.schema(df.schema).parquet(path)


def in_small_batches(rows: DataFrame) -> DataFrame:
    """``rows``, of which tasks get Arrow batches of about ``BATCH_BYTES``; a longer row stands alone, whole.

    By itself Spark fills a batch with 10,000 rows, however long they are, and holds it in the executor and its Python worker. The
    bound is a setting of the session; one that the session names itself stays.
    """
    spark = rows.sparkSession
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return rows
