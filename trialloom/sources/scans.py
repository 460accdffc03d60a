"""Readers: delimited files with a dialect, numbered parts, strict CSV, manifests, stores, shards."""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from trialloom.functions.text import after_marker
from trialloom.operators.contracts import ContractError

BOM = "﻿"


def strings(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def delimited(spark: SparkSession, paths: str | list[str], names: list[str], sep: str = ",", header: bool = True,
              drop: Column | None = None, multi_line: bool = False) -> DataFrame:
    """All-string scan with given names; ``drop`` names the lines that are no data (a second header line).

    Files are split between tasks; only ``multi_line``, for quoted line breaks, keeps each file in one task.
    """
    out = spark.read.schema(strings(names)).option("sep", sep).option("header", header).option("multiLine", multi_line).option(
        "escape", '"').csv(paths)
    return out if drop is None else out.where(~F.coalesce(drop, F.lit(False)))


def numbered(spark: SparkSession, pattern: str, numbers: list[int], names: list[str], sep: str = ";", header: bool = False) -> DataFrame:
    """Parts of one table, e.g. ``dir/nr_{}.csv``; adds the part number taken from the path."""
    out = delimited(spark, [pattern.format(n) for n in numbers], names, sep, header)
    folder = pattern.split("/")[-1].split("{}")
    found = F.regexp_extract(F.col("_metadata.file_path"), f"{folder[0]}([0-9]+)", 1).cast("int")
    return out.withColumn("part", found)


def strict_csv(spark: SparkSession, path: str, required: list[str], exact: bool = False, multi_line: bool = False) -> DataFrame:
    """CSV with a checked header; a leading byte-order mark is dropped, ragged lines fail the read.

    Every part must have the header of the first one: another header, or another order, fails the read when it is run.
    """
    options = {"header": True, "mode": "FAILFAST", "escape": '"', "multiLine": multi_line}
    found = spark.read.options(**options).csv(path).columns
    raw = spark.read.options(**options, enforceSchema=False).schema(strings(found)).csv(path)
    names = [c.replace(BOM, "") for c in found]
    raw = raw.toDF(*names)
    if exact and names != required:
        raise ContractError(f"header of {path}: {names}, expected {required}")
    missing = [c for c in required if c not in names]
    if missing:
        raise ContractError(f"{path} lacks columns {missing}")
    return raw.select(*required)


#: files up to this size are hashed as one value, larger ones as a stream of pieces
WHOLE_BYTES, PIECE_BYTES = 64 << 20, 4 << 20
_MARK = b"\xef\xbb\xbf"


def file_digests(spark: SparkSession, path: str, whole: int = WHOLE_BYTES) -> DataFrame:
    """(file, bytes, sha256) of the files below a folder, by their path from there, whatever their size.

    Small files are hashed where they are read. A larger one is read by Spark in splits, packed into pieces and hashed piece by piece
    in order by one task, which holds the running hash and a piece (SHA-256 needs all bytes in order). Only Spark's readers touch the
    files, so any store they know will do; they skip empty files, which are not listed. A single line of 2 GB is an error.
    """
    root = re.escape(re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/"))
    name = lambda c: F.regexp_extract(c, f"^.*?{root}/(.*)$", 1).alias("file")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= whole).select(name(F.col("path")), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path).where(F.col("_metadata.file_size") > whole)
    return small.unionByName(_streamed_digests(lines).select(
        name(F.url_decode(F.regexp_replace("file", r"\+", "%2B"))), "bytes", "sha256"))


def _streamed_digests(lines: DataFrame) -> DataFrame:
    """(file, bytes, sha256) from the lines of whole files: reading at line feeds loses no byte but a leading byte-order mark and
    whether the last line was ended, and both follow from the file's size."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, held, size = None, 0, [], 0

        def piece() -> pa.RecordBatch:
            file, total, start = now
            return pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([total], pa.int64()), pa.array([start], pa.int64()), pa.array([number], pa.int64()),
                 pa.array([b"\n".join(held)], pa.large_binary()).cast(pa.binary())], ["file", "bytes", "start", "number", "piece"])

        for batch in batches:
            for *key, line in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "start", "line"))):
                if key != now or size > PIECE_BYTES:
                    if held:
                        yield piece()
                    number = number + 1 if key == now else 0
                    now, held, size = key, [], 0
                held.append(line)
                size += len(line) + 1
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, plain, marked, seen = None, None, None, 0

        def result() -> pa.RecordBatch:
            file, total = now
            if total - seen not in (0, 1, 3, 4):
                raise ContractError(f"{file} has changed while it was read: {seen} bytes of {total}")
            ended, found = b"\n" * ((total - seen) % 3), marked if total - seen >= 3 else plain
            found.update(ended)
            return pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([total], pa.int64()), pa.array([found.hexdigest()])], ["file", "bytes", "sha256"])

        for batch in batches:
            for file, total, part in zip(*(batch.column(c).to_pylist() for c in ("file", "bytes", "piece"))):
                if (file, total) != now:
                    if now is not None:
                        yield result()
                    now, plain, marked, seen = (file, total), hashlib.sha256(), hashlib.sha256(_MARK), 0
                else:
                    part = b"\n" + part
                plain.update(part)
                marked.update(part)
                seen += len(part)
        if now is not None:
            yield result()

    read = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"),
                        F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    pieces = read.mapInArrow(pack, "file string, bytes long, start long, number long, piece binary")
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pieces.repartition(parts, "file").sortWithinPartitions("file", "start", "number")
    return ordered.mapInArrow(digest, "file string, bytes long, sha256 string")


def manifest(spark: SparkSession, path: str, schema: str, one_document: bool = True) -> DataFrame:
    """JSON with a stated schema: one document per file, or one per line."""
    return spark.read.schema(schema).option("multiLine", one_document).option("mode", "FAILFAST").json(path)


def bound_index(spark: SparkSession, manifest_path: str, version: int = 2) -> DataFrame:
    """The Parquet index a manifest describes, after its version, part digests and row count are checked."""
    info = manifest(spark, manifest_path, "schema_version int, index string, row_count long, parts array<struct<file: string, sha256: string>>")
    head = info.select("schema_version", "index", "row_count").first()
    if head["schema_version"] != version:
        raise ContractError(f"manifest version {head['schema_version']}, expected {version}")
    have = file_digests(spark, head["index"]).where("file like '%.parquet'").select("file", "sha256")
    declared = info.select(F.inline("parts"))
    changed = declared.exceptAll(have).unionByName(have.exceptAll(declared)).limit(1).collect()
    if changed:
        raise ContractError(f"index file differs from its manifest: {changed[0]['file']}")
    rows = spark.read.parquet(head["index"])
    if rows.count() != head["row_count"]:
        raise ContractError("index row count differs from its manifest")
    return rows


def split_scan(spark: SparkSession, path: str, split: str, dataset: str | None = None) -> DataFrame:
    """Rows of one split (and dataset); partition columns prune the files read."""
    out = spark.read.parquet(path).where(F.col("split") == split)
    return out if dataset is None else out.where(F.col("dataset_version") == dataset)


def store_lookup(store: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The wanted rows of a keyed store, each exactly once; a repeated key among them makes the read fail."""
    hit = store.join(wanted.select(*key).distinct(), key, "left_semi")  # only what is wanted is grouped
    once = hit.groupBy(*key).agg(*[F.first(c).alias(c) for c in store.columns if c not in key], F.count("*").alias("_n"))
    checked = once.withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated key in store"))).otherwise(F.lit(True)))
    return wanted.join(checked.where("_ok").drop("_n", "_ok"), key)


def shard_lookup(shards: DataFrame, locators: DataFrame) -> DataFrame:
    """Arrays by (shard, offset)."""
    return locators.join(shards, ["shard", "offset"])


def npz_shards(spark: SparkSession, path: str) -> DataFrame:
    """One-off import of array shards: (shard, offset, signal, mask) from NPZ files, one file per row of the file table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                arrays = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({
                    "shard": name.split("/")[-1], "offset": np.arange(len(arrays["eeg"]), dtype=np.int64),
                    "signal": [x.tolist() for x in arrays["eeg"].astype(np.float32)], "mask": [m.tolist() for m in arrays["mask"].astype(np.int8)]})

    return files.select("path", "content").mapInPandas(unpack, "shard string, offset long, signal array<array<float>>, mask array<tinyint>")


def predictions(spark: SparkSession, path: str, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """(prediction, target) as text behind the last marker; missing becomes empty."""
    raw = strict_csv(spark, path, [prediction, target], multi_line=True)
    return raw.select(after_marker(F.col(prediction)).alias("prediction"), after_marker(F.col(target)).alias("target"))
