"""Batch ingestion: files become append-only batches, each content once, with what is known about where a row came from."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.bronze import late_flag, record_hash
from tidemill.scale import written
from tidemill.sources.files import CORRUPT, discover, not_loaded, per_file, read_csv_text
from tidemill.sources.sinks import _fs, commit

#: Columns every ingested row gets beside its own.
METADATA = ("_batch_id", "_source_world", "_source_file", "_record_hash", "_is_late", "_ingestion_ts")


class OtherWorld(RuntimeError):
    """The target holds rows of another source world; it must be reset before it takes these."""


def reset(spark: SparkSession, target: str) -> None:
    """Removes all batches and their log."""
    fs, path = _fs(spark, target)
    if fs.exists(path) and not fs.delete(path, True):
        raise OSError(f"{target} could not be removed")


def read_log(spark: SparkSession, target: str) -> DataFrame:
    """The file log of a target; empty before its first batch."""
    fs, path = _fs(spark, f"{target}/log")
    if fs.exists(path):
        return spark.read.parquet(f"{target}/log")
    return spark.createDataFrame([], "dataset string, file_name string, sha256 string, size_bytes bigint, status string, rows_read bigint, rows_corrupt bigint, batch_id string, world string")


def ingest_batch(spark: SparkSession, folder: str, dataset: str, columns: Sequence[str], target: str, batch: str, world: str, event: Callable[[], Column] | None = None, force: bool = False) -> int:
    """Loads the new files of `dataset` in `folder` into target/rows/batch=...; returns the rows.

    A file is known by dataset, name and content: known ones are logged as skipped and left out, unless `force`d. Every
    column stays text; METADATA is added (`event`: when a row happened, for the late flag). The batch is committed as one
    folder and refused if it exists. Rows of one world are never added to those of another.
    """
    log = read_log(spark, target)
    if other := [r.world for r in log.where(F.col("world") != world).select("world").distinct().collect()]:  # at most one per target
        raise OtherWorld(f"{target} was built from {other}; reset it before adding {world}")
    found = written(discover(spark, folder).where(F.col("dataset") == dataset), "found-files")
    new = found if force else not_loaded(found, log)
    new = written(new, "new-files")
    paths = [r.path for r in new.select("path").collect()]  # the files of one batch
    rows_log = None
    rows = 0
    if paths:
        root = folder.rstrip("/").split("/")[-1]
        raw = read_csv_text(spark, paths, columns, root)
        late = late_flag(event(), F.col("_source_file")) if event else F.lit(None).cast("string")
        enriched = raw.select(*columns, CORRUPT, F.lit(world).alias("_source_world"), "_source_file", record_hash([*columns, CORRUPT]).alias("_record_hash"), late.alias("_is_late"), F.current_timestamp().alias("_ingestion_ts"), F.lit(batch).alias("_batch_id"))
        rows = commit(enriched, f"{target}/rows/batch={batch}", append_only=True)
        counts = per_file(spark.read.parquet(f"{target}/rows/batch={batch}")).withColumn("file_name", F.regexp_extract("_source_file", r"([^/]+)$", 1)).drop("_source_file")
        rows_log = new.join(counts, "file_name", "left").select("dataset", "file_name", "sha256", "size_bytes", F.lit("loaded").alias("status"), F.coalesce("rows_read", F.lit(0)).alias("rows_read"), F.coalesce("rows_corrupt", F.lit(0)).alias("rows_corrupt"))
    skipped = found.join(new.select("path"), "path", "left_anti").select("dataset", "file_name", "sha256", "size_bytes", F.lit("skipped").alias("status"), F.lit(0).cast("bigint").alias("rows_read"), F.lit(0).cast("bigint").alias("rows_corrupt"))
    entries = skipped if rows_log is None else rows_log.unionByName(skipped)
    entries.withColumns({"batch_id": F.lit(batch), "world": F.lit(world)}).coalesce(1).write.mode("append").parquet(f"{target}/log")
    return rows
