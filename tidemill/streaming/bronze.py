"""Streaming ingestion: files arriving in a folder become append-only batches, each loaded once, late rows labelled."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.expressions import tri_state
from tidemill.operators.bronze import record_hash
from tidemill.sources.files import CORRUPT, stream_csv_text
from tidemill.sources.sinks import _fs, commit


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    fs, p = _fs(spark, path)
    return spark.read.parquet(path) if fs.exists(p) else None


def recover(spark: SparkSession, target: str) -> int:
    """Removes committed batches that the log does not know (a crash between rows and log); returns how many.

    Their files are not in the log, so the next run loads them again: nothing is lost or doubled.
    """
    fs, rows = _fs(spark, f"{target}/rows")
    if not fs.exists(rows):
        return 0
    log = _read_or_none(spark, f"{target}/log")
    known = {r.batch for r in log.select("batch").distinct().collect()} if log is not None else set()  # one row per batch
    lost = [s.getPath() for s in fs.listStatus(rows) if s.getPath().getName().startswith("batch=") and s.getPath().getName().removeprefix("batch=") not in known]
    for path in lost:
        fs.delete(path, True)
    return len(lost)


def ingest_stream(spark: SparkSession, folder: str, columns: Sequence[str], target: str, event: Callable[[], Column] | None = None, delay_seconds: int = 7200, files_per_batch: int = 24, run: str = "run") -> int:
    """Loads what has newly arrived in `folder` into target/rows/batch=..., logging files in target/log; returns the rows.

    Each micro-batch is one committed folder, named by the files in it. The log, not the checkpoint, decides what is loaded:
    after a lost checkpoint, or for a batch that is retried, files in the log are left out, and folders that the log does
    not know are removed before the stream starts. With `event`, rows more than
    `delay_seconds` before the latest event of the batches before are labelled beyond_watermark 'true' (first batch:
    null); nothing is dropped. The state is the maximum kept with the log: one row per batch.
    """
    written = 0

    def load(batch: DataFrame, epoch: int) -> None:
        nonlocal written
        log = _read_or_none(spark, f"{target}/log")
        if log is not None:
            batch = batch.join(log.select("_source_file").distinct(), "_source_file", "left_anti")
        batch = batch.persist()
        try:
            if batch.isEmpty():
                return
            top = log.agg(F.max("max_event")).first()[0] if log is not None and event else None
            beyond = tri_state(F.unix_seconds(event()) < F.lit(top - delay_seconds)) if top is not None else F.lit(None).cast("string")
            files = sorted(r[0] for r in batch.select("_source_file").distinct().collect())  # at most files_per_batch
            name = f"{run}__{hashlib.sha256(chr(10).join(files).encode()).hexdigest()[:16]}"
            rows = batch.select(*columns, CORRUPT, "_source_file", record_hash([*columns, CORRUPT]).alias("_record_hash"), F.current_timestamp().alias("_ingestion_ts"), beyond.alias("beyond_watermark"))
            written += commit(rows, f"{target}/rows/batch={name}", append_only=True)
            per_file = batch.groupBy("_source_file").agg(F.count("*").alias("rows_read"), F.count_if(F.col(CORRUPT).isNotNull()).alias("rows_corrupt"), F.max(F.unix_seconds(event()) if event else F.lit(None).cast("bigint")).alias("max_event"))
            per_file.withColumn("batch", F.lit(name)).coalesce(1).write.mode("append").parquet(f"{target}/log")
        finally:
            batch.unpersist()

    recover(spark, target)
    last = folder.rstrip("/").split("/")[-1]
    root = None if set(last) & set("*?[{") else last  # a pattern names no folder
    stream = stream_csv_text(spark, folder, columns, files_per_batch, root)
    stream.writeStream.foreachBatch(load).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return written
