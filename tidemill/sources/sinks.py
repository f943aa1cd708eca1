"""Tables out: staged commits, sorted output, snapshots, flat exports, append-only logs."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class CommitRefused(RuntimeError):
    """A commit that would break its contract: it exists already, or not all rows were written."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put(fs, source, target) -> None:
    """Renames or raises: Hadoop reports a refused rename only by what it returns."""
    if not fs.rename(source, target):
        raise CommitRefused(f"{source} could not be renamed to {target}")


def _swap(spark: SparkSession, fs, staged, path: str) -> None:
    """Puts a staged folder in the place of `path`, keeping what was there as path_previous; restores it if that fails."""
    _, target = _fs(spark, path)
    _, previous = _fs(spark, f"{path}_previous")
    replaced = fs.exists(target)
    if replaced:
        if fs.exists(previous) and not fs.delete(previous, True):
            raise CommitRefused(f"{path}_previous could not be removed")
        _put(fs, target, previous)
    elif not fs.exists(target.getParent()):
        fs.mkdirs(target.getParent())
    try:
        _put(fs, staged, target)
    except CommitRefused:
        if replaced:
            _put(fs, previous, target)
        raise


def commit(df: DataFrame, path: str, append_only: bool = False, sort: Sequence[str] = (), files: int | None = None, partition_by: Sequence[str] = ()) -> int:
    """Writes `df` beside `path`, checks that every row arrived, then renames it into place; returns the rows.

    Append-only tables refuse an existing folder; others keep the one before as path_previous. `sort` orders the table
    over all files by range partitioning, `files` bounds their number. Works on any Hadoop file system.
    """
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if append_only and fs.exists(target):
        raise CommitRefused(f"{path} exists already")
    if sort:
        df = (df.repartitionByRange(files, *sort) if files else df.repartitionByRange(*sort)).sortWithinPartitions(*sort)
    elif files:
        df = df.repartition(files)
    staging, seen = f"{path}_staging_{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*partition_by).parquet(staging)
    rows, there = seen.get["rows"], spark.read.parquet(staging).count()
    _, staged = _fs(spark, staging)
    if rows != there:
        fs.delete(staged, True)
        raise CommitRefused(f"{path}: {rows} rows went in, {there} are there")
    _swap(spark, fs, staged, path)
    return there


def append_log(spark: SparkSession, path: str, rows: Sequence[tuple], schema: str, run: str) -> None:
    """Rows of one run appended to a log table as one small file; a run's rows appear together or not at all."""
    spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{path}/run={run}")


def folder_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def publish(tables: Mapping[str, DataFrame], path: str, limit_bytes: int = 50_000_000) -> DataFrame:
    """All tables as one snapshot folder, swapped in as a whole if it stays under the limit; returns its catalogue.

    Catalogue: (table_name, column_name, data_type, n_rows), also stored in the snapshot.
    """
    spark = next(iter(tables.values())).sparkSession
    staging = f"{path}_staging_{uuid.uuid4().hex}"
    entries = []
    for name, df in tables.items():
        n = commit(df, f"{staging}/{name}.parquet")
        entries += [(name, c, t, n) for c, t in df.dtypes]
    spark.createDataFrame(entries, "table_name string, column_name string, data_type string, n_rows bigint").coalesce(1).write.parquet(f"{staging}/snapshot_schema.parquet")
    fs, staged = _fs(spark, staging)
    if (size := folder_bytes(spark, staging)) > limit_bytes:
        fs.delete(staged, True)
        raise CommitRefused(f"{path}: {size} bytes exceed {limit_bytes}")
    _swap(spark, fs, staged, path)
    return spark.read.parquet(f"{path}/snapshot_schema.parquet")


def open_snapshot(spark: SparkSession, path: str) -> list[str]:
    """Every table of a snapshot as a temporary view of its name."""
    names = [r.table_name for r in spark.read.parquet(f"{path}/snapshot_schema.parquet").select("table_name").distinct().sort("table_name").collect()]  # a catalogue, bounded by the number of tables
    for n in names:
        spark.read.parquet(f"{path}/{n}.parquet").createOrReplaceTempView(n)
    return names


def export_flat(df: DataFrame, path: str, key: Sequence[str]) -> None:
    """One sorted CSV file with header, for people; not for large tables."""
    df.coalesce(1).sortWithinPartitions(*key).write.mode("overwrite").option("header", "true").option("nullValue", "").csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A text column written verbatim, one line per row: how malformed fixtures are made."""
    df.select(F.col(column).alias("value")).write.text(path)
