"""Raw files in: CSV scans and streams of text columns, file discovery by content, the log of what was loaded."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where a row that does not parse is kept.
CORRUPT = "_corrupt_record"
_OPTIONS = {"header": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "enforceSchema": "true"}


def text_schema(columns: Sequence[str]) -> T.StructType:
    """All columns as text, and one for rows that do not parse; nothing is inferred."""
    return T.StructType([T.StructField(c, T.StringType()) for c in [*columns, CORRUPT]])


def with_source(df: DataFrame, root: str | None = None) -> DataFrame:
    """Adds _source_file, relative to the last folder called `root` if given."""
    path = F.col("_metadata.file_path")
    return df.select("*", (F.regexp_extract(path, rf"({re.escape(root)}/.*)$", 1) if root else path).alias("_source_file"))


def read_csv_text(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], root: str | None = None) -> DataFrame:
    """CSV files as text columns with their source file; bad rows are kept whole, spaces are kept."""
    return with_source(spark.read.schema(text_schema(columns)).options(**_OPTIONS).csv(list(paths)), root)


def stream_csv_text(spark: SparkSession, folder: str, columns: Sequence[str], files_per_batch: int = 24, root: str | None = None) -> DataFrame:
    """The same as a stream of the files arriving in a folder."""
    return with_source(spark.readStream.schema(text_schema(columns)).options(**_OPTIONS).option("maxFilesPerTrigger", files_per_batch).csv(folder), root)


def discover(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(dataset, file_name, sha256, size_bytes, path) of every file below `folder`; contents are hashed by the executors.

    The dataset is the part of the name before '__'.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.substring_index(name, "__", 1).alias("dataset"), name.alias("file_name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), "path")


def not_loaded(files: DataFrame, log: DataFrame) -> DataFrame:
    """Files whose identity (dataset, name, content) is not in the log as loaded; of equal new files all stay."""
    done = log.where(F.col("status") == "loaded").select("dataset", "file_name", "sha256")
    return files.join(done, ["dataset", "file_name", "sha256"], "left_anti")


def per_file(df: DataFrame, corrupt: Column | None = None) -> DataFrame:
    """Rows and corrupt rows of each source file."""
    bad = F.col(CORRUPT).isNotNull() if corrupt is None else corrupt
    return df.groupBy("_source_file").agg(F.count("*").alias("rows_read"), F.count_if(bad).alias("rows_corrupt"))
