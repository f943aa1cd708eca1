"""Reading the engine's Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The Parquet table `name` under `root`, one file or a directory of them; columns and filters are pushed down."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def instants(df: DataFrame) -> DataFrame:
    """`df` with every zone-less timestamp read as an instant of the session's time zone."""
    return df.select(*[F.col(f"`{n}`").cast("timestamp").alias(n) if t == "timestamp_ntz" else F.col(f"`{n}`") for n, t in df.dtypes])
