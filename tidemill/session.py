"""One place that decides how a session of this engine is configured."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that the results rely on (time zone) or the plans are laid out for (adaptive execution).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


def get_spark(app: str = "tidemill", master: str | None = None, **conf: str) -> SparkSession:
    """The active session, or a new one with DEFAULTS; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master or not os.environ.get("SPARK_MASTER"):
        builder = builder.master(master or "local[*]")
    spark = builder.config(map=DEFAULTS | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
