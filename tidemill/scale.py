"""Helpers that keep plans safe at scale: shared scratch space and joins with hot keys."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the rows; there can be at most HOT_SHARE such keys.
HOT_SHARE = 1024

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors share; removed when the application ends.

    Where the setting is absent a temporary folder stands in, on a local master only: on a cluster every executor would
    write to its own disk and what is read back would be incomplete.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _own:
        configured = sc.getConf().get("spark.checkpoint.dir")
        if not configured and not (sc.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = configured.rstrip("/") if configured else f"file://{tempfile.gettempdir()}"
        _own[app] = f"{root}/tidemill-{app}-{uuid.uuid4().hex[:8]}"
        path = sc._jvm.org.apache.hadoop.fs.Path(_own[app])
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _own[app]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers wherever they run: once per application, through the shared folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root, held = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{root.name}-{uuid.uuid4().hex}.zip")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
    out.write(held.getvalue())
    out.close()
    sc.addPyFile(path.toString())
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow for functions that use this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(f, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """`written` and the number of rows, which is observed while they are written."""
    seen = Observation()
    table = written(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return table, seen.get["n"]


def join_salted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join on `key`, any number of rows per key on both sides, without a task that holds a hot key of `left`.

    `left` must be cheap to read twice (a written table). Keys with over 1/HOT_SHARE of its rows, fewer than HOT_SHARE of
    them, are cut into as many salts as they exceed that share; the rows of `right` with such a key are repeated per salt.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("__n"))
    total = F.broadcast(left.agg(F.count("*").alias("__all")))  # one row
    share = F.greatest(F.lit(1000.0), F.col("__all") / HOT_SHARE)
    hot = F.broadcast(counts.join(total).where(F.col("__n") > share).select(key, F.ceil(F.col("__n") / share).cast("int").alias("__k")))
    k = F.coalesce("__k", F.lit(1))
    mine = left.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), k).cast("int"))
    other = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), k - 1)))
    return mine.drop("__k").join(other.drop("__k"), [key, "__salt"]).drop("__salt")


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of `left` with `right` (one row per key, `n` = how many rows of `left` hold it) without a skewed task.

    Keys with over 1/HOT_SHARE of the `total` rows of `left` go by broadcast: there are fewer than HOT_SHARE of them
    whatever the data. Only the rest, in which no key is hot, is shuffled. `right` is read three times: write it first
    if it is costly.
    """
    limit = max(1, total // HOT_SHARE)
    hot, cold = F.broadcast(right.where(F.col(n) > limit)), right.where(F.col(n) <= limit)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(cold, key))
