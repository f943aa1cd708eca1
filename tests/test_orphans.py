from datetime import datetime

from pyspark.sql import functions as F

from tidemill import scale
from tidemill.operators import orphans
from tidemill.operators.orphans import ForeignKey, orphan_counts

t = lambda d: datetime(2025, 1, d)


def orphan_references(child, column, parent, parent_column):
    return orphans.orphan_references(child, [ForeignKey(column, parent, parent_column)])


CHILD = "row_id bigint, fk string, _ingestion_ts timestamp_ntz, key string, n int"
PARENT = "pk string, _ingestion_ts timestamp_ntz, _deleted_at timestamp_ntz, key string"


def test_kinds(spark):
    parent = spark.createDataFrame([("A", t(1), None, "x"), ("a ", t(3), t(4), "x"), ("B", t(1), t(2), "x"), ("b", t(1), t(5), "x"), ("C", t(6), None, "x"), ("D", t(6), t(7), "x"), (None, t(1), None, "x")], PARENT)
    rows = [(1, "a", t(2)), (2, " B", t(4)), (3, "B", t(5)), (4, "c", t(5)), (5, "C", t(6)), (6, "z", t(1)), (7, None, t(1)), (8, "", t(1)), (9, "d", t(5)), (10, "z", None), (11, "c", None), (6, "z", t(1))]
    child = spark.createDataFrame([(*r, "k", 1) for r in rows], CHILD)
    got = sorted((r.row_id, r.kind) for r in orphan_references(child, "fk", parent, "pk").collect())
    assert got == [(3, "deleted"), (4, "late"), (6, "missing"), (6, "missing"), (8, "missing"), (9, "late"), (10, "missing")]
    assert orphan_references(child.limit(0), "fk", parent, "pk").count() == 0
    assert orphan_references(child, "fk", parent.limit(0), "pk").count() == 11
    assert orphan_references(child, "fk", parent.drop("_deleted_at"), "pk").where("kind = 'deleted'").count() == 0
    found = orphan_references(child, "fk", parent, "pk").withColumn("child_table", F.lit("c"))
    assert sum(r.n_rows for r in orphan_counts(found, ["child_table"]).collect()) == 7


def test_hot_missing_key_goes_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_SHARE", 4)
    child = spark.range(400).select(F.col("id").alias("row_id"), F.when(F.col("id") < 150, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("fk"), F.lit(t(1)).cast("timestamp_ntz").alias("_ingestion_ts"))
    parent = child.where("row_id between 200 and 299").select(F.col("fk").alias("pk"), "_ingestion_ts")
    got = orphan_references(child, "fk", parent, "pk")
    assert got.count() == 300 and got.select("row_id").distinct().count() == 300


def test_references_of_one_child_are_kept_apart(spark):
    child = spark.createDataFrame([(1, "a", t(2), "x", 1), (2, "b", t(2), None, 1)], CHILD)
    one, two = spark.createDataFrame([("A", t(1), None, "x")], PARENT), spark.createDataFrame([("b", t(3), None, "x")], PARENT)
    got = orphans.orphan_references(child, [ForeignKey("fk", one, "pk"), ForeignKey("key", two, "pk"), ForeignKey("fk", two, "pk")]).collect()
    assert sorted((r.child_column, r.row_id, r.kind) for r in got) == [("fk", 1, "missing"), ("fk", 2, "late"), ("fk", 2, "missing"), ("key", 1, "missing")]
