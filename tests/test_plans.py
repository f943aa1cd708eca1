from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemill import scale, serving
from tidemill.operators.rejects import rejected_rows
from tidemill.plans.marts import global_rank
from tidemill.plans.ops import reachable
from tidemill.plans.quality import LAYOUTS


@pytest.mark.parametrize("run", range(3))
def test_ranks_are_the_same_in_every_run(spark, run):
    rows = [(i * 7919 % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "value int, id int").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        got = {r.id: (r.rank, r["rows"]) for r in global_rank(df, ["value", "id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: (n, 3000) for n, (_, i) in enumerate(sorted(rows), 1)}


def test_reachable_has_no_cap_and_allows_cycles(spark):
    chain = reachable(spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(12)] + [(None, "t1"), ("t0", "t1")], "source string, target string")).collect()
    assert len(chain) == 12 * 13 // 2 and max(r.distance for r in chain) == 12
    full = reachable(spark.createDataFrame([(a, b) for a in "abcd" for b in "abcd" if a != b], "source string, target string")).collect()
    assert Counter(r.distance for r in full) == {1: 12, 2: 4}
    assert reachable(spark.createDataFrame([], "source string, target string")).count() == 0


def test_rejects_judge_repeated_and_null_offsets_by_their_text(spark):
    good, bad = "LOG000000001,2025-04-05T21:11:49Z,payment-service,INFO,x", "LOG1,x"
    df = spark.createDataFrame([(1, "application_logs", good), (1, "application_logs", bad), (None, "application_logs", good), (None, "application_logs", bad), (None, "application_logs", None)], "line_id bigint, dataset string, _corrupt_record string")
    assert Counter((r.line_id, r.reason) for r in rejected_rows(df, LAYOUTS).collect()) == {(1, "column_count"): 1, (None, "column_count"): 2}


def test_salted_join_is_an_inner_join(spark):
    left = spark.range(6000).select(F.when(F.col("id") < 5000, 1).otherwise(F.col("id")).alias("k"), "id")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (5500, "c"), (7, "d")], "k bigint, v string")
    got = scale.join_salted(left, right, "k")
    assert got.columns == ["k", "id", "v"] and Counter(r.v for r in got.collect()) == {"a": 5000, "b": 5000, "c": 1}


def test_scratch_space_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class sparkContext:  # noqa: N801
            applicationId, master = "app-1", "spark://somewhere:7077"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(RuntimeError):
        scale.shared_dir(Cluster)


@pytest.mark.parametrize("value", ["\\') or 1=1 -- ", "'); drop view x; --", "S000001\\"])
def test_filters_are_bound_not_spelled(spark, sf, value):
    assert serving.ask(spark, sf, "analyst", "sales_trend", stores=[value]).count() == 0
    with pytest.raises(serving.AccessDenied):
        serving.ask(spark, sf, "planner", "sales_trend")
    with pytest.raises(ValueError):
        serving.ask(spark, sf, "analyst", "sales_trend", nonsense=1)
