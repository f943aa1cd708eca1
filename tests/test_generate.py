from pyspark.sql import functions as F

from tidemill.operators import generate as g


def test_uniforms_depend_on_key_and_stream_only(spark):
    df = spark.range(5000)
    a = {r.id: r.u for r in df.select("id", g.uniform("s", F.col("id")).alias("u")).collect()}
    b = {r.id: r.u for r in df.repartition(7).select("id", g.uniform("s", F.col("id")).alias("u")).collect()}
    assert a == b and 0 <= min(a.values()) and max(a.values()) < 1 and abs(sum(a.values()) / 5000 - 0.5) < 0.02
    assert a != {r.id: r.u for r in df.select("id", g.uniform("t", F.col("id")).alias("u")).collect()}


def test_allocation_adds_up(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 3.0), ("a", 3, 1.0), ("b", 1, 0.0)], "k string, i int, w double")
    got = {(r.k, r.i): r.units for r in g.largest_remainder(df, "w", 10, "i", ["k"]).collect()}
    assert got == {("a", 1): 5, ("a", 2): 4, ("a", 3): 1, ("b", 1): 0} or sum(v for (k, _), v in got.items() if k == "a") == 10
    assert got["b", 1] == 0


def test_draws_follow_weights(spark):
    choices = spark.createDataFrame([("x", 1.0), ("y", 3.0), ("z", 0.0)], "c string, w double")
    got = {r.c: r["count"] for r in g.drawn(spark.range(4000), choices, "c", "w", g.uniform("d", F.col("id"))).groupBy("c").count().collect()}
    assert set(got) == {"x", "y"} and abs(got["y"] - 3000) < 150


def test_budget_and_faults(spark):
    shares = {"miss": 0.02, "type": 0.01, "seq": 0.01}
    assert g.budget(1000, shares, ["miss", "type"]) == {"miss": 27, "type": 13} and g.budget(1000, shares, []) == {}
    df = spark.range(3000).withColumn("v", F.lit("ok"))
    x = g.with_faults(df, "id", {"blank": (0.1, {"v": F.lit(None)}), "odd": (0.1, {"v": F.lit("?")})})
    assert {(r.fault, r.v) for r in x.select("fault", "v").distinct().collect()} == {(None, "ok"), ("blank", None), ("odd", "?")}
    twice = g.with_copies(df, "id", 0.1)
    assert 3200 < twice.count() < 3400 and twice.distinct().count() == 3000
    top = g.zipf_weights(spark.range(5), "id").agg(F.max("weight"), F.min("weight")).first()
    assert tuple(top) == (1.0, 0.2)
