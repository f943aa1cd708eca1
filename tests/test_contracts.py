from datetime import datetime

from pyspark.sql import functions as F

from tidemill.operators import bronze, contracts
from tidemill.operators.contracts import Check, Contract, Field, Reference, check, in_range, in_sequence

T = datetime(2025, 1, 1)
PARENT = Contract("parents", ("id",), (Field("id", style="upper"), Field("kind", style="lower", values=("a", "b"))), row_id="r")
CHILD = Contract(
    "children",
    ("id",),
    (Field("id", style="upper"), Field("parent", style="upper"), Field("n", "int"), Field("mail", required=False, style="email"), Field("at", "timestamp"), Field("done", "timestamp", required=False)),
    (in_range("n", 1, 9), in_sequence("done_first", "done", "at"), Check("business:large", lambda: F.col("n") > 5, hard=False), Check("business:slow", lambda: F.col("done") > F.col("at"), hard=False, unknown_passes=False)),
    (Reference("parent", "parents", "id"),),
    event="at",
    row_id="r",
)


def children(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "r bigint, _ingestion_ts timestamp_ntz, id string, parent string, n string, mail string, at string, done string")


def test_validation_cascade_and_conservation(spark):
    parents = check(spark.createDataFrame([(1, T, "p1", "A"), (2, T, " P2 ", "zzz"), (3, T, "p2", None)], "r bigint, _ingestion_ts timestamp_ntz, id string, kind string"), PARENT)
    assert {(r.std_id, tuple(r.failures)) for r in parents.checked.collect()} == {("P1", ()), ("P2", ("required_missing:kind",))}
    at = "2025-01-01 10:00:00"
    rows = [
        (T, "c1", "p1", "5", "X@Y.org ", at, None),
        (T, " C1", "P1", "6", "nope", "2025-01-01T11:00:00Z", at.replace("10", "12", 1) and "2025-01-01 12:00:00"),  # later event: stays
        (T, "c2", "p2", "3", None, at, None),  # only its parent is rejected
        (T, "c3", "p2", "99", None, at, None),  # direct as well
        (T, "c4", "p9", "x", None, at, None),
        (T, None, "p1", "1", None, at, None),
        (T, "", "p1", "1", None, at, None),
        (T, "c5", "p1", "2", None, at, "2024-01-01 00:00:00"),
    ]
    o = check(children(spark, rows), CHILD, {"parents": parents})
    got = {r.r: (r.primary_rule, r.rejection_type, r.n_copies) for r in o.checked.collect()}
    assert got == {
        1: (None, None, 2),
        2: ("parent_rejected:parents", "cascade", 1),
        3: ("range_invalid:n", "direct", 1),
        4: ("type_invalid:n", "direct", 1),
        5: ("required_missing:id", "direct", 1),
        6: ("required_missing:id", "direct", 1),
        7: ("sequence_invalid:done_first", "direct", 1),
    }
    assert [(r.id, r.mail, r.dq_large, r.dq_slow) for r in o.valid.collect()] == [("C1", None, True, True)]
    assert tuple(contracts.conservation(o).first()) == ("children", 8, 1, 5, 1, 1)
    q = {r.row_id: r for r in contracts.quarantine(o).collect()}
    assert q[4].failed_rules == "type_invalid:n|fk_missing:parent" and q[2].severity == "warning" and '"parent":"p2"' in q[2].raw_record
    rules = {(r.check_type, r.rule_name): r.rows_affected for r in contracts.quality_rows(o).collect()}
    assert rules["rule", "required_missing:id"] == 2 and rules["soft_rule", "business:large"] == 2 and rules["standardize", "id"] == 5


def test_empty(spark):
    parents = spark.createDataFrame([], "id string")
    o = check(children(spark, []), CHILD, {"parents": parents})
    assert o.valid.count() == 0 and tuple(contracts.conservation(o).first())[1:] == (0, 0, 0, 0, 0)


def test_majority_spelling(spark):
    df = spark.createDataFrame([(x,) for x in ["Ab", "Ab", "AB", "cd", "CD", None]], "b string")
    assert sorted((r.b or "") for r in contracts.majority_spelling(df, "b").collect()) == ["", "Ab", "Ab", "Ab", "CD", "CD"]


def test_lateness(spark):
    rows = [("x__2025-09-25T23-00.csv", "2025-09-10 00:00:00"), ("x__2025-09.csv", "2025-08-31 18:30:00"), ("x__2025-09-01.csv", "2025-08-31 18:29:59"), ("x.csv", "2025-01-01 00:00:00"), ("x__2025-09-01.csv", None)]
    df = spark.createDataFrame(rows, "f string, t string").select(bronze.late_flag(F.col("t").cast("timestamp"), F.col("f")).alias("l"))
    assert [r.l for r in df.collect()] == ["true", "false", "true", None, None]
