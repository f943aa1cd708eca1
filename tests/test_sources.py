import pytest
from pyspark.sql import functions as F

from tidemill.sources.files import CORRUPT, discover, not_loaded, per_file, read_csv_text
from tidemill.sources.sinks import CommitRefused, commit, export_flat, open_snapshot, publish, write_lines
from tidemill.streaming.bronze import ingest_stream

COLUMNS = ["id", "event_ts", "note"]


def put(folder, name, *lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(["id,event_ts,note", *lines]) + "\n")


def test_csv_keeps_bad_rows_and_spaces(spark, tmp_path):
    put(tmp_path / "landing", "a__2025-01.csv", '1,2025-01-01T00:00:00Z," x ""y"", z "', "2,too,many,cells", " 3 ,,")
    df = read_csv_text(spark, [str(tmp_path / "landing")], COLUMNS, "landing")
    got = {r.id: r for r in df.collect()}
    assert got["1"].note == ' x "y", z ' and got["2"][CORRUPT] == "2,too,many,cells" and got[" 3 "].note is None
    assert got["1"]._source_file == "landing/a__2025-01.csv"
    assert [tuple(r) for r in per_file(df.cache()).collect()] == [("landing/a__2025-01.csv", 3, 1)]


def test_only_new_contents_are_loaded(spark, tmp_path):
    put(tmp_path, "a__1.csv", "1,,")
    put(tmp_path, "b__1.csv", "1,,")
    files = spark.createDataFrame(discover(spark, str(tmp_path)).collect())
    assert {r.dataset for r in files.collect()} == {"a", "b"}
    log = files.where("dataset = 'a'").withColumn("status", F.lit("loaded"))
    assert [r.dataset for r in not_loaded(files, log).collect()] == ["b"]
    put(tmp_path, "a__1.csv", "2,,")
    assert {r.dataset for r in not_loaded(discover(spark, str(tmp_path)), log).collect()} == {"a", "b"}


def test_commit_replaces_keeps_previous_and_refuses(spark, tmp_path):
    path = str(tmp_path / "t")
    assert commit(spark.range(5), path) == 5 and commit(spark.range(7), path, sort=["id"], files=2) == 7
    assert spark.read.parquet(path).count() == 7 and spark.read.parquet(path + "_previous").count() == 5
    with pytest.raises(CommitRefused):
        commit(spark.range(1), path, append_only=True)
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]


def test_snapshot_and_exports(spark, tmp_path):
    path = str(tmp_path / "snap")
    catalogue = publish({"one": spark.range(3), "two": spark.range(4).withColumn("x", F.lit("y"))}, path)
    assert {(r.table_name, r.column_name, r.n_rows) for r in catalogue.collect()} == {("one", "id", 3), ("two", "id", 4), ("two", "x", 4)}
    assert open_snapshot(spark, path) == ["one", "two"] and spark.sql("select count(*) from two").first()[0] == 4
    with pytest.raises(CommitRefused):
        publish({"one": spark.range(3)}, path, limit_bytes=10)
    export_flat(spark.range(3), str(tmp_path / "flat"), ["id"])
    assert len(list((tmp_path / "flat").glob("*.csv"))) == 1
    write_lines(spark.createDataFrame([('a,"b',)], "l string"), "l", str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ['a,"b']


def test_stream_loads_once_and_labels_late_rows(spark, tmp_path):
    landing, target = tmp_path / "landing", str(tmp_path / "bronze")
    event = lambda: F.try_to_timestamp("event_ts", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    put(landing, "e__1.csv", "1,2025-01-01T10:00:00Z,a", "2,2025-01-01T12:00:00Z,b")
    assert ingest_stream(spark, str(landing), COLUMNS, target, event, run="r1") == 2
    put(landing, "e__2.csv", "3,2025-01-01T09:59:59Z,c", "4,2025-01-01T10:00:00Z,d", "5,bad,e", "6")
    assert ingest_stream(spark, str(landing), COLUMNS, target, event, run="r2") == 4
    assert ingest_stream(spark, str(landing), COLUMNS, target, event, run="r3") == 0
    import shutil

    shutil.rmtree(f"{target}/checkpoint")  # the log still knows what is loaded
    assert ingest_stream(spark, str(landing), COLUMNS, target, event, run="r4") == 0
    got = {r.id: r.beyond_watermark for r in spark.read.parquet(f"{target}/rows").collect()}
    assert got == {"1": None, "2": None, "3": "true", "4": "false", "5": None, "6": None}
    assert spark.read.parquet(f"{target}/rows").select("_record_hash").distinct().count() == 6
    assert spark.read.parquet(f"{target}/log").agg(F.sum("rows_read"), F.sum("rows_corrupt")).first()[:] == (6, 1)


def test_stream_survives_lost_checkpoints_and_crashes(spark, tmp_path):
    import shutil

    landing, target = tmp_path / "landing", str(tmp_path / "bronze")
    put(landing, "e__1.csv", "1,,a", "2,,b")
    assert ingest_stream(spark, str(landing), COLUMNS, target) == 2
    shutil.rmtree(f"{target}/checkpoint")
    put(landing, "e__2.csv", "3,,c")
    assert ingest_stream(spark, str(landing), COLUMNS, target) == 1  # same run name, checkpoint gone, one new file
    # A crash after the rows were committed and before they were logged: the batch is loaded again, not doubled.
    shutil.rmtree(f"{target}/checkpoint")
    shutil.rmtree(f"{target}/log")
    assert ingest_stream(spark, str(landing), COLUMNS, target) == 3
    assert sorted(r.id for r in spark.read.parquet(f"{target}/rows").collect()) == ["1", "2", "3"]
