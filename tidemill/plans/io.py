"""Sources and sinks as queries: each writes what it reads to the shared folder, so that the way there and back is checked."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.contracts import clean
from tidemill.operators.rejects import instant
from tidemill.plans import silver
from tidemill.plans.registry import Registry
from tidemill.scale import shared_dir
from tidemill.sources import files, ingest, sinks, tracking
from tidemill.sources.tables import instants, table
from tidemill.streaming import bronze, windows

query = Registry()
QUERIES, SQL = query.queries, query.sql

_PAYMENT = ["payment_id", "order_id", "attempt_no", "method", "amount", "status", "payment_ts"]
_ROWS = ["row_id", *_PAYMENT]
_FILLED = ", ".join(f"nullif({c}, '') as {c}" for c in _PAYMENT)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").option("emptyValue", "").csv(path)


def _payments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "brz_payments").select(F.col("row_id").cast("string").alias("row_id"), *_PAYMENT)


@query(f"select cast(row_id as varchar) as row_id, {_FILLED}, true as has_source from brz_payments")
def io_csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Payments written as CSV and scanned as text with their source file; spaces and odd values are kept."""
    path = _folder(spark, "csv")
    _csv(_payments(spark, d), path)
    back = files.read_csv_text(spark, [path], _ROWS)
    return back.where(F.col(files.CORRUPT).isNull()).select(*_ROWS, F.col("_source_file").endswith(".csv").alias("has_source"))


@query(f"select cast(row_id as varchar) as row_id, {_FILLED} from brz_payments")
def io_stream_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same files read as a stream of micro-batches until nothing is left."""
    path = _folder(spark, "csv")
    _csv(_payments(spark, d).repartition(6), path)
    return windows.run_to_table(files.stream_csv_text(spark, path, _ROWS, 2).select(*_ROWS), "append")


@query(f"""select cast(row_id as varchar) as row_id, sha256(concat_ws(chr(31), {", ".join(f"coalesce(nullif({c}, ''), chr(0))" if c != "row_id" else "cast(row_id as varchar)" for c in _ROWS)}, chr(0))) as record_hash,
    cast(null as varchar) as beyond_watermark from brz_payments""")
def io_stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Streaming ingestion in two runs with the checkpoint lost between them: every row once, with its content hash."""
    path, target = _folder(spark, "landing"), _folder(spark, "bronze")
    _csv(_payments(spark, d).where("cast(row_id as bigint) % 2 = 0").repartition(3), f"{path}/a")
    bronze.ingest_stream(spark, f"{path}/*", _ROWS, target)
    fs, checkpoint = sinks._fs(spark, f"{target}/checkpoint")
    fs.delete(checkpoint, True)
    _csv(_payments(spark, d).where("cast(row_id as bigint) % 2 = 1").repartition(3), f"{path}/b")
    bronze.ingest_stream(spark, f"{path}/*", _ROWS, target)
    return spark.read.parquet(f"{target}/rows").select("row_id", F.col("_record_hash").alias("record_hash"), "beyond_watermark")


_TS = silver._TS.format("p")


@query(f"select cast(ts as date) as day, cast(count(*) as bigint) as n, cast(count(*) filter (row_id % 3 = 0) as bigint) as later from (select row_id, {_TS} as ts from (select row_id, nullif(trim(payment_ts, ' '), '') as p from brz_payments)) group by 1")
def io_late_rows_by_event_date(spark: SparkSession, d: str) -> DataFrame:
    """Rows that arrive in a second run, out of order, count on the day they happened: the rebuild from all batches equals one load."""
    path, target = _folder(spark, "landing"), _folder(spark, "bronze")
    event = lambda: instant(clean(F.col("payment_ts")))
    late = F.col("row_id").cast("bigint") % 3 == 0
    for part, rows in (("a", _payments(spark, d).where(~late)), ("b", _payments(spark, d).where(late).orderBy(F.xxhash64("row_id")))):
        _csv(rows, f"{path}/{part}")
        bronze.ingest_stream(spark, f"{path}/*", _ROWS, target, event, run=part)
    all_rows = spark.read.parquet(f"{target}/rows")
    return all_rows.groupBy(F.to_date(event()).alias("day")).agg(F.count("*").alias("n"), F.count_if(late).alias("later"))


#: Small landing files, as name and content.
_FILES = (("orders__2025-04-06.csv", "id,event_ts\n1,2025-04-06T01:00:00Z\n2,2025-04-05T01:00:00Z\n"), ("orders__2025-04-07.csv", "id,event_ts\n3,2025-04-07T01:00:00Z\n4\n"), ("stores__2025-04.csv", "id,event_ts\nx,\n"))


def _put(spark: SparkSession, path: str, chosen=_FILES) -> None:
    for name, content in chosen:
        fs, p = sinks._fs(spark, f"{path}/{name}")
        out = fs.create(p)
        out.write(content.encode())
        out.close()


_VALUES = ", ".join(f"""('{n.split("__")[0]}', '{n}', sha256('{c.replace(chr(10), "' || chr(10) || '")}'), {len(c)})""" for n, c in _FILES)


@query(f"select dataset, file_name, sha256, cast(size_bytes as bigint) as size_bytes from (values {_VALUES}) f(dataset, file_name, sha256, size_bytes)")
def io_discovered_files(spark: SparkSession, d: str) -> DataFrame:
    """Files found in a folder, known by dataset, name and the hash of their content."""
    path = _folder(spark, "landing")
    _put(spark, path)
    return files.discover(spark, path).select("dataset", "file_name", "sha256", "size_bytes")


@query("""select * from (values ('1', '1', 'orders__2025-04-06.csv', 'false', 0), ('1', '2', 'orders__2025-04-06.csv', 'true', 0), ('2', '3', 'orders__2025-04-07.csv', 'false', 0), ('2', '4', 'orders__2025-04-07.csv', null, 1),
    ('forced', '3', 'orders__2025-04-07.csv', 'false', 0), ('forced', '4', 'orders__2025-04-07.csv', null, 1), ('forced', '1', 'orders__2025-04-06.csv', 'false', 0), ('forced', '2', 'orders__2025-04-06.csv', 'true', 0)) v(batch, id, file, is_late, corrupt)""")
def io_batch_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Three batches: new files only, what is new in the second, all again when forced; late rows and short rows are marked."""
    path, target = _folder(spark, "landing"), _folder(spark, "bronze")
    event = lambda: F.try_to_timestamp("event_ts", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    _put(spark, path, _FILES[:1])
    ingest.ingest_batch(spark, path, "orders", ["id", "event_ts"], target, "1", "world", event)
    _put(spark, path, _FILES[1:])
    ingest.ingest_batch(spark, path, "orders", ["id", "event_ts"], target, "2", "world", event)
    ingest.ingest_batch(spark, path, "orders", ["id", "event_ts"], target, "forced", "world", event, force=True)
    rows = spark.read.parquet(f"{target}/rows")
    return rows.select(F.col("_batch_id").alias("batch"), "id", F.regexp_extract("_source_file", r"([^/]+)$", 1).alias("file"), F.col("_is_late").alias("is_late"), F.col(files.CORRUPT).isNotNull().cast("int").alias("corrupt"))


@query("select * from (values ('1', 'loaded', 1, 2), ('2', 'loaded', 1, 2), ('2', 'skipped', 1, 0), ('3', 'skipped', 2, 0)) v(batch, status, files, rows_read)")
def io_idempotent_skip(spark: SparkSession, d: str) -> DataFrame:
    """The log of three ingestions of one folder: files already loaded are skipped, and said to be."""
    path, target = _folder(spark, "landing"), _folder(spark, "bronze")
    for batch, chosen in (("1", _FILES[:1]), ("2", _FILES[1:]), ("3", ())):
        _put(spark, path, chosen)
        ingest.ingest_batch(spark, path, "orders", ["id", "event_ts"], target, batch, "world")
    log = ingest.read_log(spark, target).groupBy(F.col("batch_id").alias("batch"), "status").agg(F.count("*").cast("int").alias("files"), F.sum("rows_read").cast("int").alias("rows_read"))
    return log


@query("select * from (values ('first', 'loaded'), ('other world', 'refused'), ('after reset', 'loaded')) v(step, result)")
def io_source_world_guard(spark: SparkSession, d: str) -> DataFrame:
    """A target takes rows of one source world only, until it is reset."""
    path, target, out = _folder(spark, "landing"), _folder(spark, "bronze"), []
    _put(spark, path)

    def load(step: str, batch: str, world: str) -> None:
        try:
            ingest.ingest_batch(spark, path, "orders", ["id", "event_ts"], target, batch, world)
            out.append((step, "loaded"))
        except ingest.OtherWorld:
            out.append((step, "refused"))

    load("first", "1", "one")
    load("other world", "2", "two")
    ingest.reset(spark, target)
    load("after reset", "2", "two")
    return spark.createDataFrame(out, "step string, result string")


@query("select o_orderkey, o_custkey, o_totalprice, cast(row_number() over (order by o_totalprice, o_orderkey) as bigint) as place from orders")
def io_sorted_commit(spark: SparkSession, d: str) -> DataFrame:
    """A table committed in sorted order over all its files: the place of a row is its file's and its own in it."""
    path = _folder(spark, "sorted")
    sinks.commit(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, sort=["o_totalprice", "o_orderkey"], files=4)
    back = spark.read.parquet(path).select("*", F.regexp_extract("_metadata.file_path", r"part-(\d+)", 1).cast("int").alias("file"), F.col("_metadata.row_index").alias("i"))
    sizes = back.groupBy("file").agg(F.count("*").alias("n")).alias("s")
    before = sizes.crossJoin(sizes.select(F.col("file").alias("f2"), F.col("n").alias("n2"))).groupBy("file").agg(F.sum(F.when(F.col("f2") < F.col("file"), F.col("n2")).otherwise(0)).alias("before"))  # one row per file
    return back.join(F.broadcast(before), "file").select("o_orderkey", "o_custkey", "o_totalprice", (F.col("before") + F.col("i") + 1).alias("place"))


@query("select * from (values ('previous', 1), ('refused', 1), ('current', 2), ('stagings left', 0)) v(what, n)")
def io_atomic_replace(spark: SparkSession, d: str) -> DataFrame:
    """A committed table replaced as a whole, the one before kept; an append-only one refuses to be replaced."""
    root = _folder(spark, "atomic")
    one = table(spark, d, "region").limit(1)
    sinks.commit(one, f"{root}/t")
    sinks.commit(table(spark, d, "region").limit(2), f"{root}/t")
    refused = 0
    try:
        sinks.commit(one, f"{root}/t", append_only=True)
    except sinks.CommitRefused:
        refused = 1
    fs, p = sinks._fs(spark, root)
    left = sum("staging" in s.getPath().getName() for s in fs.listStatus(p))
    out = [("previous", spark.read.parquet(f"{root}/t_previous").count()), ("refused", refused), ("current", spark.read.parquet(f"{root}/t").count()), ("stagings left", left)]
    return spark.createDataFrame(out, "what string, n int")


@query("""select 'nation' as table_name, 'n_nationkey' as column_name, (select count(*) from nation) as n_rows union all select 'nation', 'n_name', (select count(*) from nation) union all select 'nation', 'n_regionkey', (select count(*) from nation)
    union all select 'region', 'r_regionkey', (select count(*) from region) union all select 'region', 'r_name', (select count(*) from region)""")
def io_snapshot_publish(spark: SparkSession, d: str) -> DataFrame:
    """Two tables published as one snapshot and opened again; its catalogue says what it holds."""
    path = _folder(spark, "snapshot")
    sinks.publish({"nation": table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "region": table(spark, d, "region").select("r_regionkey", "r_name")}, path)
    names = sinks.open_snapshot(spark, path)
    counts = reduce(DataFrame.unionByName, [spark.table(n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names])
    return spark.read.parquet(f"{path}/snapshot_schema.parquet").select("table_name", "column_name").join(counts, "table_name")


@query("select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation")
def io_flat_export(spark: SparkSession, d: str) -> DataFrame:
    """One sorted CSV file with header, read back as text."""
    path = _folder(spark, "flat")
    sinks.export_flat(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, ["n_nationkey"])
    return spark.read.option("header", "true").csv(path)


@query("select md5(_corrupt_record) as line, cast(count(*) as bigint) as n from landing_rows where _corrupt_record is not null and not contains(_corrupt_record, chr(10)) and not contains(_corrupt_record, chr(13)) group by 1")
def io_verbatim_lines(spark: SparkSession, d: str) -> DataFrame:
    """Landing rows written as lines, byte for byte, malformed ones too, and read back."""
    path = _folder(spark, "lines")
    rows = table(spark, d, "landing_rows").where(~F.contains("_corrupt_record", F.lit("\n")) & ~F.contains("_corrupt_record", F.lit("\r")))
    sinks.write_lines(rows, "_corrupt_record", path)
    return spark.read.text(path).groupBy(F.md5("value").alias("line")).agg(F.count("*").alias("n"))


@query("""select * from (values ('file_loads', 1, 1), ('lineage_edges', 3, 2), ('model_metrics', 2, 1), ('model_runs', 1, 1), ('pipeline_runs', 2, 2), ('quality_results', 3, 2), ('stage_runs', 4, 2), ('table_runs', 2, 2)) v(table_name, n, runs)""")
def io_metadata_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two runs logged to the eight metadata tables, the second failing; a quality result implies its lineage edge, once."""
    root = _folder(spark, "metadata")
    for run_id in ("run_1", "run_2"):
        run = tracking.Run(spark, root, "nightly", run_id)
        with run.stage("ingest"):
            run.record("table_runs", stage="ingest", source="landing/orders", target="brz_orders", rows_read=5, rows_written=5, status="success")
            run.record("lineage_edges", source="landing/orders", target="brz_orders", transform="ingest")
        try:
            with run.stage("silver"):
                run.record("quality_results", dataset="orders", check_type="rule", rule="range_invalid:total_amount", rows_affected=1, rows_checked=5, outcome="quarantined")
                if run_id == "run_1":
                    run.record("quality_results", dataset="orders", check_type="duplicates", rule="", rows_affected=1, rows_checked=5, outcome="removed")
                    run.record("file_loads", batch_id="1", dataset="orders", file="a.csv", rows_read=5, rows_corrupt=0, status="loaded")
                    run.record("model_runs", model_name="demand", model_version="v1", method="poisson", train_rows=10, status="success")
                    for metric, value in (("wape", 0.5), ("bias", 0.1)):
                        run.record("model_metrics", model_version="v1", evaluation="backtest", horizon=1, segment="all", metric=metric, value=value)
                else:
                    run.rows["lineage_edges"].clear()
                    run.record("lineage_edges", source="brz_orders", target="slv_orders", transform="silver")
                    raise ValueError("no /root/secret/path here")
            run.finish()
        except ValueError:
            run.finish("failed", "silver")
    parts = [tracking.metadata(spark, root, t).agg(F.count("*").cast("int").alias("n"), F.count_distinct("run_id").cast("int").alias("runs")).select(F.lit(t).alias("table_name"), "n", "runs") for t in tracking.TABLES]
    return reduce(DataFrame.unionByName, parts)


@query("select event_id, ts, user_id, event_type from events")
def streaming_copies_removed(spark: SparkSession, d: str) -> DataFrame:
    """Every event delivered twice, in two files of one stream: each comes out once, by the stream's own state."""
    path = _folder(spark, "twice")
    events = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type")
    events.write.parquet(f"{path}/a")
    events.write.parquet(f"{path}/b")
    stream = instants(spark.readStream.schema(events.schema).parquet(f"{path}/*"))
    once = windows.run_to_table(windows.deduplicated(stream, late="3650 days"), "append")
    return once.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("select a.event_id as click_id, b.event_id as purchase_id, a.user_id from events a join events b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval 10 minute")
def streaming_stream_join(spark: SparkSession, d: str) -> DataFrame:
    """Purchases within ten minutes of a click of the same user: two streams joined under watermarks."""
    schema = table(spark, d, "events").schema
    both = instants(spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]"))
    return windows.run_to_table(windows.followed_by(both.where("event_type = 'click'"), both.where("event_type = 'purchase'")), "append").select(F.col("first_id").alias("click_id"), F.col("second_id").alias("purchase_id"), "user_id")
