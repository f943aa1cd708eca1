"""What runs leave behind: eight append-only metadata tables, written once per run."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans.ops import scrubbed_text
from tidemill.sources.sinks import _fs, append_log

#: The metadata tables and their columns.
TABLES = {
    "pipeline_runs": "run_id string, pipeline string, stages string, status string, started_at timestamp, ended_at timestamp, duration_s double, error string",
    "stage_runs": "run_id string, stage string, status string, started_at timestamp, ended_at timestamp, duration_s double, error string",
    "table_runs": "run_id string, stage string, source string, target string, rows_read bigint, rows_written bigint, rows_rejected bigint, status string",
    "quality_results": "run_id string, dataset string, check_type string, rule string, rows_affected bigint, rows_checked bigint, outcome string",
    "file_loads": "run_id string, batch_id string, dataset string, file string, size_bytes bigint, sha256 string, rows_read bigint, rows_corrupt bigint, status string",
    "lineage_edges": "run_id string, source string, target string, transform string",
    "model_runs": "run_id string, model_name string, model_version string, method string, train_rows bigint, status string",
    "model_metrics": "run_id string, model_version string, evaluation string, horizon int, segment string, metric string, value double",
}


def _names(table: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in TABLES[table].split(",")]


class Run:
    """Collects the metadata of one run; `finish` appends each table in one file, so a run appears whole or not at all."""

    def __init__(self, spark: SparkSession, root: str, pipeline: str, run_id: str) -> None:
        self.spark, self.root, self.pipeline, self.run_id = spark, root, pipeline, run_id
        self.rows: dict[str, list[dict]] = {t: [] for t in TABLES}
        self.started, self.stages = dt.datetime.now(dt.timezone.utc), []

    def record(self, table: str, **fields: object) -> None:
        """One row of a table; columns not given are null. A quality result implies the edge from its dataset to the log."""
        if unknown := set(fields) - set(_names(table)):
            raise ValueError(f"{table} has no columns {sorted(unknown)}")
        row = {"run_id": self.run_id, **fields}
        if table != "lineage_edges" or row not in self.rows[table]:
            self.rows[table].append(row)
        if table == "quality_results" and fields.get("dataset"):
            self.record("lineage_edges", source=f"brz_{fields['dataset']}", target="quality_results", transform="quality checks")

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Times a stage and logs how it ended; errors are logged without paths and go on."""
        began, clock, status, error = dt.datetime.now(dt.timezone.utc), time.perf_counter(), "success", None
        self.stages.append(name)
        try:
            yield
        except BaseException as e:
            status, error = "failed", scrubbed_text(f"{type(e).__name__}: {e}")
            raise
        finally:
            self.record("stage_runs", stage=name, status=status, started_at=began, ended_at=dt.datetime.now(dt.timezone.utc), duration_s=round(time.perf_counter() - clock, 2), error=error)

    def finish(self, status: str = "success", error: str | None = None) -> None:
        ended = dt.datetime.now(dt.timezone.utc)
        self.record("pipeline_runs", pipeline=self.pipeline, stages="|".join(self.stages), status=status, started_at=self.started, ended_at=ended, duration_s=round((ended - self.started).total_seconds(), 2), error=error)
        for table, rows in self.rows.items():
            if rows:
                append_log(self.spark, f"{self.root}/{table}", [tuple(r.get(c) for c in _names(table)) for r in rows], TABLES[table], self.run_id)


def metadata(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A metadata table over all runs, empty if no run wrote it."""
    fs, path = _fs(spark, f"{root}/{table}")
    if not fs.exists(path):
        return spark.createDataFrame([], TABLES[table])
    return spark.read.schema(TABLES[table]).parquet(f"{root}/{table}/run=*")
