"""References to records that do not exist, are deleted, or arrive later.

Method: left anti-join of the distinct non-null foreign keys against the parent keys, joined back to the child rows.
Only keys that can be orphans for some row are joined back, hot ones among them by broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.keys import norm_key
from tidemill.scale import join_hot, written


@dataclass(frozen=True)
class ForeignKey:
    """A column of the child and the table and column that should hold its keys."""

    column: str
    parent: DataFrame
    parent_column: str


def orphan_references(child: DataFrame, references: Sequence[ForeignKey], row_id: str = "row_id", arrived: str = "_ingestion_ts", deleted: str = "_deleted_at") -> DataFrame:
    """(child_column, row_id, arrived, kind) of every non-null reference that is an orphan when its row arrives.

    Keys are compared trimmed and ignoring case; null is no reference, a blank key is one. kind is 'missing' if no parent
    row has the key; 'deleted' if all its parent rows carry a deletion and the latest is at or before the arrival; else
    'late' if the earliest arrival of the parent rows is after the child's. A child row without arrival can only be
    'missing'; a parent without the column `deleted` has no deletions. An empty parent makes all references missing, an
    empty child gives an empty result; repeated child rows come out each.

    Each reference scans its own column of the child: to explode all keys of a row in one scan halves the rows read and
    costs twice the CPU (README). The keys that can be orphans are written once, as three branches of the join back read them.
    """
    return reduce(DataFrame.unionByName, [_orphans(child, r, row_id, arrived, deleted) for r in references])


def _orphans(child: DataFrame, r: ForeignKey, row_id: str, arrived: str, deleted: str) -> DataFrame:
    rows = child.select(norm_key(F.col(f"`{r.column}`")).alias("key"), F.col(f"`{row_id}`").alias("row_id"), F.col(f"`{arrived}`").alias("arrived")).where(F.col("key").isNotNull())
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("arrived").alias("first"), F.max("arrived").alias("last"))
    gone = F.col(f"`{deleted}`") if deleted in r.parent.columns else F.lit(None).cast("timestamp")
    parents = (
        r.parent.select(norm_key(F.col(f"`{r.parent_column}`")).alias("key"), F.col(f"`{arrived}`").alias("seen"), gone.alias("gone"))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("seen").alias("since"), F.when(F.count("*") == F.count("gone"), F.max("gone")).alias("until"))
    )
    timed = keys.join(parents, "key").where((F.col("until") <= F.col("last")) | (F.col("since") > F.col("first")))
    missing = keys.join(parents.select("key"), "key", "left_anti")
    suspects = missing.select("key", "n", F.lit(True).alias("missing"), F.lit(None).alias("since"), F.lit(None).alias("until")).unionByName(timed.select("key", "n", F.lit(False).alias("missing"), "since", "until"))
    kind = F.when(F.col("missing"), "missing").when(F.col("until") <= F.col("arrived"), "deleted").when(F.col("since") > F.col("arrived"), "late")
    found = join_hot(rows, written(suspects, "suspects"), "key", "n", child.count())
    return found.select(F.lit(r.column).alias("child_column"), "row_id", "arrived", kind.alias("kind")).where(F.col("kind").isNotNull())


def orphan_counts(orphans: DataFrame, by: list[str]) -> DataFrame:
    """Rows of orphan_references (with the columns of `by` added) counted per `by`, day of arrival and kind."""
    return orphans.groupBy(*by, F.to_date("arrived").alias("arrived_on"), "kind").agg(F.count("*").alias("n_rows"))
