"""Rows that fail to parse: typed valid rows of each dataset, and the rejected rows with the reason.

Method: strict load plus anti-join. A strict grammar loads only conforming rows, keeping the offset (line id) of each;
their offsets are subtracted from all raw offsets, and only the remainder is diagnosed.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Possessive quantifiers: no backtracking, and no recursion in Java's matcher however long a cell is.
_QUOTED = '"[^"]*+(?:""[^"]*+)*+"'
_PLAIN = '(?:[^",][^,]*+)?+'
_CELL = f"(?:{_QUOTED}|{_PLAIN})"
#: Well quoted: every cell that begins with a quote also ends with one. \z, as $ would allow a trailing line end.
_WELL_QUOTED = rf"\A{_CELL}(?:,{_CELL})*+\z"

_TIME = r"\d\d:\d\d:\d\d"


@dataclass(frozen=True)
class Cell:
    """A column of a dataset: its name, the SQL type it is loaded as, and what a trimmed, non-empty cell must be.

    `pattern` must match the whole cell; `values` lists what is allowed, in any case if `any_case`.
    """

    name: str
    type: str = "string"
    pattern: str | None = None
    values: tuple[str, ...] = ()
    any_case: bool = False


def instant(text: Column) -> Column:
    """A timestamp from one of the five layouts; null unless it is a real instant (no 30 February, no hour 24)."""
    part = lambda start, length: F.substring(text, start, length)
    plain = (
        F.when(text.rlike(rf"\A\d{{4}}-\d\d-\d\dT{_TIME}(?:Z|\+00:00)\z"), F.concat(part(1, 10), F.lit(" "), part(12, 8)))
        .when(text.rlike(rf"\A\d{{4}}([-/])\d\d\1\d\d {_TIME}\z"), F.translate(text, "/", "-"))
        .when(text.rlike(rf"\A\d\d/\d\d/\d{{4}} {_TIME}\z"), F.concat(part(7, 4), F.lit("-"), part(4, 2), F.lit("-"), part(1, 2), F.lit(" "), part(12, 8)))
    )
    return F.when(~plain.startswith("0000"), plain).try_cast("timestamp")


def _value(cell: Cell, text: Column) -> Column:
    """The typed value of a trimmed cell; null if it does not conform."""
    ok = text != ""
    if cell.pattern:
        ok &= text.rlike(rf"\A(?:{cell.pattern})\z")
    if cell.values:
        ok &= (F.upper(text) if cell.any_case else text).isin([v.upper() if cell.any_case else v for v in cell.values])
    if cell.type == "timestamp":
        return F.when(ok, instant(text))
    return F.when(ok, text if cell.type == "string" else text.try_cast(cell.type))


def cells(text: Column) -> Column:
    """The cells of a well-quoted row as an array, quotes resolved, spaces trimmed."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(f",({_CELL})"), F.lit(1))  # with a comma before each, no match is empty
    plain = lambda c: F.when(c.startswith('"'), F.replace(c.substr(F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(raw, lambda c: F.trim(plain(c)))


def strict_load(raw: DataFrame, layout: list[Cell], text: str, offset: str) -> DataFrame:
    """Only the conforming rows of `raw`: its `offset` and the typed columns of `layout`. A null text does not conform."""
    split = raw.where(F.col(text).rlike(_WELL_QUOTED)).select(F.col(offset).alias("__at"), cells(F.col(text)).alias("__c")).where(F.size("__c") == len(layout))
    typed = split.select("__at", *[_value(c, F.get("__c", F.lit(i))).alias(c.name) for i, c in enumerate(layout)])
    for c in layout:
        typed = typed.where(F.col(f"`{c.name}`").isNotNull())
    return typed.withColumnRenamed("__at", offset)


def reason(text: Column, n_cells: Column) -> Column:
    """Why a row that the strict load left out is rejected; the first that holds of quoting, column_count, invalid_value."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(~whole.rlike(_WELL_QUOTED), "quoting").when(F.size(cells(whole)) != n_cells, "column_count").otherwise("invalid_value")


def rejected_rows(raw: DataFrame, layouts: Mapping[str, list[Cell]], dataset: str = "dataset", text: str = "_corrupt_record", offset: str = "line_id") -> DataFrame:
    """(offset, dataset, reason) of every row that is no valid row of its dataset.

    A null or empty text is a row of one empty cell (column_count). A row of a dataset without a layout, or of a null
    dataset, can have no valid form: column_count unless its quoting fails first. Rows are subtracted by their offset and a
    64-bit hash of what they hold, so of two rows with one offset, or a null one, each is judged by its own text.
    """
    loaded = None
    sizes = F.lit(-1)
    marked = raw.select(offset, dataset, text, F.struct(F.col(offset).alias("o"), F.xxhash64(dataset, text).alias("h")).alias("__id"))
    for name, layout in layouts.items():
        one = strict_load(marked.where(F.col(dataset) == name), layout, text, "__id").select("__id")
        loaded = one if loaded is None else loaded.unionByName(one)
        sizes = F.when(F.col(dataset) == name, len(layout)).otherwise(sizes)
    rest = marked
    if loaded is not None:
        ids = loaded.select(F.col("__id.o").alias("__o"), F.col("__id.h").alias("__h"))
        rest = rest.join(ids, F.col("__id.o").eqNullSafe(F.col("__o")) & (F.col("__id.h") == F.col("__h")), "left_anti")
    return rest.select(offset, dataset, reason(F.col(text), sizes).alias("reason"))
