"""Declarative data contracts: standardise, cast, de-duplicate, validate, quarantine with reasons, cascade to child rows.

A contract is compiled into one lazy plan per dataset: one projection per step, one aggregation for duplicates, one
join per reference, all checks in a single array expression.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemill.operators.rejects import instant
from tidemill.scale import written

#: Which kind of failure names the row when several hold, first to last.
PRIORITY = ("malformed", "required_missing", "type_invalid", "enum_invalid", "range_invalid", "sequence_invalid", "fk_missing", "business", "parent_rejected")
#: Fixed value: what an e-mail address looks like.
EMAIL = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"


@dataclass(frozen=True)
class Field:
    """A column: SQL type, whether it must be filled, how its text is written (lower, upper, title, majority, email), allowed values."""

    name: str
    type: str = "string"
    required: bool = True
    style: str | None = None
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Sql:
    """A column as SQL text over the typed columns and lookups of a row; `other`: its spelling in another engine, if it differs."""

    text: str
    other: str | None = None

    def __call__(self) -> Column:
        return F.expr(self.text)


@dataclass(frozen=True)
class Check:
    """A named failure 'kind:detail'. Soft ones only set the flag dq_detail; an unknown result passes, or stays null if so asked."""

    name: str
    fails: Callable[[], Column]
    hard: bool = True
    unknown_passes: bool = True


def in_range(column: str, low: float | None = None, high: float | None = None, open_low: bool = False, open_high: bool = False) -> Check:
    """Outside low..high (bounds included unless open); null is not a failure."""

    def fails() -> Column:
        c, out = F.col(column), F.lit(False)
        if low is not None:
            out |= c <= low if open_low else c < low
        if high is not None:
            out |= c >= high if open_high else c > high
        return out

    return Check(f"range_invalid:{column}", fails)


def in_sequence(detail: str, later: str, earlier: str) -> Check:
    """`later` lies before `earlier`."""
    return Check(f"sequence_invalid:{detail}", lambda: F.col(later) < F.col(earlier))


def off_by(detail: str, one: str, other: str, tolerance: float = 0.005) -> Check:
    """Two amounts differ by more than a tolerance; a soft flag."""
    return Check(f"business:{detail}", lambda: F.abs(F.col(one) - F.col(other)) > tolerance, hard=False)


@dataclass(frozen=True)
class Reference:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class Lookup:
    """Columns joined from the valid rows of a parent by equal keys: `values` maps a parent's column to its name here."""

    column: str
    parent: str
    parent_column: str
    values: Mapping[str, str]


@dataclass(frozen=True)
class Contract:
    """A dataset: business key, fields, checks, references, and which columns date a row (arrival, event)."""

    dataset: str
    key: tuple[str, ...]
    fields: tuple[Field, ...]
    checks: tuple[Check, ...] = ()
    references: tuple[Reference, ...] = ()
    arrival: str = "_ingestion_ts"
    event: str | None = None
    row_id: str = "row_id"
    derive: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    lookups: tuple[Lookup, ...] = ()


@dataclass(frozen=True)
class Outcome:
    """checked: surviving rows with failures (an array), primary_rule and rejection_type; n_copies: rows per survivor."""

    contract: Contract
    checked: DataFrame

    @property
    def valid(self) -> DataFrame:
        c = self.contract
        soft = [F.col(f"dq_{k.name.split(':')[1]}") for k in c.checks if not k.hard] + [F.col(f"dq_{f.name}_invalid") for f in c.fields if f.style == "email"]
        rows = self.checked.where(F.size("failures") == 0)
        return rows.select(c.row_id, *[f.name for f in c.fields], *[e().alias(n) for n, e in c.derive.items()], *soft)

    @property
    def rejected(self) -> DataFrame:
        return self.checked.where(F.size("failures") > 0)


def clean(c: Column) -> Column:
    """Outer spaces removed, blank as null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def typed(text: Column, kind: str) -> Column:
    """The value of a cleaned text, null if it is none: integers only from digits, instants from any of the five layouts."""
    if kind == "string":
        return text
    if kind == "timestamp":
        return instant(text)
    if kind in ("int", "bigint"):
        return F.when(text.rlike(r"^[+-]?\d+\z"), text).try_cast(kind)
    return text.try_cast(kind)


def majority_spelling(df: DataFrame, column: str) -> DataFrame:
    """`column` replaced by the most frequent spelling of the same value ignoring case; ties go to the alphabetically first.

    Spellings are counted map-side; the list joined back has one row per value.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.lower(column).alias("__v"), F.col(column).alias("__s")).agg(F.count("*").alias("__n"))
    best = counts.groupBy("__v").agg(F.min_by("__s", F.struct(-F.col("__n"), "__s")).alias("__s"))
    return df.join(best, F.lower(column) == F.col("__v"), "left").withColumn(column, F.coalesce("__s", column)).drop("__v", "__s")


def _styled(f: Field, text: Column) -> Column:
    if f.style == "email":
        return F.when(F.lower(text).rlike(EMAIL), F.lower(text))
    return {"lower": F.lower, "upper": F.upper, "title": F.initcap}.get(f.style or "", lambda x: x)(text)


def standardised(raw: DataFrame, contract: Contract) -> DataFrame:
    """Row id, arrival, the texts as received (raw_), standardised (std_), and typed under their own names."""
    by_name = {f.name: f for f in contract.fields}
    text = {n: clean(F.col(f"`{n}`")) for n in by_name}
    kept = [c for c in (contract.row_id, contract.arrival) if c not in by_name]
    df = raw.select(*kept, *[F.col(f"`{n}`").cast("string").alias(f"raw_{n}") for n in by_name], *[_styled(f, text[n]).alias(f"std_{n}") for n, f in by_name.items()])
    for n, f in by_name.items():
        if f.style == "majority":
            df = majority_spelling(df, f"std_{n}")
    return df.select("*", *[typed(F.col(f"std_{n}"), f.type).alias(n) for n, f in by_name.items()])


def latest(df: DataFrame, contract: Contract) -> DataFrame:
    """One row per complete business key: the latest by arrival, event time (nulls last), then row id; n_copies rows had it.

    Rows with an incomplete key stay as they are. Partial aggregation keeps one candidate per key and task.
    """
    whole = F.lit(True)
    for k in contract.key:
        whole &= F.col(k).isNotNull()
    at = [F.col(contract.arrival), *([F.col(contract.event)] if contract.event else []), F.col(contract.row_id)]
    groups = [F.when(whole, F.col(k)).alias(f"__{i}") for i, k in enumerate(contract.key)] + [F.when(~whole, F.col(contract.row_id)).alias("__own")]
    return df.groupBy(*groups).agg(F.max_by(F.struct(*df.columns), F.struct(*at)).alias("r"), F.count("*").alias("n_copies")).select("r.*", "n_copies")


def _looked_up(df: DataFrame, lookup: Lookup, parent: Outcome | DataFrame) -> DataFrame:
    """`df` with the columns of a lookup, null where the parent has no valid row of the key; keys that repeat give their lowest value."""
    rows = parent.valid if isinstance(parent, Outcome) else parent
    found = rows.where(F.col(lookup.parent_column).isNotNull()).groupBy(F.col(lookup.parent_column).alias("__lk")).agg(*[F.min(v).alias(n) for v, n in lookup.values.items()])
    return df.join(found, F.expr(lookup.column) == F.col("__lk"), "left").drop("__lk")


def check(raw: DataFrame, contract: Contract, parents: Mapping[str, Outcome | DataFrame] | None = None) -> Outcome:
    """The contract applied to raw text or typed columns. `parents`: outcomes (or plain tables) of the datasets referenced."""
    df = latest(standardised(raw, contract), contract)
    for lookup in contract.lookups:
        df = _looked_up(df, lookup, (parents or {})[lookup.parent])
    checks: list[tuple[str, Column]] = []
    for f in contract.fields:
        std, value = F.col(f"std_{f.name}"), F.col(f.name)
        if f.required:
            checks.append((f"required_missing:{f.name}", std.isNull()))
        if f.type != "string":
            checks.append((f"type_invalid:{f.name}", std.isNotNull() & value.isNull()))
        if f.values:
            checks.append((f"enum_invalid:{f.name}", value.isNotNull() & ~value.isin(list(f.values))))
    checks += [(k.name, k.fails()) for k in contract.checks if k.hard]
    for i, ref in enumerate(contract.references):
        parent = (parents or {})[ref.parent]
        if isinstance(parent, Outcome):
            seen = parent.checked.select(F.col(f"std_{ref.parent_column}").alias(f"__k{i}"), (F.size("failures") == 0).alias("ok"))
        else:
            seen = parent.select(F.upper(clean(F.col(f"`{ref.parent_column}`"))).alias(f"__k{i}"), F.lit(True).alias("ok"))
        status = seen.where(F.col(f"__k{i}").isNotNull()).groupBy(f"__k{i}").agg(F.max("ok").alias(f"__ok{i}"))
        df = df.join(status, F.col(ref.column) == F.col(f"__k{i}"), "left")
        checks.append((f"fk_missing:{ref.column}", F.col(ref.column).isNotNull() & F.col(f"__ok{i}").isNull()))
        checks.append((f"parent_rejected:{ref.parent}", F.col(ref.column).isNotNull() & ~F.col(f"__ok{i}")))
    checks.sort(key=lambda c: PRIORITY.index(c[0].split(":")[0]))  # stable: within a kind, the declared order
    failures = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in checks]))
    flags = {f"dq_{k.name.split(':')[1]}": F.coalesce(k.fails(), F.lit(False)) if k.unknown_passes else k.fails() for k in contract.checks if not k.hard}
    flags |= {f"dq_{f.name}_invalid": clean(F.col(f"raw_{f.name}")).isNotNull() & F.col(f"std_{f.name}").isNull() for f in contract.fields if f.style == "email"}
    df = df.withColumns({"failures": failures, **flags})
    cascade = F.forall("failures", lambda x: x.startswith("parent_rejected"))
    drop = [f"__k{i}" for i in range(len(contract.references))] + [f"__ok{i}" for i in range(len(contract.references))]
    return Outcome(contract, df.withColumns({"primary_rule": F.get("failures", F.lit(0)), "rejection_type": F.when(F.size("failures") > 0, F.when(cascade, "cascade").otherwise("direct"))}).drop(*drop))


def settled(o: Outcome, name: str) -> Outcome:
    """The outcome with its rows written once: datasets that refer to it do not check it again."""
    return Outcome(o.contract, written(o.checked, name))


def quarantine(o: Outcome) -> DataFrame:
    """Rejected rows in one form for all datasets: record id, rules, primary rule, severity, type, the row as JSON."""
    c = o.contract
    record = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), F.coalesce(f"std_{k}", F.lit(""))) for k in c.key])
    row = F.to_json(F.struct(*[F.col(f"raw_{f.name}").alias(f.name) for f in c.fields]), {"ignoreNullFields": "false"})
    return o.rejected.select(
        F.lit(c.dataset).alias("source_dataset"),
        F.col(c.row_id).alias("row_id"),
        record.alias("source_record_id"),
        F.array_join("failures", "|").alias("failed_rules"),
        "primary_rule",
        F.when(F.col("rejection_type") == "cascade", "warning").otherwise("error").alias("severity"),
        "rejection_type",
        row.alias("raw_record"),
    )


def conservation(o: Outcome) -> DataFrame:
    """One row: rows read = duplicates + rejected (direct, cascade) + valid, in a single pass."""
    kind = F.col("rejection_type")
    return o.checked.agg(
        F.coalesce(F.sum("n_copies"), F.lit(0)).alias("rows_raw"),
        F.coalesce(F.sum(F.col("n_copies") - 1), F.lit(0)).alias("rows_duplicates"),
        F.count_if(kind == "direct").alias("rows_direct"),
        F.count_if(kind == "cascade").alias("rows_cascade"),
        F.count_if(kind.isNull()).alias("rows_valid"),
    ).select(F.lit(o.contract.dataset).alias("dataset"), "*")


def quality_rows(o: Outcome) -> DataFrame:
    """(dataset, check_type, rule_name, rows_affected, rows_checked, affected_pct, outcome) for duplicates, rules, soft flags and standardised columns."""
    c = o.contract
    rules = F.transform("failures", lambda f: F.concat(F.lit("rule/"), f))
    soft = [F.when(F.col(f"dq_{k.name.split(':')[1]}"), F.lit(f"soft_rule/{k.name}")) for k in c.checks if not k.hard]
    restyled = [F.when(F.coalesce(f"raw_{f.name}", F.lit("")) != F.coalesce(f"std_{f.name}", F.lit("")), F.lit(f"standardize/{f.name}")) for f in c.fields]
    every = F.concat(F.array(F.lit("")), rules, F.array_compact(F.array(*soft, *restyled)))
    counts = o.checked.select(F.explode(every).alias("what")).groupBy("what").agg(F.count("*").alias("rows_affected"))
    total = F.max(F.when(F.col("what") == "", F.col("rows_affected"))).over(W.partitionBy())  # one row per rule
    rows = counts.withColumn("rows_checked", total).where("what <> ''")
    named = rows.select(F.substring_index("what", "/", 1).alias("check_type"), F.regexp_extract("what", "/(.*)", 1).alias("rule_name"), "rows_affected", "rows_checked")
    copies = o.checked.agg(F.coalesce(F.sum(F.col("n_copies") - 1), F.lit(0)).alias("rows_affected"), F.count("*").alias("rows_checked"))
    every = named.unionByName(copies.select(F.lit("duplicates").alias("check_type"), F.lit("business_key").alias("rule_name"), "rows_affected", "rows_checked"))
    kind, cascade = F.col("check_type"), F.col("rule_name").startswith("parent_rejected")
    outcome = F.when(kind == "rule", F.when(cascade, "cascade").otherwise("quarantined")).when(kind == "standardize", "fixed").when(kind == "soft_rule", "flagged").otherwise("removed")
    return every.select(F.lit(c.dataset).alias("dataset"), "check_type", "rule_name", "rows_affected", "rows_checked", F.round(F.col("rows_affected") / F.col("rows_checked") * 100, 3).alias("affected_pct"), outcome.alias("outcome"))
