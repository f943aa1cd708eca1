"""Building blocks of synthetic data: reproducible uniforms, exact allocations, draws by weight, planted faults.

Nothing depends on partitioning or order: every random number is a hash of the row's key and a named stream.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def uniform(stream: str, *keys: Column) -> Column:
    """A uniform number in [0, 1) for a key in a named stream: the same in every run, engine and partitioning."""
    text = F.concat_ws("|", F.lit(stream), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))


def largest_remainder(df: DataFrame, weight: str, total: int | Column, key: str, within: Sequence[str] = ()) -> DataFrame:
    """`df` with units: `total` whole units (per group of `within`; a column may give each group its own) shared out in proportion to `weight`, adding up exactly.

    What rounding down leaves goes to the largest fractions, ties to the lower key. Groups of weight 0 get nothing.
    For lists of the size of a dimension: one group is ranked in one task.
    """
    group = W.partitionBy(*within)
    exact = F.try_divide(F.col(weight) * (total if isinstance(total, Column) else F.lit(total)), F.sum(weight).over(group))
    x = df.withColumn("__e", F.coalesce(F.round(exact, 9), F.lit(0.0))).withColumn("__f", F.floor("__e"))
    left = F.round(F.sum("__e").over(group)) - F.sum("__f").over(group)
    rank = F.row_number().over(group.orderBy(F.desc(F.round(F.col("__e") - F.col("__f"), 9)), key))
    return x.withColumn("units", (F.col("__f") + (rank <= left).cast("int")).cast("bigint")).drop("__e", "__f")


def drawn(rows: DataFrame, choices: DataFrame, choice: str, weight: str, u: Column) -> DataFrame:
    """`rows` with one `choice` each, drawn by `weight` with the uniform `u` (inverse cumulative weights).

    The choices become one sorted array in a one-row table, so a draw is a search in an array, not a range join; for
    lists of the size of a dimension.
    """
    w = W.orderBy(choice)
    share = F.sum(weight).over(w.rowsBetween(W.unboundedPreceding, 0)) / F.sum(weight).over(W.partitionBy())
    table = choices.where(F.col(weight) > 0).select(choice, share.alias("__c")).agg(F.sort_array(F.collect_list(F.struct("__c", choice))).alias("__t"))
    # Not all shares lie above the last uniform if rounding ends under 1: then the last choice it is.
    found = F.coalesce(F.get(F.filter("__t", lambda x: x["__c"] > F.col("__u")), F.lit(0))[choice], F.get(F.col("__t"), F.size("__t") - 1)[choice])
    return rows.withColumn("__u", u).join(F.broadcast(table)).withColumn(choice, found).drop("__t", "__u")  # one row


def budget(n_rows: int, shares: Mapping[str, float], applicable: Sequence[str]) -> dict[str, int]:
    """How many rows get each kind of fault: the shares of kinds that do not apply go to the others in proportion; whole numbers, exact total."""
    total = round(n_rows * sum(shares.values()))
    kinds = [k for k in shares if k in applicable]
    if not kinds:
        return {}
    mass = sum(shares[k] for k in kinds)
    exact = {k: total * shares[k] / mass for k in kinds}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(kinds, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values())]:
        out[k] += 1
    return out


def with_faults(df: DataFrame, key: str, faults: Mapping[str, tuple[float, Mapping[str, Column]]], stream: str = "faults") -> DataFrame:
    """Plants faults: each row has at most one, chosen by its key's uniform; adds the column fault (null if clean).

    `faults` maps a name to its share of the rows and the columns it changes.
    """
    u, low, kind = uniform(stream, F.col(key)), 0.0, F.lit(None).cast("string")
    for name, (share, _) in faults.items():
        kind = F.when((u >= low) & (u < low + share), name).otherwise(kind)
        low += share
    marked = df.withColumn("fault", kind)
    changed = {}
    for name, (_, columns) in faults.items():
        for c, e in columns.items():
            changed[c] = F.when(F.col("fault") == name, e).otherwise(changed.get(c, F.col(c)))
    return marked.withColumns(changed)


#: Ways to spoil the text of a cell, by name.
MUTATIONS: dict[str, Callable[[Column], Column]] = {
    "null": lambda c: F.lit(None).cast("string"),
    "empty": lambda c: F.lit(""),
    "blank": lambda c: F.lit("   "),
    "leading_space": lambda c: F.concat(F.lit("  "), c),
    "trailing_space": lambda c: F.concat(c, F.lit(" ")),
    "inner_spaces": lambda c: F.replace(c, F.lit(" "), F.lit("  ")),
    "tab": lambda c: F.concat(c, F.lit("\t")),
    "line_end": lambda c: F.concat(c, F.lit("\n")),
    "upper": F.upper,
    "lower": F.lower,
    "truncated": lambda c: F.substring(c, 1, 3),
    "first_lost": lambda c: c.substr(F.lit(2), F.length(c)),
    "last_doubled": lambda c: F.concat(c, F.right(c, F.lit(1))),
    "reversed": F.reverse,
    "letter_for_digit": lambda c: F.translate(c, "01", "OI"),
    "text_in_number": lambda c: F.concat(c, F.lit("abc")),
    "negative": lambda c: F.concat(F.lit("-"), c),
    "zero": lambda c: F.lit("0"),
    "huge": lambda c: F.lit("99999999999999999999"),
    "fraction": lambda c: F.concat(c, F.lit(".5")),
    "decimal_comma": lambda c: F.translate(c, ".", ","),
    "thousands_mark": lambda c: F.concat(c, F.lit(",000")),
    "currency": lambda c: F.concat(F.lit("Rs "), c),
    "exponent": lambda c: F.concat(c, F.lit("e3")),
    "quoted": lambda c: F.concat(F.lit('"'), c, F.lit('"')),
    "open_quote": lambda c: F.concat(F.lit('"'), c),
    "separator": lambda c: F.concat(c, F.lit(",")),
    "markup": lambda c: F.concat(F.lit("<b>"), c, F.lit("</b>")),
    "unknown_word": lambda c: F.lit("n/a"),
    "bad_date": lambda c: F.lit("2025-02-30"),
    "other_date_order": lambda c: F.lit("31/12/2025 10:00:00"),
    "far_future": lambda c: F.lit("2199-01-01T00:00:00Z"),
}


def spoiled(df: DataFrame, key: str, column: str, stream: str = "mutations") -> DataFrame:
    """`df` with one of MUTATIONS applied to `column` of every row, drawn by the row's key; adds the column mutation."""
    names = list(MUTATIONS)
    which = F.floor(uniform(stream, F.col(key)) * len(names)).cast("int")
    out = F.col(column)
    for i, n in enumerate(names):
        out = F.when(which == i, MUTATIONS[n](F.col(column))).otherwise(out)
    return df.withColumns({"mutation": F.get(F.array(*map(F.lit, names)), which), column: out})


def simulated_stock(days: DataFrame, keys: Sequence[str], day: str, demand: str, start: int, reorder: int, upto: int) -> DataFrame:
    """(*keys, days, sold, lost, orders, empty_days, stock): a stock policy run day by day on the demand of each series.

    What was ordered two days ago arrives first, then demand is met as far as stock goes; when stock and what is on its
    way are at `reorder` or less, an order fills up to `upto`. A series is one sorted array, as long as the calendar, and
    the run one fold over it on the JVM.
    """
    series = days.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(day, demand))).alias("d"))
    big = lambda v: F.lit(v).cast("bigint")
    first = F.struct(big(start).alias("stock"), big(0).alias("next"), big(0).alias("after"), big(0).alias("sold"), big(0).alias("lost"), big(0).alias("orders"), big(0).alias("empty"))

    def step(s: Column, x: Column) -> Column:
        have = s["stock"] + s["next"]
        sold = F.least(have, x[demand].cast("bigint"))
        left = have - sold
        short = left + s["after"] <= reorder
        return F.struct(
            left.alias("stock"), s["after"].alias("next"), F.when(short, upto - left - s["after"]).otherwise(0).cast("bigint").alias("after"), (s["sold"] + sold).alias("sold"),
            (s["lost"] + x[demand] - sold).cast("bigint").alias("lost"), (s["orders"] + short.cast("bigint")).alias("orders"), (s["empty"] + (left == 0).cast("bigint")).alias("empty"),
        )

    run = F.aggregate("d", first, step)
    return series.select(*keys, F.size("d").alias("days"), run.alias("r")).select(*keys, "days", "r.sold", "r.lost", "r.orders", F.col("r.empty").alias("empty_days"), "r.stock")


def sliced(df: DataFrame, key: str, event: str, history_until: Column, late_share: float = 0.02, stream: str = "slices") -> DataFrame:
    """`df` with slice (historical, or the day of arrival as batch_yyyy-MM-dd), is_late and place: how rows reach a landing folder.

    Late rows, drawn by key, arrive a day after they happened. place orders the rows of a slice; the late ones of the
    stream stand out of order, at a place drawn by their key.
    """
    late = uniform(stream, F.col(key)) < late_share
    day = F.to_date(event)
    arrival = F.when(late, F.date_add(day, 1)).otherwise(day)
    name = F.when(day < history_until, "historical").otherwise(F.concat(F.lit("batch_"), F.date_format(arrival, "yyyy-MM-dd")))
    return df.withColumns({"slice": name, "is_late": late & (day >= history_until), "place": F.when(late, uniform(f"{stream}-place", F.col(key))).otherwise(F.lit(0.0))})


def manifest(df: DataFrame, by: str, key: str, fault: str) -> DataFrame:
    """Per slice what was delivered: rows, distinct keys, a checksum of the keys, and how many planted faults of each kind (as a map)."""
    kinds = df.where(F.col(fault).isNotNull()).groupBy(by, fault).agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(fault, "n")))).alias("faults"))
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.sum(F.pmod(F.col(key).cast("bigint") * 2654435761, F.lit(1_000_003))).alias("checksum")).join(kinds, by, "left")


def with_copies(df: DataFrame, key: str, share: float, stream: str = "copies") -> DataFrame:
    """Some rows twice: an exact copy of the rows whose uniform lies under `share`, in the same pass."""
    n = F.when(uniform(stream, F.col(key)) < share, 2).otherwise(1)
    return df.withColumn("__n", F.explode(F.sequence(F.lit(1), n))).drop("__n")


def zipf_weights(df: DataFrame, key: str, exponent: float = 1.0) -> DataFrame:
    """`df` (a list of the size of a dimension) with weight = 1 / rank^exponent in a reproducible shuffled order."""
    w = W.orderBy(uniform("zipf", F.col(key)), key)
    return df.withColumn("weight", 1.0 / F.pow(F.row_number().over(w), F.lit(exponent)))
