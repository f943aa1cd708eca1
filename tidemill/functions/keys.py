"""How keys are compared, and fixed-width stand-ins for the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Microseconds from 0001-01-01 to 1970-01-01; shifts every timestamp of Spark's range to a non-negative number.
_EPOCH_SHIFT = 62_135_596_800_000_000


def norm_key(c: Column) -> Column:
    """A key as it is compared: outer spaces removed, upper case. Null stays null."""
    return F.upper(F.trim(c))


def packed_order(ts: Column, tie: Column) -> Column:
    """The order of (ts, tie), nulls of ts last, as one decimal(38,0).

    An aggregate whose buffer holds a struct falls back to sorting its input; a decimal buffer has a fixed width,
    so min_by over this stand-in for struct(ts, tie) stays a hash aggregation. `tie` is a bigint, null counts as
    the highest; years 0001 to 9999.
    """
    micros = F.coalesce(F.unix_micros(ts.cast("timestamp")) + F.lit(_EPOCH_SHIFT), F.lit(900_000_000_000_000_000))
    # 10^20 exceeds the range of a bigint, so a later time outweighs any tie-break, negative ones included.
    low = F.coalesce(tie.cast("bigint"), F.lit((1 << 63) - 1)).cast("decimal(19,0)")
    return (micros.cast("decimal(18,0)") * F.lit("100000000000000000000").cast("decimal(21,0)")).cast("decimal(38,0)") + low
