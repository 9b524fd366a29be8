"""Exact time arithmetic on integer micro-, milli- and epoch seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

US = 1_000_000
DAY_S = 86_400


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: Column | str) -> Column:
    """Epoch microseconds of a TIMESTAMP or TIMESTAMP_NTZ (read in the session zone, UTC)."""
    return F.unix_micros(col(c).cast("timestamp"))


def floor_to(x: Column, step: Column) -> Column:
    """Largest multiple of ``step`` not above ``x``; integers only, right for negatives."""
    return x - F.pmod(x, step)


def ceil_to(x: Column, step: Column) -> Column:
    """Smallest multiple of ``step`` not below ``x``."""
    return x + F.pmod(-x, step)


def floor_div(x: Column, step: Column) -> Column:
    """Integer floor division, without a detour over doubles."""
    return F.call_function("div", floor_to(x, step), step)


def big(n: int) -> Column:
    return F.lit(n).cast("bigint")


def ceil_seconds(us: Column) -> Column:
    """Smallest whole second not before an instant in microseconds."""
    return F.call_function("div", ceil_to(us, big(US)), big(US))
