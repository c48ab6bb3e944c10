"""Scalar expression helpers (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US

_NUMERIC_RE = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros_between(start, end) -> Column:
    """end - start in microseconds (works for TIMESTAMP and TIMESTAMP_NTZ)."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end))


def floor_div(x, d: int) -> Column:
    """Integer floor division that is exact for negative numerators."""
    x = col(x)
    return ((x - F.pmod(x, F.lit(d))) / F.lit(d)).cast("long")


def ceil_div(x, d: int) -> Column:
    return -floor_div(-col(x), d)


def numeric_value(v, is_numeric_type: bool) -> Column:
    """Coerce a mixed text/number VALUE to DOUBLE; unparsable or NaN -> NULL.

    Text must look like a decimal number (``try_cast`` alone accepts ``1d``).
    """
    v = col(v)
    if is_numeric_type:
        d = v.cast("double")
    else:
        t = F.trim(v.cast("string"))
        d = F.when(t.rlike(_NUMERIC_RE), t.try_cast("double"))
    return F.when(~F.isnan(d), d)


def round6(c) -> Column:
    return F.round(col(c).cast("double"), 6)



def hours_6dp(micros) -> Column:
    """Elapsed hours rounded half-up to 6 decimals in integer arithmetic
    (1e-6 h = 3600 us): exact ties (1 in 3600 microsecond counts) round the
    same way in every engine, unlike rounding the float quotient."""
    return floor_div(col(micros) + 1800, 3600) / F.lit(1e6)
