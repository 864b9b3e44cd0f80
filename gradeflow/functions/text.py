"""Text and arithmetic helpers with exactly defined edge cases."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# All characters Python's str.strip() removes; Spark's trim() alone removes spaces only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Remove leading and trailing white space of every kind."""
    return F.btrim(as_col(value), F.lit(WHITESPACE))


def fold(value: Column | str) -> Column:
    """Stripped lower-case form used for comparisons."""
    return F.lower(strip(value))


def whole_div(value: Column, by: Column | int) -> Column:
    """Whole-number division, cut toward zero."""
    return F.call_function("div", value, F.lit(by).cast("bigint") if isinstance(by, int) else by)


def half_up_ratio(num: Column, den: Column, scale: int, factor: int = 1) -> Column:
    """``round(factor * num / den, scale)`` half-up, in whole-number arithmetic.

    ``num`` and ``den`` are non-negative BIGINTs.  Doubles would round a tie
    by its binary form and make the result depend on the engine.  A zero or
    NULL denominator gives 0.
    """
    num, den = num.cast("decimal(20,0)"), den.cast("decimal(20,0)")
    unit = 10**scale
    doubled = (num * F.lit(2 * factor * unit).cast("decimal(14,0)") + den).cast("decimal(38,0)")
    # floor(a / b) for whole numbers: (a - a mod b) / b is exact.
    halves = (den * F.lit(2).cast("decimal(1,0)")).cast("decimal(38,0)")
    rounded = ((doubled - doubled % halves) / halves).cast("bigint")
    return F.when(den > 0, rounded / F.lit(float(unit))).otherwise(F.lit(0.0))
