"""Number formats of report values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(c: Column, digits: int) -> Column:
    """Decimals with halves rounded away from zero."""
    return F.format_string(f"%.{digits}f", F.round(c.cast("double"), digits))


def percent(c: Column, digits: int = 1) -> Column:
    return F.concat(fixed(100 * c.cast("double"), digits), F.lit("%"))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def significant(c: Column, digits: int) -> Column:
    """A number with ``digits`` significant digits, as plain decimals."""
    places = F.greatest(F.lit(0), F.lit(digits - 1) - F.floor(F.log10(F.abs(c))).cast("int"))
    rounded = F.when(c == 0, F.lit(0.0)).otherwise(F.round(c.cast("double") * F.pow(F.lit(10.0), places), 0) / F.pow(F.lit(10.0), places))
    return F.when(c == 0, F.lit("0")).otherwise(F.regexp_replace(F.format_string("%.12f", rounded), r"\.?0+$", ""))
