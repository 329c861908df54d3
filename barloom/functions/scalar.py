"""Column functions for names, timeframes, seeds and exchange records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(name: Column) -> Column:
    """Characters other than letters, digits, ``_-. `` become ``_``; outer blanks go."""
    return F.trim(F.regexp_replace(name, r"[^\w\-. ]", "_"))


def timeframe_minutes(text: Column) -> Column:
    """Minutes of ``15m``, ``4H``, ``1d``, ``1w`` or ``1M`` (a month of 30 days; only the capital M); else null."""
    n, unit = F.regexp_extract(text, r"^(\d+)([mhHdDwWM])$", 1), F.regexp_extract(text, r"^(\d+)([mhHdDwWM])$", 2)
    each = F.when(unit == "m", 1).when(unit == "M", 43200).when(F.lower(unit) == "h", 60).when(F.lower(unit) == "d", 1440).when(F.lower(unit) == "w", 10080)
    return F.when(n != "", n.cast("bigint") * each)


def symbol_seed(symbol: Column, base: int, path: Column) -> Column:
    """base + (first 8 hex digits of the name's md5) mod 100000 + path"""
    return F.conv(F.substring(F.md5(symbol), 1, 8), 16, 10).cast("bigint") % 100000 + base + path


def number_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def natural_log(x: Column) -> Column:
    """Natural logarithm with minus infinity for 0, for which Spark's is null."""
    return F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log(x))
