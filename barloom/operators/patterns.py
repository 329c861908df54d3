"""Candle shapes and two-bar patterns as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .indicators import by_bar

#: Bit of each pattern in a mask.
PATTERNS = ["doji", "hammer", "shooting_star", "bullish_engulfing", "bearish_engulfing", "piercing_line", "dark_cloud_cover"]


def shape() -> dict[str, Column]:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {"body": F.abs(c - o), "upper_wick": h - F.greatest(o, c), "lower_wick": F.least(o, c) - l}


def patterns() -> dict[str, Column]:
    """Boolean columns by name; false where the bar before is missing."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    o1, c1 = F.lag("open").over(by_bar()), F.lag("close").over(by_bar())
    body, up, low = shape().values()
    small = body < 0.3 * (up + low)
    found = {
        "doji": body <= 0.1 * (h - l),
        "hammer": small & (low > 2 * body),
        "shooting_star": small & (up > 2 * body),
        "bullish_engulfing": (c > o) & (c1 < o1) & (c >= o1) & (o <= c1),
        "bearish_engulfing": (c < o) & (c1 > o1) & (o >= c1) & (c <= o1),
        "piercing_line": (c1 < o1) & (c > o) & (o < c1) & (c >= o1 + 0.5 * (c1 - o1)),
        "dark_cloud_cover": (c1 > o1) & (c < o) & (o > c1) & (c <= o1 - 0.5 * (c1 - o1)),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in found.items()}


def pattern_mask() -> Column:
    mask = F.lit(0)
    for bit, found in enumerate(patterns().values()):
        mask = mask + F.when(found, 1 << bit).otherwise(0)
    return mask
