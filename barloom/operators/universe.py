"""Which symbols and positions to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import number_or_zero

CHECKED = ["open", "high", "low", "close", "volume_quote"]


def clean_bars(bars: DataFrame) -> DataFrame:
    """Bars without null or zero in prices and quote volume."""
    return bars.dropna(subset=CHECKED).where(" and ".join(f"{c} <> 0" for c in CHECKED))


def mean_of_last(bars: DataFrame, column: str, n: int) -> DataFrame:
    """Mean of each symbol's last ``n`` rows (of all, where there are fewer)."""
    last = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("_nth", F.row_number().over(last)).where(F.col("_nth") <= n).groupBy("symbol").agg(F.avg(column).alias("mean_last"))


def judge_symbols(wanted: DataFrame, bars: DataFrame, min_price: float | None, min_volume: float, min_bars: int, volume_window: int = 50) -> DataFrame:
    """Every wanted symbol with ``reason``, the first of the checks that it fails, or null if it passes all."""
    clean = clean_bars(bars)
    there = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("raw"))
    facts = clean.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max_by("close", "ts").alias("last_close"))
    facts = facts.join(mean_of_last(clean, "volume_quote", volume_window), "symbol")
    reason = F.when(F.col("raw").isNull(), "File missing").when(F.col("n").isNull(), "Contains zeros")
    if min_price is not None:
        reason = reason.when(F.col("last_close") <= min_price, "Last close too low")
    reason = reason.when(F.col("mean_last") < min_volume, "Avg volume too low").when(F.col("n") < min_bars, "Not enough bars")
    return wanted.join(there, "symbol", "left").join(facts, "symbol", "left").select("symbol", reason.alias("reason"))


def removal_counts(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("reason", F.lit("Kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def keep_universe(bars: DataFrame, judged: DataFrame) -> DataFrame:
    return clean_bars(bars).join(judged.where("reason is null").select("symbol"), "symbol", "left_semi")


def live_universe(listed: DataFrame, saved: DataFrame) -> DataFrame:
    return listed.select("symbol").intersect(saved.select("symbol")).orderBy("symbol")


def open_positions(positions: DataFrame) -> DataFrame:
    return positions.where(F.col("total").try_cast("double") > 0)


def position_summary(positions: DataFrame) -> DataFrame:
    """Symbol, side in capitals and figures, with defaults for what is missing."""
    numbers = ["total", "averageOpenPrice", "marketPrice", "unrealizedPL", "leverage", "liquidationPrice"]
    return positions.select(F.coalesce("symbol", F.lit("?")).alias("symbol"), F.upper(F.coalesce("holdSide", F.lit("?"))).alias("side"), *(number_or_zero(F.col(c)).alias(c) for c in numbers))
