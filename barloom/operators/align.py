"""Joins in time: extremes of fine bars within coarse ones, as-of prices, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import timeframe_minutes

from .chunks import carried_last, numbered


def time_of_extremes(coarse: DataFrame, fine: DataFrame) -> DataFrame:
    """Coarse bars with ``high_time`` and ``low_time``, the first fine bars with the greatest high and least low from a bar to the next
    one; nulls where there is none. Bars before the first fine bar and each symbol's last bar are left out.

    No range join: coarse and fine rows stand in one order, and each fine row takes the last coarse ts before it."""
    both = coarse.select("symbol", "ts", F.lit(0).alias("fine"), F.col("ts").alias("own"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("low")).unionByName(
        fine.select("symbol", "ts", F.lit(1).alias("fine"), F.lit(None).cast("timestamp_ntz").alias("own"), "high", "low")
    )
    marked = carried_last(both, "own", ["ts", "fine"], "bar").where("fine = 1 and bar is not null")
    found = marked.groupBy("symbol", "bar").agg(F.min_by("ts", F.struct(-F.col("high"), F.col("ts"))).alias("high_time"), F.min_by("ts", F.struct("low", "ts")).alias("low_time"))
    first = fine.groupBy("symbol").agg(F.min("ts").alias("first_fine"))
    last = Window.partitionBy("symbol").orderBy("ts")
    kept = coarse.withColumn("_next", F.lead("ts").over(last)).where("_next is not null").drop("_next").join(first, "symbol").where("ts >= first_fine").drop("first_fine")
    return kept.join(found.withColumnRenamed("bar", "ts"), ["symbol", "ts"], "left")


def extreme_coverage(annotated: DataFrame) -> DataFrame:
    """Share of bars in percent with both times, and without null in any column."""
    both = F.col("high_time").isNotNull() & F.col("low_time").isNotNull()
    whole = F.lit(True)
    for c in annotated.columns:
        whole = whole & F.col(c).isNotNull()
    share = lambda x: F.avg(x.cast("double")) * 100
    return annotated.groupBy("symbol").agg(share(both).alias("pct_times"), share(whole).alias("pct_whole"))


def timeframe_pair(files: DataFrame, allowed: list[str]) -> DataFrame:
    """Finest and coarsest allowed timeframe of each symbol that has two or more."""
    minutes = F.coalesce(timeframe_minutes(F.col("timeframe")), F.lit(999999))
    rows = files.where(F.col("timeframe").isin(allowed)).select("symbol", "timeframe", minutes.alias("m")).distinct()
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min_by("timeframe", F.struct("m", "timeframe")).alias("fine"), F.max_by("timeframe", F.struct("m", "timeframe")).alias("coarse")).where("n >= 2").drop("n")


def asof_price(probes: DataFrame, bars: DataFrame, strict: bool = False) -> DataFrame:
    """Probes (symbol, ts, ...) with ``price``, the last close at or before ts (before it, if ``strict``); null if there is none."""
    extra = [c for c in probes.columns if c not in ("symbol", "ts")]
    b = bars.select("symbol", "ts", F.lit(1 if strict else 0).alias("_side"), F.col("close").alias("_close"), *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra))
    p = probes.select("symbol", "ts", F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast("double").alias("_close"), *extra)
    found = carried_last(b.unionByName(p), "_close", ["ts", "_side"], "price")
    return found.where(F.col("_side") == (0 if strict else 1)).select(*probes.columns, "price")


def timeline(bars: DataFrame) -> DataFrame:
    """(ts, ord): all distinct bar times with their running number from 0."""
    return numbered(bars.select("ts").distinct(), ["ts"], "ord").withColumn("ord", F.col("ord").cast("int"))


def line_end(line: DataFrame) -> int:
    """The last place of a line; -1 if it is empty."""
    last = line.agg(F.max("ord")).first()[0]
    return -1 if last is None else last


def closes_on_timeline(bars: DataFrame, line: DataFrame) -> DataFrame:
    """(symbol, ord, price): the last close at each time of the line, before a symbol's first bar its first close."""
    return closes_where(bars, line, bars.select("symbol").distinct().crossJoin(line))


def closes_where(bars: DataFrame, line: DataFrame, wanted: DataFrame) -> DataFrame:
    """``closes_on_timeline`` for the distinct (symbol, ord) of ``wanted`` alone, by an as-of join: no table of all symbols and times."""
    probes = wanted.select("symbol", "ord").distinct().join(line, "ord").select("symbol", "ts", "ord")
    first = bars.groupBy("symbol").agg(F.min_by("close", "ts").alias("first_close"))
    return asof_price(probes, bars).join(first, "symbol").select("symbol", "ord", F.coalesce("price", "first_close").alias("price"))


def benchmark_change(bars: DataFrame, symbol: str) -> DataFrame:
    """(ts, benchmark_pct): change of one symbol's close from its first, in percent."""
    own = bars.where(F.col("symbol") == symbol)
    first = own.agg(F.min_by("close", "ts").alias("first_close"))
    return own.crossJoin(F.broadcast(first)).select("ts", ((F.col("close") / F.col("first_close") - 1) * 100).alias("benchmark_pct"))
