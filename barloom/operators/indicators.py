"""Indicators of one symbol's bars in time order. Input rows have ``symbol`` and ``idx``, the bar's number from 0."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.scratch import written

from .chunks import by_chunk, overlapping, own_rows


def by_bar() -> Window:
    """A symbol's bars in order."""
    return Window.partitionBy("symbol").orderBy("idx")


def indexed(bars: DataFrame) -> DataFrame:
    """``idx``, the number of a symbol's bar from 0, and ``n``, the number of its bars."""
    numbered = bars.withColumn("idx", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).cast("long"))
    return numbered.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("symbol")))


def delta(column: str = "close") -> Column:
    return F.coalesce(F.col(column) - F.lag(column).over(by_bar()), F.lit(0.0))


def second_difference(column: str = "close") -> Column:
    return F.coalesce(F.col(column) - 2 * F.lag(column, 1).over(by_bar()) + F.lag(column, 2).over(by_bar()), F.lit(0.0))


def _composed(maps: DataFrame, keys: list[str], count: int, n: int, width: int) -> DataFrame:
    """(keys, _chunk, c0, c1, ...): what affine maps (keys, _chunk, m0, b0, m1, b1, ...) of the chunks before carry into each chunk. ``count`` is the number of chunks of the longest
    series. Up and down a tree of ``width`` branches: maps are composed within a branch, whole branches by the same means, and what is carried into a branch goes through it."""
    kinds = ", ".join(f"`{k}` {maps.schema[k].dataType.simpleString()}" for k in keys)
    local = maps.withColumn("_branch", F.floor(F.col("_chunk") / width))

    def scan(group: pa.Table) -> pa.Table:
        group = group.sort_by("_chunk")
        out = group.select([*keys, "_branch", "_chunk"])
        for i in range(n):
            slope, shift = np.ones(len(group) + 1), np.zeros(len(group) + 1)
            for k, (m, b) in enumerate(zip(group.column(f"m{i}").to_pylist(), group.column(f"b{i}").to_pylist(), strict=True)):
                slope[k + 1], shift[k + 1] = m * slope[k], m * shift[k] + b
            out = out.append_column(f"p{i}", pa.array(slope[:-1])).append_column(f"q{i}", pa.array(shift[:-1]))
            out = out.append_column(f"m{i}", pa.array(np.full(len(group), slope[-1]))).append_column(f"b{i}", pa.array(np.full(len(group), shift[-1])))
        return out

    fields = ", ".join(f"p{i} double, q{i} double, m{i} double, b{i} double" for i in range(n))
    within = local.groupBy(*keys, "_branch").applyInArrow(scan, f"{kinds}, _branch long, _chunk long, {fields}")
    if count <= width:
        # the first map takes nothing in, so nothing before it counts
        return within.select(*keys, "_chunk", *(F.col(f"q{i}").alias(f"c{i}") for i in range(n)))
    within = written(within, "branches")
    whole = within.where(F.col("_chunk") % width == 0).select(*keys, F.col("_branch").alias("_chunk"), *(f"{x}{i}" for i in range(n) for x in "mb"))
    above = _composed(whole, keys, -(-count // width), n, width).withColumnRenamed("_chunk", "_branch")
    return within.join(above, [*keys, "_branch"]).select(*keys, "_chunk", *((F.col(f"p{i}") * F.col(f"c{i}") + F.col(f"q{i}")).alias(f"c{i}") for i in range(n)))


def smoothed(df: DataFrame, columns: dict[str, tuple[str, float]], keys: tuple[str, ...] = ("symbol",), order: str = "idx", chunk: int = 50_000, width: int = 1024) -> DataFrame:
    """``df`` with a column for each of ``columns``, from the column and alpha given: y = alpha x + (1 - alpha) y before, from the first x on. ``order`` counts rows.

    Series longer than ``chunk`` rows are cut into chunks, each smoothed by itself (a chunk is what a task must hold); a chunk is an affine map of what comes into it, and a tree scan over
    these maps corrects each chunk, so series of any length spread over tasks."""
    keys = list(keys)
    first, last = df.agg(F.min(order), F.max(order)).first()
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    named = ", ".join(f"`{name}` double" for name in columns)

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order).reset_index(drop=True)
        for name, (column, alpha) in columns.items():
            group[name] = group[column].ewm(alpha=alpha, adjust=False).mean()
        return group

    if last is None or last // chunk == first // chunk:
        return df.groupBy(*keys).applyInPandas(scan, f"{fields}, {named}")
    base = df.withColumn("_chunk", F.floor((F.col(order) - first) / chunk))
    schema = f"{fields}, _chunk long, {named}"
    local = written(base.groupBy(*keys, "_chunk").applyInPandas(scan, schema).withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(order))), "smoothed")
    xs = [(i, name, column, alpha) for i, (name, (column, alpha)) in enumerate(columns.items())]
    ends = local.groupBy(*keys, "_chunk").agg(F.max("_k").alias("_len"), *(f(c, "_k").alias(f"_{x}{i}") for i, name, column, _ in xs for f, c, x in ((F.min_by, column, "x"), (F.max_by, name, "e"))))
    begins = F.col("_chunk") == F.min("_chunk").over(Window.partitionBy(*keys))
    slopes = {f"m{i}": F.when(F.col("_begins"), 0.0).otherwise(F.pow(F.lit(1 - alpha), F.col("_len"))) for i, _, _, alpha in xs}
    maps = ends.withColumn("_begins", begins).withColumns(slopes).withColumns({f"b{i}": F.col(f"_e{i}") - F.col(f"m{i}") * F.col(f"_x{i}") for i, *_ in xs})
    maps = written(maps, "chunks")
    carried = _composed(maps.select(*keys, "_chunk", *(f"{x}{i}" for i, *_ in xs for x in "mb")), keys, (last - first) // chunk + 1, len(xs), width)
    corrections = maps.join(carried, [*keys, "_chunk"]).select(*keys, "_chunk", *(F.when(~F.col("_begins"), F.col(f"c{i}") - F.col(f"_x{i}")).otherwise(0.0).alias(f"_d{i}") for i, *_ in xs))
    joined = local.join(corrections, [*keys, "_chunk"])
    return joined.select(*df.columns, *((F.col(name) + F.pow(F.lit(1 - alpha), F.col("_k")) * F.col(f"_d{i}")).alias(name) for i, name, _, alpha in xs))


def ema(df: DataFrame, column: str, spans: dict[str, int], **settings) -> DataFrame:
    """Exponential means of the given spans, alpha = 2 / (span + 1)."""
    return smoothed(df, {name: (column, 2 / (span + 1)) for name, span in spans.items()}, **settings)


def rsi(df: DataFrame, period: int = 14) -> DataFrame:
    """Adds ``rsi`` by Wilder: 50 for the first ``period`` bars, then from means seeded by the first ``period`` changes. Series not longer than the period are 50 throughout."""
    change = df.withColumn("_d", delta())
    seeds = change.where((F.col("idx") >= 1) & (F.col("idx") <= period)).groupBy("symbol").agg((F.sum(F.greatest("_d", F.lit(0.0))) / period).alias("_g"), (F.sum(F.greatest(-F.col("_d"), F.lit(0.0))) / period).alias("_l"))
    tail = change.where(F.col("idx") >= period).join(seeds, "symbol")
    at_seed = F.col("idx") == period
    tail = tail.select("symbol", "idx", F.when(at_seed, F.col("_g")).otherwise(F.greatest("_d", F.lit(0.0))).alias("_gain"), F.when(at_seed, F.col("_l")).otherwise(F.greatest(-F.col("_d"), F.lit(0.0))).alias("_loss"))
    means = smoothed(tail, {"_mg": ("_gain", 1 / period), "_ml": ("_loss", 1 / period)}).select("symbol", "idx", "_mg", "_ml")
    value = 100 - 100 / (1 + F.col("_mg") / (F.col("_ml") + 1e-8))
    return df.join(means, ["symbol", "idx"], "left").withColumn("rsi", F.coalesce(value, F.lit(50.0))).drop("_mg", "_ml")


def atr(df: DataFrame, period: int = 14, causal: bool = False) -> DataFrame:
    """Adds ``atr``. As usual in this family of jobs the value at a bar uses the true range of the next one, the first of all the
    mean of the first ``period``, and the last repeats the one before; ``causal`` shifts by one bar so that none looks ahead."""
    before = F.lag("close").over(by_bar())
    ranges = df.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    # true range of bar i + 1 stands at i
    ahead = ranges.withColumn("_tr", F.lead("_tr").over(by_bar())).where("_tr is not null").select("symbol", "idx", "_tr")
    run = Window.partitionBy("symbol").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    first = ahead.where(F.col("idx") < period)
    seeds = first.groupBy("symbol").agg(F.avg("_tr").alias("_seed"))
    start = first.join(seeds, "symbol").select("symbol", "idx", F.when(F.col("idx") == 0, F.col("_seed")).otherwise(F.avg("_tr").over(run)).alias("_atr"))
    tail = ahead.where(F.col("idx") >= period - 1).join(seeds, "symbol").withColumn("_x", F.when(F.col("idx") == period - 1, F.col("_seed")).otherwise(F.col("_tr")))
    later = smoothed(tail, {"_atr": ("_x", 1 / period)}).where(F.col("idx") >= period).select("symbol", "idx", "_atr")
    found = df.join(start.unionByName(later), ["symbol", "idx"], "left")
    if causal:
        return found.withColumn("atr", F.lag("_atr").over(by_bar())).drop("_atr")
    return found.withColumn("atr", F.coalesce("_atr", F.lag("_atr").over(by_bar()))).drop("_atr")


def rolling_entropy(df: DataFrame, column: str, window: int = 5, bins: int = 10, closed: bool = False, expanding: bool = False, chunk: int = 50_000) -> DataFrame:
    """Adds ``entropy``: base-2 entropy of the last ``window`` values over equal bins between the series' least and greatest value
    (of the whole series, which looks ahead; ``expanding``: up to the bar). ``closed``: exact edges, the last bin closed."""
    if expanding:
        run = by_bar().rowsBetween(Window.unboundedPreceding, 0)
        ranged = df.withColumns({"_lo": F.min(column).over(run), "_hi": F.max(column).over(run)})
    else:
        ranged = df.join(df.groupBy("symbol").agg(F.min(column).alias("_lo"), F.max(column).alias("_hi")), "symbol")
    return entropy_between(ranged, column, window, bins, closed, chunk).drop("_lo", "_hi")


def entropy_between(ranged: DataFrame, column: str, window: int = 5, bins: int = 10, closed: bool = False, chunk: int = 50_000) -> DataFrame:
    """Adds ``entropy`` over equal bins between each row's own ``_lo`` and ``_hi``."""
    width = F.col("_hi") - F.col("_lo")
    share = F.when(width == 0, 0.0).otherwise((F.col(column) - F.col("_lo")) / width) if closed else (F.col(column) - F.col("_lo")) / (width + 1e-9)
    ranged = ranged.withColumn("_bin", F.least((share * bins).cast("int"), F.lit(bins - 1)))
    seen = F.collect_list("_bin").over(by_chunk().rowsBetween(-(window - 1), 0))
    n = F.size("_w")
    logs = F.aggregate(F.transform("_w", lambda x: F.log2(F.size(F.filter("_w", lambda y: y == x)).cast("double"))), F.lit(0.0), lambda a, b: a + b)
    return own_rows(overlapping(ranged, back=window - 1, chunk=chunk).withColumn("_w", seen)).withColumn("entropy", F.log2(n.cast("double")) - logs / n).drop("_bin", "_w")


def bootstrap_features(bars: DataFrame) -> DataFrame:
    """Relative moves within each bar, seconds since the bar before (for the first the commonest step, the least of equals), and seconds from
    the bar's start to its extremes."""
    step = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(by_bar()).cast("timestamp"))
    rows = bars.withColumn("_step", step)
    common = rows.where("_step is not null").groupBy("symbol", "_step").count().groupBy("symbol").agg(F.min_by("_step", F.struct(-F.col("count"), F.col("_step"))).alias("_mode"))
    since = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return rows.join(common, "symbol", "left").select(
        "symbol", "idx", "ts", "open", "close",
        *(((F.col(c) - F.col("open")) / F.col("open")).alias(f"pct_o{c[0]}") for c in ("low", "high", "close")),
        F.coalesce("_step", "_mode").alias("time_variation"), since("low_time").alias("low_offset"), since("high_time").alias("high_offset"),
    )


def return_moments(bars: DataFrame, vol_scale: float = 1.0) -> DataFrame:
    """Mean and spread of log returns by symbol, and the last close."""
    rows = bars.withColumn("_r", F.log(F.col("close") / F.lag("close").over(by_bar())))
    return rows.groupBy("symbol").agg(F.avg("_r").alias("mu"), F.greatest(F.stddev_pop("_r") * vol_scale, F.lit(1e-8)).alias("sigma"), F.max_by("close", "idx").alias("last_close"))
