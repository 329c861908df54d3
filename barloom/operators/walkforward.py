"""Walk-forward windows, best combinations by window, consensus parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def window_starts(longest: int, train: int, test: int, anchored: bool) -> list[tuple[int, int, bool]]:
    """(start, end of training, whether it is the last one that each series splits by itself) of each window for the longest series. Anchored windows keep their start
    and grow by a test length; rolling ones move by a whole window. A rest shorter than a whole window is split."""
    if test <= 0:
        return []
    if anchored:
        return [(0, end, False) for end in range(train, longest, test)] if longest >= train + test else [(0, train, True)] * (longest > 0)
    return [(start, start + train, longest - start < train + test) for start in range(0, longest, train + test)]


def window_table(counts: DataFrame, train: int, pct_train: float, anchored: bool) -> DataFrame:
    """(window_id, symbol, t0, t1, test0, test1) by each symbol's own bar numbers; a symbol without a training or a test bar in a window isn't in it. In a split
    window each symbol takes ``pct_train`` of its own rest for training, and isn't in it with less than 0.8 of ``train``."""
    spark: SparkSession = counts.sparkSession
    longest = counts.agg(F.max("n")).first()[0] or 0
    starts = window_starts(longest, train, int(train / pct_train - train), anchored)
    table = spark.createDataFrame([(i, *b) for i, b in enumerate(starts)], "window_id int, t0 long, e long, rest boolean")
    size = F.floor((F.col("n") - F.col("t0")) * F.lit(pct_train))
    rows = counts.select("symbol", "n").crossJoin(F.broadcast(table)).where((F.col("n") > F.col("t0")) & (~F.col("rest") | (size >= F.lit(0.8 * train))))
    t1 = F.when(F.col("rest"), F.col("t0") + size).otherwise(F.least("e", "n"))
    test1 = F.when(F.col("rest"), F.col("n")).otherwise(F.least(t1 + int(train / pct_train - train), F.col("n")))
    return rows.select("window_id", "symbol", "t0", t1.alias("t1"), t1.alias("test0"), test1.alias("test1")).where("t1 > t0 and test1 > test0")


def rows_of_windows(bars: DataFrame, windows: DataFrame, part: str = "train") -> DataFrame:
    """Bars of each window's part, numbered from 0, with the part's own ``n``; symbols become one for each (window, symbol) in ``series``."""
    a, b = ("t0", "t1") if part == "train" else ("test0", "test1")
    joined = bars.drop("n").join(windows, "symbol").where(f"idx >= {a} and idx < {b}")
    return joined.withColumns({"idx": F.col("idx") - F.col(a), "n": F.col(b) - F.col(a)}).drop("t0", "t1", "test0", "test1")


def extremes_by_window(rows: DataFrame, windows: DataFrame, column: str, train: int, step: int) -> DataFrame:
    """(symbol, window_id, t1, _lo, _hi, regime) for anchored windows that end at ``train``, ``train + step`` ...: least and greatest ``column`` from a symbol's first bar to the window's end, as prefixes of the
    extremes between window ends. ``regime`` is the first window of those with the same extremes."""
    segment = F.when(F.col("idx") < train, 0).otherwise(F.floor((F.col("idx") - train) / step) + 1).cast("int")
    parts = rows.groupBy("symbol", segment.alias("window_id")).agg(F.min(column).alias("a"), F.max(column).alias("b"))
    run = Window.partitionBy("symbol").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = parts.select("symbol", "window_id", F.min("a").over(run).alias("_lo"), F.max("b").over(run).alias("_hi"))
    found = windows.select("symbol", "window_id", "t1").join(upto, ["symbol", "window_id"])
    return found.withColumn("regime", F.min("window_id").over(Window.partitionBy("symbol", "_lo", "_hi")))


def best_by_window(results: DataFrame, params: list[str], metric: str = "Sharpe") -> DataFrame:
    """The combination with the greatest metric in each window, the first of those equal to nine decimals; nulls never win."""
    pick = F.max_by(F.struct("combo_id", *params, metric), F.struct(F.round(metric, 9), -F.col("combo_id")))
    return results.where(F.col(metric).isNotNull()).groupBy("window_id").agg(pick.alias("x")).select("window_id", "x.*")


def consensus(best: DataFrame, params: list[str]) -> DataFrame:
    """(param, value): the commonest value of each parameter by itself, the first seen of equals; whole numbers unless the name ends in ``_max``."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in params)))
    rows = best.select("window_id", each.alias("x")).select("window_id", "x.*")
    seen = rows.groupBy("param", "value").agg(F.count(F.lit(1)).alias("k"), F.min("window_id").alias("first"))
    most = seen.groupBy("param").agg(F.max_by("value", F.struct(F.col("k"), -F.col("first"))).alias("value"))
    return most.select("param", F.when(F.lower("param").endswith("_max"), F.col("value")).otherwise(F.round("value")).alias("value"))
