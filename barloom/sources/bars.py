"""Candle tables: landing, cleaning, splitting, reading and writing.

Bars are one table (symbol, timeframe, ts, open, high, low, close, volume_base, volume_quote), partitioned by timeframe on disk;
``ts`` has no time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OHLC = ["open", "high", "low", "close"]
VALUES = [*OHLC, "volume_base", "volume_quote"]


def parse_candles(raw: DataFrame, array_col: str = "raw", symbol_col: str = "symbol", order_col: str = "seq") -> DataFrame:
    """Text fields of candle arrays ``[ms, open, high, low, close, volume_base, volume_quote]``. Rows with fewer than seven
    fields or a start that isn't a whole number are dropped."""
    fields = F.from_json(F.col(array_col), "array<string>")
    rows = raw.select(F.col(symbol_col).alias("symbol"), F.col(order_col).alias("seq"), fields.alias("x")).where(F.size("x") >= 7)
    ms = F.expr("try_cast(x[0] as bigint)")
    named = [F.col("x")[i + 1].alias(c) for i, c in enumerate(VALUES)]
    return rows.where(ms.isNotNull()).select("symbol", "seq", F.timestamp_millis(ms).cast("timestamp_ntz").alias("ts"), *named)


def coerce_values(df: DataFrame) -> DataFrame:
    """Prices and volumes as doubles; text that isn't a number becomes null."""
    return df.select(*(F.expr(f"try_cast({c} as double)").alias(c) if c in VALUES else F.col(c) for c in df.columns))


def first_of_each_ts(df: DataFrame, order_col: str = "seq") -> DataFrame:
    """One bar for each symbol and ts: the one that arrived first."""
    w = Window.partitionBy("symbol", "ts").orderBy(order_col)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def history_starts(df: DataFrame, wanted: str) -> DataFrame:
    """First ts of each symbol, and whether it is later than ``wanted``."""
    return df.groupBy("symbol").agg(F.min("ts").alias("first_ts")).withColumn("starts_late", F.col("first_ts") > F.lit(wanted).cast("timestamp_ntz"))


def listed_symbols(df: DataFrame, names: list[str]) -> DataFrame:
    """Distinct symbols in order, each from the first of the columns ``names`` that isn't null."""
    return df.select(F.coalesce(*names).alias("symbol")).distinct().orderBy("symbol")


def in_and_out_of_sample(df: DataFrame, end: str, start: str) -> DataFrame:
    """Rows with ``split``: IS up to ``end``, OOS from ``start``; rows strictly between belong to neither."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    part = F.explode(F.array_compact(F.array(F.when(F.col("ts") <= at(end), F.lit("IS")), F.when(F.col("ts") >= at(start), F.lit("OOS")))))
    return df.withColumn("split", part)


def write_bars(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(by or ["timeframe"])).parquet(path)


def read_bars(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """One timeframe of a bar table; other partitions aren't read."""
    return spark.read.parquet(path).where(F.col("timeframe") == timeframe)


def read_bar_files(spark: SparkSession, folder: str, timeframe: str) -> DataFrame:
    """A folder of ``{symbol}_{timeframe}.parquet`` files: those of one timeframe, the symbol from the name."""
    df = spark.read.parquet(folder).withColumn("_file", F.regexp_extract("_metadata.file_name", r"^(.+_[^_]+)\.parquet$", 1))
    cut = lambda k: F.regexp_extract("_file", r"^(.+)_([^_]+)$", k)
    return df.where(cut(2) == timeframe).withColumn("symbol", cut(1)).withColumn("timeframe", cut(2)).drop("_file")


def write_bar_files(df: DataFrame, folder: str, timeframe: str) -> None:
    """One file ``{symbol}_{timeframe}.parquet`` for each symbol. Executors write all of them in one job; the driver renames, one call a file."""
    spark, staged = df.sparkSession, f"{folder}/_staged"
    df.repartition("symbol").withColumn("_name", F.col("symbol")).write.partitionBy("_name").parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.globStatus(path(f"{staged}/_name=*/part-*")):
        name = spark._jvm.java.net.URLDecoder.decode(status.getPath().getParent().getName()[len("_name=") :], "UTF-8")
        fs.rename(status.getPath(), path(f"{folder}/{name}_{timeframe}.parquet"))
    fs.delete(path(staged), True)


def save_symbols(df: DataFrame, path: str, strategy: str, timeframe: str) -> None:
    df.select(F.lit(strategy).alias("strategy"), F.lit(timeframe).alias("timeframe"), "symbol").write.mode("append").partitionBy("strategy", "timeframe").parquet(path)


def load_symbols(spark: SparkSession, path: str, strategy: str, timeframe: str) -> DataFrame:
    return spark.read.parquet(path).where((F.col("strategy") == strategy) & (F.col("timeframe") == timeframe)).select("symbol")


def save_results(df: DataFrame, path: str, strategy: str, timeframe: str) -> None:
    df.withColumns({"strategy": F.lit(strategy), "timeframe": F.lit(timeframe)}).write.mode("append").partitionBy("strategy", "timeframe").parquet(path)


def save_summary(df: DataFrame, path: str, strategy: str, timeframe: str) -> None:
    """A table of results for spreadsheets: CSV with a header, one folder for each strategy and timeframe."""
    df.withColumns({"strategy": F.lit(strategy), "timeframe": F.lit(timeframe)}).write.mode("append").option("header", True).partitionBy("strategy", "timeframe").csv(path)


def ticks_to_bars(ticks: DataFrame, width: str, symbol: str | Column = "event_type", price: str = "value", ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """Bars of a width such as ``4 hours`` from single prices, in the order of (ts, seq)."""
    at, name = F.struct(ts, seq), F.col(symbol) if isinstance(symbol, str) else symbol
    return (
        ticks.groupBy(name.alias("symbol"), F.window(ts, width)["start"].alias("ts"))
        .agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(price).cast("double").alias("volume_base"), F.sum(price).alias("volume_quote"))
        .withColumn("timeframe", F.lit(width))
    )
