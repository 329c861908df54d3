"""Bars and settings that the registered queries share: events as ticks, their type as symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import align, signals
from barloom.operators.indicators import indexed
from barloom.plans.jobs import Backtest, Settings, grid_backtest
from barloom.sources.bars import ticks_to_bars
from barloom.sources.scratch import written

LISTS = {"sell_after": [6, 12], "entropy_max": [1.5, 2.0], "accel_span": [5, 15], "tp": [0.0, 40.0], "sl": [0.0, 30.0]}
#: The work size of a full grid: 4320 combinations.
FULL = {"sell_after": [10, 15, 20, 25, 30, 35, 40, 45], "entropy_max": [0.4, 0.6, 0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 2.2], "accel_span": [5, 8, 10, 12, 15, 20], "tp": [0.0, 20.0, 40.0], "sl": [0.0, 15.0, 30.0]}
SETTINGS = Settings()


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def bars(spark: SparkSession, d: str, hours: int) -> DataFrame:
    return ticks_to_bars(events(spark, d), f"{hours} hours")


def annotated(spark: SparkSession, d: str) -> DataFrame:
    return written(align.time_of_extremes(bars(spark, d, 4), bars(spark, d, 1)), "annotated")


def rows(spark: SparkSession, d: str) -> DataFrame:
    return indexed(annotated(spark, d))


def backtest(spark: SparkSession, d: str, lists: dict | None = None) -> Backtest:
    return grid_backtest(annotated(spark, d), lists or LISTS, SETTINGS)


def features_of(spark: SparkSession, d: str) -> DataFrame:
    return signals.entropy_acceleration(rows(spark, d), LISTS["accel_span"])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show."""
    return df.select(*((F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema))
