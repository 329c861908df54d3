"""Parameter grids."""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parameter_grid(spark: SparkSession, lists: dict[str, list]) -> DataFrame:
    """``combo_id`` and a column for each list. Numbers follow the order of the product, the last list running fastest."""
    total = prod(len(v) for v in lists.values())
    grid, below = spark.range(total).withColumnRenamed("id", "combo_id"), total
    for name, values in lists.items():
        below //= len(values)
        place = F.floor(F.col("combo_id") / below) % len(values)
        grid = grid.withColumn(name, F.array(*(F.lit(v) for v in values))[place.cast("int")])
    return grid


def signals_of_combos(candidates: DataFrame, grid: DataFrame) -> DataFrame:
    """Candidates (symbol, idx, accel_span, entropy) that each combination takes. The grid is as many rows as its author lists."""
    return candidates.join(F.broadcast(grid), "accel_span").where("entropy < entropy_max")
