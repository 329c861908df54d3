"""How alike simulated and historic log returns are, as scores from 0 to 100.

Returns are tables: history (symbol, nth, r) and paths (keys, path_index, nth, r), nth counted from 0."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.scratch import written

from .chunks import overlapping

WEIGHTS = {"mean": 0.20, "std": 0.20, "skew": 0.10, "kurt": 0.10, "acf": 0.10, "ks": 0.10, "wasserstein": 0.20}


def log_returns(bars: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, nth, r) without each series' first row."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = bars.withColumns({"r": F.log(F.col("close") / F.lag("close").over(w)), "nth": (F.row_number().over(w) - 2).cast("long")})
    return rows.where("r is not null").select(*keys, "nth", "r")


def last_points(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Each series' last points, as many as its column ``n`` says, counted anew."""
    w = Window.partitionBy(*keys).orderBy(F.desc("nth"))
    return returns.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= F.col("n")).withColumn("nth", (F.col("n") - F.col("_k")).cast("long")).drop("_k")


def moments(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, sample deviation, and skew and excess kurtosis corrected for bias."""
    n = F.count("r").cast("double")
    skew = F.skewness("r") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("r") + 6)
    return returns.groupBy(*keys).agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.when(n > 2, skew).alias("skew"), F.when(n > 3, kurt).alias("kurt"))


def block_products(x: np.ndarray, back: int, lags: int) -> np.ndarray:
    """For lags 0, 1, ... the sum of products of each value from place ``back`` on with the one that many places before, by Fourier transforms; places before the first count nothing."""
    own = x[back:]
    if not len(own):
        return np.zeros(lags + 1)
    size = 1 << (len(x) + lags).bit_length()
    product = np.fft.irfft(np.fft.rfft(own, size).conj() * np.fft.rfft(x, size), size)
    return product[back - np.arange(lags + 1)]  # a negative place wraps round to where nothing is


def autocorrelation(returns: DataFrame, keys: list[str], lags: int = 50, chunk: int = 65_536) -> DataFrame:
    """(keys, lag, acf) of absolute returns from 0 to ``lags``, over the whole sample's variance. Series are cut into chunks, each seen with as many values before it as there are lags;
    a chunk's sums of products come from one transform (overlap-save), whatever the number of lags, and are added up."""
    means = returns.groupBy(*keys).agg(F.avg(F.abs("r")).alias("m"))
    centred = returns.join(means, keys).select(*keys, F.col("nth").alias("idx"), (F.abs("r") - F.col("m")).alias("x"))
    kinds = ", ".join(f"`{k}` {returns.schema[k].dataType.simpleString()}" for k in keys)

    def products(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        back = int((rows.column("_home").to_numpy() != rows.column("_part").to_numpy()).sum())
        p = block_products(rows.column("x").to_numpy(), back, lags)
        same = pa.array(np.zeros(lags + 1, np.int32))
        return pa.table([*(rows.column(k).combine_chunks().take(same) for k in keys), pa.array(np.arange(lags + 1, dtype=np.int32)), pa.array(p)], names=[*keys, "lag", "p"])

    found = overlapping(centred, back=lags, chunk=chunk).groupBy(*keys, "_part").applyInArrow(products, f"{kinds}, lag int, p double").groupBy(*keys, "lag").agg(F.sum("p").alias("p"))
    whole = found.where("lag = 0").select(*keys, F.col("p").alias("p0"))
    ratio = F.when(F.col("p0") > 0, F.col("p") / F.when(F.col("p0") > 0, F.col("p0"))).otherwise((F.col("lag") == 0).cast("double"))
    return found.join(whole, keys).select(*keys, "lag", ratio.alias("acf"))


def distribution_distance(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Kolmogorov-Smirnov statistic and Wasserstein distance of the values r of a and b with equal keys, in one sorted pass."""
    rows = a.select(*keys, "r", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*keys, "r", F.lit(0).alias("a"), F.lit(1).alias("b")))
    values = rows.groupBy(*keys, "r").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy(*keys).orderBy("r")
    run, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    gap = F.abs(F.sum("a").over(run) / F.sum("a").over(whole) - F.sum("b").over(run) / F.sum("b").over(whole))
    steps = values.select(*keys, gap.alias("gap"), (F.lead("r").over(order) - F.col("r")).alias("width"))
    return steps.groupBy(*keys).agg(F.max("gap").alias("ks"), F.coalesce(F.sum(F.col("gap") * F.col("width")), F.lit(0.0)).alias("wasserstein"))


def series_distance(history: DataFrame, paths: DataFrame, once: list[str], by: list[str]) -> DataFrame:
    """(by, ks, wasserstein) of each path to the history of its keys ``once``: series of equal length, each sorted in one row, so that no
    history is repeated for the values of a path."""
    ordered = lambda df, keys, name: df.groupBy(*keys).agg(F.sort_array(F.collect_list("r")).alias(name))

    @F.pandas_udf("ks double, wasserstein double")
    def distance(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            at = np.concatenate([x, y])
            gap = np.searchsorted(x, at, "right") / len(x) - np.searchsorted(y, at, "right") / len(y)
            out.append((np.abs(gap).max(), np.abs(x - y).mean()))
        return pd.DataFrame(out, columns=["ks", "wasserstein"])

    rows = ordered(paths, by, "p").join(ordered(history, once, "h"), once)
    return rows.select(*by, distance("h", "p").alias("d")).select(*by, "d.*")


def closeness(a: Column, b: Column) -> Column:
    """100 for equal values, falling with the difference relative to the first."""
    return 100 / (1 + F.abs(a - b) / (F.abs(a) + 1e-8))


def similarity(history: DataFrame, paths: DataFrame, keys: list[str], lags: int = 50) -> DataFrame:
    """(keys, a score for each part, total). ``keys`` of paths begin with symbol, the key of history. For each key both sides keep their
    last points, as many as the shortest of the symbol's history and the key's own paths has; under two there is no score."""
    size = lambda df, by: df.groupBy(*by).agg((F.max("nth") + 1).alias("n"))
    least = size(paths, [*keys, "path_index"]).groupBy(*keys).agg(F.min("n").alias("p"))
    sizes = least.join(size(history, ["symbol"]), "symbol").select(*keys, F.least("n", "p").alias("n")).where("n > 1")
    # a history is cut once for each of its lengths
    once = ["symbol", "n"]
    history = last_points(history.join(sizes.select(*once).distinct(), "symbol"), once)
    paths = last_points(paths.join(sizes, keys), [*keys, "path_index"])
    by = [*keys, "n"]
    h = moments(history, once).select(*once, *(F.col(c).alias(f"h_{c}") for c in ("mean", "std", "skew", "kurt")))
    p = moments(paths, [*by, "path_index"]).groupBy(*by).agg(*(F.avg(c).alias(c) for c in ("mean", "std", "skew", "kurt")))
    mean = 100 * F.greatest(F.lit(0.0), 1 - F.abs(F.col("h_mean") - F.col("mean")) / (F.abs(F.col("h_std")) + 1e-12))
    scored = p.join(h, once).select(*keys, mean.alias("mean"), *(closeness(F.col(f"h_{c}"), F.col(c)).alias(c) for c in ("std", "skew", "kurt")))
    ha = autocorrelation(history, once, lags).withColumnRenamed("acf", "h")
    pa = autocorrelation(paths, [*by, "path_index"], lags).groupBy(*by, "lag").agg(F.avg("acf").alias("p"))
    off, size_h = F.sqrt(F.sum(F.pow(F.col("h") - F.col("p"), 2))), F.sqrt(F.sum(F.pow("h", F.lit(2))))
    acf = pa.join(ha, [*once, "lag"]).groupBy(*keys).agg(F.when(size_h > 0, F.greatest(F.lit(0.0), 100 * (1 - off / (size_h + 1e-12)))).otherwise(0.0).alias("acf"))
    d = written(series_distance(history, paths, once, [*by, "path_index"]), "distances")
    limit = d.groupBy(*keys).agg(F.percentile("wasserstein", F.lit(0.95)).alias("p95"))
    share = F.when(F.col("p95") > 0, F.least(F.col("wasserstein") / F.when(F.col("p95") > 0, F.col("p95")), F.lit(1.0))).otherwise(0.0)
    dist = d.join(limit, keys).groupBy(*keys).agg((100 * (1 - F.avg("ks"))).alias("ks"), F.avg(100 * (1 - share)).alias("wasserstein"))
    rows = scored.join(acf, keys).join(dist, keys)
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    return rows.withColumn("total", total)
