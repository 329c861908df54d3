"""Price paths: bootstrapped from a symbol's own bars, or by a jump diffusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import symbol_seed


def draw_index(seed: Column, path: Column, step: Column, n: Column) -> Column:
    """A row number below n: the first 48 bits of the md5 of ``seed + path`` and the step, so that draws are independent wherever they are made. Symbols aren't
    in it, so symbols of equal length share draws."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed + path, step)), 1, 12), 16, 10).cast("bigint") % n


def bootstrap_draws(features: DataFrame, paths: int, steps: int, seed: int = 42) -> DataFrame:
    """(symbol, path_index, step, row): ``steps`` draws with replacement for each path of each symbol."""
    sizes = features.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    grid = sizes.withColumn("path_index", F.explode(F.sequence(F.lit(0), F.lit(paths - 1)))).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    row = draw_index(F.lit(seed).cast("long"), F.col("path_index").cast("long"), F.col("step").cast("long"), F.col("n"))
    return grid.select("symbol", "path_index", "step", row.alias("row"))


def bootstrap_paths(features: DataFrame, draws: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Bars of each path: closes by the product of drawn moves from the last historic open, opens at the close before, times by summed steps."""
    start = features.groupBy("symbol").agg(F.max_by("open", "idx").alias("p0"), F.max_by("ts", "idx").alias("t0"))
    rows = draws.join(features.select("symbol", F.col("idx").alias("row"), "pct_ol", "pct_oh", "pct_oc", "time_variation", "low_offset", "high_offset", *extra), ["symbol", "row"]).join(start, "symbol")
    order = Window.partitionBy("symbol", "path_index").orderBy("step")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    # a fall to 0 is minus infinity, and what follows stays 0
    moves = F.when(F.col("pct_oc") == -1, F.lit(float("-inf"))).otherwise(F.log1p("pct_oc"))
    rows = rows.withColumn("close", F.col("p0") * F.exp(F.sum(moves).over(run)))
    rows = rows.withColumns({"open": F.coalesce(F.lag("close").over(order), F.col("p0")), "_s": F.sum("time_variation").over(run)})
    at = lambda seconds: F.timestamp_seconds(F.unix_timestamp(F.col("t0").cast("timestamp")) + seconds).cast("timestamp_ntz")
    return rows.select(
        "symbol", "path_index", "step", "row", at(F.col("_s")).alias("ts"), "open", F.greatest(F.col("open") * (1 + F.col("pct_oh")), F.col("close")).alias("high"),
        F.least(F.col("open") * (1 + F.col("pct_ol")), F.col("close")).alias("low"), "close", at(F.col("_s") + F.col("low_offset")).alias("low_time"), at(F.col("_s") + F.col("high_offset")).alias("high_time"), *extra,
    )


def path_bars(paths: DataFrame, ordinal_time: bool = False) -> DataFrame:
    """Paths as bars: ``idx``, ``n``, one series for each (symbol, path). ``ordinal_time``: the step's number in microseconds instead of simulated time."""
    size = F.count(F.lit(1)).over(Window.partitionBy("symbol", "path_index"))
    out = paths.withColumns({"idx": F.col("step").cast("long"), "n": size})
    return out.withColumn("ts", F.timestamp_micros(F.col("step").cast("long")).cast("timestamp_ntz")) if ordinal_time else out


def floored(start: np.ndarray, move: np.ndarray, jump: np.ndarray, floor: float) -> np.ndarray:
    """Prices after each (move, jump) of rows of log changes, where the log price is lifted to ``floor`` after either: the sum of changes, lifted by
    how far it has ever been under the floor."""
    changes = np.stack([move, jump], axis=2).reshape(len(move), -1)
    level = np.cumsum(changes, axis=1)
    lifted = level + np.maximum(start[:, None], floor - np.minimum.accumulate(level, axis=1))
    return np.exp(lifted[:, 1::2])


def jump_diffusion(moments: DataFrame, paths: int, steps: int, substeps: int = 10, jump_prob: float = 0.01, jump_mu: float = 0.0, jump_sigma: float = 0.01, min_price: float = 1e-4, seed: int = 42, vol_scale: Column | None = None) -> DataFrame:
    """Bars (symbol, trial, path_index, step, open, high, low, close) of a diffusion with random volatility and lognormal jumps, for rows (symbol, mu, sigma,
    last_close and, for a search, trial and its settings). Every (symbol, path) has its own stream of random numbers. A jump comes with ``jump_prob`` in each
    substep; a price that falls under ``min_price``, by diffusion or by a jump, goes on from there."""
    given = set(moments.columns)
    cols = {"trial": F.lit(0), "jump_prob": F.lit(jump_prob), "jump_mu": F.lit(jump_mu), "jump_sigma": F.lit(jump_sigma)}
    rows = moments.withColumns({k: v for k, v in cols.items() if k not in given}).withColumn("path_index", F.explode(F.sequence(F.lit(0), F.lit(paths - 1))))
    rows = rows.withColumn("seed", symbol_seed(F.col("symbol"), seed, F.col("path_index")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dt = 1.0 / substeps
        for frame in frames:
            for part in (frame.iloc[i : i + 256] for i in range(0, len(frame), 256)):
                draws = [np.random.Generator(np.random.Philox(key=int(s))) for s in part["seed"]]
                m = len(part)
                p = {c: part[c].to_numpy(float)[:, None] for c in ("mu", "sigma", "jump_prob", "jump_mu", "jump_sigma")}
                u = np.stack([g.random((steps * substeps, 2)) for g in draws])
                z = np.stack([g.standard_normal((steps * substeps, 2)) for g in draws])
                sigma = p["sigma"] * np.maximum(0.1, 1 + 0.4 * (2 * u[:, :, 0] - 1))
                move = (p["mu"] - sigma**2 / 2) * dt + sigma * np.sqrt(dt) * z[:, :, 0]
                jump = np.where(u[:, :, 1] < p["jump_prob"], p["jump_mu"] + p["jump_sigma"] * z[:, :, 1], 0.0)
                price = floored(np.log(part["last_close"].to_numpy(float)), move, jump, np.log(min_price)).reshape(m, steps, substeps)
                close = price[:, :, -1]
                open_ = np.concatenate([part["last_close"].to_numpy(float)[:, None], close[:, :-1]], axis=1)
                whole = np.concatenate([open_[:, :, None], price], axis=2)
                rep = lambda c, part=part: np.repeat(part[c].to_numpy(), steps)
                yield pd.DataFrame({"symbol": rep("symbol"), "trial": rep("trial"), "path_index": rep("path_index"), "step": np.tile(np.arange(steps), m), "open": open_.ravel(), "high": whole.max(axis=2).ravel(), "low": whole.min(axis=2).ravel(), "close": close.ravel()})

    return rows.select("symbol", "trial", "path_index", "seed", "mu", "sigma", "last_close", "jump_prob", "jump_mu", "jump_sigma").mapInPandas(run, "symbol string, trial int, path_index int, step int, open double, high double, low double, close double")
