"""Draws, simulated prices, windows, distances, and jobs with another signal."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators.paths import bootstrap_draws, floored
from barloom.operators.signals import entropy_grid
from barloom.operators.similarity import series_distance
from barloom.operators.walkforward import best_by_window, window_starts, window_table
from barloom.plans.jobs import bootstrap_monte_carlo, grid_backtest, walk_forward


def test_draws_are_independent(spark):
    """895 draws of 895 rows hit 63 of 100, and steps between draws are all kinds."""
    features = spark.range(895).select(F.lit("a").alias("symbol"), "id")
    rows = {}
    for r in bootstrap_draws(features, 3, 895).collect():
        rows.setdefault(r["path_index"], {})[r["step"]] = r["row"]
    for own in rows.values():
        x = np.array([own[k] for k in range(895)])
        assert 0.59 < len(set(x.tolist())) / 895 < 0.67 and len(set(np.diff(x).tolist())) > 400 and x.min() >= 0 and x.max() < 895
    assert rows[0] != rows[1]


def test_prices_go_on_from_the_floor():
    rng = np.random.default_rng(1)
    start, move, jump, floor = np.log(np.array([5.0, 0.3])), rng.normal(-0.1, 0.3, (2, 400)), np.where(rng.random((2, 400)) < 0.1, rng.normal(0, 1, (2, 400)), 0.0), np.log(0.1)
    got = floored(start, move, jump, floor)
    for i in range(2):
        s = np.exp(start[i])
        for k in range(400):
            s = max(s * np.exp(move[i, k]), 0.1)
            s = max(s * np.exp(jump[i, k]), 0.1)
            assert got[i, k] == pytest.approx(s, rel=1e-9)
    assert (got > 0.1001).mean() > 0.3 and (got < 0.1001).any()


def test_windows_of_unequal_series(spark):
    table = lambda counts, *a: {(r["window_id"], r["symbol"]): tuple(r)[2:] for r in window_table(spark.createDataFrame(counts, "symbol string, n long"), *a).collect()}
    assert table([("a", 45), ("b", 20)], 40, 0.8, True) == {(0, "a"): (0, 36, 36, 45)}
    assert table([("a", 75), ("b", 55)], 40, 0.8, True) == {(0, "a"): (0, 40, 40, 50), (0, "b"): (0, 40, 40, 50), (1, "a"): (0, 50, 50, 60), (1, "b"): (0, 50, 50, 55), (2, "a"): (0, 60, 60, 70), (3, "a"): (0, 70, 70, 75)}
    assert table([("a", 95), ("b", 91), ("c", 60)], 40, 0.8, False) == {(0, "a"): (0, 40, 40, 50), (0, "b"): (0, 40, 40, 50), (0, "c"): (0, 40, 40, 50), (1, "a"): (50, 86, 86, 95), (1, "b"): (50, 82, 82, 91)}
    assert window_starts(0, 40, 10, True) == window_starts(0, 40, 10, False) == window_starts(100, 40, 0, False) == []


def test_distances(spark):
    rng = np.random.default_rng(2)
    h, paths = rng.normal(0, 1, 50), rng.normal(0.3, 2, (3, 50)).round(1)
    hist = spark.createDataFrame([("a", float(x)) for x in h], "symbol string, r double")
    rows = spark.createDataFrame([("a", k, float(x)) for k in range(3) for x in paths[k]], "symbol string, path_index int, r double")
    for r in series_distance(hist, rows, ["symbol"], ["symbol", "path_index"]).collect():
        p = paths[r["path_index"]]
        at = np.sort(np.concatenate([h, p]))
        gap = np.abs((h[:, None] <= at).mean(axis=0) - (p[:, None] <= at).mean(axis=0))
        assert r["ks"] == pytest.approx(gap.max()) and r["wasserstein"] == pytest.approx((gap[:-1] * np.diff(at)).sum())


def every_nth(bars, combos, lists):
    """A signal of one's own: every nth bar."""
    return bars.select("symbol", "idx").join(F.broadcast(combos), F.expr("idx % nth = 0"))


def test_jobs_take_any_signal(spark):
    rows = [(s, i, 100.0 + i % 7 + (s == "b"), 101.5 + i % 7 + (s == "b"), 99.0 + i % 7 + (s == "b")) for s in "ab" for i in range(60)]
    bars = spark.createDataFrame(rows, "symbol string, i int, close double, high double, low double").select("symbol", F.timestamp_seconds(F.col("i") * 3600 + 1_700_000_000).cast("timestamp_ntz").alias("ts"), F.col("close").alias("open"), "close", "high", "low")
    bars = bars.withColumns({"high_time": F.col("ts"), "low_time": F.expr("ts + interval 5 minutes")})
    lists = {"sell_after": [3], "nth": [5, 10], "tp": [0.0, 2.0], "sl": [0.0]}
    results = {r["combo_id"]: r for r in grid_backtest(bars, lists, take=every_nth).results.collect()}
    assert len(results) == 4 and all(r["Num_Trades"] == 2 * (60 // r["nth"]) for r in results.values())
    windows = walk_forward(bars, lists, 30, 0.75, take=every_nth)
    assert windows.select("window_id").distinct().count() == 3 and {r["nth"] for r in best_by_window(windows, ["nth", "tp"], "Net_Gain").collect()} <= {5, 10}
    features = bars.select("symbol", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).cast("long").alias("idx"), "ts", "open", "close", F.lit(-0.01).alias("pct_ol"), F.lit(0.01).alias("pct_oh"), F.lit(0.001).alias("pct_oc"), F.lit(3600).cast("long").alias("time_variation"), F.lit(60).cast("long").alias("low_offset"), F.lit(30).cast("long").alias("high_offset"))
    made = bootstrap_monte_carlo(features, 2, 30, lists, take=every_nth)
    assert made.count() == 8 and made.where("Num_Trades > 0").count() == 8


def test_shared_windows_equal_windows_of_their_own(spark):
    """Anchored windows that share bars, indicators and touches, against each window's own bars; symbols of different length, holds of one bar, and too short a history."""
    rng = np.random.default_rng(9)
    rows = []
    for symbol, n, first in (("A", 150, 0), ("B", 120, 20), ("C", 70, 0), ("D", 64, 5)):
        close = np.round(50 + np.cumsum(rng.normal(size=n) * np.linspace(0.3, 2, n)), 2)
        for i, c in enumerate(close.tolist()):
            ts = datetime(2024, 1, 1) + timedelta(hours=4 * (first + i))
            rows.append((symbol, ts, c, c + 1.0, c - 1.0, c, ts + timedelta(minutes=int(rng.integers(200))), ts + timedelta(minutes=100)))
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, high_time timestamp_ntz, low_time timestamp_ntz")
    lists = {"sell_after": [2, 7], "entropy_max": [1.2, 2.0], "accel_span": [4], "tp": [0.0, 3.0], "sl": [0.0, 2.0]}
    key = lambda r: (r["window_id"], r["combo_id"])
    for data, train in ((bars, 40), (bars.where("symbol = 'D'"), 60)):
        shared, own = (sorted(walk_forward(data, lists, train, 0.8, take=take).collect(), key=key) for take in (entropy_grid, lambda *x: entropy_grid(*x)))
        assert len(shared) == len(own) > 0 and shared[0].__fields__ == own[0].__fields__
        assert sum(r["Num_Trades"] for r in shared) > 0
        for a, b in zip(shared, own):
            for x, y in zip(a, b):
                assert x == pytest.approx(y, rel=1e-9) if isinstance(y, float) else x == y, (a, b)


def test_prices_of_zero(spark):
    """A low of 0 has the logarithm minus infinity, not null; a close of 0 stays 0, where its move had been left out of the sum."""
    from pyspark.sql import functions as F

    from barloom.functions.scalar import natural_log
    from barloom.operators.paths import bootstrap_paths

    schema = "symbol string, idx long, ts timestamp_ntz, open double, pct_ol double, pct_oh double, pct_oc double, time_variation long, low_offset long, high_offset long"
    moves = [(-1.0, 0.5, 0.5), (-1.0, 0.0, -1.0)]
    features = spark.createDataFrame([("A", i, None, 8.0, *m, 60, 0, 0) for i, m in enumerate(moves)], schema).withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    draws = spark.createDataFrame([("A", 0, k, row) for k, row in enumerate([0, 1, 0])], "symbol string, path_index int, step int, row long")
    made = bootstrap_paths(features, draws).orderBy("step")
    got = [(round(r["close"], 9), r["low"], r["log_low"]) for r in made.withColumn("log_low", natural_log(F.col("low"))).collect()]
    assert got == [(12.0, 0.0, float("-inf")), (0.0, 0.0, float("-inf")), (0.0, 0.0, float("-inf"))]
    assert [r[0] for r in spark.sql("select explode(array(1D, 0D, null)) x").select(natural_log(F.col("x"))).collect()] == [0.0, float("-inf"), None]
