"""Registered queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from barloom.plans import queries as q

D = "/root/testdata/sf0.001"
#: Each of these covers the steps of many others.
NAMES = ["parse_candles", "coerce_values", "first_of_each_ts", "in_and_out_of_sample", "universe_filter", "time_of_extremes", "asof_price", "asof_price_strict", "parameter_grid", "ema", "rsi", "atr", "rolling_entropy", "patterns_piercing_line", "trend_signal", "grid_backtest", "trade_log", "best_combos", "closed_position_rates", "bootstrap_paths", "distribution_distance", "live_bars", "window_table_rolling", "symbol_metrics", "grid_trend", "grid_patterns", "walk_forward_final", "path_best", "similarity_score", "live_signals", "paper_positions", "read_bar_files"]


def plain(v):
    return (None if math.isnan(v) else round(v + 0.0, 6)) if isinstance(v, float) else None if v is None else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in os.listdir(D):
        con.execute(f"create view {t[:-8]} as select * from '{D}/{t}'")
    df = q.QUERIES[name](spark, D)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cur = con.execute(q.SQL[name])
    names = [x[0] for x in cur.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=str)
    assert sorted(names) == columns
    assert got == want


@pytest.mark.parametrize("name", ["grid_4320_combos", "grid_8640_combos"])
def test_slice_of_a_full_grid(spark, name):
    """First and last values of each list, against SQL for these alone."""
    from barloom.plans import fixture as fx
    from barloom.plans.oracle import CHAIN, entropy_sql

    full, size = (fx.FULL, 4320) if name == "grid_4320_combos" else (q.FULL_TREND, 8640)
    lists = {k: [v[0], v[-1]] for k, v in full.items()}
    con = duckdb.connect()
    for t in os.listdir(D):
        con.execute(f"create view {t[:-8]} as select * from '{D}/{t}'")
    found = entropy_sql("v", lists["accel_span"]) if full is fx.FULL else q._trend_sql(lists)
    cur = con.execute(CHAIN + q.grid_results_sql(lists, found))
    names = [x[0] for x in cur.description if x[0] != "combo_id"]
    at = [x[0] for x in cur.description].index("combo_id")
    want = sorted((tuple(plain(v) for i, v in enumerate(r) if i != at) for r in cur.fetchall()), key=str)
    rows = q.QUERIES[name](spark, D).collect()
    got = sorted((tuple(plain(r[c]) for c in names) for r in rows if all(r[k] in v for k, v in lists.items())), key=str)
    assert len(rows) == size and len({r["combo_id"] for r in rows}) == size and got == want


def test_chunks_do_not_change_smoothing(spark):
    from pyspark.sql import functions as F

    from barloom.operators.indicators import ema, smoothed

    df = spark.range(300).select(F.lit("A").alias("symbol"), F.col("id").alias("idx"), F.sin(F.col("id") * 1.7).alias("x"))
    one = [r["y"] for r in ema(df, "x", {"y": 9}).orderBy("idx").collect()]
    many = [r["y"] for r in ema(df, "x", {"y": 9}, chunk=17).orderBy("idx").collect()]
    assert one == pytest.approx(many, abs=1e-12)
    # a tree of several levels, two series of different length, and keys of their own
    two = df.select(F.explode(F.array(F.lit("A"), F.lit("B"))).alias("k"), F.lit(1).alias("j"), "idx", "x").where("k = 'A' or idx < 41")
    for chunk, width in ((50_000, 4), (3, 3), (1, 2)):
        got = smoothed(two, {"y": ("x", 0.2), "z": ("x", 0.6)}, keys=("k", "j"), chunk=chunk, width=width).orderBy("k", "idx").collect()
        assert [r["y"] for r in got] == pytest.approx(one + one[:41], abs=1e-12) and len(got) == 341
    tail = df.where("idx >= 14")
    a, b = ([r["y"] for r in smoothed(tail, {"y": ("x", 0.2)}, chunk=c).orderBy("idx").collect()] for c in (50_000, 5))
    assert a == pytest.approx(b, abs=1e-12) and smoothed(df.where("false"), {"y": ("x", 0.2)}).count() == 0


def test_chunks_do_not_change_windows(spark):
    from pyspark.sql import functions as F

    from barloom.operators.align import asof_price
    from barloom.operators.chunks import carried_last
    from barloom.operators.indicators import rolling_entropy
    from barloom.operators.trades import forward_bars

    at = lambda c: F.timestamp_seconds(F.col(c) * 700_000 + 1_700_000_000).cast("timestamp_ntz")
    bars = spark.range(120).select(F.lit("A").alias("symbol"), F.col("id").alias("idx"), F.lit(120).alias("n"), at("id").alias("ts"), F.sin(F.col("id") * 1.7).alias("close"))
    bars = bars.withColumns({c: F.col("close") for c in ("high", "low")} | {c: F.col("ts") for c in ("high_time", "low_time")})
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(forward_bars(bars, 7, chunk=10)) == rows(forward_bars(bars, 7)) and forward_bars(bars, 7, chunk=3).count() == 120
    assert rows(rolling_entropy(bars, "close", chunk=11)) == rows(rolling_entropy(bars, "close"))
    probes = spark.range(0, 400).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 250_000 + 1_690_000_000).cast("timestamp_ntz").alias("ts"), "id")
    closes = [(r["ts"], r["close"]) for r in bars.orderBy("ts").collect()]
    for strict in (False, True):
        got = {r["id"]: r["price"] for r in asof_price(probes, bars, strict).collect()}
        for r in probes.collect():
            past = [c for t, c in closes if (t < r["ts"] if strict else t <= r["ts"])]
            assert got[r["id"]] == (past[-1] if past else None)
    one = carried_last(bars.withColumn("x", F.when(F.col("idx") % 50 == 7, F.col("idx"))), "x", ["ts"], "y", F.lit(1))
    assert rows(one) == rows(carried_last(bars.withColumn("x", F.when(F.col("idx") % 50 == 7, F.col("idx"))), "x", ["ts"], "y"))


def test_stream_equals_batch(spark):
    """The streamed signals of each complete bar, from the bars up to it."""
    from datetime import timedelta

    import numpy as np

    from barloom.plans import fixture as fx
    from barloom.streaming.live import recent_signals

    got = {(r["symbol"], r["ts"]): r["signal"] for r in q.QUERIES["live_signals"](spark, D).collect()}
    rows = fx.bars(spark, D, 4).orderBy("ts").collect()
    past, want = {}, {}
    for r in rows:
        past.setdefault(r["symbol"], []).append(r["close"])
        if r["ts"] <= rows[-1]["ts"] - timedelta(days=10):
            want[(r["symbol"], r["ts"])] = bool(recent_signals(np.array([past[r["symbol"]][-50:]]), 10, 2.0)[0])
    assert got == want
