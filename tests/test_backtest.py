"""Hand-computed portfolios, and the library against a plain interpreter of the rules."""

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.operators import grid, trades
from barloom.operators.portfolio import walk
from barloom.plans.jobs import Settings, evaluate_signals

START = datetime(2024, 1, 1)


def series(closes, highs=None, lows=None, signals=(), symbol="SYM1", spread=0.5, first=0):
    highs = highs or [c + spread for c in closes]
    lows = lows or [c - spread for c in closes]
    rows = []
    for i, (c, h, lo) in enumerate(zip(closes, highs, lows)):
        ts = START + timedelta(hours=first + i)
        rows.append((symbol, i, len(closes), ts, float(c), float(h), float(lo), ts + timedelta(minutes=30), ts + timedelta(minutes=15), i in signals))
    return rows


SCHEMA = "symbol string, idx long, n long, ts timestamp_ntz, close double, high double, low double, high_time timestamp_ntz, low_time timestamp_ntz, signal boolean"


def run(spark, rows, sell_after, tp, sl, initial=10_000.0, comi=0.05):
    bars = spark.createDataFrame(rows, SCHEMA)
    lists = {"sell_after": [sell_after], "tp": [float(tp)], "sl": [float(sl)]}
    combos = grid.parameter_grid(spark, lists)
    taken = bars.where("signal").select("symbol", "idx").crossJoin(combos)
    done = evaluate_signals(bars.drop("signal"), taken, combos, lists, Settings(initial, 100.0, comi))
    log = done.trades.where("closed").orderBy("close_ord", "seq").collect()
    return done.results.first(), log, done


SIMPLE = [99, 99.5, 100, 101, 102, 103, 104, 105, 106, 107]
SECOND = [49, 49.5, 50, 51, 52, 53, 54, 55, 56, 57]


@pytest.mark.parametrize(
    "rows, args, balance, reasons",
    [
        (series(SIMPLE, signals=[2]), (3, 0, 0), 10002.8985, ["SELL_AFTER"]),
        (series([99, 99.5, 100, 102, 104, *range(105, 115)], [99.5, 100, 100.5, 103, 106, *[x + 1.5 for x in range(105, 115)]], [98.5, 99, 99.5, 101.5, *[x + 0.5 for x in range(103, 114)]], [2]), (10, 5, 0), 10004.8975, ["TP"]),
        (series([100, 99.5, 100, 98, 96, *range(95, 85, -1)], [100.5, 100, 100.5, 99, *range(97, 86, -1)], [99.5, 99, 99.5, 96.5, *range(95, 84, -1)], [2]), (10, 0, 3), 9996.9015, ["SL"]),
        (series([100] * 10, [101] * 3 + [106] + [101] * 6, [99] * 3 + [96] + [99] * 6, [2]), (5, 5, 3), 9996.9015, ["SL"]),
        (series(SIMPLE, signals=[2]) + series(SECOND, signals=[2], symbol="SYM2"), (3, 0, 0), 10008.7955, ["SELL_AFTER"] * 2),
        (series([100, 100, 100, 104, *range(106, 112)], [100.5] * 3 + [105.0] + [x + 0.5 for x in range(106, 112)], [99.5] * 3 + [103.5, *[x - 0.5 for x in range(106, 112)]], [2]), (5, 5, 0), 10004.8975, ["TP"]),
        (series([100, 101, 102, 103, 104], signals=[4]), (3, 0, 0), 10000.0, []),
    ],
    ids=["simple", "take profit", "stop loss", "same bar", "two symbols", "exact touch", "last bar"],
)
def test_hand_computed(spark, rows, args, balance, reasons):
    result, log, _ = run(spark, rows, *args)
    assert result["Final_Balance"] == pytest.approx(balance, abs=1e-4)
    assert [r["exit_reason"] for r in log] == reasons


def test_limited_cash_and_no_commission(spark):
    rows = series([99, 99.5, 100, 101, 102, 103, 104, *range(100, 108)], signals=[2, 8])
    result, log, _ = run(spark, rows, 3, 0, 0, initial=150.0)
    assert result["Final_Balance"] == pytest.approx(155.7673, abs=1e-4)
    assert [r["profit"] for r in log] == pytest.approx([2.8985, 2.8688], abs=1e-4)
    assert run(spark, series(SIMPLE, signals=[2]), 3, 0, 0, comi=0.0)[0]["Final_Balance"] == pytest.approx(10003.0)


def test_equal_times_take_profit_and_missing_times_stop(spark):
    bar = lambda dt: [(*r[:7], r[3], r[3] + dt if dt is not None else None, r[9]) for r in series([100] * 10, [101] * 3 + [106] + [101] * 6, [99] * 3 + [96] + [99] * 6, [2])]
    assert run(spark, bar(timedelta(0)), 5, 5, 3)[1][0]["exit_reason"] == "TP"
    assert run(spark, bar(None), 5, 5, 3)[1][0]["exit_reason"] == "SL"


def test_position_without_length(spark):
    # a hold of one bar on a symbol's last bar closes at the next time of the line, or never
    rows = series([100, 100, 100], signals=[2]) + series([50] * 5, symbol="B")
    result, log, done = run(spark, rows, 1, 0, 0)
    assert (result["Num_Signals"], result["Num_Trades"]) == (1, 1) and log[0]["profit"] == pytest.approx(-0.1)
    result, log, _ = run(spark, series([100, 100, 100], signals=[2]), 1, 0, 0)
    assert (result["Num_Signals"], result["Num_Trades"], log) == (1, 0, [])


def test_missing_times_fail_early(spark):
    bars = spark.createDataFrame(series(SIMPLE, signals=[2]), SCHEMA).drop("high_time")
    with pytest.raises(ValueError):
        trades.forward_bars(bars, 3)
    with pytest.raises(ValueError):
        trades.touches(bars, bars, [1.0], [1.0], [3])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 4), st.floats(-30, 30)), max_size=25, unique_by=lambda x: x[0] * 100 + x[1]), st.floats(50, 500))
def test_walk_follows_the_rules(items, cash):
    """Against an event loop over times."""
    import numpy as np

    items = sorted((b, k, b + k, 101.0, 100.0 + p) for k, (b, _, p) in enumerate(items))
    items = [(b, o, c, r) for b, _, o, c, r in items]
    taken, closes = walk(*(np.array([x[i] for x in items], float if i > 1 else int) for i in range(4)), cash, 100.0) if items else ([], [])
    money, open_, want = cash, [], []
    for t in range(60):
        for k in [k for k in open_ if max(items[k][1], items[k][0] + 1) <= t]:
            open_.remove(k)
            money += items[k][3]
        if open_:
            continue
        for k, x in enumerate(items):
            if x[0] == t:
                if money < 100.0:
                    break
                money -= x[2]
                open_.append(k)
                want.append(k)
    assert taken == want


@given(st.lists(st.integers(-3, 9), max_size=40), st.integers(0, 45), st.integers(-4, 11))
def test_first_reach_is_the_first(values, start, price):
    import numpy as np

    want = next((i for i in range(start, len(values)) if values[i] >= price), -1)
    assert trades.first_reach(trades.block_maxima(np.array(values, float)), np.array([start]), np.array([price])).tolist() == [want]


@pytest.mark.parametrize("chunk, holds", [(50_000, [1, 4, 30]), (35, [1, 4, 30]), (50, [10_000])])
def test_touches_and_extremes_ahead(spark, chunk, holds):
    """Against loops over bars, for two series of different length cut into chunks."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = []
    for symbol, n in (("A", 130), ("B", 41)):
        close = np.round(100 + np.cumsum(rng.normal(size=n)), 2)
        rows += series(close.tolist(), (close + rng.random(n)).tolist(), (close - rng.random(n)).tolist(), rng.choice(n, n // 2, replace=False).tolist(), symbol)
    bars = spark.createDataFrame(rows, SCHEMA)
    levels, most = [0.0, 0.5, 1.0, 3.0], max(holds)
    by = {(r[0], r[1]): r for r in rows}
    got = {(r["symbol"], r["idx"]): r for r in trades.touches(bars, bars.where("signal"), levels, levels, holds, chunk).collect()}
    assert set(got) == {k for k, r in by.items() if r[9]}
    for (symbol, i), r in got.items():
        close, n = by[symbol, i][4], by[symbol, i][2]
        ahead = [by[symbol, j] for j in range(i + 1, min(i + most, n - 1) + 1)]
        for k, level in enumerate(levels):
            for side, hit in (("tp", lambda x: x[5] >= close * (1 + level / 100)), ("sl", lambda x: x[6] <= close * (1 - level / 100))):
                at = next((j for j, x in enumerate(ahead, 1) if level and hit(x)), None)
                assert (r[f"{side}_at"][k], r[f"{side}_ts"][k]) == (at, at and by[symbol, i + at][3])
                assert side == "sl" or r["tp_first"][k] is (at and by[symbol, i + at][7] <= by[symbol, i + at][8])
        for k, hold in enumerate(holds):
            end = min(i + hold, n - 1)
            assert (r["hold_at"][k], r["hold_ts"][k], r["hold_close"][k]) == (end - i, by[symbol, end][3], by[symbol, end][4])
    for r in trades.ahead_extremes(bars, most, chunk).collect():
        ahead = [by[r["symbol"], j] for j in range(r["idx"] + 1, min(r["idx"] + most, by[r["symbol"], 0][2] - 1) + 1)]
        assert (r["n_ahead"], r["top"], r["bottom"]) == (len(ahead), max((x[5] for x in ahead), default=None), min((x[6] for x in ahead), default=None))


@pytest.mark.parametrize("stretch", [65_536, 7])
def test_gate_equals_the_walk(spark, stretch):
    """Many combinations at once, some of which run out of cash, over one stretch of the line and over many."""
    import numpy as np

    from barloom.operators.portfolio import portfolio_trades

    rng = np.random.default_rng(stretch)
    at = lambda t: START + timedelta(hours=int(t))
    rows, want = [], {}
    for combo in range(30):
        density, cash_back = rng.uniform(0.02, 0.9), 60.0 if combo % 3 == 0 else 100.0
        items = [(t, k) for t in range(200) for k in range(3) if rng.random() < density]
        items = [(t, k, t + int(rng.choice([0, 1, 2, 5, 40], p=[0.1, 0.3, 0.3, 0.25, 0.05])), cash_back + float(rng.normal())) for t, k in items]
        rows += [(combo, f"S{k}", at(t), at(min(out, 199)), back / 0.5, 0.5, 0.1, 0.0, back - 100.1) for t, k, out, back in items]
        arrays = [np.array(x) for x in zip(*((t, min(out, 199), 100.1, back) for t, _, out, back in items))]
        taken, closes = walk(*arrays, 450.0, 100.0)
        want |= {(combo, f"S{items[i][1]}", items[i][0]): (close, seq, close <= 199) for seq, (i, close) in enumerate(zip(taken, closes))}
    frame = spark.createDataFrame(rows, "combo_id long, symbol string, buy_time timestamp_ntz, sell_time timestamp_ntz, sell_price double, qty double, commission_buy double, commission_sell double, profit double")
    line = spark.createDataFrame([(at(t), t) for t in range(200)], "ts timestamp_ntz, ord int")
    got = portfolio_trades(frame, line, 450.0, 100.0, stretch=stretch).collect()
    assert {(r["combo_id"], r["symbol"], r["buy_ord"]): (r["close_ord"], r["seq"], r["closed"]) for r in got} == want and len(got) == len(want)
    assert portfolio_trades(frame.where("false"), line, 450.0, 100.0, stretch=stretch).count() == 0


@pytest.mark.parametrize("piece", [65_536, 6])
def test_folded_pieces_equal_whole_curves(spark, piece):
    """Summaries of pieces against measures of every time; curves that begin at the first time, stay, fall to nothing and end early."""
    import numpy as np

    from barloom.operators import metrics
    from barloom.operators.portfolio import equity_curve

    rng = np.random.default_rng(8)
    rows = [(c, int(t), float(round(rng.uniform(50, 150), 2))) for c in range(12) for t in np.flatnonzero(rng.random(60) < (0.05, 0.5, 1)[c % 3])]
    rows += [(12, 0, 90.0), (13, 59, 120.0), (14, 5, 0.0), (14, 9, 0.0), (14, 20, 50.0), (15, 30, 0.0)]
    held = spark.createDataFrame(rows, "combo_id int, ord int, balance double")
    line = spark.createDataFrame([(START + timedelta(hours=t + (t > 30) * 5), t) for t in range(60)], "ts timestamp_ntz, ord int")
    combos = spark.range(17).select(F.col("id").cast("int").alias("combo_id"))
    curve = equity_curve(held, line, combos, 100.0)
    want = {r["combo_id"]: r for r in metrics.curve_metrics(curve).collect()}
    got = metrics.folded(metrics.curve_pieces(held, piece=piece), metrics.line_span(line), 100.0).collect()
    assert curve.count() == 17 * 60 and len(got) == len({r[0] for r in rows}) >= 13 and len(want) == 17
    for r in got:
        for c in ("final_balance", "max_dd", "sharpe"):
            of = want[r["combo_id"]][c]
            assert (r[c] is None) if of is None else r[c] == pytest.approx(of, rel=1e-9), (r, want[r["combo_id"]])


def test_running_numbers(spark):
    from barloom.operators.chunks import numbered

    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.col("id").alias("y"))
    got = numbered(df.repartition(5), ["x"], "k").collect()
    assert len(got) == 1000 and all(r["k"] == r["x"] and r["y"] * 7919 % 1000 == r["x"] for r in got)
    assert numbered(df.where("false"), ["x"], "k").count() == 0


def test_results_do_not_depend_on_partitions(spark):
    rows = series(SIMPLE, signals=[1, 4]) + series(SECOND, signals=[1, 5], symbol="SYM2")
    a = run(spark, rows, 3, 2, 2)[0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    b = run(spark, rows[::-1], 3, 2, 2)[0]
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert a == b
