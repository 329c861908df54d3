"""Registered queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import scalar
from barloom.operators import align, grid, indicators, metrics, paths, patterns, portfolio, report, signals, similarity, trades, universe, walkforward
from barloom.plans import fixture as fx
from barloom.plans.jobs import PARAMS, bootstrap_monte_carlo, grid_backtest, search_diffusion, walk_forward
from barloom.plans.oracle import CHAIN, entropy_sql, evaluation_sql, grid_sql
from barloom.sources import bars as src
from barloom.sources.scratch import scratch_path, written
from barloom.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, chain: bool = True):
    def register(f):
        QUERIES[name] = lambda spark, d: fx.rounded(f(spark, d))
        if sql:
            SQL[name] = (CHAIN + sql) if chain else sql
        return f

    return register


def r6(*names: str) -> str:
    """Columns as the queries round them."""
    return ", ".join(f'round({n.split("=")[-1]}, 6) AS {n.split("=")[0]}' for n in names)


# ---- sources and sinks


def raw_candles(spark: SparkSession, d: str) -> DataFrame:
    """Candle arrays as text, one in ten too short and one in ten with a start that isn't a number."""
    e = fx.events(spark, d)
    i, text = F.col("event_id"), lambda c: c.cast("string")
    ms = F.when(i % 10 == 1, "soon").otherwise(text(F.unix_millis(F.col("ts").cast("timestamp"))))
    quote = F.when(i % 7 == 0, "n/a").otherwise(text(i * 10))
    fields = F.array(ms, text(i), text(i + 2), text(i - 2), text(i + 1), F.lit("1"), quote)
    return e.select(F.col("event_type").alias("symbol"), i.alias("seq"), F.to_json(F.when(i % 10 == 0, F.slice(fields, 1, 5)).otherwise(fields)).alias("raw"))


_RAW = "SELECT event_type AS symbol, event_id AS seq, date_trunc('millisecond', ts) AS ts, {} FROM events WHERE event_id % 10 > 1"


@query("parse_candles", _RAW.format("event_id::VARCHAR AS open, (event_id + 2)::VARCHAR AS high, (event_id - 2)::VARCHAR AS low, (event_id + 1)::VARCHAR AS close, '1' AS volume_base, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE (event_id * 10)::VARCHAR END AS volume_quote"), chain=False)
def _(spark, d):
    return src.parse_candles(raw_candles(spark, d))


@query("coerce_values", _RAW.format("event_id::DOUBLE AS open, (event_id + 2)::DOUBLE AS high, (event_id - 2)::DOUBLE AS low, (event_id + 1)::DOUBLE AS close, 1.0::DOUBLE AS volume_base, CASE WHEN event_id % 7 <> 0 THEN (event_id * 10)::DOUBLE END AS volume_quote"), chain=False)
def _(spark, d):
    return src.coerce_values(src.parse_candles(raw_candles(spark, d)))


@query("first_of_each_ts", "SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, min(event_id) AS seq FROM events GROUP BY 1, 2", chain=False)
def _(spark, d):
    return src.first_of_each_ts(fx.events(spark, d).select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq")))


@query("history_starts", "SELECT event_type AS symbol, min(ts) AS first_ts, min(ts) > TIMESTAMP '2024-01-01 00:10:00' AS starts_late FROM events GROUP BY 1", chain=False)
def _(spark, d):
    return src.history_starts(fx.events(spark, d).withColumnRenamed("event_type", "symbol"), "2024-01-01 00:10:00")


@query("listed_symbols", "SELECT DISTINCT event_type AS symbol FROM events", chain=False)
def _(spark, d):
    e = fx.events(spark, d).select(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("contract"), F.col("event_type").alias("symbolName"))
    return src.listed_symbols(e, ["contract", "symbolName"])


@query("in_and_out_of_sample", "SELECT symbol, ts, " + r6("close") + ", CASE WHEN ts <= TIMESTAMP '2024-01-20' THEN 'IS' ELSE 'OOS' END AS split FROM b4 WHERE ts <= TIMESTAMP '2024-01-20' OR ts >= TIMESTAMP '2024-01-21'")
def _(spark, d):
    return src.in_and_out_of_sample(fx.bars(spark, d, 4), "2024-01-20", "2024-01-21").select("symbol", "ts", "close", "split")


@query("ticks_to_bars", "SELECT symbol, ts, " + r6("open", "high", "low", "close", "volume_base", "volume_quote") + " FROM b4")
def _(spark, d):
    return fx.bars(spark, d, 4).drop("timeframe")


@query("write_and_read_bars", "SELECT symbol, ts, " + r6("close") + " FROM b4")
def _(spark, d):
    path = scratch_path(spark, "bars")
    src.write_bars(fx.bars(spark, d, 4).unionByName(fx.bars(spark, d, 1)), path)
    return src.read_bars(spark, path, "4 hours").select("symbol", "ts", "close")


@query("read_bar_files", "SELECT symbol, '4H' AS timeframe, count(*) AS n FROM b4 GROUP BY 1")
def _(spark, d):
    folder = scratch_path(spark, "files")
    src.write_bar_files(fx.bars(spark, d, 4).drop("timeframe"), folder, "4H")
    return src.read_bar_files(spark, folder, "4H").groupBy("symbol", "timeframe").agg(F.count(F.lit(1)).alias("n"))


@query("save_and_load_symbols", "SELECT DISTINCT symbol FROM b4")
def _(spark, d):
    path = scratch_path(spark, "symbols")
    src.save_symbols(fx.bars(spark, d, 4).select("symbol").distinct(), path, "entropy", "4H")
    return src.load_symbols(spark, path, "entropy", "4H")


@query("save_results", 'SELECT combo_id, ' + r6('"Net_Gain"') + ", 'entropy' AS strategy, '4H' AS timeframe FROM res")
def _(spark, d):
    path = scratch_path(spark, "results")
    src.save_results(fx.backtest(spark, d).results, path, "entropy", "4H")
    return spark.read.parquet(path).select("combo_id", "Net_Gain", "strategy", "timeframe")


@query("save_summary", 'SELECT combo_id, ' + r6('"Net_Gain"', '"Sharpe"') + ", 'entropy' AS strategy, '4H' AS timeframe FROM res")
def _(spark, d):
    path = scratch_path(spark, "summary")
    src.save_summary(fx.backtest(spark, d).results.select("combo_id", "Net_Gain", "Sharpe"), path, "entropy", "4H")
    return spark.read.schema("combo_id long, Net_Gain double, Sharpe double, strategy string, timeframe string").option("header", True).csv(path)


# ---- universe

_WIDE = "wide AS (SELECT 'U' || (user_id % 50)::VARCHAR AS symbol, time_bucket(INTERVAL '4 hours', e.ts) AS ts, first(value ORDER BY e.ts, e.event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY e.ts, e.event_id) AS close, sum(value) AS volume_quote FROM events e GROUP BY 1, 2), cl AS (SELECT * FROM wide WHERE open <> 0 AND high <> 0 AND low <> 0 AND close <> 0 AND volume_quote <> 0)"
_JUDGE = _WIDE + """, rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM cl),
fa AS (SELECT symbol, count(*) AS n, max(close) FILTER (k = 1) AS last_close, avg(volume_quote) FILTER (k <= 50) AS mv FROM rk GROUP BY 1),
wa AS (SELECT 'U' || i::VARCHAR AS symbol FROM range(55) q(i)),
ju AS (SELECT wa.symbol, CASE WHEN wa.symbol NOT IN (SELECT symbol FROM wide) THEN 'File missing' WHEN n IS NULL THEN 'Contains zeros' WHEN last_close <= 2.0 THEN 'Last close too low' WHEN mv < 30 THEN 'Avg volume too low' WHEN n < 40 THEN 'Not enough bars' END AS reason FROM wa LEFT JOIN fa USING (symbol))"""


def wide_bars(spark: SparkSession, d: str) -> DataFrame:
    return src.ticks_to_bars(fx.events(spark, d), "4 hours", F.concat(F.lit("U"), (F.col("user_id") % 50).cast("string")))


def judged(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.range(55).select(F.concat(F.lit("U"), F.col("id").cast("string")).alias("symbol"))
    return universe.judge_symbols(wanted, wide_bars(spark, d), 2.0, 30.0, 40)


@query("clean_bars", f"WITH {_WIDE} SELECT symbol, ts, " + r6("close", "volume_quote") + " FROM cl", chain=False)
def _(spark, d):
    return universe.clean_bars(wide_bars(spark, d)).select("symbol", "ts", "close", "volume_quote")


@query("mean_of_last", f"WITH {_JUDGE} SELECT symbol, " + r6("mean_last=mv") + " FROM fa", chain=False)
def _(spark, d):
    return universe.mean_of_last(universe.clean_bars(wide_bars(spark, d)), "volume_quote", 50)


@query("universe_filter", f"WITH {_JUDGE} SELECT * FROM ju", chain=False)
def _(spark, d):
    return judged(spark, d)


@query("removal_counts", f"WITH {_JUDGE} SELECT coalesce(reason, 'Kept') AS reason, count(*) AS n FROM ju GROUP BY 1", chain=False)
def _(spark, d):
    return universe.removal_counts(judged(spark, d))


@query("keep_universe", f"WITH {_JUDGE} SELECT symbol, ts, " + r6("close") + " FROM cl WHERE symbol IN (SELECT symbol FROM ju WHERE reason IS NULL)", chain=False)
def _(spark, d):
    return universe.keep_universe(wide_bars(spark, d), judged(spark, d)).select("symbol", "ts", "close")


@query("live_universe", f"WITH {_JUDGE} SELECT DISTINCT symbol FROM wide WHERE symbol IN (SELECT symbol FROM ju WHERE reason IS NULL)", chain=False)
def _(spark, d):
    return universe.live_universe(wide_bars(spark, d), judged(spark, d).where("reason is null"))


def positions(spark: SparkSession, d: str) -> DataFrame:
    e = fx.events(spark, d)
    i = F.col("event_id")
    return e.select(
        F.when(i % 11 != 0, F.col("event_type")).alias("symbol"), F.when(i % 3 != 0, F.lit("long")).alias("holdSide"), F.when(i % 5 == 0, F.lit("bad")).otherwise((i % 4).cast("string")).alias("total"),
        (i % 100).cast("string").alias("averageOpenPrice"), F.when(i % 2 == 0, (i % 90).cast("string")).alias("marketPrice"), F.lit("1.5").alias("unrealizedPL"), F.lit("10").alias("leverage"), F.lit(None).cast("string").alias("liquidationPrice"), "event_id",
        F.when(i % 13 == 0, F.lit("?")).otherwise((F.floor(F.col("value")) - 35).cast("string")).alias("netProfit"),
    )


@query("open_positions", "SELECT event_id FROM events WHERE event_id % 5 <> 0 AND event_id % 4 > 0", chain=False)
def _(spark, d):
    return universe.open_positions(positions(spark, d)).select("event_id")


@query("position_summary", """SELECT symbol, side, total, "averageOpenPrice", "marketPrice", "unrealizedPL", leverage, "liquidationPrice", count(*) AS n FROM (SELECT CASE WHEN event_id % 11 <> 0 THEN event_type ELSE '?' END AS symbol, CASE WHEN event_id % 3 <> 0 THEN 'LONG' ELSE '?' END AS side,
 CASE WHEN event_id % 5 = 0 THEN 0.0::DOUBLE ELSE (event_id % 4)::DOUBLE END AS total, (event_id % 100)::DOUBLE AS "averageOpenPrice", CASE WHEN event_id % 2 = 0 THEN (event_id % 90)::DOUBLE ELSE 0.0::DOUBLE END AS "marketPrice", 1.5::DOUBLE AS "unrealizedPL", 10.0::DOUBLE AS leverage, 0.0::DOUBLE AS "liquidationPrice" FROM events) GROUP BY ALL""", chain=False)
def _(spark, d):
    s = universe.position_summary(positions(spark, d))
    return s.groupBy(*s.columns).agg(F.count(F.lit(1)).alias("n"))


# ---- joins in time


@query("time_of_extremes", "SELECT symbol, ts, high_time, low_time FROM ann")
def _(spark, d):
    return fx.annotated(spark, d).select("symbol", "ts", "high_time", "low_time")


@query("extreme_coverage", "SELECT symbol, round(avg((high_time IS NOT NULL AND low_time IS NOT NULL)::INT::DOUBLE) * 100, 6) AS pct_times, round(avg((high_time IS NOT NULL AND low_time IS NOT NULL AND close IS NOT NULL)::INT::DOUBLE) * 100, 6) AS pct_whole FROM ann GROUP BY 1")
def _(spark, d):
    return align.extreme_coverage(fx.annotated(spark, d))


@query("timeframe_pair", "SELECT symbol, CASE WHEN bool_or(t = '15m') THEN '15m' ELSE '1H' END AS fine, CASE WHEN bool_or(t = '1D') THEN '1D' WHEN bool_or(t = '4h') THEN '4h' ELSE '1H' END AS coarse FROM (SELECT DISTINCT 'U' || (user_id % 50)::VARCHAR AS symbol, CASE event_id % 5 WHEN 0 THEN '15m' WHEN 1 THEN '1H' WHEN 2 THEN '4h' WHEN 3 THEN '1D' ELSE '2x' END AS t FROM events) WHERE t <> '2x' GROUP BY 1 HAVING count(*) >= 2", chain=False)
def _(spark, d):
    e = fx.events(spark, d).select(F.concat(F.lit("U"), (F.col("user_id") % 50).cast("string")).alias("symbol"), F.element_at(F.array(*map(F.lit, ["15m", "1H", "4h", "1D", "2x"])), (F.col("event_id") % 5 + 1).cast("int")).alias("timeframe"))
    return align.timeframe_pair(e, ["15m", "1H", "4h", "1D"])


def probes(spark: SparkSession, d: str) -> DataFrame:
    return fx.events(spark, d).select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_id")


_PROBE = "SELECT e.event_id, e.event_type AS symbol, date_trunc('hour', e.ts) AS ts, round(b.close, 6) AS price FROM events e ASOF LEFT JOIN b4 b ON b.symbol = e.event_type AND {} b.ts"


@query("asof_price", _PROBE.format("date_trunc('hour', e.ts) >="))
def _(spark, d):
    return align.asof_price(probes(spark, d), fx.bars(spark, d, 4))


@query("asof_price_strict", _PROBE.format("date_trunc('hour', e.ts) >"))
def _(spark, d):
    return align.asof_price(probes(spark, d), fx.bars(spark, d, 4), strict=True)


@query("parameter_grid", "SELECT symbol, g.* FROM (SELECT DISTINCT symbol FROM r), g")
def _(spark, d):
    """The grid of every symbol."""
    return fx.rows(spark, d).select("symbol").distinct().crossJoin(F.broadcast(grid.parameter_grid(spark, {p: fx.LISTS[p] for p in PARAMS})))


@query("signals_of_combos", "SELECT combo_id, symbol, idx FROM s")
def _(spark, d):
    found = signals.signal_candidates(fx.features_of(spark, d), fx.LISTS["accel_span"])
    return grid.signals_of_combos(found, grid.parameter_grid(spark, {p: fx.LISTS[p] for p in PARAMS})).select("combo_id", "symbol", "idx")


@query("bounded_range_join", "SELECT a.symbol, a.idx, count(b.idx) AS n_ahead, round(max(b.high), 6) AS top FROM r a LEFT JOIN r b ON b.symbol = a.symbol AND b.idx > a.idx AND b.idx <= a.idx + 12 GROUP BY 1, 2")
def _(spark, d):
    return trades.ahead_extremes(fx.rows(spark, d), 12).drop("bottom")


@query("closes_on_timeline", "SELECT symbol, ord, round(price, 6) AS price FROM px")
def _(spark, d):
    rows = fx.rows(spark, d)
    return align.closes_on_timeline(rows, align.timeline(rows)).select("symbol", F.col("ord").cast("long").alias("ord"), "price")


@query("benchmark_change", "SELECT ts, round((close / first(close) OVER (ORDER BY ts) - 1) * 100, 6) AS benchmark_pct FROM b4 WHERE symbol = 'view'")
def _(spark, d):
    return align.benchmark_change(fx.bars(spark, d, 4), "view")


# ---- indicators


def bar_query(name: str, sql: str, make: Callable[[DataFrame], DataFrame]) -> None:
    query(name, sql)(lambda spark, d: make(fx.rows(spark, d)))


bar_query("delta", "SELECT symbol, idx, round(delta, 6) AS delta FROM d", lambda b: b.select("symbol", "idx", indicators.delta().alias("delta")))
bar_query("second_difference", "SELECT symbol, idx, round(accel, 6) AS accel FROM d", lambda b: b.select("symbol", "idx", indicators.second_difference().alias("accel")))
bar_query("ema", "SELECT a.symbol, a.idx, round(a.y, 6) AS ema_5, round(b.y, 6) AS ema_21 FROM ec a JOIN ec b ON a.symbol = b.symbol AND a.idx = b.idx AND a.span = 5 AND b.span = 21", lambda b: indicators.ema(b, "close", {"ema_5": 5, "ema_21": 21}).select("symbol", "idx", "ema_5", "ema_21"))
bar_query("rsi", "SELECT symbol, idx, round(rsi, 6) AS rsi FROM rsi", lambda b: indicators.rsi(b).select("symbol", "idx", "rsi"))
bar_query("atr", "SELECT symbol, idx, round(atr, 6) AS atr FROM atr", lambda b: indicators.atr(b).select("symbol", "idx", "atr"))
bar_query("rolling_entropy", "SELECT symbol, idx, round(entropy, 6) AS entropy FROM en", lambda b: indicators.rolling_entropy(b.withColumn("delta", indicators.delta()), "delta").select("symbol", "idx", "entropy"))
bar_query("rolling_entropy_closed", "SELECT symbol, idx, round(entropy2, 6) AS entropy FROM en", lambda b: indicators.rolling_entropy(b.withColumn("delta", indicators.delta()), "delta", closed=True).select("symbol", "idx", "entropy"))
bar_query("candle_shape", "SELECT symbol, idx, round(body, 6) AS body, round(uw, 6) AS upper_wick, round(lw, 6) AS lower_wick FROM pn", lambda b: b.select("symbol", "idx", *(v.alias(k) for k, v in patterns.shape().items())))
for _names in (patterns.PATTERNS[:3], patterns.PATTERNS[3:5], patterns.PATTERNS[5:]):
    bar_query("patterns_" + _names[0], f"SELECT symbol, idx, {', '.join(_names)} FROM pn", lambda b, names=_names: b.select("symbol", "idx", *(patterns.patterns()[k].alias(k) for k in names)))
bar_query("shifted_signal", "SELECT symbol, idx, coalesce(lag(doji) OVER (PARTITION BY symbol ORDER BY idx), false) AS signal FROM pn", lambda b: b.withColumn("doji", patterns.patterns()["doji"]).select("symbol", "idx", signals.shifted(F.col("doji")).alias("signal")))
bar_query("bootstrap_features", "SELECT symbol, idx, round(pct_ol, 6) AS pct_ol, round(pct_oh, 6) AS pct_oh, round(pct_oc, 6) AS pct_oc, time_variation, low_offset, high_offset FROM ft", lambda b: indicators.bootstrap_features(b).drop("ts", "open", "close"))
bar_query("return_moments", "SELECT hr.symbol, round(avg(hr.r), 6) AS mu, round(greatest(stddev_pop(hr.r) * 0.8, 1e-8), 6) AS sigma, round(any_value(l.c), 6) AS last_close FROM hr JOIN (SELECT symbol, last(close ORDER BY idx) AS c FROM r GROUP BY 1) l ON l.symbol = hr.symbol GROUP BY 1", lambda b: indicators.return_moments(b, 0.8))

# ---- signals


@query("entropy_signal", "SELECT en.symbol, en.idx, coalesce(lag(entropy < 2.0 AND y > 0) OVER (PARTITION BY en.symbol ORDER BY en.idx), false) AS signal FROM en JOIN ea ON ea.symbol = en.symbol AND ea.idx = en.idx AND span = 5")
def _(spark, d):
    return signals.entropy_signal(fx.features_of(spark, d), 5, 2.0).select("symbol", "idx", "signal")


@query("trend_signal", "SELECT a.symbol, a.idx, coalesce(lag(a.y > b.y AND r.close > a.y AND rsi > 50) OVER (PARTITION BY a.symbol ORDER BY a.idx), false) AS signal FROM ec a JOIN ec b ON a.symbol = b.symbol AND a.idx = b.idx AND a.span = 10 AND b.span = 21 JOIN rsi i ON i.symbol = a.symbol AND i.idx = a.idx JOIN r ON r.symbol = a.symbol AND r.idx = a.idx")
def _(spark, d):
    return signals.trend_signal(fx.rows(spark, d), 10, 21).select("symbol", "idx", "signal")


_PATTERN_NOW = "(doji OR hammer OR bullish_engulfing) AND entropy < 2.1"


@query("pattern_signal", f"SELECT pn.symbol, pn.idx, coalesce(lag({_PATTERN_NOW}) OVER (PARTITION BY pn.symbol ORDER BY pn.idx), false) AS signal FROM pn JOIN en ON en.symbol = pn.symbol AND en.idx = pn.idx")
def _(spark, d):
    return signals.pattern_signal(fx.rows(spark, d), ["doji", "hammer", "bullish_engulfing"], 2.1).select("symbol", "idx", "signal")


@query("latest_signals", "SELECT en.symbol, en.ts, round(en.close, 6) AS close FROM en JOIN ea ON ea.symbol = en.symbol AND ea.idx = en.idx AND span = 5 WHERE en.idx = en.n - 1 AND entropy < 2.5 AND y > 0")
def _(spark, d):
    return signals.latest_signals(signals.entropy_signal(fx.features_of(spark, d), 5, 2.5, live=True))


# ---- trades and portfolio


def bt_query(name: str, sql: str | None, make: Callable) -> None:
    query(name, sql)(lambda spark, d: make(fx.backtest(spark, d)))


_KEY = "combo_id, symbol, idx"
bt_query("entry_eligibility", f"SELECT {_KEY}, buy_time, round(buy_price, 6) AS buy_price, round(qty, 6) AS qty FROM cand", lambda b: b.candidates.select("combo_id", "symbol", "idx", "buy_time", "buy_price", "qty"))
bt_query("exit_resolution", f"SELECT {_KEY}, sell_time, round(sell_price, 6) AS sell_price, exit_reason FROM cand", lambda b: b.candidates.select("combo_id", "symbol", "idx", "sell_time", "sell_price", "exit_reason"))
bt_query("trade_profit", f"SELECT {_KEY}, {r6('commission_buy', 'commission_sell', 'profit')} FROM cand", lambda b: b.candidates.select("combo_id", "symbol", "idx", "commission_buy", "commission_sell", "profit"))
bt_query("portfolio_trades", f"SELECT {_KEY}, buy_ord, close_ord, seq, closed FROM tk", lambda b: b.trades.select("combo_id", "symbol", "idx", *(F.col(c).cast("long").alias(c) for c in ("buy_ord", "close_ord", "seq")), "closed"))
bt_query("equity_curve", "SELECT combo_id, ts, round(balance, 6) AS balance FROM eq", lambda b: b.equity.select("combo_id", "ts", "balance"))
_LOG = ["symbol", "buy_time", "buy_price", "sell_time", "sell_price", "qty", "profit", "exit_reason", "commission_buy", "commission_sell"]
bt_query("trade_log", f"SELECT combo_id, symbol, buy_time, sell_time, exit_reason, {r6('buy_price', 'sell_price', 'qty', 'profit', 'commission_buy', 'commission_sell')} FROM tk WHERE closed", lambda b: b.trades.where("closed").orderBy("combo_id", "close_ord", "seq").select("combo_id", *_LOG))


@query("first_touch", "SELECT a.symbol, a.idx, min(CASE WHEN b.high >= a.close * 1.4 THEN b.idx - a.idx END) AS tp_at, min(CASE WHEN b.low <= a.close * 0.7 THEN b.idx - a.idx END) AS sl_at FROM r a LEFT JOIN r b ON b.symbol = a.symbol AND b.idx > a.idx AND b.idx <= a.idx + 12 GROUP BY 1, 2")
def _(spark, d):
    rows = fx.rows(spark, d)
    return trades.touches(rows, rows, [40.0], [30.0], [12]).select("symbol", "idx", F.col("tp_at")[0].alias("tp_at"), F.col("sl_at")[0].alias("sl_at"))


@query("expired_price", "SELECT e.event_id, e.event_type AS symbol, round(coalesce(b.close, l.close), 6) AS sell_price, CASE WHEN b.close IS NULL THEN 'FORCED_LAST' ELSE 'SELL_AFTER' END AS exit_reason FROM events e ASOF LEFT JOIN b4 b ON b.symbol = e.event_type AND date_trunc('hour', e.ts) - INTERVAL '1 day' >= b.ts JOIN (SELECT symbol, last(close ORDER BY ts) AS close FROM b4 GROUP BY 1) l ON l.symbol = e.event_type")
def _(spark, d):
    early = probes(spark, d).withColumn("ts", F.expr("ts - interval 1 day"))
    return trades.expired_price(early, fx.bars(spark, d, 4)).select("event_id", "symbol", "sell_price", "exit_reason")


# ---- metrics and reports

bt_query("curve_metrics", "SELECT combo_id, round(final_balance, 6) AS final_balance, round(max_dd, 6) AS max_dd, round(sharpe, 6) AS sharpe FROM em", lambda b: metrics.curve_metrics(b.equity))
bt_query("win_ratio", "SELECT combo_id, round(wr, 6) AS win_ratio FROM ts1", lambda b: b.trades.where("closed").groupBy("combo_id").agg(F.avg((F.col("profit") > 0).cast("double")).alias("win_ratio")))
_RES = ["Net_Gain", "Net_Gain_pct", "Final_Balance", "Win_Ratio", "Avg_Trade", "Median_Trade", "DD_pct", "Sharpe"]
bt_query("grid_backtest", "SELECT combo_id, sell_after, entropy_max, accel_span, tp, sl, symbol, \"Num_Signals\", \"Num_Trades\", " + r6(*(f'"{c}"' for c in _RES)) + " FROM res", lambda b: b.results)
bt_query("symbol_equity", "SELECT u.combo_id, u.symbol, tl.ts, round(10000.0 + sum(coalesce(q.p, 0)) OVER (PARTITION BY u.combo_id, u.symbol ORDER BY tl.ts), 6) AS balance FROM (SELECT DISTINCT combo_id, symbol FROM tk) u CROSS JOIN tl LEFT JOIN (SELECT combo_id, symbol, close_ord, sum(profit) AS p FROM tk WHERE closed GROUP BY ALL) q ON q.combo_id = u.combo_id AND q.symbol = u.symbol AND q.close_ord = tl.ord", lambda b: metrics.symbol_equity(b.trades, b.line, 10000.0).drop("ord"))
bt_query("sequence_metrics", "SELECT combo_id, count(*) AS n, round(CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252.0) END, 6) AS sharpe_seq, round(max(dd), 6) AS max_dd_abs FROM (SELECT combo_id, coalesce(b / lag(b) OVER w - 1, 0) AS ret, max(b) OVER w - b AS dd FROM (SELECT combo_id, close_ord, seq, 10000.0 + sum(profit) OVER (PARTITION BY combo_id ORDER BY close_ord, seq) AS b FROM tk WHERE closed) WINDOW w AS (PARTITION BY combo_id ORDER BY close_ord, seq)) GROUP BY 1", lambda b: metrics.sequence_metrics(b.trades, 10000.0))
bt_query("gain_per_signal", 'SELECT combo_id, round(CASE WHEN "Num_Signals" > 0 THEN "Net_Gain" / "Num_Signals" END, 6) AS "Gain_signal" FROM res', lambda b: report.with_gain_per_signal(b.results).select("combo_id", "Gain_signal"))
bt_query("best_combos", " UNION ALL ".join(f"""(SELECT '{m}' AS metric, combo_id, sell_after, entropy_max, accel_span, tp, sl, round("{m}", 6) AS value FROM res WHERE "{m}" IS NOT NULL ORDER BY "{m}" {o}, combo_id LIMIT 1)""" for m, o in (("Net_Gain_pct", "DESC"), ("Sharpe", "DESC"), ("DD_pct", "ASC"))), lambda b: report.best_combos(b.results, PARAMS))
_UNP = " UNION ALL ".join(f"""SELECT '{p}' AS param, {p}::DOUBLE AS value, combo_id, "Net_Gain", "Net_Gain_pct", "Win_Ratio" FROM res""" for p in PARAMS)
bt_query("parameter_profile", f'SELECT param, value, round(sum("Net_Gain_pct"), 6) AS sum_gain_pct, round(avg("Win_Ratio") * 100, 6) AS win_pct FROM ({_UNP}) GROUP BY 1, 2', lambda b: report.parameter_profile(b.results, PARAMS))
bt_query("parameter_correlation", f'SELECT param, round(CASE WHEN count(DISTINCT value) > 1 AND count(DISTINCT "Net_Gain") > 1 AND count(*) >= 5 THEN corr(value, "Net_Gain") END, 6) AS correlation FROM ({_UNP}) GROUP BY 1', lambda b: report.parameter_correlation(b.results, PARAMS))
bt_query("parameter_information", f'SELECT param, round(sum(nxy / n * ln(nxy * n / (nx * ny))), 6) AS information FROM (SELECT param, nxy, sum(nxy) OVER (PARTITION BY param, value) AS nx, sum(nxy) OVER (PARTITION BY param, bin) AS ny, sum(nxy) OVER (PARTITION BY param) AS n FROM (SELECT param, value, bin, count(*)::DOUBLE AS nxy FROM ({_UNP}) JOIN (SELECT combo_id, ntile(10) OVER (ORDER BY "Net_Gain", combo_id) AS bin FROM res) USING (combo_id) GROUP BY ALL)) GROUP BY 1', lambda b: report.parameter_information(b.results, PARAMS))
_PSI = lambda n: f"coalesce(list_sum(list_transform(range(1, {n}), lambda i: 1.0 / i)), 0.0)"  # noqa: E731  but for a constant, which cancels out
bt_query("nearest_information", f"""SELECT param, round(greatest(0.0, {_PSI('count(*)')} + avg({_PSI('k')}) - avg({_PSI('c')}) - avg({_PSI('m')})), 6) AS information FROM (SELECT d.*, (SELECT count(*) FROM nq b WHERE b.param = d.param AND (abs(b.y - d.y) < d.d OR (d.d = 0 AND b.y = d.y))) AS m FROM
(SELECT a.param, a.combo_id, any_value(a.y) AS y, any_value(a.c) AS c, least(3, any_value(a.c) - 1) AS k, list_sort(list(abs(a.y - b.y)))[least(3, any_value(a.c) - 1)] AS d FROM nq a JOIN nq b ON a.param = b.param AND a.value = b.value AND a.combo_id <> b.combo_id GROUP BY 1, 2) d) GROUP BY 1""".replace("nq", f"""(SELECT *, round("Net_Gain", 6) AS y, count(*) OVER (PARTITION BY param, value) AS c FROM ({_UNP}) QUALIFY c > 1)"""), lambda b: report.nearest_information(fx.rounded(b.results), PARAMS))
bt_query("result_histogram", 'SELECT least(floor(("Net_Gain_pct" - lo) / (hi - lo) * k), k - 1)::INT AS bin, count(*) AS n FROM res, (SELECT min("Net_Gain_pct") AS lo, max("Net_Gain_pct") AS hi, greatest(10, least(50, count(*))) AS k FROM res) GROUP BY 1', lambda b: report.histogram(b.results, "Net_Gain_pct"))


@query("strategy_curve", "SELECT e.combo_id, e.ts, round((balance / 10000.0 - 1) * 100, 6) AS gain_pct, round((balance / max(balance) OVER (PARTITION BY combo_id ORDER BY e.ts) - 1) * 100, 6) AS dd_pct, round(b.pct, 6) AS benchmark_pct FROM eq e LEFT JOIN (SELECT ts, (close / first(close) OVER (ORDER BY ts) - 1) * 100 AS pct FROM b4 WHERE symbol = 'view') b ON b.ts = e.ts")
def _(spark, d):
    return report.strategy_curve(fx.backtest(spark, d).equity, align.benchmark_change(fx.bars(spark, d, 4), "view"), 10000.0)


@query("closed_position_rates", "SELECT symbol, count(*) AS n, count(*) FILTER (p > 0) AS wins, round(avg((p > 0)::INT::DOUBLE) * 100, 6) AS win_pct, round(sum(p), 6) AS net FROM (SELECT CASE WHEN event_id % 11 <> 0 THEN event_type ELSE 'UNKNOWN' END AS symbol, CASE WHEN event_id % 13 = 0 THEN 0.0::DOUBLE ELSE (floor(value) - 35)::DOUBLE END AS p FROM events) GROUP BY ROLLUP (symbol)", chain=False)
def _(spark, d):
    return report.closed_position_rates(positions(spark, d))


bt_query("profitability_pct", 'SELECT combo_id, round(("Final_Balance" / 10000.0 - 1) * 100, 6) AS pct FROM res', lambda b: b.results.select("combo_id", report.profitability_pct(F.col("Final_Balance"), F.lit(10000.0)).alias("pct")))

# ---- other strategies, and metrics by symbol

TREND = {"sell_after": [6, 12], "ema_fast": [2, 5], "ema_slow": [20, 30], "rsi_period": [5, 14], "atr_period": [14], "tp": [0.0, 40.0], "sl": [0.0, 30.0]}
PATTERN = {"sell_after": [6, 12], "entropy_max": [1.5, 2.1], **{p: [True, False] if p in ("doji", "hammer") else [p not in ("piercing_line",)] for p in patterns.PATTERNS}, "tp": [0.0, 40.0], "sl": [0.0]}
_RESULTS = ', symbol, "Num_Signals", "Num_Trades", ' + r6(*(f'"{c}"' for c in _RES))
_SERIES = "SELECT 0 AS k, symbol, idx, n, ts, open, close, high, low, high_time, low_time, delta FROM d"


def _trend_sql(lists: dict[str, list]) -> str:
    spans = sorted({*lists["ema_fast"], *lists["ema_slow"]})
    rsi = " UNION ALL ".join(f"""SELECT d.symbol, d.idx, {n} AS period, coalesce(100 - 100 / (1 + g / (l + 1e-8)), 50.0) AS rsi FROM d LEFT JOIN (WITH RECURSIVE q(symbol, idx, g, l) AS (SELECT symbol, {n}::BIGINT, sum(greatest(delta, 0)) / {n}, sum(greatest(-delta, 0)) / {n} FROM d WHERE idx BETWEEN 1 AND {n} GROUP BY symbol HAVING count(*) = {n}
  UNION ALL SELECT d.symbol, d.idx, (q.g * {n - 1} + greatest(d.delta, 0)) / {n}, (q.l * {n - 1} + greatest(-d.delta, 0)) / {n} FROM q JOIN d ON d.symbol = q.symbol AND d.idx = q.idx + 1) SELECT * FROM q) q USING (symbol, idx)""" for n in lists["rsi_period"])
    return f"""te(symbol, idx, span, y) AS (SELECT symbol, idx, span, close FROM d, (VALUES {', '.join(f'({x})' for x in spans)}) s(span) WHERE idx = 0
  UNION ALL SELECT d.symbol, d.idx, e.span, 2.0 / (e.span + 1) * d.close + (1 - 2.0 / (e.span + 1)) * e.y FROM te e JOIN d ON d.symbol = e.symbol AND d.idx = e.idx + 1),
tr_i AS ({rsi}),
v_s AS (SELECT g.*, 0 AS k, d.symbol, d.idx + 1 AS idx FROM d JOIN te a ON a.symbol = d.symbol AND a.idx = d.idx JOIN te b ON b.symbol = d.symbol AND b.idx = d.idx JOIN tr_i i ON i.symbol = d.symbol AND i.idx = d.idx
  JOIN v_g g ON g.ema_fast = a.span AND g.ema_slow = b.span AND g.rsi_period = i.period WHERE a.y > b.y AND d.close > a.y AND rsi > 50 AND d.idx + 1 < d.n),
"""


def grid_results_sql(lists: dict[str, list], found: str) -> str:
    return f", v_r AS ({_SERIES}), v_g AS ({grid_sql(lists)}), {found}{evaluation_sql('v', list(lists))} SELECT combo_id, {', '.join(lists)}{_RESULTS} FROM v_res"


def grid_query(name: str, lists: dict[str, list], take: signals.GridSignals, found: str) -> None:
    query(name, grid_results_sql(lists, found))(lambda spark, d: grid_backtest(fx.annotated(spark, d), lists, fx.SETTINGS, take).results)


grid_query("grid_trend", TREND, signals.trend_grid, _trend_sql(TREND))
grid_query("grid_patterns", PATTERN, signals.pattern_grid, "v_s AS (SELECT g.*, 0 AS k, pn.symbol, pn.idx + 1 AS idx FROM pn JOIN en ON en.symbol = pn.symbol AND en.idx = pn.idx JOIN v_g g ON entropy < g.entropy_max AND (" + " OR ".join(f"(pn.{p} AND g.{p})" for p in patterns.PATTERNS) + ") WHERE pn.idx + 1 < en.n),\n")

# Grids of full size. Their SQL takes minutes on whole tables, so tests hold a slice of each against it.
FULL_TREND = {"sell_after": [10, 15, 20, 25, 30], "ema_fast": [2, 5, 10, 15], "ema_slow": [20, 30, 40], "rsi_period": [2, 5, 10, 15], "atr_period": [2, 5, 10, 15], "tp": [0.0, 20.0, 40.0], "sl": [0.0, 15.0, 30.0]}
query("grid_4320_combos")(lambda spark, d: grid_backtest(fx.annotated(spark, d), fx.FULL, fx.SETTINGS).results)
query("grid_8640_combos")(lambda spark, d: grid_backtest(fx.annotated(spark, d), FULL_TREND, fx.SETTINGS, signals.trend_grid).results)

MOMENTUM = {"sell_after": [6, 12], "back": [3, 8], "tp": [0.0, 40.0], "sl": [0.0]}


def momentum_grid(bars: DataFrame, combos: DataFrame, lists: dict[str, list]) -> DataFrame:
    """A signal that isn't the library's own: the close before is over that of ``back`` bars earlier."""
    order = indicators.by_bar()
    rises = lambda n: F.struct(F.lit(n).alias("back"), F.coalesce(F.lag("close", 1).over(order) > F.lag("close", n + 1).over(order), F.lit(False)).alias("up"))
    found = bars.select("symbol", "idx", F.array(*map(rises, lists["back"])).alias("x")).select("symbol", "idx", F.explode("x").alias("x")).where("x.up")
    return found.select("symbol", "idx", "x.back").join(F.broadcast(combos), "back")


grid_query("grid_custom_signal", MOMENTUM, momentum_grid, "v_s AS (SELECT g.*, 0 AS k, d.symbol, d.idx FROM d JOIN v_g g ON true JOIN d a ON a.symbol = d.symbol AND a.idx = d.idx - 1 JOIN d b ON b.symbol = d.symbol AND b.idx = d.idx - 1 - g.back WHERE a.close > b.close),\n")

bt_query("symbol_metrics", """, us AS (SELECT u.combo_id, u.symbol, tl.ord, tl.ts, 10000.0 + sum(coalesce(q.p, 0)) OVER (PARTITION BY u.combo_id, u.symbol ORDER BY tl.ts) AS b FROM (SELECT DISTINCT combo_id, symbol FROM tk) u CROSS JOIN tl LEFT JOIN (SELECT combo_id, symbol, close_ord, sum(profit) AS p FROM tk WHERE closed GROUP BY ALL) q ON q.combo_id = u.combo_id AND q.symbol = u.symbol AND q.close_ord = tl.ord),
uc AS (SELECT *, (max(b) OVER w - b) / max(b) OVER w AS dd, b / lag(b) OVER w - 1 AS ret, epoch(ts) - epoch(lag(ts) OVER w) AS dt FROM us WINDOW w AS (PARTITION BY combo_id, symbol ORDER BY ord)),
um AS (SELECT combo_id, symbol, last(b ORDER BY ord) AS f, max(dd) AS dd, CASE WHEN stddev_pop(ret) > 1e-12 THEN avg(ret) * (31536000.0 / median(dt)) / (stddev_pop(ret) * sqrt(31536000.0 / median(dt))) END AS sharpe FROM uc GROUP BY 1, 2)
SELECT combo_id, symbol, round(f, 6) AS "Final_Balance", (SELECT count(*) FROM tk t WHERE t.combo_id = um.combo_id AND t.symbol = um.symbol) AS "Num_Signals", (SELECT round(avg((profit > 0)::INT::DOUBLE), 6) FROM tk t WHERE t.combo_id = um.combo_id AND t.symbol = um.symbol AND closed) AS "Win_Ratio",
  round(dd * 100, 6) AS "DD_pct", round(sharpe, 6) AS "Sharpe" FROM um""", lambda b: metrics.symbol_metrics(b.trades, b.line, 10000.0))

# ---- walk-forward


def unequal(bars: DataFrame) -> DataFrame:
    """Bar counts by symbol, with series of different lengths."""
    n = F.count(F.lit(1))
    return bars.groupBy("symbol").agg((n - F.length("symbol") * F.floor(n / 12)).alias("n"))


def _windows_sql(train: int, test: int, rolling: bool, counts: str) -> str:
    longest = f"(SELECT max(n) FROM ({counts}))"
    if rolling:
        starts = f"SELECT w AS window_id, w * {train + test} AS t0, w * {train + test} + {train} AS e, {longest} - w * {train + test} < {train + test} AS rest FROM range(0, CAST(ceil({longest} / {train + test}::DOUBLE) AS BIGINT)) q(w)"
    else:
        starts = f"SELECT w AS window_id, 0 AS t0, {train} + w * {test} AS e, {longest} < {train + test} AS rest FROM range(0, CASE WHEN {longest} < {train + test} THEN 1 ELSE CAST(ceil(({longest} - {train}) / {test}::DOUBLE) AS BIGINT) END) q(w)"
    t1 = "CASE WHEN rest THEN t0 + CAST(floor((n - t0) * 0.8::DOUBLE) AS BIGINT) ELSE least(e, n) END"
    return f"wt AS (SELECT window_id::INT AS window_id, symbol, t0, t1, t1 AS test0, CASE WHEN rest THEN n ELSE least(t1 + {test}, n) END AS test1 FROM (SELECT *, {t1} AS t1 FROM ({counts}) c, ({starts}) s WHERE n > t0 AND (NOT rest OR floor((n - t0) * 0.8::DOUBLE) >= 0.8 * {train})) WHERE t1 > t0 AND CASE WHEN rest THEN n ELSE least(t1 + {test}, n) END > t1)"


_UNEQUAL = "SELECT symbol, count(*) - length(symbol) * (count(*) // 12) AS n FROM r GROUP BY 1"


@query("window_table_anchored", ", " + _windows_sql(80, 20, False, _UNEQUAL) + " SELECT * FROM wt")
def _(spark, d):
    return walkforward.window_table(unequal(fx.rows(spark, d)), 80, 0.8, True)


@query("window_table_rolling", ", " + _windows_sql(40, 10, True, _UNEQUAL) + " SELECT * FROM wt")
def _(spark, d):
    return walkforward.window_table(unequal(fx.rows(spark, d)), 40, 0.8, False)


SMALL = {"sell_after": [6], "entropy_max": [1.5, 2.0], "accel_span": [5, 15], "tp": [0.0, 40.0], "sl": [0.0]}


def walked(spark: SparkSession, d: str, part: str = "train") -> DataFrame:
    return walk_forward(fx.annotated(spark, d), SMALL, 80, 0.8, part=part)


def _walked_sql(part: str = "train") -> str:
    a, b = ("t0", "t1") if part == "train" else ("test0", "test1")
    bars = f"SELECT window_id AS k, r.symbol, r.idx - {a} AS idx, {b} - {a} AS n, ts, close, high, low, high_time, low_time FROM r JOIN wt ON wt.symbol = r.symbol AND r.idx >= {a} AND r.idx < {b}"
    return f", {_windows_sql(80, 20, False, 'SELECT symbol, count(*) AS n FROM r GROUP BY 1')}, v_r AS ({bars}), v_g AS ({grid_sql(SMALL)}), {entropy_sql('v', SMALL['accel_span'])}{evaluation_sql('v', PARAMS)}"


_WALKED = f" SELECT k AS window_id, combo_id, {', '.join(PARAMS)}{_RESULTS} FROM v_res"
_BEST = f""", be AS (SELECT k AS window_id, combo_id, {', '.join(PARAMS)}, "Sharpe" FROM v_res WHERE "Sharpe" IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY round("Sharpe", 9) DESC, combo_id) = 1)"""
_AGREED = _BEST + ", co AS (SELECT param, CASE WHEN param LIKE '%_max' THEN value ELSE round(value) END AS value FROM (SELECT param, value, count(*) AS c, min(window_id) AS f FROM (" + " UNION ALL ".join(f"SELECT window_id, '{p}' AS param, {p}::DOUBLE AS value FROM be" for p in PARAMS) + ") GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY param ORDER BY c DESC, f) = 1)"
_FINAL = _AGREED + f", f_r AS (SELECT 0 AS k, symbol, idx, n, ts, close, high, low, high_time, low_time FROM r), f_g AS (SELECT 0 AS combo_id, {', '.join(f'(SELECT value{"::INT" if p in ("sell_after", "accel_span") else ""} FROM co WHERE param = {chr(39)}{p}{chr(39)}) AS {p}' for p in PARAMS)}), {entropy_sql('f', SMALL['accel_span'])}{evaluation_sql('f', PARAMS)}"


@query("walk_forward_grid", _walked_sql() + _WALKED)
def _(spark, d):
    return walked(spark, d)


@query("walk_forward_best", _walked_sql() + _BEST + f" SELECT window_id, combo_id, {', '.join(PARAMS)}, {r6(chr(34) + 'Sharpe' + chr(34))} FROM be")
def _(spark, d):
    return walkforward.best_by_window(walked(spark, d), PARAMS)


@query("walk_forward_consensus", _walked_sql() + _AGREED + " SELECT param, round(value, 6) AS value FROM co")
def _(spark, d):
    return walkforward.consensus(walkforward.best_by_window(walked(spark, d), PARAMS), PARAMS)


@query("walk_forward_final", _walked_sql() + _FINAL + f" SELECT combo_id, {', '.join(PARAMS)}{_RESULTS} FROM f_res")
def _(spark, d):
    # the consensus is one value for each parameter
    best = walkforward.consensus(walkforward.best_by_window(walked(spark, d), PARAMS), PARAMS).collect()
    chosen = {r["param"]: [int(r["value"]) if r["param"] in ("sell_after", "accel_span") else float(r["value"])] for r in best}
    return grid_backtest(fx.annotated(spark, d), {p: chosen.get(p, SMALL[p][:1]) for p in PARAMS}).results


@query("walk_forward_test", _walked_sql("test") + _WALKED)
def _(spark, d):
    return walked(spark, d, "test")


# ---- Monte Carlo


def made_paths(spark: SparkSession, d: str) -> DataFrame:
    f = indicators.bootstrap_features(fx.rows(spark, d))
    return paths.bootstrap_paths(f, paths.bootstrap_draws(f, 4, 60))


@query("bootstrap_draws", "SELECT symbol, path_index, step, row FROM dw")
def _(spark, d):
    return paths.bootstrap_draws(indicators.bootstrap_features(fx.rows(spark, d)), 4, 60).select("symbol", *(F.col(c).cast("long").alias(c) for c in ("path_index", "step", "row")))


@query("bootstrap_paths", "SELECT symbol, path_index, step, ts, " + ", ".join(f"round(ln({c}), 6) AS log_{c}" for c in ("open", "high", "low", "close")) + ", low_time, high_time FROM pb")
def _(spark, d):
    m = made_paths(spark, d)
    # prices of long paths have many digits; their logarithms are compared
    return m.select("symbol", *(F.col(c).cast("long").alias(c) for c in ("path_index", "step")), "ts", *(scalar.natural_log(F.col(c)).alias(f"log_{c}") for c in ("open", "high", "low", "close")), "low_time", "high_time")


@query("bootstrap_extra_columns", "SELECT dw.symbol, path_index, step, round(ft.close, 6) AS drawn_close FROM dw JOIN ft ON ft.symbol = dw.symbol AND ft.idx = dw.row")
def _(spark, d):
    f = indicators.bootstrap_features(fx.rows(spark, d)).withColumn("drawn_close", F.col("close"))
    return paths.bootstrap_paths(f, paths.bootstrap_draws(f, 4, 60), ("drawn_close",)).select("symbol", F.col("path_index").cast("long").alias("path_index"), F.col("step").cast("long").alias("step"), "drawn_close")


@query("path_bars", "SELECT symbol, path_index, step AS idx, 60 AS n, make_timestamp(step) AS ts, round(ln(close), 6) AS log_close FROM pb")
def _(spark, d):
    b = paths.path_bars(made_paths(spark, d), ordinal_time=True)
    return b.select("symbol", F.col("path_index").cast("long").alias("path_index"), "idx", F.col("n").cast("int").alias("n"), "ts", scalar.natural_log(F.col("close")).alias("log_close"))


def monte_carlo(spark: SparkSession, d: str) -> DataFrame:
    return bootstrap_monte_carlo(indicators.bootstrap_features(fx.rows(spark, d)), 4, 60, SMALL)


def short(df: DataFrame) -> DataFrame:
    """Values of simulated prices have many digits: doubles as precise as floats."""
    return df.select(*(F.col(f.name).cast("float").cast("double").alias(f.name) if f.dataType.simpleString() == "double" and f.name not in PARAMS else F.col(f.name) for f in df.schema))


def rf(*names: str) -> str:
    return ", ".join(f'round({n.split("=")[-1]}::FLOAT::DOUBLE, 6) AS {n.split("=")[0]}' for n in names)


_PATHS = f", v_r AS (SELECT path_index AS k, symbol, step AS idx, 60 AS n, make_timestamp(step) AS ts, close, high, low, high_time, low_time FROM pb), v_g AS ({grid_sql(SMALL)}), {entropy_sql('v', SMALL['accel_span'])}{evaluation_sql('v', PARAMS)}"
_PATH_MEANS = ', me AS (SELECT k AS path_index, avg("Final_Balance") AS balance, avg("DD_pct") AS dd, (avg("Final_Balance") / 10000.0 - 1) * 100 AS gain_pct FROM v_res GROUP BY 1)'
_MEANS = ["Net_Gain", "Net_Gain_pct", "Win_Ratio", "DD_pct", "Sharpe"]


@query("bootstrap_monte_carlo", _PATHS + f""" SELECT k::INT AS path_index, combo_id, {', '.join(PARAMS)}, symbol, "Num_Signals", "Num_Trades", {rf(*(f'"{c}"' for c in _RES))} FROM v_res""")
def _(spark, d):
    return short(monte_carlo(spark, d))


@query("path_summary", _PATHS + f""" SELECT {', '.join(PARAMS)}, {rf(*(f'"mean_{c}"=avg("{c}")' for c in _MEANS))}, count(DISTINCT k) AS paths, count(*) AS rows FROM v_res GROUP BY ALL""")
def _(spark, d):
    return short(report.path_summary(monte_carlo(spark, d), PARAMS))


@query("path_best", _PATHS + ", sm AS (SELECT combo_id, " + ", ".join(PARAMS) + ", " + ", ".join(f'avg("{c}") AS "mean_{c}"' for c in _MEANS) + " FROM v_res GROUP BY ALL) " + " UNION ALL ".join(f"""(SELECT '{m}' AS metric, combo_id, {', '.join(PARAMS)}, {rf(f'value="{m}"')} FROM sm WHERE "{m}" IS NOT NULL ORDER BY round("{m}", 9) {o}, combo_id LIMIT 1)""" for m, o in (("mean_Net_Gain_pct", "DESC"), ("mean_Sharpe", "DESC"), ("mean_DD_pct", "ASC"))))
def _(spark, d):
    means = report.path_summary(monte_carlo(spark, d), ["combo_id", *PARAMS])
    return short(report.best_combos(means, PARAMS, ("mean_DD_pct",), ("mean_Net_Gain_pct", "mean_Sharpe"), digits=9))


@query("path_means", _PATHS + _PATH_MEANS + f" SELECT path_index::INT AS path_index, {rf('balance', 'dd', 'gain_pct')} FROM me")
def _(spark, d):
    return short(report.path_means(monte_carlo(spark, d), 10000.0))


@query("path_quantiles", _PATHS + _PATH_MEANS + f" SELECT {rf('p50=median(gain_pct)', 'std=stddev_samp(gain_pct)', 'pct_negative=avg((gain_pct < 0)::INT::DOUBLE) * 100')} FROM me")
def _(spark, d):
    return short(report.path_quantiles(report.path_means(monte_carlo(spark, d), 10000.0)))


@query("jump_diffusion")
def _(spark, d):
    return paths.jump_diffusion(indicators.return_moments(fx.rows(spark, d)), 5, 50)


@query("symbol_seed", "SELECT symbol, path, 42 + ('0x' || substr(md5(symbol), 1, 8))::BIGINT % 100000 + path AS seed FROM (SELECT DISTINCT event_type AS symbol FROM events), range(3) q(path)", chain=False)
def _(spark, d):
    return fx.events(spark, d).select(F.col("event_type").alias("symbol")).distinct().crossJoin(spark.range(3).withColumnRenamed("id", "path")).withColumn("seed", scalar.symbol_seed(F.col("symbol"), 42, F.col("path")))


def history(spark: SparkSession, d: str) -> DataFrame:
    return similarity.log_returns(fx.rows(spark, d), ["symbol"], "idx")


def path_returns(spark: SparkSession, d: str) -> DataFrame:
    return similarity.log_returns(made_paths(spark, d), ["symbol", "path_index"], "step")


@query("return_shape", "SELECT symbol, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, round(skewness(r), 6) AS skew, round(kurtosis(r), 6) AS kurt FROM hr GROUP BY 1")
def _(spark, d):
    return similarity.moments(history(spark, d), ["symbol"])


@query("autocorrelation", "SELECT c.symbol, k AS lag, round(sum(c.x * e.x) / any_value(v.s), 6) AS acf FROM (SELECT symbol, nth, abs(r) - avg(abs(r)) OVER (PARTITION BY symbol) AS x FROM hr) c, range(0, 11) q(k), (SELECT symbol, nth, abs(r) - avg(abs(r)) OVER (PARTITION BY symbol) AS x FROM hr) e, (SELECT symbol, sum(x * x) AS s FROM (SELECT symbol, abs(r) - avg(abs(r)) OVER (PARTITION BY symbol) AS x FROM hr) GROUP BY 1) v WHERE e.symbol = c.symbol AND v.symbol = c.symbol AND e.nth = c.nth + k GROUP BY 1, 2")
def _(spark, d):
    return similarity.autocorrelation(history(spark, d), ["symbol"], 10).withColumn("lag", F.col("lag").cast("long"))


_CDF = """, hp AS (SELECT symbol, path_index, hr.r FROM hr JOIN (SELECT DISTINCT symbol, path_index FROM pr) USING (symbol)),
vv AS (SELECT symbol, path_index, r, sum(a) AS a, sum(b) AS b FROM (SELECT symbol, path_index, r, 1 AS a, 0 AS b FROM hp UNION ALL SELECT symbol, path_index, r, 0, 1 FROM pr) GROUP BY 1, 2, 3),
cc AS (SELECT symbol, path_index, abs(sum(a) OVER w / sum(a) OVER z - sum(b) OVER w / sum(b) OVER z) AS gap, lead(r) OVER w - r AS width FROM vv WINDOW w AS (PARTITION BY symbol, path_index ORDER BY r), z AS (PARTITION BY symbol, path_index))
"""


@query("distribution_distance", _CDF + "SELECT symbol, path_index, round(max(gap), 6) AS ks, round(sum(gap * width), 6) AS wasserstein FROM cc GROUP BY 1, 2")
def _(spark, d):
    p = path_returns(spark, d)
    h = p.select("symbol", "path_index").distinct().join(history(spark, d).select("symbol", "r"), "symbol")
    return similarity.distribution_distance(h, p, ["symbol", "path_index"]).withColumn("path_index", F.col("path_index").cast("long"))


_SCORE = """, q_hn AS (SELECT symbol, count(*) AS c FROM hr GROUP BY 1),
q_nn AS (SELECT symbol, least(min(p.c), any_value(hn.c)) AS n FROM (SELECT symbol, path_index, count(*) AS c FROM pr GROUP BY 1, 2) p JOIN q_hn hn USING (symbol) GROUP BY 1),
q_h AS (SELECT symbol, n, r, row_number() OVER (PARTITION BY symbol ORDER BY nth) - 1 AS nth FROM (SELECT symbol, n, nth, r FROM hr JOIN q_nn nn USING (symbol) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY nth DESC) <= n)),
q_s AS (SELECT symbol, path_index, n, r, row_number() OVER (PARTITION BY symbol, path_index ORDER BY nth) - 1 AS nth FROM (SELECT symbol, path_index, n, nth, r FROM pr JOIN q_nn nn USING (symbol) QUALIFY row_number() OVER (PARTITION BY symbol, path_index ORDER BY nth DESC) <= n)),
q_hm AS (SELECT symbol, avg(r) AS m, stddev_samp(r) AS d, skewness(r) AS w, kurtosis(r) AS u FROM q_h h GROUP BY 1),
q_sm AS (SELECT symbol, avg(m) AS m, avg(d) AS d, avg(w) AS w, avg(u) AS u FROM (SELECT symbol, path_index, avg(r) AS m, stddev_samp(r) AS d, skewness(r) AS w, kurtosis(r) AS u FROM q_s s GROUP BY 1, 2) GROUP BY 1),
q_al AS (SELECT symbol, -1 AS path_index, nth, abs(r) - avg(abs(r)) OVER (PARTITION BY symbol) AS x FROM q_h h UNION ALL SELECT symbol, path_index, nth, abs(r) - avg(abs(r)) OVER (PARTITION BY symbol, path_index) FROM q_s s),
q_ac AS (SELECT a.symbol, a.path_index, lag_k, coalesce(sum(a.x * b.x), 0.0) / any_value(v.q) AS acf FROM q_al a CROSS JOIN range(0, 51) z(lag_k) JOIN (SELECT symbol, path_index, sum(x * x) AS q FROM q_al al GROUP BY 1, 2) v ON v.symbol = a.symbol AND v.path_index = a.path_index LEFT JOIN q_al b ON b.symbol = a.symbol AND b.path_index = a.path_index AND b.nth = a.nth + lag_k GROUP BY 1, 2, 3),
q_aa AS (SELECT symbol, greatest(0.0, 100 * (1 - sqrt(sum((h - p) ** 2)) / (sqrt(sum(h ** 2)) + 1e-12))) AS acf FROM (SELECT symbol, lag_k, avg(acf) FILTER (path_index >= 0) AS p, max(acf) FILTER (path_index = -1) AS h FROM q_ac ac GROUP BY 1, 2) GROUP BY 1),
q_vv AS (SELECT s.symbol, s.path_index, h.r, 1 AS a, 0 AS b FROM (SELECT DISTINCT symbol, path_index FROM q_s s) s JOIN q_h h ON h.symbol = s.symbol UNION ALL SELECT symbol, path_index, r, 0, 1 FROM q_s s),
q_cc AS (SELECT symbol, path_index, abs(sum(a) OVER w / sum(a) OVER z - sum(b) OVER w / sum(b) OVER z) AS gap, lead(r) OVER w - r AS width FROM (SELECT symbol, path_index, r, sum(a) AS a, sum(b) AS b FROM q_vv vv GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY symbol, path_index ORDER BY r), z AS (PARTITION BY symbol, path_index)),
q_dd AS (SELECT symbol, path_index, max(gap) AS ks, sum(gap * width) AS wa FROM q_cc cc GROUP BY 1, 2),
q_di AS (SELECT symbol, 100 * (1 - avg(ks)) AS ks, avg(100 * (1 - CASE WHEN p95 > 0 THEN least(wa / p95, 1.0) ELSE 0.0 END)) AS wasserstein FROM q_dd dd JOIN (SELECT symbol, quantile_cont(wa, 0.95) AS p95 FROM q_dd dd GROUP BY 1) USING (symbol) GROUP BY 1),
q_sc AS (SELECT symbol, 100 * greatest(0.0, 1 - abs(hm.m - sm.m) / (abs(hm.d) + 1e-12)) AS mean, 100 / (1 + abs(hm.d - sm.d) / (abs(hm.d) + 1e-8)) AS std, 100 / (1 + abs(hm.w - sm.w) / (abs(hm.w) + 1e-8)) AS skew, 100 / (1 + abs(hm.u - sm.u) / (abs(hm.u) + 1e-8)) AS kurt, acf, ks, wasserstein FROM q_hm hm JOIN q_sm sm USING (symbol) JOIN q_aa aa USING (symbol) JOIN q_di di USING (symbol))
"""


@query("similarity_score", _SCORE + "SELECT symbol, " + r6("mean", "std", "skew", "kurt", "acf", "ks", "wasserstein", "total=0.2 * mean + 0.2 * std + 0.1 * skew + 0.1 * kurt + 0.1 * acf + 0.1 * ks + 0.2 * wasserstein") + " FROM q_sc")
def _(spark, d):
    return similarity.similarity(written(history(spark, d), "returns"), written(path_returns(spark, d), "returns"), ["symbol"])


@query("search_diffusion")
def _(spark, d):
    return search_diffusion(fx.annotated(spark, d), 6, 4, 60)


# ---- streams


@query("live_bars", "SELECT symbol, ts, " + r6("open", "close") + " FROM b4 WHERE ts + INTERVAL '4 hours' <= (SELECT max(ts) - INTERVAL '1 hour' FROM events)")
def _(spark, d):
    return streamed(spark, d, live.live_bars).select("symbol", "ts", "open", "close")


def streamed(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over the events table has given out once it has read all of it."""
    table = f"{d}/events.parquet"
    schema = spark.read.parquet(table).schema
    folder = table if spark._jvm.org.apache.hadoop.fs.Path(table).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(table)).isDirectory() else d
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if folder == table else "events.parquet").parquet(folder)
    return run_stream(make(stream), scratch_path(spark, "stream"))


def run_stream(df: DataFrame, out: str) -> DataFrame:
    """What a stream gives out until it has read everything there is; run again with the same folder it goes on."""
    df.writeStream.format("parquet").option("checkpointLocation", f"{out}/state").option("path", f"{out}/rows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.parquet(f"{out}/rows")


def batch_bars(spark: SparkSession, d: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A stream over bars that were written as files."""
    out = scratch_path(spark, "livebars")
    fx.bars(spark, d, 4).drop("timeframe").orderBy("ts").write.parquet(f"{out}/bars")
    stream = spark.readStream.schema(spark.read.parquet(f"{out}/bars").schema).parquet(f"{out}/bars")
    return run_stream(make(stream), out)


def dealt_stream(rows: DataFrame, out: str, parts: int = 2) -> DataFrame:
    """``rows`` (symbol, ts, ...) as a stream of a file a batch: parts of time one after another, in which the symbols of one time are in two files."""
    rows = written(rows, "dealt")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    begin, last = rows.agg(F.min(micros), F.max(micros)).first()
    share = (micros - (begin or 0)) * parts / ((last or 0) - (begin or 0) + 1)
    for i in range(parts):
        half = rows.where(F.floor(share) == i).withColumn("_half", F.length("symbol") % 3 > 0)
        for side in (True, False):
            half.where(F.col("_half") == side).drop("_half").coalesce(1).write.mode("append").parquet(f"{out}/in")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")


def live_signal_rows(spark: SparkSession, d: str) -> DataFrame:
    out = scratch_path(spark, "livesignals")
    return run_stream(live.live_signals(dealt_stream(fx.bars(spark, d, 4).drop("timeframe"), out), lateness="10 days"), out)


_LIVE = """, l1 AS (SELECT symbol, ts, close, list(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS c FROM b4),
l2 AS (SELECT *, list_transform(c, lambda x, i: CASE WHEN i = 1 THEN 0.0 ELSE x - c[i - 1] END) AS ch, list_transform(c, lambda x, i: CASE WHEN i <= 2 THEN 0.0 ELSE x - 2 * c[i - 1] + c[i - 2] END) AS se FROM l1),
l3 AS (SELECT *, list_transform(ch[greatest(1, len(ch) - 4):], lambda x: least(CAST(trunc((x - list_min(ch)) / (list_max(ch) - list_min(ch) + 1e-9) * 10) AS INT), 9)) AS b FROM l2),
lv AS (SELECT symbol, ts, close, log2(len(b)::DOUBLE) - list_sum(list_transform(b, lambda x: log2(len(list_filter(b, lambda y: y = x))::DOUBLE))) / len(b) < 2.0
  AND list_sum(list_transform(se, lambda x, i: CASE WHEN i = 1 THEN 1.0 ELSE 2.0 / 11 END * pow(1 - 2.0 / 11, len(se) - i) * x)) > 0 AS signal FROM l3),
lc AS (SELECT * FROM lv WHERE ts <= (SELECT max(ts) - INTERVAL '10 days' FROM lv)), lp AS (SELECT * FROM lc WHERE ts <= (SELECT max(ts) - INTERVAL '10 days' FROM lc))"""


@query("live_signals", _LIVE + " SELECT symbol, ts, round(close, 6) AS close, signal FROM lc")
def _(spark, d):
    return live_signal_rows(spark, d)


@query("paper_positions", _LIVE + """, bk AS (SELECT book, ts, any_signal, row_number() OVER (PARTITION BY book ORDER BY ts) - 1 AS ord FROM (SELECT (length(symbol) % 2)::VARCHAR AS book, ts, bool_or(signal) AS any_signal FROM lp GROUP BY 1, 2)),
ps(book, ord) AS (SELECT book, min(ord) FROM bk WHERE any_signal GROUP BY 1 UNION ALL SELECT ps.book, (SELECT min(b.ord) FROM bk b WHERE b.book = ps.book AND b.any_signal AND b.ord > ps.ord + 6) FROM ps WHERE ps.ord IS NOT NULL),
op AS (SELECT bk.book, bk.ts, bk.ord, lv.symbol, lv.close FROM ps JOIN bk ON bk.book = ps.book AND bk.ord = ps.ord JOIN lp lv ON lv.ts = bk.ts AND (length(lv.symbol) % 2)::VARCHAR = bk.book AND lv.signal)
SELECT book, ts, symbol, 'open' AS action, round(close, 6) AS price FROM op UNION ALL SELECT op.book, bk.ts, op.symbol, 'close', round(lv.close, 6) FROM op JOIN bk ON bk.book = op.book AND bk.ord = op.ord + 6 LEFT JOIN lp lv ON lv.symbol = op.symbol AND lv.ts = bk.ts""")
def _(spark, d):
    out = scratch_path(spark, "paper")
    stream = dealt_stream(live_signal_rows(spark, d), out)
    return run_stream(live.paper_positions(stream, 6, F.length("symbol") % 2, lateness="10 days"), out)


@query("stream_without_repeats", "SELECT symbol, ts FROM b4")
def _(spark, d):
    return batch_bars(spark, d, lambda s: live.without_repeats(s.select("symbol", "ts").union(s.select("symbol", "ts"))))


@query("timeframe_minutes", "SELECT t AS timeframe, m AS minutes, count(*) AS n FROM (SELECT CASE event_id % 5 WHEN 0 THEN '15m' WHEN 1 THEN '1H' WHEN 2 THEN '4h' WHEN 3 THEN '1M' ELSE '2x' END AS t, CASE event_id % 5 WHEN 0 THEN 15 WHEN 1 THEN 60 WHEN 2 THEN 240 WHEN 3 THEN 43200 END::BIGINT AS m FROM events) GROUP BY 1, 2", chain=False)
def _(spark, d):
    t = F.element_at(F.array(*map(F.lit, ["15m", "1H", "4h", "1M", "2x"])), (F.col("event_id") % 5 + 1).cast("int"))
    return fx.events(spark, d).select(t.alias("timeframe")).groupBy("timeframe", scalar.timeframe_minutes(F.col("timeframe")).alias("minutes")).agg(F.count(F.lit(1)).alias("n"))


@query("safe_name", "SELECT event_id, trim(regexp_replace('a/b:' || event_type || ' x? ', '[^\\w\\-. ]', '_', 'g')) AS name FROM events", chain=False)
def _(spark, d):
    return fx.events(spark, d).select("event_id", scalar.safe_name(F.concat(F.lit("a/b:"), "event_type", F.lit(" x? "))).alias("name"))
