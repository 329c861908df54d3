"""Measures of equity curves and trades. What isn't defined is null, never NaN, so that no maximum picks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .portfolio import equity_curve

YEAR = 365.0 * 24 * 3600


def curve_metrics(equity: DataFrame, keys: tuple[str, ...] = ("combo_id",)) -> DataFrame:
    """Final balance, largest drawdown (share) and annualised Sharpe ratio of each curve (keys, ts, balance)."""
    order = Window.partitionBy(*keys).orderBy("ts")
    peak = F.max("balance").over(order.rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag("balance").over(order)
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = equity.select(
        *keys, "ts", "balance",
        ((peak - F.col("balance")) / F.when(peak == 0, 1.0).otherwise(peak)).alias("dd"),
        F.when(before != 0, F.col("balance") / F.when(before != 0, before) - 1).alias("r"),
        (seconds - F.lag(seconds).over(order)).alias("dt"),
    )
    found = rows.groupBy(*keys).agg(
        F.max_by("balance", "ts").alias("final_balance"), F.max("dd").alias("max_dd"), F.avg("r").alias("_m"), F.stddev_pop("r").alias("_s"),
        F.coalesce(F.percentile(F.when(F.col("dt") > 0, F.col("dt")), F.lit(0.5)), F.lit(86400.0)).alias("_dt"),
    )
    per_year = F.lit(YEAR) / F.col("_dt")
    sharpe = F.when(F.col("_s") > 0, F.col("_m") * per_year / (F.col("_s") * F.sqrt(per_year)))
    return found.select(*keys, "final_balance", "max_dd", sharpe.alias("sharpe"))


def line_span(times: DataFrame, on: tuple[str, ...] = ()) -> DataFrame:
    """For each line (``on``; a single one without) of times (ord, ts) its number of times ``n``, its ``first_ord``, and ``dt``, the median distance of neighbours in seconds (a day, if there are none)."""
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = times.select(*on, "ord", seconds.alias("s"))
    if on:
        rows = rows.withColumn("dt", F.col("s") - F.lag("s").over(Window.partitionBy(*on).orderBy("ord")))
    else:  # a whole line's numbers have no gaps
        rows = rows.join(rows.select((F.col("ord") + 1).alias("ord"), F.col("s").alias("_b")), "ord", "left").withColumn("dt", F.col("s") - F.col("_b"))
    dt = F.coalesce(F.percentile(F.when(F.col("dt") > 0, F.col("dt")), F.lit(0.5)), F.lit(86400.0))
    return rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first_ord"), dt.alias("dt"))


def curve_pieces(held: DataFrame, keys: tuple[str, ...] = ("combo_id",), piece: int = 65_536) -> DataFrame:
    """Summaries (keys, piece, first_at, last_at, first, last, peak, trough, fall, zeros, s, ss) of rows (keys, ord, balance) by pieces of the line: the first and last row's time and
    balance, greatest and least balance, deepest fall from a peak before (share), and sum and sum of squares of the returns from row to row within the piece. ``zeros``
    counts the times from which no return can be taken, as the balance is 0. ``folded`` merges them in order."""
    rows = held.withColumn("piece", F.floor(F.col("ord") / piece).cast("int"))
    order = Window.partitionBy(*keys, "piece").orderBy("ord")
    peak, before = F.max("balance").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lag("balance").over(order)
    fall = (peak - F.col("balance")) / F.when(peak == 0, 1.0).otherwise(peak)
    r = F.when(before != 0, F.col("balance") / F.when(before != 0, before) - 1)
    zeros = F.when(F.col("balance") == 0, F.lead("ord").over(order) - F.col("ord"))
    rows = rows.select(*keys, "piece", "ord", "balance", fall.alias("fall"), r.alias("r"), zeros.alias("z"))
    return rows.groupBy(*keys, "piece").agg(
        F.min("ord").alias("first_at"), F.max("ord").alias("last_at"), F.min_by("balance", "ord").alias("first"), F.max_by("balance", "ord").alias("last"), F.max("balance").alias("peak"), F.min("balance").alias("trough"), F.max("fall").alias("fall"),
        F.coalesce(F.sum("z"), F.lit(0)).alias("zeros"), F.coalesce(F.sum("r"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("r") * F.col("r")), F.lit(0.0)).alias("ss"),
    )


def folded(pieces: DataFrame, spans: DataFrame, initial: float, keys: tuple[str, ...] = ("combo_id",), on: tuple[str, ...] = ()) -> DataFrame:
    """(keys, final_balance, max_dd, sharpe) of whole curves: pieces of ``curve_pieces`` in order, where the balance stays between rows and begins as ``initial``. ``spans``: the line's numbers, by ``on``
    if there are several lines."""
    spanned = pieces.join(F.broadcast(spans), [*on]) if on else pieces.crossJoin(F.broadcast(spans))
    past = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # a line whose first time has a row begins with that
    begins = F.when((F.col("_last").isNull()) & (F.col("first_at") > F.col("first_ord")), F.lit(float(initial)))
    rows = spanned.withColumns({"_last": F.last("last").over(past), "_peak": F.max("peak").over(past), "_early": F.first("first_at").over(past), "_next": F.lead("first_at").over(Window.partitionBy(*keys).orderBy("piece"))})
    starts = F.when(F.coalesce("_early", "first_at") > F.col("first_ord"), F.lit(float(initial)))
    top, before = F.greatest("_peak", starts), F.coalesce("_last", begins)
    across = (top - F.col("trough")) / F.when(top == 0, 1.0).otherwise(top)
    joint = F.when(before != 0, F.col("first") / F.when(before != 0, before) - 1)
    stays = F.when(F.col("last") == 0, F.coalesce("_next", F.col("first_ord") + F.col("n") - 1) - F.col("last_at")).otherwise(0)
    rows = rows.withColumns({"_across": across, "_joint": F.coalesce(joint, F.lit(0.0)), "zeros": F.col("zeros") + stays})
    found = rows.groupBy(*keys).agg(
        F.max_by("last", "piece").alias("final_balance"), F.max(F.greatest("fall", "_across", F.lit(0.0))).alias("max_dd"), F.first("dt").alias("_dt"), (F.first("n") - 1 - F.sum("zeros")).alias("_n"),
        F.sum(F.col("s") + F.col("_joint")).alias("_s"), F.sum(F.col("ss") + F.col("_joint") * F.col("_joint")).alias("_ss"),
    )
    # returns between rows are 0; what is left of rounding counts as no spread
    spread = F.when(F.col("_n") > 0, (F.col("_ss") - F.col("_s") * F.col("_s") / F.col("_n")) / F.col("_n"))
    deviation = F.sqrt(F.when(spread > 1e-13 * F.col("_ss"), spread))
    per_year = F.lit(YEAR) / F.col("_dt")
    return found.select(*keys, "final_balance", "max_dd", (F.col("_s") / F.col("_n") * per_year / (deviation * F.sqrt(per_year))).alias("sharpe"))


def grid_results(combos: DataFrame, trades: DataFrame, curves: DataFrame, initial: float, keys: tuple[str, ...] = ("combo_id",)) -> DataFrame:
    """One record for each row of ``combos``, with nulls and zeros where nothing was traded. ``curves``: (keys, final_balance, max_dd, sharpe) of those that traded."""
    done = trades.groupBy(*keys).agg(
        F.sum(F.when(F.col("closed"), F.col("profit"))).alias("gain"), F.count(F.lit(1)).alias("Num_Signals"), F.count_if("closed").alias("Num_Trades"),
        F.avg(F.when(F.col("closed"), (F.col("profit") > 0).cast("double"))).alias("Win_Ratio"),
        F.avg(F.when(F.col("closed"), F.col("profit"))).alias("Avg_Trade"), F.percentile(F.when(F.col("closed"), F.col("profit")), F.lit(0.5)).alias("Median_Trade"),
    )
    rows = combos.join(done, [*keys], "left").join(curves.select(*keys, "final_balance", "max_dd", "sharpe"), [*keys], "left")
    gain, zero = F.coalesce("gain", F.lit(0.0)), F.lit(0).cast("long")
    return rows.select(
        *combos.columns, F.lit("__PORTFOLIO__").alias("symbol"), gain.alias("Net_Gain"), (gain / initial * 100).alias("Net_Gain_pct"), F.coalesce("final_balance", F.lit(float(initial))).alias("Final_Balance"),
        F.coalesce("Num_Signals", zero).alias("Num_Signals"), F.coalesce("Num_Trades", zero).alias("Num_Trades"), "Win_Ratio", "Avg_Trade", "Median_Trade", (F.coalesce("max_dd", F.lit(0.0)) * 100).alias("DD_pct"), F.col("sharpe").alias("Sharpe"),
    )


def realised(trades: DataFrame, initial: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, ord, balance) after the closes of each time that has any."""
    run = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    done = trades.where("closed").groupBy(*keys, F.col("close_ord").alias("ord")).agg(F.sum("profit").alias("profit"))
    return done.select(*keys, "ord", (F.lit(float(initial)) + F.sum("profit").over(run)).alias("balance"))


def symbol_equity(trades: DataFrame, line: DataFrame, initial: float) -> DataFrame:
    """Realised equity of each (combo, symbol) at every time of the line."""
    own = ("combo_id", "symbol")
    return equity_curve(realised(trades, initial, own), line, trades.select(*own).distinct(), initial, own)


def symbol_metrics(trades: DataFrame, line: DataFrame, initial: float, keys: tuple[str, ...] = ("combo_id",)) -> DataFrame:
    """A record for each (keys, symbol) that trades: final balance, entries, share of winners among closed trades, largest drawdown (share) and annualised Sharpe ratio of
    its realised equity on the line. Equity moves at closes only, so these are the only rows."""
    own = (*keys, "symbol")
    curves = folded(curve_pieces(realised(trades, initial, own), own), line_span(line), initial, own)
    entries = trades.groupBy(*own).agg(F.count(F.lit(1)).alias("Num_Signals"), F.avg(F.when(F.col("closed"), (F.col("profit") > 0).cast("double"))).alias("Win_Ratio"))
    found = entries.join(curves, [*own], "left")
    return found.select(*own, F.coalesce("final_balance", F.lit(float(initial))).alias("Final_Balance"), "Num_Signals", "Win_Ratio", (F.coalesce("max_dd", F.lit(0.0)) * 100).alias("DD_pct"), F.col("sharpe").alias("Sharpe"))


def sequence_metrics(trades: DataFrame, initial: float, keys: tuple[str, ...] = ("combo_id",)) -> DataFrame:
    """From the sequence of closed trades alone: Sharpe ratio of balance changes (by the sample deviation, 252 periods) and drawdown in money."""
    order = Window.partitionBy(*keys).orderBy("close_ord", "seq")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.where("closed").withColumn("b", F.lit(initial) + F.sum("profit").over(run))
    rows = rows.withColumns({"r": F.coalesce(F.col("b") / F.lag("b").over(order) - 1, F.lit(0.0)), "dd": F.max("b").over(run) - F.col("b")})
    found = rows.groupBy(*keys).agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"), F.max("dd").alias("max_dd_abs"), F.count(F.lit(1)).alias("n"))
    return found.select(*keys, "n", F.when(F.col("s") > 0, F.col("m") / F.col("s") * F.sqrt(F.lit(252.0))).alias("sharpe_seq"), "max_dd_abs")
