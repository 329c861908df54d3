"""Which candidate trades a portfolio takes, and its equity.

Positions are opened only while none is open: all eligible signals of one time in order of symbols, as long as cash covers an order. The next entries come at
the first signal time that isn't before the last exit. Where cash always covers the orders, the entered times are a chain that ``gate`` follows over stretches of the line; only
combinations that may run out of cash go through one linear pass of their candidates each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.scratch import written

from .align import closes_where, line_end
from .chunks import spread
from .gate import entered_times


def walk(buy: np.ndarray, out: np.ndarray, cost: np.ndarray, back: np.ndarray, cash: float, order: float) -> tuple[list[int], list[int]]:
    """Rows that are taken and the times at which they close. Rows stand in order of (buy time, symbol); ``out`` is the exit time, ``cost`` what a position takes
    from cash, ``back`` what its close returns. A position whose exit is its entry closes at the next time."""
    taken, closes, i, n = [], [], 0, len(buy)
    while i < n:
        now, j = buy[i], int(np.searchsorted(buy, buy[i], "right"))
        last, returned = -1, 0.0
        for k in range(i, j):
            if cash < order:
                break
            cash -= cost[k]
            returned += back[k]
            close = max(out[k], now + 1)
            taken.append(k)
            closes.append(close)
            last = max(last, close)
        cash += returned
        i = max(j, int(np.searchsorted(buy, last, "left")))
    return taken, closes


def walked_trades(rows: DataFrame, initial: float, order: float, keys: tuple[str, ...]) -> DataFrame:
    """(keys, symbol, buy_ord, seq) of what each combination takes, by an exact walk over its candidates."""
    slim = rows.select(*keys, "symbol", "buy_ord", "close_ord", "cost", "back")

    def gate(group: pa.Table) -> pa.Table:
        group = group.sort_by([("buy_ord", "ascending"), ("symbol", "ascending")])
        taken, _ = walk(*(group.column(c).to_numpy() for c in ("buy_ord", "close_ord", "cost", "back")), initial, order)
        return group.select([*keys, "symbol", "buy_ord"]).take(pa.array(taken, pa.int64())).append_column("seq", pa.array(np.arange(len(taken))))

    kinds = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys)
    return spread(slim, *keys).groupBy(*keys).applyInArrow(gate, f"{kinds}, symbol string, buy_ord int, seq long")


def portfolio_trades(candidates: DataFrame, line: DataFrame, initial: float, order: float, keys: tuple[str, ...] = ("combo_id",), stretch: int = 65_536, end: int | None = None) -> DataFrame:
    """The candidates that are taken, with ``buy_ord``, ``close_ord`` (times of the line), ``seq`` (order of entry) and ``closed`` (false if the line ends first). Candidates may have
    their places on the line already. ``end``: the line's last place, if it is known."""
    end, rows = line_end(line) if end is None else end, candidates
    if "buy_ord" not in candidates.columns:
        for side in ("buy", "sell"):
            rows = rows.join(line.select(F.col("ts").alias(f"{side}_time"), F.col("ord").alias(f"{side}_ord")), f"{side}_time")
    rows = rows.withColumns({"close_ord": F.greatest("sell_ord", F.col("buy_ord") + 1), "cost": F.lit(order) + F.col("commission_buy"), "back": F.col("qty") * F.col("sell_price") - F.col("commission_sell")}).drop("sell_ord")
    batches = rows.groupBy(*keys, F.col("buy_ord").alias("at")).agg(F.max("close_ord").alias("leave"), F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"), F.min("cost").alias("least_cost"), F.sum("back").alias("back"))
    entered, short = entered_times(batches, keys, end + 1, initial, order, stretch)
    place = F.row_number().over(Window.partitionBy(*keys, "buy_ord").orderBy("symbol")) - 1
    taken = rows.join(entered.withColumnRenamed("at", "buy_ord"), [*keys, "buy_ord"]).withColumn("seq", F.col("before") + place).drop("before")
    if not short.isEmpty():
        short = written(short, "short")
        poor = rows.join(short, [*keys], "left_semi")
        taken = taken.join(short, [*keys], "left_anti").unionByName(poor.join(walked_trades(poor, initial, order, keys), [*keys, "symbol", "buy_ord"]))
    return taken.drop("cost", "back").withColumn("closed", F.col("close_ord") <= end)


def held_curve(trades: DataFrame, bars: DataFrame, line: DataFrame, initial: float, order: float, keys: tuple[str, ...] = ("combo_id",), stretch: int = 65_536, end: int | None = None) -> DataFrame:
    """(keys, ord, balance) at the times at which a combination holds, opens or closes something: cash after that time's closes and entries, and holdings at their last close. Between
    them the balance is that of the row before. Running cash goes over stretches of the line and is carried over by their sums; closes are looked up where something is held."""
    end = (line_end(line) if end is None else end) + 1
    flows = trades.select(*keys, F.col("buy_ord").alias("ord"), (-(F.lit(order) + F.col("commission_buy"))).alias("flow")).unionByName(
        trades.where("closed").select(*keys, F.col("close_ord").alias("ord"), (F.col("qty") * F.col("sell_price") - F.col("commission_sell")).alias("flow"))
    )
    open_ = trades.select(*keys, "symbol", "qty", F.explode(F.sequence("buy_ord", F.least("close_ord", F.lit(end)) - 1)).alias("ord"))
    held = open_.join(closes_where(bars, line, open_), ["symbol", "ord"]).select(*keys, "ord", F.lit(0.0).alias("flow"), (F.col("qty") * F.col("price")).alias("value"))
    rows = flows.withColumn("value", F.lit(0.0)).unionByName(held).groupBy(*keys, "ord").agg(F.sum("flow").alias("flow"), F.sum("value").alias("value"))
    if end <= stretch:
        run = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
        return rows.select(*keys, "ord", (F.lit(float(initial)) + F.sum("flow").over(run) + F.col("value")).alias("balance"))
    rows = written(rows.withColumn("_stretch", F.floor(F.col("ord") / stretch)), "held")
    past = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_stretch").agg(F.sum("flow").alias("flow")).select(*keys, "_stretch", F.coalesce(F.sum("flow").over(past), F.lit(0.0)).alias("_past"))
    run = Window.partitionBy(*keys, "_stretch").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("_near", F.sum("flow").over(run))
    return near.join(sums, [*keys, "_stretch"]).select(*keys, "ord", (F.lit(float(initial)) + F.col("_past") + F.col("_near") + F.col("value")).alias("balance"))


def equity_curve(held: DataFrame, line: DataFrame, combos: DataFrame, initial: float, keys: tuple[str, ...] = ("combo_id",), end: int | None = None) -> DataFrame:
    """(keys, ord, ts, balance) at every time of the line, from the rows of ``held_curve``: each lasts until the next."""
    end = line_end(line) if end is None else end
    begins = combos.select(*keys, F.lit(-1).alias("ord"), F.lit(float(initial)).alias("balance"))
    onward = F.lead("ord", 1, end + 1).over(Window.partitionBy(*keys).orderBy("ord"))
    runs = held.select(*keys, "ord", "balance").unionByName(begins).withColumn("_next", onward).withColumn("ord", F.greatest("ord", F.lit(0))).where("_next > ord")
    return runs.select(*keys, F.explode(F.sequence("ord", F.col("_next") - 1)).alias("ord"), "balance").join(line, "ord").select(*keys, "ord", "ts", "balance")
