"""Trades of fixed holding time with take-profit and stop-loss levels.

A signal at bar i buys for ``order_amount`` at its close and is held to bar ``min(i + sell_after, n - 1)``, unless a later bar's high or low touches a
level first. Signals with ``i + sell_after > n`` are left out. Where both levels are first touched in the same bar, the bar's high time decides: profit
only if it isn't after the low time. The exit price is the level, the exit time that of the bar."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import by_chunk, overlapping, own_rows, spread


def _require_times(bars: DataFrame) -> None:
    missing = {"high_time", "low_time"} - set(bars.columns)
    if missing:
        raise ValueError(f"bars have no {', '.join(sorted(missing))}: annotate them with the times of extremes first")


def forward_bars(bars: DataFrame, most: int, chunk: int = 50_000) -> DataFrame:
    """Bars (symbol, idx, n, ts, close, high, low, high_time, low_time) with ``ahead``, the next ``most`` bars as structs."""
    _require_times(bars)
    ahead = F.collect_list(F.struct("ts", "close", "high", "low", "high_time", "low_time")).over(by_chunk().rowsBetween(1, most))
    return own_rows(overlapping(bars, ahead=most, chunk=chunk).withColumn("ahead", ahead))


def block_maxima(values: np.ndarray) -> list[np.ndarray]:
    """Greatest values of blocks of 1, 2, 4, ... places, up to one block of all; short levels are filled up to an even length."""
    levels = [values]
    while len(levels[-1]) > 1:
        if len(levels[-1]) % 2:
            levels[-1] = np.append(levels[-1], -np.inf)
        levels.append(np.maximum(levels[-1][::2], levels[-1][1::2]))
    return levels


def first_reach(levels: list[np.ndarray], start: np.ndarray, price: np.ndarray) -> np.ndarray:
    """The first place from ``start`` on whose value is at least ``price``, -1 if there is none: up the blocks to one that reaches it, and down to its first place."""
    block, at, found = start.copy(), np.full(len(start), -1), np.zeros(len(start), np.int64)
    open_ = np.ones(len(start), bool)
    for k, top in enumerate(levels):
        open_ &= block < len(top)
        # an even block is part of the next level's, which is looked at instead
        look = open_ & ((block % 2 == 1) | (k == len(levels) - 1))
        hit = look & (top[np.minimum(block, len(top) - 1)] >= price) if len(top) else look
        at[hit], found[hit] = k, block[hit]
        open_ &= ~hit
        block = (block + look) // 2
    for k in range(len(levels) - 2, -1, -1):
        deeper = at > k
        left = np.where(deeper, 2 * found, 0)
        found = np.where(deeper, left + ~(levels[k][left] >= price), found)
    return np.where(at >= 0, found, -1)


def _lists(values: pa.Array, rows: int, width: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), values)


def touches(bars: DataFrame, signals: DataFrame, tp: list[float], sl: list[float], sell_after: list[int], chunk: int = 50_000) -> DataFrame:
    """Bars with a signal (symbol, idx, n, ts, close), with what each of the given levels and holds comes to, found once for all combinations: ``tp_at`` and ``sl_at``, how many bars ahead a level is first
    touched (null: not within the longest hold, or the level is 0), ``tp_ts`` and ``sl_ts`` of those bars, ``tp_first``, whether that bar's high isn't after its low, and ``hold_at``,
    ``hold_ts`` and ``hold_close`` of the bar that ends a hold. Where bars have ``ord``, their place on a line of times, it comes along with each ts. A task has a chunk of a series and the bars that its last signals look ahead to, with an index of
    extremes; what comes out of it doesn't grow with the holds."""
    _require_times(bars)
    most = max(sell_after)
    chunk = max(chunk, most)
    stamps = {c: bars.schema[c].dataType.simpleString() for c in ("ts", "ord") if c in bars.columns}
    seen = overlapping(bars.select("symbol", "idx", "n", *stamps, "close", "high", "low", "high_time", "low_time"), ahead=most, chunk=chunk).drop("_home")
    wanted = signals.select(F.col("symbol").alias("_of"), F.col("idx").alias("_at")).distinct().withColumn("_chunk", F.floor(F.col("_at") / chunk))

    def search(wanted: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        idx = rows.column("idx").to_numpy()
        asked = wanted.column("_at").to_numpy()
        asked = np.sort(asked[np.isin(asked, idx)])
        at = np.searchsorted(idx, asked)
        close, n = rows.column("close").to_numpy(), rows.column("n").to_numpy()
        first = pc.fill_null(pc.less_equal(rows.column("high_time"), rows.column("low_time")), False).combine_chunks()
        out = {c: rows.column(c).take(pa.array(at)) for c in ("symbol", "idx", "n", *stamps, "close")}
        pick = lambda column, places: column.take(pa.array(places, mask=places < 0))
        marks = {c: rows.column(c).combine_chunks() for c in stamps}
        for side, levels, sign, values in (("tp", tp, 1.0, rows.column("high").to_numpy()), ("sl", sl, -1.0, -rows.column("low").to_numpy())):
            index = block_maxima(values)
            price = close[at][:, None] * (1 + sign * np.array(levels, float) / 100)
            start = np.repeat(at + 1, len(levels))
            place = first_reach(index, start, sign * price.ravel()) if len(at) else np.zeros(0, np.int64)
            place[(place - start >= most) | np.tile(np.array(levels) == 0, len(at))] = -1
            ahead = np.where(place < 0, 0, place - start + 1).astype(np.int32)
            out[f"{side}_at"] = _lists(pa.array(ahead, mask=place < 0), len(at), len(levels))
            out |= {f"{side}_{c}": _lists(pick(mark, place), len(at), len(levels)) for c, mark in marks.items()}
            if side == "tp":
                out["tp_first"] = _lists(pick(first, place), len(at), len(levels))
        held = np.minimum(np.array(sell_after), (n[at] - 1 - asked)[:, None]).ravel()
        place = np.repeat(at, len(sell_after)) + held
        place = np.where(held >= 0, np.minimum(place, len(idx) - 1), -1)
        out |= {f"hold_{c}": _lists(pick(mark, place), len(at), len(sell_after)) for c, mark in (marks | {"close": rows.column("close").combine_chunks()}).items()}
        out["hold_at"] = _lists(pa.array(held.astype(np.int32)), len(at), len(sell_after))
        return pa.table(out).select(names)

    one = {"symbol": "string", "idx": "long", "n": "long"} | stamps | {"close": "double"}
    many = {"tp_at": "int", "sl_at": "int", "hold_at": "int", "tp_first": "boolean", "hold_close": "double"} | {f"{x}_{c}": kind for c, kind in stamps.items() for x in ("tp", "sl", "hold")}
    names, schema = [*one, *many], ", ".join([*(f"{c} {t}" for c, t in one.items()), *(f"{c} array<{t}>" for c, t in many.items())])
    return spread(wanted, "_of", "_chunk").groupBy("_of", "_chunk").cogroup(spread(seen, "symbol", "_part").groupBy("symbol", "_part")).applyInArrow(search, schema)


def candidate_trades(touched: DataFrame, signals: DataFrame, tp: list[float], sl: list[float], sell_after: list[int], order_amount: float, comi_pct: float) -> DataFrame:
    """A row for each eligible (combo, symbol, idx): prices, exit bar, reason and profit. ``signals`` has combo_id, sell_after, tp, sl; ``touched`` is of ``touches`` with the same lists.
    Where it has places on a line, so has the result: buy_ord, sell_ord. Where signals have ``own_n``, their series ends there, before the bars do; ``sell_after`` must then list, with each hold, the
    one a bar shorter."""
    f = comi_pct / 100
    nth = lambda column, values: F.array_position(F.array(*(F.lit(float(v)) for v in values)), F.col(column).cast("double")).cast("int")
    ends = ["own_n"] if "own_n" in signals.columns else []
    rows = signals.select("combo_id", "symbol", "idx", "sell_after", "tp", "sl", *ends).join(touched, ["symbol", "idx"]).where(f"idx + sell_after <= {ends[0] if ends else 'n'}")
    rows = rows.withColumns({"_i": nth("tp", tp), "_j": nth("sl", sl), "_k": nth("sell_after", sell_after)})
    if ends:
        rows = rows.withColumn("_hold", F.least("sell_after", F.col("own_n") - 1 - F.col("idx"))).withColumn("_k", nth("_hold", sell_after))
    rows = rows.withColumn("_held", F.element_at("hold_at", F.col("_k")))
    # touches within the hold
    never = F.lit(2**31 - 1)
    within = lambda at: F.when(at <= F.col("_held"), at).otherwise(never)
    rows = rows.withColumns({"_t": within(F.element_at("tp_at", F.col("_i"))), "_s": within(F.element_at("sl_at", F.col("_j")))})
    profit_first = F.coalesce(F.element_at("tp_first", F.col("_i")), F.lit(False))
    reason = F.when((F.col("_t") < F.col("_s")) | ((F.col("_t") == F.col("_s")) & (F.col("_t") < never) & profit_first), "TP").when(F.col("_s") < never, "SL").otherwise("SELL_AFTER")
    rows = rows.withColumn("exit_reason", reason)
    by_reason = lambda t, s, h: F.when(F.col("exit_reason") == "TP", t).when(F.col("exit_reason") == "SL", s).otherwise(h)
    price = by_reason(F.col("close") * (1 + F.col("tp") / 100), F.col("close") * (1 - F.col("sl") / 100), F.element_at("hold_close", F.col("_k")))
    sold = lambda c: by_reason(F.element_at(f"tp_{c}", F.col("_i")), F.element_at(f"sl_{c}", F.col("_j")), F.element_at(f"hold_{c}", F.col("_k")))
    places = [F.col("ord").alias("buy_ord"), sold("ord").alias("sell_ord")] if "ord" in touched.columns else []
    rows = rows.select("combo_id", "symbol", "idx", F.col("ts").alias("buy_time"), F.col("close").alias("buy_price"), sold("ts").alias("sell_time"), *places, price.alias("sell_price"), (F.lit(order_amount) / F.col("close")).alias("qty"), "exit_reason")
    buy, sell = F.col("qty") * F.col("buy_price") * f, F.col("qty") * F.col("sell_price") * f
    return rows.withColumns({"commission_buy": buy, "commission_sell": sell, "profit": (F.col("sell_price") - F.col("buy_price")) * F.col("qty") - buy - sell})


def ahead_extremes(bars: DataFrame, most: int, chunk: int = 50_000) -> DataFrame:
    """Each bar (symbol, idx) with how many of the next ``most`` bars there are (``n_ahead``), their greatest high (``top``) and least low (``bottom``); null without any. Ranges are covered by two
    blocks of the greatest power of two in them, so the work is the logarithm of ``most``."""
    seen = overlapping(bars.select("symbol", "idx", "high", "low"), ahead=most, chunk=chunk)

    def search(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        n = len(rows)
        start, stop = np.arange(1, n + 1), np.minimum(np.arange(n) + most, n - 1)
        size = stop - start + 1
        power = np.maximum(np.frexp(np.maximum(size, 1))[1] - 1, 0)
        out = {"symbol": rows.column("symbol"), "idx": rows.column("idx"), "n_ahead": pa.array(np.maximum(size, 0).astype(np.int64))}
        for name, sign, column in (("top", 1.0, "high"), ("bottom", -1.0, "low")):
            best, found = sign * rows.column(column).to_numpy(), np.zeros(n)
            for k in range(int(power.max(initial=0)) + 1):
                of = (power == k) & (size > 0)
                found[of] = np.maximum(best[start[of]], best[stop[of] + 1 - (1 << k)])
                best = np.append(np.maximum(best[: -(1 << k)], best[1 << k :]), np.full(min(1 << k, n), -np.inf))[:n]
            out[name] = pa.array(sign * found, mask=size <= 0)
        own = pc.equal(rows.column("_home"), rows.column("_part"))
        return pa.table(out).filter(own)

    return seen.groupBy("symbol", "_part").applyInArrow(search, "symbol string, idx long, n_ahead long, top double, bottom double")


def expired_price(probes: DataFrame, bars: DataFrame) -> DataFrame:
    """Closing prices of positions (symbol, ts): the last close by then, SELL_AFTER; where there is none the symbol's last close, FORCED_LAST."""
    from .align import asof_price

    last = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("last_close"), F.max("ts").alias("last_ts"))
    rows = asof_price(probes, bars).join(last, "symbol")
    return rows.select(*probes.columns, F.coalesce("price", "last_close").alias("sell_price"), F.when(F.col("price").isNull(), F.col("last_ts")).otherwise(F.col("ts")).alias("sell_time"), F.when(F.col("price").isNull(), "FORCED_LAST").otherwise("SELL_AFTER").alias("exit_reason"))
