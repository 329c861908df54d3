"""Entry signals. Unless ``live``, a signal stands one bar after the bar that shows it, so that it doesn't look ahead."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.sources.scratch import written

from .grid import signals_of_combos
from .indicators import by_bar, delta, ema, rolling_entropy, rsi, second_difference
from .patterns import PATTERNS, pattern_mask


def shifted(signal: Column) -> Column:
    """The value of the bar before; false for the first."""
    return F.coalesce(F.lag(signal).over(by_bar()), F.lit(False))


def entropy_acceleration(bars: DataFrame, spans: list[int], window: int = 5, bins: int = 10) -> DataFrame:
    """Bars with ``entropy`` of changes and ``accel_{span}``, smoothed second differences. One pass serves a whole grid of limits."""
    rows = ema(bars.withColumns({"delta": delta(), "accel": second_difference()}), "accel", {f"accel_{s}": s for s in spans})
    return rolling_entropy(rows, "delta", window, bins)


def signal_candidates(rows: DataFrame, spans: list[int], live: bool = False) -> DataFrame:
    """(symbol, idx, accel_span, entropy) where a signal of the span's acceleration may stand; the entropy limit is left to the grid."""
    value = (lambda c: F.col(c)) if live else (lambda c: F.lag(c).over(by_bar()))
    tall = rows.withColumn("_e", value("entropy")).withColumns({f"_a{s}": value(f"accel_{s}") for s in spans})
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("accel_span"), F.col(f"_a{s}").alias("accel")) for s in spans)))
    return tall.select("symbol", "idx", F.col("_e").alias("entropy"), each.alias("x")).select("symbol", "idx", "entropy", "x.*").where("accel > 0 and entropy is not null")


def entropy_signal(rows: DataFrame, span: int, entropy_max: float, live: bool = False) -> DataFrame:
    now = (F.col("entropy") < entropy_max) & (F.col(f"accel_{span}") > 0)
    return rows.withColumn("signal", now if live else shifted(now))


def trend_signal(bars: DataFrame, fast: int, slow: int, period: int = 14) -> DataFrame:
    """``ema_fast``, ``ema_slow``, ``rsi``, and the signal of a rising trend with strength."""
    rows = rsi(ema(bars, "close", {"ema_fast": fast, "ema_slow": slow}), period)
    return rows.withColumn("signal", shifted((F.col("ema_fast") > F.col("ema_slow")) & (F.col("close") > F.col("ema_fast")) & (F.col("rsi") > 50)))


def pattern_signal(bars: DataFrame, enabled: list[str], entropy_max: float, window: int = 5, bins: int = 10, live: bool = False) -> DataFrame:
    """Any of the enabled patterns at low entropy."""
    wanted = sum(1 << PATTERNS.index(p) for p in enabled)
    rows = rolling_entropy(bars.withColumn("delta", delta()), "delta", window, bins).withColumn("mask", pattern_mask())
    now = (F.col("mask").bitwiseAND(F.lit(wanted)) != 0) & (F.col("entropy") < entropy_max)
    return rows.withColumn("signal", now if live else shifted(now))


def latest_signals(rows: DataFrame) -> DataFrame:
    """Symbols whose last bar has a signal, with its ts and close."""
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("ts", "close", "signal"), "idx").alias("x"))
    return last.where("x.signal").select("symbol", "x.ts", "x.close")


#: Signals of a whole grid: from bars (symbol, idx, n, prices), the grid (combo_id and a column for each list) and its lists to the rows of the grid with symbol and idx
#: of each signal. Any function of this kind may drive the backtest, walk-forward and Monte Carlo jobs.
GridSignals = Callable[[DataFrame, DataFrame, dict[str, list]], DataFrame]


def entropy_grid(bars: DataFrame, combos: DataFrame, lists: dict[str, list]) -> DataFrame:
    """Lists ``accel_span`` and ``entropy_max``."""
    rows = written(entropy_acceleration(bars, lists["accel_span"]), "features")  # read for levels and for trades
    return signals_of_combos(signal_candidates(rows, lists["accel_span"]), combos)


def _next_bar(rows: DataFrame) -> DataFrame:
    """Signals stand one bar after the bar that shows them."""
    return rows.where("idx + 1 < n").withColumn("idx", F.col("idx") + 1).drop("n")


def trend_grid(bars: DataFrame, combos: DataFrame, lists: dict[str, list]) -> DataFrame:
    """Lists ``ema_fast``, ``ema_slow`` and ``rsi_period``; others, like a period of the true range, don't touch the signal. Each mean and each strength is computed once."""
    spans = sorted({*lists["ema_fast"], *lists["ema_slow"]})
    rows = ema(bars.select("symbol", "idx", "n", "close"), "close", {f"ema_{s}": s for s in spans})
    for p in lists["rsi_period"]:
        rows = rsi(rows, p).withColumnRenamed("rsi", f"rsi_{p}")
    shown = lambda f, s, p: (F.col(f"ema_{f}") > F.col(f"ema_{s}")) & (F.col("close") > F.col(f"ema_{f}")) & (F.col(f"rsi_{p}") > 50)
    each = [F.struct(F.lit(f).alias("ema_fast"), F.lit(s).alias("ema_slow"), F.lit(p).alias("rsi_period"), shown(f, s, p).alias("shown")) for f, s, p in product(lists["ema_fast"], lists["ema_slow"], lists["rsi_period"])]
    found = _next_bar(rows.select("symbol", "idx", "n", F.explode(F.array(*each)).alias("x")).where("x.shown").select("symbol", "idx", "n", "x.ema_fast", "x.ema_slow", "x.rsi_period"))
    return found.join(F.broadcast(combos), ["ema_fast", "ema_slow", "rsi_period"])


def pattern_grid(bars: DataFrame, combos: DataFrame, lists: dict[str, list], window: int = 5, bins: int = 10) -> DataFrame:
    """Lists ``entropy_max`` and one of booleans for each pattern. A bar meets the combinations by the sets of patterns that they want, of which there are as many as the
    lists make."""
    mask = sum((F.col(p).cast("int") * (1 << i) for i, p in enumerate(PATTERNS)), F.lit(0))
    wanted = sorted({sum(int(on) << i for i, on in enumerate(x)) for x in product(*(lists[p] for p in PATTERNS))})
    rows = rolling_entropy(bars.withColumn("delta", delta()), "delta", window, bins).withColumn("mask", pattern_mask())
    hits = F.filter(F.array(*map(F.lit, wanted)), lambda w: w.bitwiseAND(F.col("mask")) != 0)
    found = _next_bar(rows.select("symbol", "idx", "n", "entropy", F.explode(hits).alias("wanted")))
    return found.join(F.broadcast(combos.withColumn("wanted", mask)), "wanted").where("entropy < entropy_max").drop("wanted", "entropy")
