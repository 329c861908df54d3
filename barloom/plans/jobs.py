"""The main jobs, from bars to results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import align, grid, metrics, paths, portfolio, similarity, trades, walkforward
from barloom.operators.grid import signals_of_combos
from barloom.operators.indicators import delta, ema, entropy_between, indexed, return_moments, second_difference
from barloom.operators.signals import GridSignals, entropy_grid, signal_candidates
from barloom.sources.scratch import written


@dataclass
class Settings:
    initial: float = 10_000.0
    order: float = 100.0
    comi_pct: float = 0.05


PARAMS = ["sell_after", "entropy_max", "accel_span", "tp", "sl"]


@dataclass
class Backtest:
    """Tables of one evaluated grid."""

    combos: DataFrame
    line: DataFrame
    candidates: DataFrame
    trades: DataFrame
    equity: DataFrame
    results: DataFrame


def evaluate_signals(bars: DataFrame, taken: DataFrame, combos: DataFrame, lists: dict[str, list], settings: Settings) -> Backtest:
    """``taken``: (combo_id, symbol, idx, sell_after, tp, sl)."""
    line = align.timeline(bars)
    end = align.line_end(line)
    touched = trades.touches(bars.join(line, "ts"), taken, lists["tp"], lists["sl"], lists["sell_after"])
    found = written(trades.candidate_trades(touched, taken, lists["tp"], lists["sl"], lists["sell_after"], settings.order, settings.comi_pct), "candidates")
    done = written(portfolio.portfolio_trades(found, line, settings.initial, settings.order, end=end), "trades")
    held = portfolio.held_curve(done, bars, line, settings.initial, settings.order, end=end)
    curves = metrics.folded(metrics.curve_pieces(held), metrics.line_span(line), settings.initial)
    results = metrics.grid_results(combos, done, curves, settings.initial)
    return Backtest(combos, line, found, done, portfolio.equity_curve(held, line, combos, settings.initial, end=end), results)


def grid_backtest(bars: DataFrame, lists: dict[str, list], settings: Settings | None = None, take: GridSignals = entropy_grid) -> Backtest:
    """A grid of ``lists`` (sell_after, tp, sl and what ``take`` asks for); ``bars`` are clean, annotated and of one timeframe. Levels are searched once for all
    combinations that share them."""
    rows = written(indexed(bars), "bars")
    combos = grid.parameter_grid(bars.sparkSession, lists)
    return evaluate_signals(rows, take(rows, combos, lists), combos, lists, settings or Settings())


def _numbered(taken: DataFrame, combos: DataFrame, size: int) -> DataFrame:
    """Signals of symbols named ``number/symbol`` with combinations that are numbered anew for each number."""
    return taken.withColumn("combo_id", F.split("symbol", "/")[0].cast("int") * size + F.col("combo_id"))


def anchored_signals(rows: DataFrame, windows: DataFrame, combos: DataFrame, lists: dict[str, list], train: int, step: int, size: int) -> DataFrame:
    """Entropy-acceleration signals of anchored windows: (combo_id, symbol, idx, sell_after, tp, sl, own_n). All windows begin with the first bar, so smoothed differences are shared; bins depend on a window
    by the extremes of its changes alone, so entropy is computed once for each pair of extremes, not for each window."""
    spans = lists["accel_span"]
    shared = written(ema(rows.withColumns({"delta": delta(), "accel": second_difference()}), "accel", {f"accel_{s}": s for s in spans}), "shared")
    regimes = written(walkforward.extremes_by_window(shared, windows, "delta", train, step), "regimes")
    series = F.concat_ws("/", F.lpad(F.col("regime").cast("string"), 9, "0"), "symbol")
    longest = regimes.groupBy("symbol", "regime").agg(F.max("t1").alias("_t1"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    seen = shared.select("symbol", "idx", "delta", *(f"accel_{s}" for s in spans)).join(longest, "symbol").where(F.col("idx") < F.col("_t1")).withColumn("symbol", series)
    found = signals_of_combos(signal_candidates(entropy_between(seen, "delta"), spans), combos)
    within = regimes.select(F.col("symbol").alias("_symbol"), "window_id", F.col("t1").alias("own_n"), series.alias("symbol"))
    taken = found.join(within, "symbol").where(F.col("idx") < F.col("own_n"))
    return taken.select((F.col("window_id") * size + F.col("combo_id")).alias("combo_id"), F.col("_symbol").alias("symbol"), "idx", "sell_after", "tp", "sl", "own_n")


def walk_forward(bars: DataFrame, lists: dict[str, list], train: int, pct_train: float, anchored: bool = True, part: str = "train", settings: Settings | None = None, take: GridSignals = entropy_grid) -> DataFrame:
    """Grid results of every window: (window_id, params..., results). Each window is evaluated on its own bars, with indicators that start there; all windows in one plan, with
    its combinations numbered within it. Anchored training windows all begin with the first bar: for entropy-acceleration signals they share their bars, indicators and touches. Others have
    bars of their own, their symbols named ``window/symbol``."""
    rows = written(indexed(bars), "bars")
    windows = walkforward.window_table(rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), train, pct_train, anchored)
    step = int(train / pct_train - train)
    # a series too short for a window is split by its own length
    if anchored and part == "train" and take is entropy_grid and (rows.agg(F.max("n")).first()[0] or 0) >= train + step:
        return _shared_walk(rows, written(windows, "windows"), lists, train, step, settings or Settings())
    own = walkforward.rows_of_windows(rows, windows, part).withColumn("symbol", F.concat_ws("/", F.lpad(F.col("window_id").cast("string"), 9, "0"), "symbol"))
    own = written(own, "windows")
    combos = grid.parameter_grid(bars.sparkSession, lists)
    size = combos.count()
    taken = _numbered(take(own.drop("window_id"), combos, lists), combos, size)
    many = windows.select("window_id").distinct().crossJoin(F.broadcast(combos)).withColumn("combo_id", F.col("window_id") * size + F.col("combo_id"))
    settings = settings or Settings()
    line = align.timeline(own)
    end = align.line_end(line)
    touched = trades.touches(own.drop("window_id").join(line, "ts"), taken, lists["tp"], lists["sl"], lists["sell_after"])
    candidates = written(trades.candidate_trades(touched, taken, lists["tp"], lists["sl"], lists["sell_after"], settings.order, settings.comi_pct), "candidates")
    done = written(portfolio.portfolio_trades(candidates, line, settings.initial, settings.order, end=end), "trades")
    # a window's curve has the times of its own bars only
    times = own.select("window_id", "ts").distinct().join(line, "ts")
    held = portfolio.held_curve(done, own, line, settings.initial, settings.order, end=end)
    held = held.withColumn("window_id", F.floor(F.col("combo_id") / size).cast("int")).join(times, ["window_id", "ord"], "left_semi")
    keys = ("window_id", "combo_id")
    curves = metrics.folded(metrics.curve_pieces(held, keys), metrics.line_span(times, ("window_id",)), settings.initial, keys, ("window_id",))
    results = metrics.grid_results(many, done, curves.drop("window_id"), settings.initial)
    return results.withColumn("combo_id", F.col("combo_id") - F.col("window_id") * size)


def _shared_walk(rows: DataFrame, windows: DataFrame, lists: dict[str, list], train: int, step: int, settings: Settings) -> DataFrame:
    combos = grid.parameter_grid(rows.sparkSession, lists)
    size = combos.count()
    taken = anchored_signals(rows, windows, combos, lists, train, step, size)
    # a signal whose hold ends with the window's last bar but one is held a bar less
    holds = sorted({h for s in lists["sell_after"] for h in (s, s - 1) if h >= 0})
    line = align.timeline(rows)
    touched = trades.touches(rows.join(line, "ts"), taken, lists["tp"], lists["sl"], holds)
    candidates = written(trades.candidate_trades(touched, taken, lists["tp"], lists["sl"], holds, settings.order, settings.comi_pct), "candidates")
    times = rows.select("symbol", "idx", "ts").join(windows, "symbol").where("idx < t1").select("window_id", "ts").distinct().join(line, "ts")
    spans = written(metrics.line_span(times, ("window_id",)).join(times.groupBy("window_id").agg(F.max("ord").alias("_last")), "window_id"), "spans")
    window = F.floor(F.col("combo_id") / size).cast("int").alias("window_id")
    done = portfolio.portfolio_trades(candidates, line, settings.initial, settings.order).select("*", window)
    # what would close after a window's own last time stays open
    done = written(done.join(F.broadcast(spans.select("window_id", "_last")), "window_id").withColumn("closed", F.col("close_ord") <= F.col("_last")), "trades")
    keys = ("window_id", "combo_id")
    held = portfolio.held_curve(done, rows, line, settings.initial, settings.order, keys).join(F.broadcast(spans.select("window_id", "_last")), "window_id").where("ord <= _last").drop("_last")
    curves = metrics.folded(metrics.curve_pieces(held, keys), spans.drop("_last"), settings.initial, keys, ("window_id",))
    many = windows.select("window_id").distinct().crossJoin(F.broadcast(combos)).withColumn("combo_id", F.col("window_id") * size + F.col("combo_id"))
    results = metrics.grid_results(many, done.drop("window_id"), curves.drop("window_id"), settings.initial)
    return results.withColumn("combo_id", F.col("combo_id") - F.col("window_id") * size)


def bootstrap_monte_carlo(features: DataFrame, n_paths: int, steps: int, lists: dict[str, list], settings: Settings | None = None, seed: int = 42, take: GridSignals = entropy_grid) -> DataFrame:
    """Grid results on every bootstrapped path: (path_index, params..., results), by the same operators with a path's symbols named ``path/symbol``."""
    made = paths.bootstrap_paths(features, paths.bootstrap_draws(features, n_paths, steps, seed))
    bars = paths.path_bars(made, ordinal_time=True).withColumn("symbol", F.concat_ws("/", F.lpad(F.col("path_index").cast("string"), 9, "0"), "symbol")).drop("path_index", "step", "row")
    bars = written(bars, "paths")
    combos = grid.parameter_grid(features.sparkSession, lists)
    size = combos.count()
    taken = _numbered(take(bars, combos, lists), combos, size)
    many = features.sparkSession.range(n_paths).select(F.col("id").cast("int").alias("path_index")).crossJoin(F.broadcast(combos)).withColumn("combo_id", F.col("path_index") * size + F.col("combo_id"))
    done = evaluate_signals(bars, taken, many, lists, settings or Settings())
    return done.results.withColumn("combo_id", F.col("combo_id") - F.col("path_index") * size)


def search_diffusion(bars: DataFrame, trials: int, n_paths: int, steps: int, seed: int = 42) -> DataFrame:
    """By symbol the settings of a jump diffusion whose paths are most like its history, among ``trials`` drawn from fixed ranges by a hash of the trial."""
    rows = written(indexed(bars), "bars")
    draw = lambda k, low, high, step: low + F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col("trial")), F.lit(round((high - low) / step) + 1)) * step
    table = bars.sparkSession.range(trials).select(F.col("id").cast("int").alias("trial"))
    table = table.select("trial", draw(1, 0.3, 1.0, 0.05).alias("vol_scale"), draw(2, 0.0, 0.03, 0.0025).alias("jump_prob"), draw(3, -0.02, 0.02, 0.0025).alias("jump_mu"), draw(4, 0.002, 0.024, 0.002).alias("jump_sigma"))
    base = return_moments(rows)
    asked = base.crossJoin(F.broadcast(table)).withColumn("sigma", F.greatest(F.col("sigma") * F.col("vol_scale"), F.lit(1e-8)))
    made = paths.jump_diffusion(asked, n_paths, steps, seed=seed)
    returns = written(similarity.log_returns(made, ["symbol", "trial", "path_index"], "step"), "returns")
    scores = similarity.similarity(written(similarity.log_returns(rows, ["symbol"], "idx"), "returns"), returns, ["symbol", "trial"])
    best = scores.groupBy("symbol").agg(F.max_by("trial", F.struct(F.col("total"), -F.col("trial"))).alias("trial"), F.max("total").alias("total"))
    return best.join(table, "trial")
