"""The live loop as streaming queries: closed bars from ticks, signals over each symbol's recent bars, paper positions.

Signals and positions act on a bar time once, when the watermark says that it is complete: rows wait in the state until an event-time timer takes all times up to the watermark, in order.
How rows are dealt over files and micro-batches changes nothing, nor does the order of rows that aren't later than ``lateness``; later ones are dropped. What is newer
than the watermark waits for later bars. The state store must be RocksDB's, which these functions set for the session."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def live_bars(ticks: DataFrame, width: str = "4 hours", lateness: str = "1 hour", symbol: str = "event_type", price: str = "value", seq: str = "event_id") -> DataFrame:
    """Bars of windows counted from midnight UTC, each given out once its window has closed (append mode)."""
    at = F.struct("ts", seq)
    bars = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).groupBy(F.window("ts", width), F.col(symbol).alias("symbol"))
    return bars.agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count(price).cast("double").alias("volume_base"), F.sum(price).alias("volume_quote")).select("symbol", F.col("window.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume_base", "volume_quote")


def without_repeats(bars: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each (symbol, ts) once; late repeats within the watermark go."""
    kind = bars.schema["ts"].dataType
    rows = bars.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return rows.dropDuplicatesWithinWatermark(["symbol", "ts"]).withColumn("ts", F.col("ts").cast(kind))


def recent_signals(closes: np.ndarray, span: int, entropy_max: float, window: int = 5, bins: int = 10) -> np.ndarray:
    """Entropy-acceleration signal of the last close of each row, unshifted; the least and greatest change are those of the row."""
    n, m = closes.shape
    change = np.diff(closes, axis=1, prepend=closes[:, :1])
    low, high = change.min(axis=1, keepdims=True), change.max(axis=1, keepdims=True)
    place = np.minimum(((change[:, -window:] - low) / (high - low + 1e-9) * bins).astype(int), bins - 1)
    share = (place[:, :, None] == np.arange(bins)).mean(axis=1)
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    second = np.zeros((n, m))
    second[:, 2:] = closes[:, 2:] - 2 * closes[:, 1:-1] + closes[:, :-2]
    # the last exponential mean as a weighted sum; the first value's weight is what the others leave
    alpha = 2 / (span + 1)
    weights = alpha * (1 - alpha) ** np.arange(m - 1, -1, -1.0)
    weights[0] = (1 - alpha) ** (m - 1)
    return (entropy < entropy_max) & (second @ weights > 0)


class _Complete(StatefulProcessor):
    """Rows (at, ...) of a key wait until the watermark has passed their time; ``act`` gets all complete ones, by time. ``at`` is in microseconds."""

    fields: str  # of the rows that wait, beginning with ``at``

    def __init__(self, names: list[str], idle: int | None = None):
        self.names, self.idle = names, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.fields)
        self.done = handle.getValueState("done", "at long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, timer = self.done.get() if self.done.exists() else (None, None)
        new = [r for frame in rows for r in frame[self.names].itertuples(index=False, name=None) if last is None or r[0] > last]
        if new:
            self.waiting.appendList(new)
            timer = self._set(timer, min(r[0] for r in new))
            self.done.update((last, timer))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, timer = self.done.get() if self.done.exists() else (None, None)
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = sorted((r for r in rows if r[0] <= until), key=lambda r: r[0]), [r for r in rows if r[0] > until]
        if ready:
            (self.waiting.put(rest) if rest else self.waiting.clear())
            # what came after too long a silence begins anew, whether or not the state was cleared by then
            times = [last, *(r[0] for r in ready)]
            cuts = [i for i, (a, b) in enumerate(zip(times, times[1:])) if self.idle and a is not None and b > a + self.idle]
            for begin, end in zip([0, *cuts], [*cuts, len(ready)]):
                if begin in cuts:
                    self.forget()
                if end > begin:
                    out = self.act(key, ready[begin:end])
                    if len(out):
                        yield out
            last = ready[-1][0]
        silent = bool(self.idle) and last is not None and last + self.idle <= until
        if silent:
            self.forget()
        timer = self._set(None, min(r[0] for r in rest)) if rest else self._set(None, last + self.idle) if self.idle and last is not None and not silent else None
        if timer is None and silent:
            self.done.clear()
        else:
            self.done.update((last, timer))

    def _set(self, timer: int | None, at: int) -> int:
        """One timer for a key, at the first time that waits."""
        ms = -(-at // 1000)
        if timer is None or ms < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ms)
            return ms
        return timer

    def act(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def forget(self) -> None:
        """Drops what the key's past has left."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Signals(_Complete):
    """State of a symbol: its last closes."""

    fields = "at long, close double"

    def __init__(self, span: int, entropy_max: float, keep: int, idle: int | None):
        super().__init__(["at", "close"], idle)
        self.span, self.entropy_max, self.keep = span, entropy_max, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.past = handle.getValueState("past", "closes array<double>")

    def act(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        first = dict(reversed(rows))  # of repeated times the first that came
        at, new = list(first)[::-1], np.array(list(first.values())[::-1], float)
        past = np.array(self.past.get()[0], float) if self.past.exists() else np.zeros(0)
        closes = np.concatenate([past, new])
        self.past.update((closes[-self.keep :].tolist(),))
        signal = np.zeros(len(closes), bool)
        for i in range(len(past), min(len(closes), self.keep - 1)):  # a symbol's first bars
            signal[i] = recent_signals(closes[None, : i + 1], self.span, self.entropy_max)[0]
        if len(closes) >= self.keep:
            full = np.lib.stride_tricks.sliding_window_view(closes, self.keep)[max(len(past) - self.keep + 1, 0) :]
            signal[len(closes) - len(full) :] = recent_signals(full, self.span, self.entropy_max)
        return pd.DataFrame({"symbol": key[0], "at": at, "close": new, "signal": signal[len(past) :]})

    def forget(self) -> None:
        self.past.clear()


class _Books(_Complete):
    """State of a book: what it holds, and how many times of its own it still waits."""

    fields = "at long, symbol string, close double, signal boolean"

    def __init__(self, sell_after: int, idle: int | None):
        super().__init__(["at", "symbol", "close", "signal"], idle)
        self.sell_after = sell_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getMapState("held", "symbol string", "price double")
        self.left = handle.getValueState("left", "left int")

    def act(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        before = {k[0]: v[0] for k, v in self.held.iterator()}
        held, left, out = dict(before), self.left.get()[0] if self.left.exists() else 0, []
        times: dict[int, dict[str, tuple[float, bool]]] = {}
        for at, symbol, close, signal in rows:
            times.setdefault(at, {}).setdefault(symbol, (close, signal))
        for at, now in times.items():
            if held:
                left -= 1
                if left <= 0:
                    out += [(key[0], at, s, "close", now[s][0] if s in now else None) for s in sorted(held)]
                    held = {}
                continue
            held = {s: close for s, (close, signal) in sorted(now.items()) if signal}
            left = self.sell_after
            out += [(key[0], at, s, "open", price) for s, price in held.items()]
        for s in before.keys() - held.keys():
            self.held.removeKey((s,))
        for s in held.keys() - before.keys():
            self.held.updateValue((s,), (held[s],))
        self.left.update((left,))
        return pd.DataFrame(out, columns=["book", "at", "symbol", "action", "price"]).astype({"price": float})

    def forget(self) -> None:
        """A book that holds something waits on."""
        if not any(True for _ in self.held.keys()):
            self.left.clear()


def _by_time(rows: DataFrame, key: str, lateness: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """What ``processor`` gives out for each key; its ``at`` becomes ``ts`` again, of the kind that it was."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = rows.schema["ts"].dataType
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    found = timed.groupBy(key).transformWithStateInPandas(processor, schema, "append", "eventTime")
    return found.withColumn("at", F.timestamp_micros("at").cast(kind)).withColumnRenamed("at", "ts")


def live_signals(bars: DataFrame, span: int = 10, entropy_max: float = 2.0, keep: int = 50, lateness: str = "0 seconds", idle_seconds: int | None = None) -> DataFrame:
    """(symbol, ts, close, signal) for each complete bar, from a state of each symbol's last ``keep`` bars. A symbol without a bar for ``idle_seconds`` of event time is
    forgotten and begins anew, unless that is None."""
    processor = _Signals(span, entropy_max, keep, idle_seconds and idle_seconds * 1_000_000)
    return _by_time(bars.select("symbol", "ts", "close"), "symbol", lateness, processor, "symbol string, at long, close double, signal boolean")


def paper_positions(signals: DataFrame, sell_after: int, book: Column, lateness: str = "0 seconds", idle_seconds: int | None = None) -> DataFrame:
    """Position events (book, ts, symbol, action, price). A book (an account, a strategy's share of the symbols) opens only while empty, one position for each of its symbols
    with a signal at that time, and closes each after ``sell_after`` later bar times of its own. Books are the parallel keys; a book is one state by nature, and only
    bar times and signals reach it. A book that holds nothing and gets no bar for ``idle_seconds`` of event time is forgotten, unless that is None."""
    rows = signals.withColumn("book", book.cast("string")).select("book", "ts", "symbol", "close", "signal")
    processor = _Books(sell_after, idle_seconds and idle_seconds * 1_000_000)
    return _by_time(rows, "book", lateness, processor, "book string, at long, symbol string, action string, price double")
