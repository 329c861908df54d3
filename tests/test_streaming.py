"""Streams that act on a bar time once, however rows are dealt over batches."""

import tempfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.plans.queries import run_stream
from barloom.streaming.live import live_signals, paper_positions, recent_signals

START = datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp_ntz, close double"
SIGNAL = BAR + ", signal boolean"


def at(i):
    return START + timedelta(hours=4 * i)


@pytest.fixture
def feed(spark):
    """Adds a file of rows to a folder and lets a stream over it go on, a file a batch."""
    out, before = "file://" + tempfile.mkdtemp(prefix="spark-"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def add(files, schema, make):
        for rows in files:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{out}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
        return [tuple(r) for r in run_stream(make(stream), out).collect()]

    yield add
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plain_book(rows, hold, until):
    """The rules over complete times in order."""
    held, left, out = {}, 0, []
    for t in sorted({r[1] for r in rows if r[1] <= until}):
        now = {}
        for s, ts, close, signal in rows:
            if ts == t:
                now.setdefault(s, (close, signal))
        if held:
            left -= 1
            if left <= 0:
                out += [("b", t, s, "close", now[s][0] if s in now else None) for s in sorted(held)]
                held = {}
            continue
        held = {s: c for s, (c, signal) in now.items() if signal}
        left = hold
        out += [("b", t, s, "open", held[s]) for s in sorted(held)]
    return sorted(out)


def test_book_with_a_time_in_two_batches(feed):
    """A and B open and close together though each comes in files of its own, the second after a restart; a late row within the bound counts, a later one doesn't."""
    rng = np.random.default_rng(4)
    rows = [(s, at(i), float(100 + i + (s == "B")), bool(rng.random() < 0.4)) for i in range(12) for s in "AB"]
    of = lambda a, b, s: [r for r in rows if at(a) <= r[1] < at(b) and r[0] == s]
    late, lost = ("C", at(3), 55.0, True), ("C", at(1), 44.0, True)
    make = lambda s: paper_positions(s, 3, F.lit("b"), lateness="16 hours")
    first = feed([of(0, 4, "A"), of(0, 4, "B"), [late]], SIGNAL, make)
    assert sorted(first) == plain_book(rows[:8], 3, at(-1))  # nothing is complete before later bars come
    second = feed([of(4, 8, "A"), of(4, 8, "B")], SIGNAL, make)
    third = feed([[lost], of(8, 12, "B"), of(8, 12, "A")], SIGNAL, make)
    assert len(second) < len(third)
    assert sorted(third) == plain_book([*rows, late], 3, at(11 - 4))


def test_signals_whatever_the_batches(feed):
    """Each symbol's bars over three batches, out of order within the bound and with repeats, against the windows of a sorted series."""
    rng = np.random.default_rng(5)
    closes = {s: np.round(100 + np.cumsum(rng.normal(size=n)), 2) for s, n in (("A", 70), ("B", 30))}
    rows = [(s, at(i), float(c)) for s, many in closes.items() for i, c in enumerate(many)]
    by_time = sorted(rows, key=lambda r: (r[1], r[0]))
    swapped = by_time[:40] + by_time[42:44] + by_time[40:42] + by_time[44:] + [by_time[-1]]
    got = feed([swapped[:41], swapped[41:60], swapped[60:]], BAR, lambda s: live_signals(s, 5, 2.2, keep=20, lateness="1 day"))
    last = max(r[1] for r in rows) - timedelta(days=1)
    want = []
    for s, many in closes.items():
        for i, c in enumerate(many):
            if at(i) <= last:
                want.append((s, at(i), float(c), bool(recent_signals(many[None, max(0, i - 19) : i + 1], 5, 2.2)[0])))
    assert sorted(got) == sorted(want) and 0 < sum(r[3] for r in got) < len(got)


def test_a_silent_symbol_is_forgotten(feed):
    """After its last bar and the time given, a symbol's history begins anew."""
    closes = [float(x) for x in (10, 11, 9, 12, 8, 13, 7)]
    old, new = [("A", at(i), c) for i, c in enumerate(closes)], [("A", at(100 + i), c) for i, c in enumerate(closes)]
    other = [("B", at(i), 5.0) for i in range(0, 140, 20)]
    got = feed([[*old, *other[:5]], other[4:5], new, other[5:]], BAR, lambda s: live_signals(s, 3, 3.0, keep=30, lateness="1 hour", idle_seconds=4 * 3600))
    a = [r[3] for r in sorted(got) if r[0] == "A"]
    assert len(a) == 14 and a[:7] == a[7:]


def test_windows_at_once_equal_one_by_one():
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(40, 12)), 1)
    x[3] = 1.0
    import pandas as pd

    for span, limit in ((3, 1.5), (9, 2.5)):
        want = []
        for row in x:
            change = np.diff(row, prepend=row[:1])
            place = np.minimum(((change[-5:] - change.min()) / (change.max() - change.min() + 1e-9) * 10).astype(int), 9)
            share = np.bincount(place) / 5
            second = np.concatenate([[0, 0], row[2:] - 2 * row[1:-1] + row[:-2]])
            want.append(-(share[share > 0] * np.log2(share[share > 0])).sum() < limit and pd.Series(second).ewm(span=span, adjust=False).mean().iloc[-1] > 0)
        assert recent_signals(x, span, limit).tolist() == want and any(want)
