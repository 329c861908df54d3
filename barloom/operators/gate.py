"""Which signal times a portfolio enters at, for combinations of any length.

While cash covers every order, what follows an entry depends on its time alone: positions of time t are all closed at ``leave(t)``, and the next entry is the first signal time that
isn't before it. The times that are entered are the chain of that function from the first signal on. Each combination's signal times are cut into stretches of the line:

* Within a stretch every time's chain is followed to where it leaves the stretch, by pointer jumping in arrays.
* Chains that meet stay together, so few distinct times leave a stretch. From each of these, and from the stretch's start, the next stretch is crossed again. That gives
  links between entry points, a table of few rows for each stretch.
* The links are followed from the line's start by doubling, in as many rounds as the logarithm of the number of stretches. Each stretch then has one entry point at most and marks its times.

A line of one stretch needs the last step only. Times are marked for all combinations of an Arrow batch at once. Money is a running sum of each stretch, carried over by the sums of the stretches before; combinations where it may not cover
an order are named, and walked one by one elsewhere."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.scratch import written

from .chunks import spread


def crossings(at: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """For each of the sorted times, the time at which its chain leaves the last of them behind."""
    n = len(at)
    onward = np.searchsorted(at, leave)
    last = np.where(onward < n, onward, np.arange(n))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            return leave[last]
        last = further


def entered(group: np.ndarray, at: np.ndarray, leave: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Places of the times that are entered, for several groups one after another, each with its times in order: the chain from the first time that isn't before the group's ``entry``. All
    chains at once: what n steps reach reaches twice as far by the pointers of n steps."""
    n, apart = len(at), 1 << 33
    base = group.astype(np.int64) * apart
    own = base + at
    onward = np.searchsorted(own, base + leave)
    onward[(onward < n) & (group[np.minimum(onward, n - 1)] != group)] = n
    onward = np.append(onward, n)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    root = np.searchsorted(own, base[first] + entry[first])
    root = root[(root < n) & (group[np.minimum(root, n - 1)] == group[first])]
    mark = np.zeros(n + 1, bool)
    mark[root] = True
    while (onward < n).any():
        mark[onward[np.flatnonzero(mark)]] = True
        onward = onward[onward]
    return np.flatnonzero(mark[:n])


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of sorted batches with the number of each row's group, cut between groups: what a batch ends with waits for the next."""
    rest: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            rest.append(batch)
        rows = pa.Table.from_batches(rest) if rest else None
        if rows is None or not rows.num_rows:
            continue
        new = np.zeros(rows.num_rows, bool)
        for c in by:
            x = rows.column(c).combine_chunks()
            same = pc.fill_null(pc.equal(x.slice(1), x.slice(0, len(x) - 1)), False).to_numpy(zero_copy_only=False)
            new[1:] |= ~same
        end = rows.num_rows if batch is None else int(np.flatnonzero(new)[-1]) if new.any() else 0
        if end:
            yield rows.slice(0, end), np.cumsum(new[:end])
        rest = rows.slice(end).combine_chunks().to_batches() if end < rows.num_rows else []


def reached(links: DataFrame, roots: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """The points (keys, x) that the links (keys, x, to) reach from ``roots``, those included, in at most 2 ** ``rounds`` steps."""
    jumps = [written(links.select(*keys, "x", "to"), "jumps")]
    for _ in range(rounds - 1):
        on = jumps[-1].select(*keys, F.col("x").alias("to"), F.col("to").alias("_on"))
        jumps.append(written(jumps[-1].join(on, [*keys, "to"]).select(*keys, "x", F.col("_on").alias("to")), "jumps"))
    found = roots.select(*keys, "x")
    for jump in reversed(jumps):
        found = written(found.unionByName(found.join(jump, [*keys, "x"]).select(*keys, F.col("to").alias("x"))), "reached")
    return found


def _entry_points(batches: DataFrame, keys: list[str], stretches: int, stretch: int) -> DataFrame:
    """(keys, _stretch, x): where the chain from the line's start enters each stretch."""
    kinds = ", ".join(f"{k} {batches.schema[k].dataType.simpleString()}" for k in keys)
    slim = batches.select(*keys, "_stretch", "at", "leave")

    def leaves(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        # a chain that ends before its stretch does has nothing more in it
        end = (group.column("_stretch")[0].as_py() + 1) * stretch if len(group) else 0
        x = np.unique(np.maximum(crossings(group.column("at").to_numpy(), group.column("leave").to_numpy()), end))
        return group.select(keys).slice(0, 1).take(pa.array(np.zeros(len(x), np.int64))).append_column("x", pa.array(x.astype(np.int32)))

    starts = batches.select(*keys).distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit((stretches - 1) * stretch), F.lit(stretch))))
    points = slim.groupBy(*keys, "_stretch").applyInArrow(leaves, f"{kinds}, x int").unionByName(starts).where(F.col("x") < stretches * stretch).distinct()
    points = written(points.withColumn("_stretch", F.floor(F.col("x") / stretch).cast("int")), "points")

    def cross(points: pa.Table, times: pa.Table) -> pa.Table:
        """From each point to where its chain leaves the stretch; without a signal behind it that is the stretch's end."""
        times = times.sort_by("at")
        x, at = points.column("x").to_numpy(), times.column("at").to_numpy()
        end = (points.column("_stretch")[0].as_py() + 1) * stretch if len(points) else 0
        out = np.append(np.maximum(crossings(at, times.column("leave").to_numpy()), end), end)
        return points.select([*keys, "x"]).append_column("to", pa.array(out[np.searchsorted(at, x)].astype(np.int32)))

    by = [*keys, "_stretch"]
    links = spread(points, *by).groupBy(*by).cogroup(slim.groupBy(*by)).applyInArrow(cross, f"{kinds}, x int, to int")
    found = reached(links.where(F.col("to") < stretches * stretch), starts.where("x = 0"), keys, max(1, ceil(log2(stretches))))
    return found.withColumn("_stretch", F.floor(F.col("x") / stretch).cast("int"))


def entered_times(batches: DataFrame, keys: tuple[str, ...], times: int, initial: float, order: float, stretch: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """The entered ones among ``batches`` (keys, at, leave, n, cost, least_cost, back) while cash is no matter: (keys, at, before), with the number of positions entered before; and the
    combinations (keys) where cash may fall short of an order. ``times``: how many the line has."""
    keys = list(keys)
    stretches = max(1, -(-times // stretch))
    batches = batches.withColumn("_stretch", F.floor(F.col("at") / stretch).cast("int"))
    kinds = ", ".join(f"{k} {batches.schema[k].dataType.simpleString()}" for k in keys)
    by = [*keys, "_stretch"]

    def mark(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(parts, by):
            taken = entered(group, *(rows.column(c).to_numpy() for c in ("at", "leave", "entry")))
            n, cost, least, back = (rows.column(c).to_numpy()[taken] for c in ("n", "cost", "least_cost", "back"))
            first = np.searchsorted(group[taken], group[taken])
            so_far = lambda x: (lambda total: total - x - (total - x)[first])(np.cumsum(x))  # noqa: B023, E731
            net = back - cost
            # cash before the batch's last order, without what the stretch begins with
            found = {"before": so_far(n), "n": n, "room": so_far(net) - cost + least, "net": net}
            out = rows.select([*by, "at"]).take(pa.array(taken))
            yield from pa.table([*out.columns, *map(pa.array, found.values())], names=[*out.column_names, *found]).to_batches()

    def marked(rows: DataFrame) -> DataFrame:
        dealt = spread(rows.select(*by, "at", "leave", "entry", "n", "cost", "least_cost", "back"), *by).sortWithinPartitions(*by, "at")
        return written(dealt.mapInArrow(mark, f"{kinds}, _stretch int, at int, before long, n long, room double, net double"), "entered")

    if stretches == 1:
        found = marked(batches.withColumn("entry", F.lit(0)))
        carried = found.withColumns({"_n": F.lit(0), "_net": F.lit(0.0)})
    else:
        batches = written(batches, "batches")
        points = _entry_points(spread(batches, *by), keys, stretches, stretch)
        found = marked(batches.join(points.withColumnRenamed("x", "entry"), by))
        past = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        sums = found.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum("net").alias("_net"))
        carried = found.join(sums.select(*by, *(F.coalesce(F.sum(c).over(past), F.lit(0)).alias(c) for c in ("_n", "_net"))), by)
    short = carried.where(F.lit(initial) + F.col("_net") + F.col("room") < order + 1e-6 * max(order, 1.0)).select(*keys).distinct()
    return carried.select(*keys, "at", (F.col("before") + F.col("_n")).alias("before")), short
