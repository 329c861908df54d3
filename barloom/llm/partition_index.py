"""Nearest neighbours by learned partitions.

The index is fitted on at most ``sample`` vectors, those with the least hashes. Their exact neighbour graph is cut into parts of equal size by recursive bisection: a set is halved
at the median of its principal direction, then nodes change sides in equal numbers as long as fewer edges are cut. A small network learns from each vector in which parts its neighbours
lie. Every vector goes to the part the network finds most probable; a query visits its most probable parts, as many as a held-out share of the sample needs for ``recall``
of its neighbours. The vectors of the parts that are visited are compared in full.

All rows are indexed, and nothing is capped: equal vectors are one class with the ids that any answer can need (one more than neighbours asked for, the smallest, picked in each task
before the shuffle), so a vector that a third of all rows share is one entry, and no other candidate can be behind them. Parts with many classes
are compared in blocks, and blocks with many queries in chunks of queries, so that a group's size has a bound. What the driver holds is the sample, the network and a count for each part.

Scores are inner products in double precision, added in the order of components, so equal vectors have equal scores; a matrix product picks what may be among the nearest within its
rounding. Vectors take no part that are null, all zero, or hold null or non-finite components, nor those whose length isn't the commonest one (the least of
equals), nor rows with a null id. Of rows with one id the one with the least vector counts. With fewer candidates than asked for, all that were found are given. An empty table
gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Workspace

_GRAPH = 16  # neighbours of a node
_BLOCK, _CHUNK = 16_384, 2_048  # classes and queries of one comparison


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) in double precision of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = df.select(F.col(id_col).alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    rows = rows.where(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0)).groupBy("id").agg(F.min("vec").alias("vec"))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().agg(F.max_by("n", F.struct("count", -F.col("n"))).alias("n")).first()
    return rows.where(F.size("vec") == (lengths["n"] or 0))


def classes_of(rows: DataFrame, ids: int) -> DataFrame:
    """(vec, ids): each distinct vector with its smallest ids."""
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    return rows.withColumn("_nth", nth).where(F.col("_nth") <= ids).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows with the greatest inner product with each row, itself left out."""
    near = np.zeros((len(x), min(k, len(x) - 1)), np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        near[i : i + 1024] = np.argpartition(-s, near.shape[1] - 1, axis=1)[:, : near.shape[1]] if near.shape[1] else near[i : i + 1024]
    return near


def balanced_parts(x: np.ndarray, near: np.ndarray, levels: int) -> np.ndarray:
    """A part for each row, 2 ** ``levels`` of sizes that differ by one at most a level, cut so that few edges of the graph cross."""
    part = np.zeros(len(x), np.int64)
    a, b = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    for _ in range(levels):
        side = np.zeros(len(x), np.int64)
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            centred = x[own] - x[own].mean(axis=0)
            along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
            side[own[np.argsort(along, kind="stable")[len(own) // 2 :]]] = 1
        inside = part[a] == part[b]
        ea, eb = a[inside], b[inside]
        best, cut = side.copy(), np.count_nonzero(side[ea] != side[eb])
        for _ in range(20):
            # an edge across is gained by changing sides, one within is lost
            gain = np.zeros(len(x))
            across = np.where(side[ea] != side[eb], 1.0, -1.0)
            np.add.at(gain, ea, across)
            np.add.at(gain, eb, across)
            order = np.lexsort((-gain, side, part))
            moved = np.zeros(len(x), bool)
            for p in np.unique(part):
                left, right = (order[(part[order] == p) & (side[order] == s)] for s in (0, 1))
                n = min(len(left), len(right))
                # half of the pairs that gain, as partners change together
                gains = np.count_nonzero(gain[left[:n]] + gain[right[:n]] > 0)
                moved[left[: (gains + 1) // 2]] = moved[right[: (gains + 1) // 2]] = True
            if not moved.any():
                break
            side[moved] = 1 - side[moved]
            now = np.count_nonzero(side[ea] != side[eb])
            if now < cut:
                best, cut = side.copy(), now
        part = part * 2 + best
    return part


@dataclass
class Router:
    """Log probabilities of parts for vectors, by one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def likely(self, x: np.ndarray) -> np.ndarray:
        """The parts that each vector visits, most probable first."""
        return np.argsort(-self(x), axis=1, kind="stable")[:, : self.probes]


def fit_network(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 40, seed: int = 0) -> Router:
    """Cross-entropy against shares of parts, by Adam."""
    rng = np.random.default_rng(seed)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    sizes = [(x.shape[1], hidden), (hidden,), (hidden, target.shape[1]), (target.shape[1],)]
    weights = [rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) > 1 else np.zeros(s) for s in sizes]
    mean, square, step = [np.zeros(s) for s in sizes], [np.zeros(s) for s in sizes], 0
    for epoch in range(epochs):
        rate = 3e-3 * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            w1, b1, w2, b2 = weights
            h = np.maximum(x[batch] @ w1 + b1, 0)
            z = h @ w2 + b2
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - target[batch]) / len(batch)
            dh = (d @ w2.T) * (h > 0)
            step += 1
            for i, g in enumerate((x[batch].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                mean[i] = 0.9 * mean[i] + 0.1 * g
                square[i] = 0.999 * square[i] + 0.001 * g * g
                weights[i] = weights[i] - rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*weights)


def fit_router(x: np.ndarray, levels: int, k: int, recall: float) -> Router:
    """A router for 2 ** ``levels`` parts, fitted on the rows of ``x``; one in eight is held out to tell how many parts a query must visit."""
    x = np.ascontiguousarray(x)
    held = np.arange(len(x)) % 8 == 7
    base = x[~held]
    if levels == 0 or len(base) < 2 or not held.any():
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    near = neighbour_graph(base, _GRAPH)
    part = balanced_parts(base, near, levels)
    target = np.zeros((len(base), 2**levels))
    np.add.at(target, (np.repeat(np.arange(len(base)), near.shape[1] + 1), np.column_stack([part, part[near]]).ravel()), 1 / (near.shape[1] + 1))
    router = fit_network(base, target)
    # where the network puts the rows themselves is where they will be found
    placed = np.argmax(router(base), axis=1)
    asked = x[held]
    nearest = np.argsort(-(asked @ base.T), axis=1, kind="stable")[:, : min(k, len(base))]
    place_of = np.argsort(np.argsort(-router(asked), axis=1, kind="stable"), axis=1)
    turn = np.take_along_axis(place_of, placed[nearest], axis=1)
    found = np.array([np.mean(turn < m) for m in range(1, 2**levels + 1)])
    router.probes = int(np.argmax(found >= recall)) + 1
    return router


def nearest_in_block(q: np.ndarray, c: np.ndarray, ids: list[list[int]], own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, id, score): for each query the k best ids of a block of classes without its own."""
    sizes = np.array([len(i) for i in ids])
    flat, begin = np.array([i for many in ids for i in many], np.int64), np.cumsum(sizes) - sizes
    slack = 1e-12 * np.linalg.norm(c, axis=1).max()
    rows, found, scores = [], [], []
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        s = part @ c.T
        # one class more than asked for: the query's own may count for nothing
        m = min(k + 1, len(c))
        least = np.partition(s, len(c) - m, axis=1)[:, len(c) - m]
        i, j = np.nonzero(s >= (least - slack * np.linalg.norm(part, axis=1))[:, None])
        exact = np.concatenate([np.cumsum(part[i[a : a + 65_536]] * c[j[a : a + 65_536]], axis=1)[:, -1] for a in range(0, len(i), 65_536)])
        n = sizes[j]
        row, score = np.repeat(i, n), np.repeat(exact, n)
        vec = flat[np.repeat(begin[j] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        other = vec != own[at + row]
        row, score, vec = row[other], score[other], vec[other]
        order = np.lexsort((vec, -score, row))
        row, score, vec = row[order], score[order], vec[order]
        first = np.searchsorted(row, row, "left")
        best = np.arange(len(row)) - first < k
        rows.append(at + row[best])
        found.append(vec[best])
        scores.append(score[best])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _placed(rows: DataFrame, router: Router) -> DataFrame:
    """``rows`` with ``part``, the most probable one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("part", pa.array(np.argmax(router(_matrix(batch.column("vec"))), axis=1).astype(np.int32)))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, part int")


def shelved(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The shelf of each part, neighbouring parts together while they hold at most ``most`` classes, and the number of blocks of each shelf."""
    shelf, filled, held = np.zeros(len(sizes), np.int64), [0], 0
    for part, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            filled.append(0)
            held = 0
        held += n
        filled[-1] = held
        shelf[part] = len(filled) - 1
    return shelf, np.maximum(-(-np.array(filled) // most), 1)


def _asked(rows: DataFrame, router: Router, shelf: np.ndarray) -> DataFrame:
    """A row of each query for each shelf that it visits, with the parts there."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                parts = np.sort(router.likely(_matrix(batch.column("vec"))), axis=1)
                row, on = np.repeat(np.arange(len(parts)), parts.shape[1]), shelf[parts].ravel()
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (on[1:] != on[:-1])))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(parts.ravel().astype(np.int32)))
                again = batch.take(pa.array(row[first]))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(on[first].astype(np.int32)), lists], names=["id", "vec", "shelf", "parts"])

    return rows.select("id", "vec").mapInArrow(run, f"id {kind}, vec array<double>, shelf int, parts array<int>")


def nearest_on_shelf(ours: pa.Table, theirs: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``nearest_in_block`` of queries with ``parts`` among classes with ``part``, each part by the queries that visit it."""
    own, q, c = ours.column("id").to_numpy(), _matrix(ours.column("vec")), _matrix(theirs.column("vec"))
    visits = ours.column("parts").combine_chunks()
    row, visited = np.repeat(np.arange(len(own)), visits.value_lengths().to_numpy()), visits.flatten().to_numpy()
    part, ids = theirs.column("part").to_numpy(), theirs.column("ids").to_pylist()
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for p in np.unique(part).tolist():
        at, there = row[visited == p], np.flatnonzero(part == p)
        if len(at):
            r, vec, score = nearest_in_block(q[at], c[there], [ids[i] for i in there.tolist()], own[at], k)
            found.append((at[r], vec, score))
    row, vec, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((vec, -score, row))
    row, vec, score = row[order], vec[order], score[order]
    best = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    return own[row[best]], vec[best], score[best]


def nearest_neighbours(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.95, sample: int = 8192, rows_per_part: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``df`` where ``queries`` (of the column ``id``) holds, the ``k`` other rows with the greatest inner product that were found in its parts,
    the nearest first, of equals the smaller id."""
    spark = df.sparkSession
    work = Workspace(spark, "nearest")
    kind = df.schema[id_col].dataType.simpleString()
    rows = work.write(usable(df, id_col, vec_col), "rows")
    classes = work.write(classes_of(rows, k + 1), "classes")
    drawn = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(sample).toArrow()
    if not drawn.num_rows:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    n = classes.count()
    # a part's share of the sample is 32 vectors at least
    levels = max(0, min(round(np.log2(max(n / rows_per_part, 1))), int(np.log2(max(drawn.num_rows / 32, 1)))))
    router = fit_router(_matrix(drawn.column("vec")), levels, k, recall)
    placed = work.write(_placed(classes, router), "placed")
    held = dict(placed.groupBy("part").count().collect())
    shelf, blocks = shelved(np.array([held.get(p, 0) for p in range(len(router.b2))]), _BLOCK)
    asked = work.write(_asked(rows.where(queries), router, shelf), "asked")
    visitors = dict(asked.groupBy("shelf").count().collect())
    spread = [(p, int(s), int(blocks[s]), -(-visitors.get(int(s), 0) // _CHUNK)) for p, s in enumerate(shelf)]
    tiles = spark.createDataFrame(spread, "part int, shelf int, n_block int, n_chunk int")
    # each class in its block, once for each chunk of queries, and each query in its chunk, once for each block
    own = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = placed.join(F.broadcast(tiles), "part").where("n_chunk > 0").withColumn("block", own("vec", F.col("n_block"))).select("part", "shelf", "block", upto("n_chunk").alias("chunk"), "vec", "ids")
    here = asked.join(F.broadcast(tiles.drop("part").distinct()), "shelf").withColumn("chunk", own("id", F.col("n_chunk"))).select("parts", "shelf", upto("n_block").alias("block"), "chunk", "id", "vec")
    meet = ["shelf", "block", "chunk"]

    def compare(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        id_type = ours.schema.field("id").type
        query, vec, score = nearest_on_shelf(ours, theirs, k) if ours.num_rows and theirs.num_rows else ([], [], [])
        return pa.table({"query_id": pa.array(query, id_type), "vec_id": pa.array(vec, pa.int64()).cast(id_type), "score": pa.array(score, pa.float64())})

    found = here.groupBy(*meet).cogroup(there.groupBy(*meet)).applyInArrow(compare, f"query_id {kind}, vec_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each vector of ``embeddings`` whose id is divisible by 20."""
    return nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 20 == 0)
