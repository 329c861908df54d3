"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

A document is the weighted set of its five-word shingles (weight: how often the shingle occurs; fewer than
five words make one shingle). Its weighted Jaccard similarity with another is sum(min) / sum(max).

DartMinHash: each unit of an element's weight is a region over which darts fall, at ranks that form a Poisson
process drawn from the element's hash alone. A set keeps the darts of rank below t / (total weight), with
t = k ln k + 2k, so about t darts whatever its size; each dart hits one of k coordinates by its hash, and the
earliest of a coordinate is the signature there. Two sets agree in a coordinate with the probability of their
similarity. Sets with an empty coordinate go on to later ranks.

Candidates: ``bands`` keys of ``rows`` coordinates each. With 36 x 7 a pair of similarity 0.8 shares a key with
probability 0.9998, one of 0.5 with 0.25. Exact copies are merged first, by their text's digest. In each bucket
every member is compared with the bucket's pivot, the member that meets most others. Then, where members of a pivot's
buckets are left in other components than the pivot's, they are compared with each other and with those inside it, block against block of
about ``BLOCK`` members inside a task, so that a large group spreads over tasks; a task gives out a spanning forest of the links it has
verified, so a group gives rows in proportion to its members. So each candidate pair of a bucket is either compared or already joined. Pairs whose
signatures say at least 4.5 standard errors less than the threshold are left out; the others are verified exactly from both texts.

Null texts are near nobody: each such row is a class by itself (its id; null ids together). Texts without words
are equal to the same text only. Ties: a class is named by its least id. Rows may repeat; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._components import components
from ._shared import Workspace, small_batches
from ._words import U, doubled, mix, slices, split, utf8, word_hashes

#: Members of a block, and about how many words their texts have.
BLOCK, BLOCK_WORDS = 512, 1 << 18
#: Text bytes whose shingles and darts are made at once. A worker's arrays take some 200 times as much.
_SLICE = 1 << 18
_END = U(0xB5AD4ECEDA1CE2A9)
_GOLD = U(0x9E3779B97F4A7C15)


def unit_cells(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key for each unit of weight of each row's shingles, and its row. Keys differ within a row: the
    second occurrence of a shingle has another key than the first."""
    starts, _, row = split(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(np.concatenate([[0], counts + size]))[:-1]
    words = np.full(int(counts.sum()) + size * n, _END, U)
    within = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    words[first[row] + within] = word_hashes(data, starts)
    shingles = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    of = np.repeat(np.arange(n), shingles)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    level, value = doubled(words, size.bit_length() - 1), np.zeros(len(at), U)
    for bit in range(size.bit_length()):
        if size >> bit & 1:
            value = mix(value ^ level[bit][at]) + _GOLD
            at = at + (1 << bit)
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
    where = np.flatnonzero(new)
    occurrence = np.arange(len(value)) - np.repeat(where, np.diff(np.append(where, len(value))))
    return mix(value ^ mix(occurrence.astype(U) * _GOLD)), of


def dart_signatures(cells: np.ndarray, of: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k: the hash of the earliest dart of each coordinate; rows without cells stay zero."""
    signature = np.zeros(n * k, U)
    weight = np.bincount(of, minlength=n)
    todo, darts = np.flatnonzero(weight > 0), k * log(k) + 2 * k
    while len(todo):
        limit = np.zeros(n)
        limit[todo] = darts / weight[todo]
        chosen = limit[of] > 0
        cell, row = cells[chosen], of[chosen]
        blocks = np.ceil(limit[row]).astype(np.int64)  # ranks in units; each unit has its own process
        which = np.repeat(np.arange(len(cell)), blocks)
        unit = np.arange(len(which)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        key, row = mix(cell[which] + unit.astype(U) * _GOLD), row[which]
        arrival, unit = np.zeros(len(key)), unit.astype(float)
        group, rank, dart, step = [], [], [], 0
        while len(key):
            step += 1
            h = mix(key + U(step * 0xD1342543DE82EF95 % 2**64))
            arrival = arrival - np.log(((h >> U(11)).astype(float) + 0.5) * 2.0**-53)
            keep = (arrival < 1) & (unit + arrival < limit[row])
            key, row, arrival, unit, h = key[keep], row[keep], arrival[keep], unit[keep], mix(h[keep])
            group.append(row * k + (h % U(k)).astype(np.int64))
            rank.append(unit + arrival)
            dart.append(h)
        group, rank, dart = np.concatenate(group), np.concatenate(rank), np.concatenate(dart)
        earliest = np.full(n * k, np.inf)
        np.minimum.at(earliest, group, rank)
        first = rank == earliest[group]
        full = np.zeros(n, bool)
        full[todo] = np.isfinite(earliest.reshape(n, k)[todo]).all(axis=1)
        first &= full[group // k]
        signature[group[first]] = dart[first]
        todo, darts = todo[~full[todo]], darts * 2
    return signature.reshape(n, k)


def _sketches(texts: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                cells, of = unit_cells(*utf8(part.column("text")), size)
                weight = np.bincount(of, minlength=part.num_rows)
                has = np.flatnonzero(weight)
                signature = dart_signatures(cells, of, part.num_rows, k)[has]
                keys = np.empty((len(has), bands), U)
                for b in range(bands):
                    value = np.full(len(has), b, U)
                    for c in range(b * rows, (b + 1) * rows):
                        value = mix(value ^ signature[:, c]) + _GOLD
                    keys[:, b] = value
                low = signature.astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("tid").take(pa.array(has)),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64))),
                        pa.array([low[i * k : (i + 1) * k] for i in range(len(has))], pa.binary()),
                        pa.array(weight[has].astype(np.int64)),
                    ],
                    names=["tid", "keys", "low", "weight"],
                )

    return texts.mapInArrow(run, "tid binary, keys array<long>, low binary, weight long")


def _least_alike(threshold: float, k: int) -> float:
    return threshold - 4.5 * sqrt(threshold * (1 - threshold) / k)


def _likely(pairs: DataFrame, sketches: DataFrame, threshold: float, k: int) -> DataFrame:
    """The pairs (a, b) that their signatures and weights don't rule out."""
    least = _least_alike(threshold, k)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, k) for c in ("la", "lb"))
                alike = ((x == y).mean(axis=1) - 1 / 256) * 256 / 255  # one low byte in 256 agrees by chance
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("a", "b")], names=["a", "b"]).filter(pa.array(alike >= least))

    side = lambda c: sketches.select(F.col("tid").alias(c), F.col("low").alias(f"l{c}"), F.col("weight").alias(f"w{c}"))
    weighed = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("wa", "wb") >= F.greatest("wa", "wb") * threshold)
    return weighed.select("a", "b", "la", "lb").mapInArrow(weigh, "a binary, b binary")


def _meets(dealt: DataFrame) -> DataFrame:
    """A row for each pair of blocks that a member of an open group meets in: (i, j, far), blocks of the members outside the pivot's component
    with each other, or (far) with those inside it. Members inside it are never compared among themselves."""
    blocks = lambda inside: F.greatest(F.ceil(F.count_if(inside) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(inside, F.col("weight"))), F.lit(0)) / BLOCK_WORDS), F.lit(1)).cast("int")
    away = F.col("label") != F.col("home")
    sizes = dealt.groupBy("pivot").agg(F.count_if(away).alias("away"), blocks(away).alias("n_away"), blocks(~away).alias("n_home")).where("away > 0")
    keyed = lambda df: df.withColumn("h", F.xxhash64("pivot"))  # noqa: E731  another step than the sums, so that Spark may split a large group
    rows = keyed(dealt).join(keyed(sizes).hint("merge"), ["pivot", "h"]).withColumn("own", F.pmod(F.xxhash64("tid"), F.when(away, F.col("n_away")).otherwise(F.col("n_home"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    near = F.transform(upto("n_away"), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), F.lit(False).alias("far")))
    far = F.transform(upto("n_home"), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("far")))
    home = F.transform(upto("n_away"), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(True).alias("far")))
    return rows.select("pivot", "tid", "label", away.alias("away"), "own", F.explode(F.when(away, F.concat(near, far)).otherwise(home)).alias("meet"))


def _forest(rows: pa.Table, threshold: float, k: int, size: int) -> list[tuple[bytes, bytes]]:
    """Links between different labels of one pair of blocks, no more than join them: each is verified from both texts' cells."""
    meet = rows.column("meet")[0].as_py()
    away, own = (np.array(rows.column(c).to_pylist()) for c in ("away", "own"))
    left = np.flatnonzero(away & (own == meet["i"]))
    right = np.flatnonzero(~away) if meet["far"] else np.flatnonzero(away & (own == meet["j"]))
    within = not meet["far"] and meet["i"] == meet["j"]
    if not len(left) or not len(right):
        return []
    tids, labels = rows.column("tid").to_pylist(), rows.column("label").to_pylist()
    number = {x: i for i, x in enumerate(dict.fromkeys(labels))}
    label = np.array([number[x] for x in labels])
    root = np.arange(len(number))  # of each label
    low = np.frombuffer(b"".join(rows.column("low").to_pylist()), np.uint8).reshape(-1, k)
    cell, of = unit_cells(*utf8(rows.column("text")), size)
    order = np.lexsort((cell, of))
    cell, of = cell[order], of[order]
    weight = np.bincount(of, minlength=len(tids))
    first = np.cumsum(weight) - weight
    least, out = _least_alike(threshold, k), []
    for at, m in enumerate(left.tolist()):
        others = right[at + 1 :] if within else right
        alike = ((low[m] == low[others]).mean(axis=1) - 1 / 256) * 256 / 255
        possible = (alike >= least) & (np.minimum(weight[m], weight[others]) >= np.maximum(weight[m], weight[others]) * threshold)
        others = others[possible][np.argsort(-alike[possible], kind="stable")]
        mine = cell[first[m] : first[m] + weight[m]]
        while len(others := others[root[label[others]] != root[label[m]]]):
            ask, others = others[:32], others[32:]
            n = weight[ask]
            begin = np.cumsum(n) - n
            theirs = cell[np.repeat(first[ask] - begin, n) + np.arange(int(n.sum()))]
            both = np.add.reduceat((mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs).astype(np.int64), begin)
            for q in ask[both / (weight[m] + n - both) >= threshold].tolist():
                a, b = root[label[m]], root[label[q]]
                if a != b:
                    root[root == b] = a
                    out.append((min(tids[m], tids[q]), max(tids[m], tids[q])))
    return out


def _left_open(members: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: float, k: int, size: int) -> DataFrame:
    """Links (a, b) that join different labels among ``members`` (pivot, tid, label, home): documents that share a bucket share its pivot, so
    the pairs of a pivot's group hold all of its buckets' pairs. Every pair of blocks gives out a spanning forest of its verified links, so fewer rows
    than it got, never pairs."""
    weighed = members.join(sketches.select("tid", "low", "weight").hint("merge"), "tid")
    meets = _meets(weighed.select("pivot", "tid", "label", "home", "weight"))
    whole = meets.join(sketches.select("tid", "low").hint("merge"), "tid").join(texts.hint("merge"), "tid")
    # blocks stand together: a task reads one after another
    dealt = whole.select("pivot", "meet", "away", "own", "tid", "label", "low", "text").repartition("pivot", "meet").sortWithinPartitions("pivot", "meet")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []

        def close() -> pa.RecordBatch:
            found = _forest(pa.Table.from_batches(group), threshold, k, size) if group else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            keys = [(p, m["i"], m["j"], m["far"]) for p, m in zip(batch.column("pivot").to_pylist(), batch.column("meet").to_pylist(), strict=True)]
            begin = 0
            for i, key in enumerate(keys):
                if key != now:
                    if i > begin:
                        group.append(batch.slice(begin, i - begin))
                    if group:
                        yield close()
                    now, group, begin = key, [], i
            if len(keys) > begin:
                group.append(batch.slice(begin))
        if group:
            yield close()

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def _texts_of(named: DataFrame, texts: DataFrame, work: Workspace) -> DataFrame:
    """One text for each tid of the written table ``named``: texts stay where they are while that is small. Joined by the tid and its hash and merged in another step, so that
    Spark may split a text with very many copies."""
    h = F.xxhash64("tid").alias("h")
    found = texts.select("tid", h, "text").join(work.joinable(named).select("tid", h), ["tid", "h"], "left_semi")
    return work.write(found.groupBy("tid").agg(F.first("text").alias("text")), "texts")


def _verified(likely: DataFrame, needed: DataFrame, threshold: float, size: int, work: Workspace) -> DataFrame:
    """The pairs (a, b) whose texts' similarity reaches the threshold, with it."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta", _SLICE):
                (x, i), (y, j) = (unit_cells(*utf8(part.column(c)), size) for c in ("ta", "tb"))
                cell, of = np.concatenate([x, y]), np.concatenate([i, j])
                order = np.lexsort((cell, of))
                cell, of = cell[order], of[order]
                same = (cell[1:] == cell[:-1]) & (of[1:] == of[:-1])
                n = part.num_rows
                both = np.bincount(of[1:][same], minlength=n)
                similarity = both / np.maximum(np.bincount(i, minlength=n) + np.bincount(j, minlength=n) - both, 1)
                out = pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(similarity)], names=["a", "b", "similarity"])
                yield out.filter(pa.array(similarity >= threshold))

    text = lambda c: needed.select(F.col("tid").alias(c), F.col("text").alias(f"t{c}")).hint("merge")
    return work.write(likely.join(text("a"), "a").join(text("b"), "b").mapInArrow(compare, "a binary, b binary, similarity double"), "links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, size: int = 5, bands: int = 36, rows: int = 7) -> DataFrame:
    """One row for each row of ``df``: ``id_col``, class_id (the least id of its class), tid (digest of its text,
    null for null), class_tid (digest of a text of the row that names the class). Classes are connected components."""
    work = Workspace(df.sparkSession, "neardup")
    small_batches(df.sparkSession)
    rows_in = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("tid", F.unhex(F.md5("text")))
    texts = rows_in.where("tid is not null").select("tid", "text")
    sketches = work.write(_sketches(texts, bands, rows, size).dropDuplicates(["tid"]), "sketches")
    members = sketches.select("tid", F.explode("keys").alias("key"))
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = work.write(members.join(buckets.hint("merge"), "key"), "crowded")
    # the text that meets most others stands in the middle of its copies
    met = work.write(crowded.groupBy("tid").agg(F.sum("n").alias("met")), "met")
    middle = crowded.join(met.hint("merge"), "tid").groupBy("key").agg(F.max(F.struct("met", "tid")).alias("middle")).select("key", F.col("middle.tid").alias("pivot"))
    # a pivot's group: whoever shares a bucket of which it is the middle
    groups = work.write(crowded.join(middle.hint("merge"), "key").groupBy("pivot", "tid").agg(F.max("n").alias("n")), "groups")
    work.drop(crowded)
    stars = groups.where("tid <> pivot").select(F.least("pivot", "tid").alias("a"), F.greatest("pivot", "tid").alias("b")).distinct()
    k = bands * rows
    needed = _texts_of(met, texts, work)
    links = _verified(work.write(_likely(stars, sketches, threshold, k), "likely"), needed, threshold, size, work)
    found = components(links.select("a", "b"), work)
    # what the pivots left open; a bucket of two has no more than the pair that was compared
    label = lambda column, name: found.select(F.col("node").alias(column), F.col("root").alias(name))
    labelled = groups.where("n > 2").join(label("tid", "root"), "tid", "left").join(label("pivot", "center"), "pivot", "left")
    labelled = labelled.select("pivot", "tid", F.coalesce("root", "tid").alias("label"), F.coalesce("center", "pivot").alias("home"))
    more = work.write(_left_open(labelled, sketches, needed, threshold, k, size), "forest")
    if not more.isEmpty():
        found = components(links.select("a", "b").union(more), work)
    firsts = rows_in.where("tid is not null").groupBy("tid").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    placed = work.write(firsts.join(found.withColumnRenamed("node", "tid"), "tid", "left").withColumn("root", F.coalesce("root", "tid")), "placed")
    classes = placed.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("last"), "first", "tid")).alias("head"))
    named = placed.join(classes, "root").select("tid", F.col("head.first").alias("class_id"), F.col("head.tid").alias("class_tid"))
    keyed = lambda df: df.withColumn("h", F.xxhash64("tid"))  # noqa: E731  what comes after is another step, so that Spark may split a text with very many copies
    out = keyed(rows_in.select("id", "tid")).join(keyed(named).hint("merge"), ["tid", "h"], "left").withColumn("class_id", F.when(F.col("tid").isNull(), F.col("id")).otherwise(F.col("class_id")))
    return out.select(F.col("id").alias(id_col), "class_id", "tid", "class_tid")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``df``, all columns, without all but one row of each class: the one with the least id. Null texts stay."""
    work = Workspace(df.sparkSession, "neardrop")
    classes = near_duplicates(df, id_col, text_col, **settings).where("tid is not null")
    counted = classes.groupBy("tid").agg(F.first("class_id").alias("class_id"), F.first("class_tid").alias("class_tid"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(id_col).eqNullSafe(F.col("class_id"))).alias("heads"))
    losing = work.write(counted.where((F.col("tid") != F.col("class_tid")) | (F.col("rows") > 1)), "losing")
    # by the digest and its hash, so that what follows is another step and Spark may split a text with very many copies
    keyed = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col))).alias("tid")).withColumn("h", F.xxhash64("tid"))
    tagged = keyed.join(work.joinable(losing).withColumn("h", F.xxhash64("tid")), ["tid", "h"], "left")
    stays = F.col("class_tid").isNull() | ((F.col("tid") == F.col("class_tid")) & F.col("id").eqNullSafe(F.col("class_id")))
    tagged = tagged.where(stays)
    # several rows with the same id and text: any one of them stays
    many = tagged.where("heads > 1").dropDuplicates(["tid"])
    return tagged.where("heads is null or heads <= 1").unionByName(many).select("row.*")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", "class_id")
