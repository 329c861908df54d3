"""Best-fit packing of tokenized documents into sequences, by the lengths of pieces.

Texts become token ids on the executors; documents longer than a sequence are cut. Pieces of one length are alike, and so are open sequences with one gap:

* The driver gets how many pieces there are of each length, a row for each length and so ``capacity`` rows at most. Best fit over falling lengths
  takes them in blocks: pieces of one length with numbers in a row go to sequences in a row that have the smallest gap which holds them, as many to a sequence as fit.
  A block empties a length or a gap, and a filled gap is less than half of what it was, so their number doesn't grow with the documents.
* Executors number the pieces of each length and look their blocks up; those give sequence and offset.

Where ``capacity`` allows more lengths than a driver should hold, pieces and gaps meet in bulk-synchronous rounds instead:

* They are range-sorted by size, together. Each partition sweeps its range from large to small: a piece takes its successor, the smallest gap that holds
  it; where several ask for one gap, the larger rank first. Gaps shrink and are swept again until nothing in the partition fits.
* What a partition has left is told to the driver in one row: how many pieces and how many untouched gaps, and their least and greatest
  sizes. Partitions are ranges, so all untouched gaps of a later one hold all pieces left in an earlier one; the successor sweep over these rows
  (pieces of a partition take the nearest gaps above, as many to a gap as fit for sure) gives ranges of ranks to ranges of gaps. Pieces
  and gaps find each other by a join on those ranks, and gaps are updated.
* When a round has placed nothing, as many sequences are opened as the rest needs at least.

Tables between the steps are written, so a lost executor costs its own tasks only. No list of pieces or gaps is ever on the driver or broadcast.

A null text is empty; an empty document is its end mark alone, one piece of length 1. Repeated rows are packed each. Ids may
be null or repeat. An empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import Workspace
from ._words import slices, split, utf8, word_hashes

#: Bytes of units: 1 letters whose small form is one letter of one or two bytes, 2 ASCII marks but the apostrophe (contractions are tokens).
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 2
_TIMES, _DIVIDED = 0x97, 0xB7  # the only signs behind 0xC3
_CACHE_UNITS = 2_000_000
#: Text bytes that are encoded at once. A worker's arrays take some 100 times as much beside its vocabulary and units.
_SLICE = 1 << 20
#: Lengths that the driver may hold counts of.
_LENGTHS = 1 << 16
_ENCODERS: dict[str, "Encoder"] = {}


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start and end of each unit, its row): runs between white space, where letters and the marks behind them are two units, small letters for
    capitals. Other runs are units as they are. The vocabulary's tokens never cross a unit's ends."""
    start, end, row = split(data, offsets)
    if not len(start):
        return data, start, end, row
    kind, small = _KIND[data], data.copy()
    small[(data >= 65) & (data <= 90)] += 32
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] != _TIMES) & (data[lead + 1] != _DIVIDED)]
    kind[lead] = kind[lead + 1] = 1
    small[lead[data[lead + 1] < 0x9F] + 1] += 32
    count = lambda mask, to: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.stack([start, to])], axis=0)[0]
    turns = kind[:-1] != kind[1:]
    plain = (kind[start] == 1) & (count(kind == 0, end) == 0) & (count(turns & (kind[1:] == 1), end - 1) == 0)
    cut = np.flatnonzero(turns & (kind[:-1] == 1) & (kind[1:] == 2)) + 1
    word = np.searchsorted(start, cut, "right") - 1
    cut = cut[plain[word] & (cut < end[word])]
    begin = np.sort(np.concatenate([start, cut]))
    word = np.searchsorted(start, begin, "right") - 1
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start[plain]] += 1
    inside[end[plain]] -= 1
    return np.where(np.cumsum(inside[:-1]) > 0, small, data), begin, np.minimum(np.append(begin[1:], len(data)), end[word]), row[word]


class Encoder:
    """Token ids of texts. A unit's ids don't depend on its neighbours, so units are encoded once and remembered by a 64-bit hash in sorted arrays; the memory
    is emptied when it gets large. Per occurrence of a unit there are only NumPy steps."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.first, self.count, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each followed by ``end_id`` if there is one, and the n + 1 places where texts begin and end."""
        if len(self.keys) > _CACHE_UNITS:
            self._forget()
        data, start, end, row = units(*utf8(texts))
        distinct, sample, which = np.unique(word_hashes(data, start), return_index=True, return_inverse=True)
        if len(self.keys):
            new = np.flatnonzero(self.keys[np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)] != distinct)
        else:
            new = np.arange(len(distinct))
        if len(new):
            raw = data.tobytes()
            self._learn(distinct[new], [raw[a:b].decode() for a, b in zip(start[sample[new]].tolist(), end[sample[new]].tolist(), strict=True)])
        place = np.searchsorted(self.keys, distinct)
        first, count = self.first[place][which], self.count[place][which].astype(np.int64)
        per_row = np.bincount(row, count, len(texts)).astype(np.int64)
        pool = self.pool
        if end_id is not None:
            behind = np.cumsum(np.bincount(row, minlength=len(texts)))
            first, count, per_row = np.insert(first, behind, len(pool)), np.insert(count, behind, 1), per_row + 1
            pool = np.append(pool, np.array([end_id], "<u4"))
        at = np.cumsum(count) - count
        return pool[np.repeat(first - at, count) + np.arange(int(count.sum()))], np.concatenate([[0], np.cumsum(per_row)])

    def _learn(self, hashes: np.ndarray, new: list[str]) -> None:
        """Adds units; ``hashes`` are sorted."""
        found = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
        count = np.bincount(np.array(found.word_ids, np.int64), minlength=len(new)).astype(np.int32)
        first = len(self.pool) + np.cumsum(count, dtype=np.int64) - count
        self.pool = np.append(self.pool, np.array(found.ids, "<u4"))
        keys = np.concatenate([self.keys, hashes])
        order = np.argsort(keys, kind="stable")  # two sorted runs
        self.keys, self.first, self.count = keys[order], np.concatenate([self.first, first])[order], np.concatenate([self.count, count])[order]


def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(df: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, tie): ``tie`` is another number for each piece. ``with_ids``: and ``ids``, its token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tie = TaskContext.get().partitionId() << 36
        for batch in batches:
            for rows in slices(batch, "text", _SLICE):
                ids, cuts = encoder(vocabulary).encode(rows.column("text"), end_id)
                n = -(-np.diff(cuts) // capacity)
                of = np.repeat(np.arange(rows.num_rows), n)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(np.diff(cuts)[of] - start, capacity)
                begin = (cuts[of] + start) * 4
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                columns = [rows.column("id").take(pa.array(of)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tie + np.arange(len(of)))]
                if with_ids:  # pieces stand one after another
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(cuts[of] + start, len(ids)).astype(np.int32)), pa.array(ids.view(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32", "tie", "ids"][: len(columns)])
                tie += len(of)

    id_type = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, piece int, start long, length long, ids_crc32 long, tie long{', ids array<int>' if with_ids else ''}")


def successors(pieces: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One sweep over sizes in falling order: (pieces, gaps) matched, each piece with the smallest gap that holds it and that no larger one has taken.

    That is a matching of brackets: a gap opens, a piece closes the latest that is open."""
    n = len(gaps)
    size, step = np.concatenate([gaps, pieces]), np.concatenate([np.ones(n, np.int64), np.full(len(pieces), -1)])
    order = np.lexsort((-step, -size))
    step = step[order]
    height = np.cumsum(step)
    floor = np.minimum.accumulate(np.minimum(height, 0))
    alone = (step < 0) & (floor < np.concatenate([[0], floor[:-1]]))  # no gap is open
    level = np.where(alone, -1, height - floor + (step < 0))
    by = np.argsort(level, kind="stable")
    level, step = level[by], step[by]
    met = np.flatnonzero((level[:-1] == level[1:]) & (level[:-1] >= 0) & (step[:-1] > 0) & (step[1:] < 0))
    return order[by[met + 1]] - n, order[by[met]]


def fill(pieces: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sweeps until nothing fits: each piece's gap (-1: none) and how much of it was taken before, and what is left of each gap."""
    left, owner, before = gaps.copy(), np.full(len(pieces), -1), np.zeros(len(pieces), np.int64)
    waiting, open_ = np.arange(len(pieces)), np.arange(len(gaps))
    while len(waiting):
        open_ = open_[left[open_] >= pieces[waiting].min()]
        p, g = successors(pieces[waiting], left[open_])
        if not len(p):
            break
        p, g = waiting[p], open_[g]
        owner[p], before[p] = g, gaps[g] - left[g]
        left[g] -= pieces[p]
        waiting = waiting[owner[waiting] < 0]
    return owner, before, left


_STATE = "kind int, size long, tie long, id {}, piece int, start long, ids_crc32 long, sequence_id long, offset long, part int, nth long"
_WAITING, _GAP, _PLACED = 0, 1, 2


def _settled(rows: DataFrame, capacity: int, schema: str) -> DataFrame:
    """Each partition of range-sorted pieces and gaps after its own sweeps; pieces left and untouched gaps are numbered from the largest on (``nth``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        table = pa.Table.from_batches(own)
        kind, size, tie = (table.column(c).to_numpy() for c in ("kind", "size", "tie"))
        pieces, gaps = (x[np.lexsort((tie[x], -size[x]))] for x in (np.flatnonzero(kind == _WAITING), np.flatnonzero(kind == _GAP)))
        owner, before, left = fill(size[pieces], size[gaps])
        placed, waits, untouched = owner >= 0, np.flatnonzero(owner < 0), np.flatnonzero(left == size[gaps])
        some = np.flatnonzero(left > 0)
        order = np.concatenate([pieces, gaps[some]])
        out_kind = np.concatenate([np.where(placed, _PLACED, _WAITING), np.full(len(some), _GAP)]).astype(np.int32)
        sequence, offset, nth = np.full(len(order), -1), np.full(len(order), -1), np.full(len(order), -1)
        mine = gaps[owner[placed]]
        sequence[: len(pieces)][placed], offset[: len(pieces)][placed] = tie[mine], capacity - size[mine] + before[placed]
        nth[waits] = np.arange(len(waits))
        place = np.full(len(gaps), -1)
        place[untouched] = np.arange(len(untouched))
        nth[len(pieces) :] = place[some]
        part = np.full(len(order), TaskContext.get().partitionId(), np.int32)
        kept = {c: table.column(c).take(pa.array(order)) for c in ("id", "piece", "start", "ids_crc32")}
        sizes = np.concatenate([size[pieces], left[some]])
        out = pa.table({"kind": out_kind, "size": sizes, "tie": tie[order], **kept, "sequence_id": sequence, "offset": offset, "part": part, "nth": nth})
        yield from out.combine_chunks().to_batches()

    return rows.repartitionByRange("size", "tie").mapInArrow(run, schema)


def plan_between(parts: list[dict]) -> list[tuple[int, int, int, int, int, int]]:
    """(part of pieces, first nth, last nth + 1, part of gaps, nth of the first gap, pieces to a gap) from what partitions have left, in the order of their
    ranges; the next gap has the nth before. Pieces take the nearest gaps above their partition."""
    out, above = [], []  # above: [part, untouched gaps, least size], the nearest last
    for p in sorted(parts, key=lambda p: -p["part"]):
        taken = 0
        while taken < p["pieces"] and above:
            q, n, least = above[-1]
            rest = p["pieces"] - taken
            each = min(rest, max(1, least // p["largest"]))
            used = min(n, rest // each)
            out.append((p["part"], taken, taken + used * each, q, n - 1, each))
            taken += used * each
            above[-1][1] -= used
            if not above[-1][1]:
                above.pop()
        if p["gaps"]:
            above.append([p["part"], p["gaps"], p["least"]])
    return out


def _exchanged(state: DataFrame, plan: list[tuple], capacity: int) -> DataFrame:
    """Pieces and gaps that the plan joins (a row or two for each partition), with gaps updated; the others as they are."""
    spark = state.sparkSession
    table = F.broadcast(spark.createDataFrame(plan, "p int, a long, b long, q int, g long, each long"))
    pieces = state.where(F.col("kind") == _WAITING).join(table, (F.col("part") == F.col("p")) & (F.col("nth") >= F.col("a")) & (F.col("nth") < F.col("b")), "left")
    nth_in = F.col("nth") - F.col("a")
    pieces = pieces.withColumns({"gap": F.col("g") - F.floor(nth_in / F.col("each")), "slot": nth_in % F.col("each") + 1})
    gaps = state.where(F.col("kind") == _GAP).join(table, (F.col("part") == F.col("q")) & (F.col("nth") <= F.col("g")) & (F.col("nth") > F.col("g") - (F.col("b") - F.col("a")) / F.col("each")), "left")
    gaps = gaps.withColumns({"gap": F.when(F.col("q").isNotNull(), F.col("nth")), "slot": F.lit(0).cast("long")})
    both = pieces.unionByName(gaps)
    near = Window.partitionBy("q", "gap").orderBy("slot")
    was = F.first("size").over(near)
    before = F.coalesce(F.sum(F.when(F.col("slot") > 0, F.col("size"))).over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.coalesce(F.sum(F.when(F.col("slot") > 0, F.col("size"))).over(near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0))
    met = both.where("q is not null").withColumns({"_sequence": F.first("tie").over(near), "_offset": F.lit(capacity) - was + before, "_left": was - taken})
    piece = F.col("slot") > 0
    met = met.withColumns({
        "kind": F.when(piece, F.lit(_PLACED)).otherwise(F.col("kind")), "size": F.when(piece, F.col("size")).otherwise(F.col("_left")),
        "sequence_id": F.when(piece, F.col("_sequence")).otherwise(F.col("sequence_id")), "offset": F.when(piece, F.col("_offset")).otherwise(F.col("offset")),
    }).where("size > 0")
    return met.select(state.columns).unionByName(both.where("q is null").select(state.columns))


def _opened(spark: SparkSession, first: int, number: int, capacity: int, schema: str) -> DataFrame:
    names = [x.split(" ", 1) for x in schema.split(", ")]
    given = {"kind": F.lit(_GAP), "size": F.lit(capacity), "tie": F.col("n") + first, "sequence_id": F.lit(-1), "offset": F.lit(-1), "part": F.lit(-1), "nth": F.lit(-1)}
    return spark.range(number).withColumnRenamed("id", "n").select(*(given.get(n, F.lit(None)).cast(t).alias(n) for n, t in names))


def length_plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best fit over falling lengths, from how many pieces there are of each length: blocks (length, first number, first sequence, pieces to a sequence, offset) in order of (length, first
    number). Numbers of a length count from 0; each block goes on to the next one's first number."""
    blocks, opened = [], 0
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, how many)
    gaps: list[int] = []  # those of open_ in order

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if not open_[gap]:
                insort(gaps, gap)
            open_[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        done, rest = 0, counts[length]
        while rest:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, number = open_[gap].pop()
                if not open_[gap]:
                    del gaps[at]
            else:
                gap, first, number = capacity, opened, -(-rest // (capacity // length))
                opened += number
            each = min(gap // length, rest)
            used = min(number, rest // each)
            blocks.append((length, done, first, each, capacity - gap))
            leave(gap - each * length, first, used)
            leave(gap, first + used, number - used)
            done, rest = done + used * each, rest - used * each
    return np.array(sorted(blocks), np.int64).reshape(-1, 5)


def _numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``nth``, their number from 0 among those of their length: counted by parts of each length, and carried over by what the parts before hold."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = ["length", "part"]
    rows = pieces.withColumn("part", F.pmod(F.xxhash64("tie"), F.lit(parts)).cast("int"))
    past = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).select(*own, F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*own).orderBy("tie")) - 1).join(before, own).withColumn("nth", F.col("nth") + F.col("before"))


def by_lengths(pieces: DataFrame, capacity: int, work: Workspace) -> DataFrame:
    """``best_fit`` by a plan over lengths."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    length, since, first, each, offset = length_plan(counts, capacity).T
    key = lambda size, nth: (size << 44) + nth
    begins = key(length, since)
    kept = ["id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            block = np.searchsorted(begins, key(size, nth), "right") - 1
            within = nth - since[block]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(first[block] + within // each[block]), pa.array(offset[block] + within % each[block] * size)], names=[*kept, "sequence_id", "offset"])

    kinds = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in kept)
    return work.write(_numbered(pieces).select(*kept, "nth").mapInArrow(place, f"{kinds}, sequence_id long, offset long"), "placed")


def best_fit(pieces: DataFrame, capacity: int, work: Workspace) -> DataFrame:
    """``pieces`` (id, piece, start, length, ids_crc32, tie) with sequence_id and offset."""
    return by_lengths(pieces, capacity, work) if capacity <= _LENGTHS else in_rounds(pieces, capacity, work)


def in_rounds(pieces: DataFrame, capacity: int, work: Workspace) -> DataFrame:
    """``best_fit`` without a count for each length."""
    spark = pieces.sparkSession
    schema = _STATE.format(pieces.schema["id"].dataType.simpleString())
    blank = {"kind": F.lit(_WAITING), "size": F.col("length"), "sequence_id": F.lit(-1), "offset": F.lit(-1), "part": F.lit(-1), "nth": F.lit(-1)}
    state = pieces.select(*(blank.get(n, F.col(n) if n in pieces.columns else F.lit(None)).cast(t).alias(n) for n, t in (x.split(" ", 1) for x in schema.split(", "))))
    whole = state.agg(F.sum("size")).first()[0] or 0
    opened = -(-whole // capacity)
    state = state.unionByName(_opened(spark, 0, opened, capacity, schema))
    done: list[DataFrame] = []
    while whole:
        settled = work.write(_settled(state.where(F.col("kind") != _PLACED), capacity, schema), "settled")
        kind, nth = F.col("kind"), F.col("nth")
        found = settled.groupBy("part").agg(
            F.count_if(kind == _WAITING).alias("pieces"), F.max(F.when(kind == _WAITING, F.col("size"))).alias("largest"), F.sum(F.when(kind == _WAITING, F.col("size"))).alias("waiting"),
            F.count_if((kind == _GAP) & (nth >= 0)).alias("gaps"), F.min(F.when((kind == _GAP) & (nth >= 0), F.col("size"))).alias("least"), F.count_if(kind == _PLACED).alias("placed"),
        ).collect()  # a row for each partition
        plan = plan_between([r.asDict() for r in found])
        done.append(settled.where(kind == _PLACED))
        waiting = sum(r["waiting"] or 0 for r in found)
        if not waiting:
            break
        if plan:
            state = work.write(_exchanged(settled.where(kind != _PLACED), plan, capacity), "exchanged")
            done.append(state.where(kind == _PLACED))
            if sum(b - a for _, a, b, *_ in plan) == sum(r["pieces"] for r in found):
                break
        else:
            state = settled
            if not any(r["placed"] for r in found):
                more = -(-waiting // capacity)
                state = state.unionByName(_opened(spark, opened, more, capacity, schema))
                opened += more
    if not done:
        done = [state]
    return reduce(DataFrame.unionByName, done).select("id", "piece", "start", F.col("size").alias("length"), "ids_crc32", "sequence_id", "offset")


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row for each piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset."""
    work = Workspace(df.sparkSession, "packing")
    pieces = work.write(token_pieces(df, id_col, text_col, vocabulary, capacity, end_id), "pieces")
    return best_fit(pieces, capacity, work).withColumnRenamed("id", id_col)


def packed(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The rows of ``pack`` with ``ids``, the token ids of each piece. A sequence's pieces stand together in one partition, in order of their offsets, so that one after another they are its tokens.

    Places are found from lengths alone and joined to the ids by the number of the piece; ids are shuffled to that join and to their sequences."""
    work = Workspace(df.sparkSession, "packing")
    pieces = work.write(token_pieces(df, id_col, text_col, vocabulary, capacity, end_id, with_ids=True), "pieces")
    numbers = pieces.select(F.col("tie").alias("id"), "piece", "start", "length", "ids_crc32", "tie")
    places = best_fit(numbers, capacity, work).select(F.col("id").alias("tie"), "sequence_id", "offset")
    rows = pieces.join(places.hint("merge"), "tie").select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")
    return rows.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_vocabulary())
