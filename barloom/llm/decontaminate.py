"""Benchmark decontamination by pigeonhole edit matching.

Item and document texts are compared lower-cased, with white space runs as one space. An item of m characters
may differ from a passage by k = min(m * error_rate, m / 16 - 1) edits, rounded down. Cut into k + 1 pieces, one piece
at least occurs unchanged in any such passage. Pieces (16 characters at least) are found by an Aho-Corasick automaton;
around each hit the whole item is verified by Myers' bit-parallel edit distance, with free ends in the document.

Items shorter than ``SHORT`` normalized characters say little about a text's origin. They are searched too, unchanged and between word ends only, and reported as
``short``; the filter drops no document for one of them unless it is told to.

Items go in blocks of at most ``block_chars`` characters, which pass over the driver one after another; the automaton of one block is
broadcast, so what is held and sent at a time has a fixed bound, and each block meets all documents. No pair is made but for a hit.

Null or empty documents match nothing, nor do null, empty or blank items. Items with equal text are each reported. Repeated documents are each reported. Other columns
of documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

PIECE, SHORT = 16, 24


def normalized(text: str) -> str:
    return " ".join(text.lower().split())


def budget(m: int, error_rate: float) -> int:
    return max(0, min(int(m * error_rate), m // PIECE - 1))


def myers(pattern: str, text: str, limit: int) -> tuple[int, int] | None:
    """The least edit distance of ``pattern`` to any part of ``text`` and the end of that part (the first of
    equals), or None if it is over ``limit``."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        x = eq | down
        d0 = (((eq & up) + up) ^ up) | x
        rise = down | (full & ~(d0 | up))
        fall = up & d0
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = rise << 1 & full  # the first row is free: no cost to start anywhere
        fall = fall << 1 & full
        up = fall | (full & ~(d0 | rise))
        down = rise & d0
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= limit else None


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 ranges that cover m characters, as equal as can be."""
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    return list(zip(cuts, cuts[1:], strict=False))


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[int, str], ...], error_rate: float):
    """Automaton of the pieces of a block; each has (item's place in the block, where the piece starts)."""
    import ahocorasick

    found: dict[str, list[tuple[int, int]]] = {}
    for place, (_, text) in enumerate(items):
        for a, b in pieces(len(text), budget(len(text), error_rate)):
            found.setdefault(text[a:b], []).append((place, a))
    automaton = ahocorasick.Automaton()
    for piece, where in found.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton


def _search(text: str, items: tuple[tuple[int, str], ...], automaton, error_rate: float) -> list[tuple[int, int, int, int, bool]]:
    """(item's number, edits, length of the normalized document, end of the match, short) for the best match of each item; for short ones the first."""
    windows: dict[int, list[list[int]]] = {}
    exact: dict[int, int] = {}  # short items: where their first match ends
    for end, (length, where) in automaton.iter(text):
        for place, a in where:
            m = len(items[place][1])
            if m < SHORT:
                if place not in exact and not (end + 1 > m and text[end - m].isalnum() or text[end + 1 : end + 2].isalnum()):
                    exact[place] = end + 1
                continue
            k = budget(m, error_rate)
            start = end + 1 - length - a  # where the item would start without edits
            lo, hi = max(0, start - k), min(len(text), start + m + k)
            spans = windows.setdefault(place, [])
            if spans and lo <= spans[-1][1] and spans[-1][0] <= hi:
                spans[-1] = [min(lo, spans[-1][0]), max(hi, spans[-1][1])]
            else:
                spans.append([lo, hi])
    out = [(items[place][0], 0, len(text), end, True) for place, end in exact.items()]
    for place, spans in windows.items():
        number, item = items[place]
        best = None
        for lo, hi in spans:
            got = myers(item, text[lo:hi], budget(len(item), error_rate))
            if got and (best is None or got[0] < best[0]):
                best = (got[0], lo + got[1])
        if best:
            out.append((number, best[0], len(text), best[1], False))
    return out


def benchmark_blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[tuple[tuple[int, str], ...]]:
    """Items with normalized texts in blocks of at most ``block_chars`` characters (one longer item is a block)."""
    block, size = [], 0
    for number, text in items.select(item_col, text_col).toLocalIterator():
        text = normalized(text or "")
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield tuple(block)
            block, size = [], 0
        block.append((number, text))
        size += len(text)
    if block:
        yield tuple(block)


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.06, block_chars: int = 4_000_000) -> DataFrame:
    """One row for each row of ``df`` and item that it contains: ``id_col``, ``item_col``, edits, match_end (in the
    normalized text), text_chars (its length), short. Where both ids have one name, the item's gets ``item_`` before it."""
    spark = df.sparkSession
    item_name = f"item_{item_col}" if item_col == id_col else item_col
    kinds = f"{id_col} {df.select(id_col).schema[0].dataType.simpleString()}, {item_name} {items.select(item_col).schema[0].dataType.simpleString()}, edits int, match_end long, text_chars long, short boolean"
    item_type = to_arrow_type(items.select(item_col).schema[0].dataType)
    docs = df.select(F.col(id_col), F.col(text_col).alias("text"))
    found = []
    for block in benchmark_blocks(items, item_col, item_text_col, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            automaton = _automaton(own, error_rate)
            for batch in batches:
                at, rows = [], []
                for i, text in enumerate(batch.column("text")):
                    if text.is_valid:
                        got = _search(normalized(text.as_py()), own, automaton, error_rate)
                        at += [i] * len(got)
                        rows += got
                numbers, edits, chars, ends, short = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(numbers, item_type), pa.array(edits, pa.int32()), pa.array(ends, pa.int64()), pa.array(chars, pa.int64()), pa.array(short, pa.bool_())],
                    names=[id_col, item_name, "edits", "match_end", "text_chars", "short"],
                )

        found.append(docs.mapInArrow(run, kinds))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kinds)


def drop_contaminated(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", error_rate: float = 0.06, short_too: bool = False, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``df``, all columns, without those that contain an item (a short one only if ``short_too``). Nothing is shuffled."""
    for block in benchmark_blocks(items, item_col, item_text_col, block_chars):
        sent = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(sent.value, error_rate)
            for batch in batches:
                clean = [not (t.is_valid and any(short_too or not x[-1] for x in _search(normalized(t.as_py()), sent.value, automaton, error_rate))) for t in batch.column(text_col)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, items).select("doc_id", "item_id", "edits", "match_end", "short")
