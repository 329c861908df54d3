"""Vectorised word and word-sequence hashing over the UTF-8 bytes of an Arrow string column.

Words are maximal runs of bytes other than space and 0x09-0x0D, so they equal ``[^\\x20\\x09-\\x0D]+``.
All arithmetic is modulo 2**64 on NumPy arrays; no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = U(0x9E3779B97F4A7C15 | 1)
_STEP = U(0xD6E8FEB86659FD93)
#: A value for each byte; separators count nothing.
_BYTE = np.random.default_rng(20240101).integers(1, 2**63, 256).astype(U) * U(2) + U(1)
_BYTE[_SEPARATOR] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows one after another, and the n + 1 offsets of rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    _, where, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``limit`` text bytes, or one longer row, so memory doesn't depend on batches."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and its row. A word never crosses a row's end."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~_SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each word."""
    if len(starts) == 0:
        return np.zeros(0, U)
    body = data[starts[0] :]
    at = starts - starts[0]
    lengths = np.diff(np.append(at, len(body)))
    place = np.arange(len(body), dtype=np.int32 if len(body) < 2**31 else np.int64) - np.repeat(at, lengths).astype(np.int32 if len(body) < 2**31 else np.int64)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, U))
    return mix(np.add.reduceat(_BYTE[body] * powers[place], at))


def doubled(hashes: np.ndarray, levels: int) -> list[np.ndarray]:
    """Hashes of 1, 2, 4 ... 2**levels consecutive values from each place; the last places hold no full sequence."""
    out, step = [hashes], int(_STEP)
    for level in range(levels):
        width, last = 1 << level, out[-1]
        nxt = last * U(step)
        nxt[: len(last) - width] += last[width:] if len(last) > width else 0
        out.append(nxt)
        step = step * step % 2**64
    return out
