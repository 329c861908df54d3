"""Media columns: AVI files of motion-JPEG frames that hold bytes losslessly, and clips found in them.

Writing: bytes are padded with zeros to a positive multiple of 64 and become the 8 x 8 blocks of grey frames, ``COLUMNS`` by
``ROWS`` blocks each, one byte a block: the block has that grey level throughout. Its DC coefficient with a quantizer of 8 is
the level less 128, so a baseline JPEG stores it exactly. Each row of blocks is a restart interval. The file has the
usual RIFF lists (hdrl with avih, strh, strf and strd, movi, idx1); strd holds the payload's length.

Reading: the RIFF tree and idx1 give the frames; JPEG segments give tables and sizes; all restart intervals of a batch are
decoded together, one block a step. Any baseline stream that carries its tables is read, grey or in colour with interleaved components: frames yield the
pixels of their first component, by dequantization and the inverse cosine transform; where all blocks are flat, one value a block is enough. Anything else (no
file, progressive, without tables, truncated or damaged) gives a row whose ``error`` says what is wrong and whose other columns read from the file are null; files are decoded together, and one by one where that fails, so one bad file costs no other.

Shots: a frame's histogram of 16 levels is compared with the one before (half the summed absolute differences, as a share). A
cut is where that exceeds the mean of the last ``span`` differences of the shot plus ``factor`` standard deviations, and ``least``. Clips are
the frames between cuts, with times by the file's frame rate.

Frames are coded and decoded ``AT_ONCE`` at a time, whatever the size of a file. Null and empty texts become 64 zero bytes. Equal texts give equal files and features. Repeated rows each give a row; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import slices, utf8

COLUMNS, ROWS, RATE = 64, 8, 25
_BLOCKS = COLUMNS * ROWS
AT_ONCE = 1024

#: Huffman tables of the writer: numbers of codes of 1 to 16 bits, then symbols. DC: size of the difference. AC: end of block only.
_DC_COUNTS, _DC_SYMBOLS = [0, 0, 7, 1, 1] + [0] * 11, [5, 4, 7, 3, 6, 2, 0, 1, 8]
_AC_COUNTS, _AC_SYMBOLS = [1] + [0] * 15, [0]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_JPEG_HEAD = b"\xff\xd8" + b"".join(
    [
        _segment(0xDB, b"\0" + bytes([8] * 64)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, ROWS * 8, COLUMNS * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\0" + bytes(_DC_COUNTS + _DC_SYMBOLS)),
        _segment(0xC4, b"\x10" + bytes(_AC_COUNTS + _AC_SYMBOLS)),
        _segment(0xDD, struct.pack(">H", COLUMNS)),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ]
)


def _codes(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, bits)"""
    out, code, k = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """For differences from -255 to 255: bits of a whole block (DC, then end of block) and their number."""
    dc, (end, end_bits) = _codes(_DC_COUNTS, _DC_SYMBOLS), _codes(_AC_COUNTS, _AC_SYMBOLS)[0]
    value, bits = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        value[d + 255] = ((code << size | extra) << end_bits) | end
        bits[d + 255] = n + size + end_bits
    return value, bits


_VALUE, _BITS = _block_codes()


def _entropy(frames: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Coded data of frames (n x ROWS x COLUMNS bytes), each interval with the marker after it, and where frames end."""
    level = frames.reshape(-1, COLUMNS).astype(np.int64) - 128
    d = np.diff(level, axis=1, prepend=0) + 255
    bits, value = _BITS[d], _VALUE[d]
    used = bits.sum(axis=1)
    size = (used + 7) // 8
    pad = size * 8 - used  # an interval ends in ones
    bits = np.column_stack([bits, pad])
    value = np.column_stack([value, (1 << pad) - 1])
    begin = np.cumsum(size) - size
    at = (begin * 8)[:, None] + np.cumsum(bits, axis=1) - bits
    byte = (at >> 3).ravel()
    word = (value << (32 - bits - (at & 7))).ravel()
    total = int(size.sum())
    data = sum(np.bincount(byte + k, (word >> (24 - 8 * k)) & 255, total + 4) for k in range(4))[:total].astype(np.uint8)
    full = data == 255
    row = np.repeat(np.arange(len(size)), size)
    shift = np.cumsum(full) - full + 2 * row
    out = np.zeros(total + int(full.sum()) + 2 * len(size), np.uint8)
    out[np.arange(total) + shift] = data  # a zero stays behind each 255
    ends = np.cumsum(size + np.bincount(row[full], minlength=len(size)) + 2)
    marker = np.arange(len(size)) % ROWS
    out[ends - 2], out[ends - 1] = 255, np.where(marker == ROWS - 1, 0xD9, 0xD0 + marker % 8)
    return out.tobytes(), ends[ROWS - 1 :: ROWS]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avis(payloads: list[bytes]) -> list[bytes]:
    """AVI files that hold the payloads, whose lengths are multiples of 64."""
    counts = [-(-len(p) // _BLOCKS) for p in payloads]
    data = np.frombuffer(b"".join(p.ljust(n * _BLOCKS, b"\0") for p, n in zip(payloads, counts, strict=True)), np.uint8)
    frames, coded, cuts = data.reshape(-1, ROWS, COLUMNS), bytearray(), [0]
    for k in range(0, len(frames), AT_ONCE):
        some, ends = _entropy(frames[k : k + AT_ONCE])
        cuts += (ends + len(coded)).tolist()
        coded += some
    out, k = [], 0
    for payload, n in zip(payloads, counts, strict=True):
        chunks = [_chunk(b"00dc", _JPEG_HEAD + bytes(coded[cuts[i] : cuts[i + 1]])) for i in range(k, k + n)]
        k += n
        sizes = np.array([len(c) for c in chunks], np.int64)
        index = np.zeros((n, 4), "<u4")
        index[:, 0], index[:, 1] = int.from_bytes(b"00dc", "little"), 0x10
        index[:, 2] = 4 + np.cumsum(sizes) - sizes
        index[:, 3] = [struct.unpack_from("<I", c, 4)[0] for c in chunks]
        width, height = COLUMNS * 8, ROWS * 8
        avih = struct.pack("<14I", 1_000_000 // RATE, 0, 0, 0x10, n, 0, 1, 0, width, height, 0, 0, 0, 0)
        strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, RATE, 0, n, 0, 0xFFFFFFFF, 0, 0, 0, width, height)
        strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
        stream = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", len(payload)))
        head = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", stream)
        out.append(_chunk(b"RIFF", b"AVI " + _chunk(b"LIST", head) + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", index.tobytes())))
    return out


def _chunks(data: bytes, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, last byte + 1) of the chunks of a list; lists have the name of their kind."""
    while begin + 8 <= end:
        name, size = data[begin : begin + 4], struct.unpack_from("<I", data, begin + 4)[0]
        first, last = begin + 8, begin + 8 + size
        if last > end:
            raise ValueError("a chunk runs over the end of its list")
        yield (data[first : first + 4], first + 4, last) if name == b"LIST" else (name, first, last)
        begin = last + size % 2


def parse_avi(data: bytes) -> tuple[list[tuple[int, int]], float, int | None]:
    """Byte ranges of the frames by idx1, whose offsets count from the list of frames or from the file, or by the standard indexes that an index of the stream names (OpenDML); frames a second, and
    the length in strd (None without it)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, length, movi, index, streams = float(RATE), None, None, None, []
    todo = [(12, 8 + struct.unpack_from("<I", data, 4)[0])]
    while todo:
        for name, a, b in _chunks(data, *todo.pop()):
            if name in (b"hdrl", b"strl"):
                todo.append((a, b))
            elif name == b"movi":
                movi = a - 4 if movi is None else movi
            elif name == b"indx":
                streams.append((a, b))
            elif name == b"idx1":
                index = np.frombuffer(data[a:b], "<u4").reshape(-1, 4)
            elif name == b"strh":
                scale, per = struct.unpack_from("<II", data, a + 20)
                rate = per / max(scale, 1)
            elif name == b"strd" and b - a == 8:
                length = struct.unpack_from("<Q", data, a)[0]
    if movi is None or (index is None and not streams):
        raise ValueError("no frames or no index")
    if index is None:
        return [span for a, b in streams for span in _indexed_frames(data, a, b)], rate, length
    video = index[(index[:, 0] >> 16) == int.from_bytes(b"dc", "little")].astype(np.int64)
    base = movi
    if len(video) and data[movi + video[0, 2] : movi + video[0, 2] + 4] != video[0, 0].astype("<u4").tobytes() and data[video[0, 2] : video[0, 2] + 4] == video[0, 0].astype("<u4").tobytes():
        base = 0
    return [(base + o + 8, base + o + 8 + n) for o, n in video[:, 2:].tolist()], rate, length


def _indexed_frames(data: bytes, a: int, b: int) -> list[tuple[int, int]]:
    """Byte ranges of a stream's frames: of a standard index, or of all those that a super index names."""
    width, _, kind, n, name = struct.unpack_from("<HBBI4s", data, a)
    if name[2:] != b"dc":
        return []
    if kind == 0:
        if width != 4 or a + 24 + 16 * n > b:
            raise ValueError("an index of another form")
        parts = [struct.unpack_from("<QII", data, a + 24 + 16 * i)[:2] for i in range(n)]
        return [span for at, size in parts for span in _indexed_frames(data, at + 8, at + size)]
    if kind != 1 or width != 2 or a + 24 + 8 * n > min(b, len(data)):
        raise ValueError("an index of another form")
    base = struct.unpack_from("<Q", data, a + 12)[0]
    entries = np.frombuffer(data, "<u4", 2 * n, a + 24).reshape(-1, 2).astype(np.int64)
    return [(base + o, base + o + (size & 0x7FFFFFFF)) for o, size in entries.tolist()]


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits that may come: symbol * 32 + bits of the code they begin with; 0 where none does."""
    out = np.zeros(1 << 16, np.int64)
    for symbol, (code, bits) in _codes(list(table[:16]), list(table[16:])).items():
        out[code << (16 - bits) : (code + 1) << (16 - bits)] = symbol * 32 + bits
    return out


class Head(NamedTuple):
    """What a baseline frame's headers say."""

    across: int  # units of the scan, each with the blocks of all components
    down: int
    blocks: tuple[int, ...]  # of each component in a unit
    quantizer: tuple[int, ...]  # of the first component, in the order of the stream
    tables: tuple[tuple[bytes, bytes], ...]  # DC and AC of each component
    interval: int  # units between restarts


# Fixed values of the JPEG standard, annex K.3: numbers of Huffman codes of 1 to 16 bits, and their symbols in order. Frames of motion JPEG without tables mean these. Runs and sizes of
# coefficients go on in ascending order behind those listed.
_DC_LENGTHS = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0))
_AC_LENGTHS = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119))
_AC_FIRST = (
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82",
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
)


def standard_tables() -> dict[int, bytes]:
    """Huffman tables by their class and number, as segments that define them would say."""
    tables = {}
    for k in (0, 1):
        first = bytes.fromhex(_AC_FIRST[k])
        rest = bytes(x for x in sorted({0x00, 0xF0, *(run * 16 + size for run in range(16) for size in range(1, 11))}) if x not in first)
        tables[k], tables[16 + k] = bytes(_DC_LENGTHS[k]) + bytes(range(12)), bytes(_AC_LENGTHS[k]) + first + rest
    return tables


@lru_cache(maxsize=256)
def _jpeg_head(head: bytes) -> Head:
    at, quantizer, tables, interval, parts, wide, high = 2, {}, standard_tables(), 0, [], 0, 0
    while at + 4 <= len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                width, k = 1 + (body[0] >> 4), body[0] & 15
                quantizer[k] = tuple(int.from_bytes(body[1 + i * width : 1 + (i + 1) * width], "big") for i in range(64))
                body = body[1 + 64 * width :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            precision, high, wide, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or not wide or not high:
                raise ValueError("not 8 bits a sample, or no size")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not baseline")
        elif marker == 0xDA:
            own = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if not parts or [c for c, *_ in own] != [c for c, *_ in parts] or any(dc not in tables or 16 + ac not in tables for _, dc, ac in own) or parts[0][3] not in quantizer:
                raise ValueError("not one scan of all components with its own tables")
            if len(parts) == 1:
                parts = [(parts[0][0], 1, 1, parts[0][3])]
            if not all(0 < x <= 4 for _, h, v, _ in parts for x in (h, v)):
                raise ValueError("sampling factors")
            across, down = (-(-n // (8 * max(x[i] for x in parts))) for n, i in ((wide, 1), (high, 2)))
            return Head(across, down, tuple(h * v for _, h, v, _ in parts), quantizer[parts[0][3]], tuple((tables[dc], tables[16 + ac]) for _, dc, ac in own), interval or across * down)
        at += 2 + size
    raise ValueError("no scan")


def _scan_start(frame: bytes) -> int:
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    return at + 2 + struct.unpack_from(">H", frame, at + 2)[0]


#: Places of coefficients in a block, in the order of the stream, and the inverse cosine transform of a row.
_ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
_COSINES = np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(0.125), 0.5)[:, None]


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """The grey levels of each frame: of its blocks in the order of the scan if all blocks of its like are flat, else of all their pixels."""
    groups: dict[Head, list[int]] = {}
    starts = []
    for i, frame in enumerate(frames):
        starts.append(len(_JPEG_HEAD) if frame.startswith(_JPEG_HEAD) else _scan_start(frame))
        groups.setdefault(_jpeg_head(frame[: starts[-1]]), []).append(i)
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(frames)
    for head, group in groups.items():
        for own in (group[k : k + AT_ONCE] for k in range(0, len(group), AT_ONCE)):
            levels, rest = _decode([frames[i][starts[i] :] for i in own], head)
            grey = levels * (head.quantizer[0] / 8)
            if rest:
                block, place, value = (np.concatenate(x) for x in zip(*rest, strict=True))
                whole = np.zeros((levels.size, 64))
                whole[block, _ZIGZAG[place]] = value * np.array(head.quantizer)[place]
                whole[:, 0] = levels.ravel() * head.quantizer[0]
                grey = (_COSINES.T @ whole.reshape(-1, 8, 8) @ _COSINES).reshape(len(own), -1)
            grey = np.clip(np.rint(grey) + 128, 0, 255).astype(np.uint8)
            for k, i in enumerate(own):
                out[i] = grey[k]
    return out


def _decode(scans: list[bytes], head: Head) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Of the first component: DC levels, frames x blocks, and its other coefficients (number of the block over all frames, place in the stream's order, value). All
    restart intervals advance together, one block a step."""
    data = np.frombuffer(b"".join(scans), np.uint8)
    full = np.zeros(len(data), bool)
    full[:-1] = data[:-1] == 255
    marker = np.zeros(len(data), bool)
    marker[:-1] = full[:-1] & (data[1:] >= 0xD0) & (data[1:] <= 0xD9)
    units = head.across * head.down
    per = -(-units // head.interval)
    if int(marker.sum()) != per * len(scans):
        raise ValueError("restart intervals are missing")
    keep = ~marker
    keep[1:] &= ~(marker[:-1] | (full[:-1] & (data[1:] == 0)))
    place = np.cumsum(keep) - keep
    end = place[marker]  # first byte after each interval, once markers and stuffing are out
    clean = np.concatenate([data[keep], np.zeros(8, np.uint8)]).astype(np.int64)
    word = clean[:-4] << 32 | clean[1:-3] << 24 | clean[2:-2] << 16 | clean[3:-1] << 8 | clean[4:]
    at = np.concatenate([[0], end[:-1]]) * 8
    n = len(at)
    count = np.full(n, head.interval)
    count[per - 1 :: per] = units - (per - 1) * head.interval
    tables = [(_lookup(dc), _lookup(ac)) for dc, ac in head.tables]
    level, first = np.zeros((n, len(tables)), np.int64), head.blocks[0]
    out, rest = np.zeros((n, head.interval * first), np.int64), []
    # an interval's first unit in the numbering of all frames' units
    begin = np.arange(n) // per * units + np.arange(n) % per * head.interval

    def take(which: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next symbol and, after it, its extra bits as a signed number; the low four bits of a symbol are their number."""
        byte = at[which] >> 3
        if (byte >= len(word)).any():
            raise ValueError("an interval is too short")
        window = word[byte] << (at[which] & 7)
        entry = table[(window >> 24) & 0xFFFF]
        bits, symbol = entry & 31, entry >> 5
        if not bits.all():
            raise ValueError("a code that isn't in the table")
        size = symbol & 15
        extra = (window >> (40 - bits - size)) & ((1 << size) - 1)
        at[which] += bits + size
        return symbol, np.where((size > 0) & (extra < 1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra)

    for step in range(int(count.max(initial=0))):
        live = np.flatnonzero(count > step)
        for part, (blocks, (dc, ac)) in enumerate(zip(head.blocks, tables, strict=True)):
            for nth in range(blocks):
                own = live
                _, change = take(own, dc)
                level[own, part] += change
                if part == 0:
                    out[own, step * first + nth] = level[own, 0]
                filled = np.ones(len(own), np.int64)
                while len(own):
                    symbol, value = take(own, ac)
                    filled += symbol >> 4
                    some = (symbol & 15) > 0
                    if some.any() and part == 0:
                        if filled[some].max() > 63:
                            raise ValueError("a coefficient outside its block")
                        rest.append(((begin[own[some]] + step) * first + nth, filled[some], value[some]))
                    filled += np.where(symbol == 0, 64, 1)
                    own, filled = own[filled < 64], filled[filled < 64]
    if (at > end * 8).any():
        raise ValueError("an interval is too short")
    rows = out.reshape(len(scans), per * head.interval * first)
    return rows[:, : units * first], rest


def shots(grey: np.ndarray, span: int = 8, factor: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """Clips (first frame, last frame + 1) of frames x blocks grey levels."""
    n = len(grey)
    if n == 0:
        return []
    level = np.arange(n)[:, None] * 16 + (grey >> 4)
    histogram = np.bincount(level.ravel(), minlength=16 * n).reshape(n, 16) / grey.shape[1]
    change = np.abs(np.diff(histogram, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for i in np.flatnonzero(change > least).tolist():
        past = change[max(cuts[-1], i - span) : i]
        if len(past) >= 2 and change[i] > past.mean() + factor * past.std():
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def padded(text: bytes) -> bytes:
    return text.ljust(max(64, -(-len(text) // 64) * 64), b"\0")


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes of the text, and media: its AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, offsets = utf8(part.column("text"))
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                media = write_avis([padded(t) for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    id_type = df.select(id_col).schema[0].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, n_bytes long, media binary")
    return out.withColumnRenamed("id", id_col)


def _whole(media: list[bytes]) -> list[tuple[np.ndarray, float, int | None]]:
    """(grey levels, frames a second, payload's length) of each file, decoded together."""
    parsed = [parse_avi(m) for m in media]
    grey = decode_frames([m[a:b] for m, (ranges, _, _) in zip(media, parsed, strict=True) for a, b in ranges])
    k, out = 0, []
    for ranges, rate, length in parsed:
        own = grey[k : k + len(ranges)]
        k += len(ranges)
        if len({len(x) for x in own}) > 1:  # flat frames among others
            size = max(map(len, own))
            own = [np.repeat(x, size // len(x)) if size % len(x) == 0 else x for x in own]
        out.append((np.stack(own) if own else np.zeros((0, _BLOCKS), np.uint8), rate, length))
    return out


def read_files(media: list[bytes | None]) -> list[tuple[np.ndarray, float, int | None] | str]:
    """What ``_whole`` gives for each file, or what is wrong with it."""
    wrong = (ValueError, KeyError, IndexError, struct.error, MemoryError)
    try:
        if all(m is not None for m in media):
            return _whole(media)
    except wrong:
        pass
    out: list[tuple[np.ndarray, float, int | None] | str] = []
    for m in media:
        try:
            out.append("no media" if m is None else _whole([m])[0])
        except wrong as e:
            out.append(f"{type(e).__name__}: {e}"[:200])
    return out


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows with at most a few MB of media, or one larger file."""
    first, held = 0, 0
    for i, m in enumerate(batch.column("media")):
        n = m.as_buffer().size if m.is_valid else 0
        if i > first and (held + n > 4 << 20 or i - first >= 256):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if batch.num_rows > first:
        yield batch.slice(first)


def media_clips(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each clip: ``id_col``, clip, first_frame, frames, start_s, end_s, error. A file that can't be read, or none, is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch):
                at, rows = [], []
                for i, read in enumerate(read_files(part.column("media").to_pylist())):
                    own = [(None, None, None, None, None, read)] if isinstance(read, str) else [(k, a, b - a, a / read[1], b / read[1], None) for k, (a, b) in enumerate(shots(read[0]))]
                    at += [i] * len(own)
                    rows += own
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at, pa.int64())), *map(pa.array, columns, kinds)], names=["id", "clip", "first_frame", "frames", "start_s", "end_s", "error"])

    id_type = df.select(id_col).schema[0].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, f"id {id_type}, clip int, first_frame int, frames int, start_s double, end_s double, error string")
    return out.withColumnRenamed("id", id_col)


def read_back(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id_col``, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, frames, clips, feature, error."""
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "clips", "feature", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _batches(batch):
                media = part.column("media").to_pylist()
                rows = []
                for m, read in zip(media, read_files(media), strict=True):
                    stored = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
                    if isinstance(read, str):
                        rows.append((None, None, None, *stored, None, None, None, read))
                        continue
                    grey, _, length = read
                    payload = grey.ravel().tobytes()[:length]
                    clips = shots(grey)
                    levels = np.bincount(grey.ravel() >> 4, minlength=16).astype("<i8").tobytes()
                    feature = f"frames={len(grey)} clips={len(clips)} longest={max((b - a for a, b in clips), default=0)} cuts={zlib.crc32(np.array(clips, '<i8').tobytes()):08x} levels={zlib.crc32(levels):08x}"
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *stored, len(grey), len(clips), feature, None))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = list(zip(*rows, strict=True)) or [()] * 9
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), *map(pa.array, columns, kinds)], names=names)

    id_type = df.select(id_col).schema[0].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), "n_bytes", F.col(media_col).cast("binary").alias("media")).mapInArrow(run, f"id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, clips long, feature string, error string")
    return out.withColumnRenamed("id", id_col)


def op3_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("error")
