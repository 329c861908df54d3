"""Two tokenizers' tokens aligned over the bytes they cover, each distinct text once.

Rows are shuffled by their full text, so that copies become one row with their number. Each distinct text is tokenized by both vocabularies and aligned on byte offsets: where
tokens of both end together a group ends, and tokens whose bytes overlap are linked. Counts of linked id pairs are summed over texts times their copies; measures that need
these counts are computed once for each distinct text, and all measures are joined to the documents by the text's SHA-256.

Inside a task both tokenizers are asked once for each distinct unit: a unit runs from a space behind a visible character up to the next such space, and neither
vocabulary has a token across that border (the byte vocabulary splits there first, the piece vocabulary has no piece with a space behind another character, which is checked). Units
are remembered up to a bound. What happens for each occurrence of a unit are NumPy steps over texts of bounded size or one longer text.

The table of pair counts grows with the vocabularies and the corpus, so it is broadcast only when its written size is known to be small, else merge-joined. A text with very many
copies is one row after partial sums in each task; in the last join Spark may split it.

A null or empty text has no tokens, nor has one that a vocabulary doesn't give back byte for byte: zeros and an empty string. Repeated rows and null ids count each. An empty
table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Workspace
from ._words import slices, utf8

_ALIGNERS: dict[tuple[str, str], Aligner] = {}
_REMEMBERED = 600_000  # units
_TOGETHER = 4096  # bytes of units that are tokenized in one string


def text_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of units in the bytes of texts, each of which begins with a space and isn't empty behind it, and the place of each text's first unit among them."""
    visible = (data > 0x20) & (data < 0x7F)
    cut = data == 0x20
    # behind a letter of several bytes, which may be a space of its own kind, only if a plain one follows
    cut[1:-1] &= visible[:-2] | ((data[:-2] >= 0x80) & visible[2:])
    cut[offsets[1:] - 1] = False  # a last space stays with what is before: the piece vocabulary makes nothing of a text that is empty
    cut[offsets[:-1]] = True
    starts = np.flatnonzero(cut)
    return starts, np.searchsorted(starts, offsets[:-1])


class Aligner:
    """Tokens, groups and links of units."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = self.a.get_vocab()
        self.a_size = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():  # byte-level: a letter of an entry is a byte
            self.a_size[i] = len(name)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on behind a space, so units can't be tokenized by themselves")
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array([len(p) for p in self.b_bytes], np.int64)
        shown = lambda n, mark: np.array([[f"{i},".encode(), f"{i}{mark}".encode()] for i in range(n)], object)
        self.a_shown, self.b_shown = shown(len(self.a_size), "|"), shown(len(self.b_size), ";")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.whole = np.zeros(0, bool)
        self.counts = np.zeros((0, 4), np.int64)  # tokens of a, of b, groups, links
        self.links = np.zeros(0, np.int64)
        self.groups: list[bytes] = []

    def learn(self, units: list[bytes]) -> None:
        """Remembers new units. Those that end visibly are tokenized many at a time, as a border lies between them."""
        data, ends = b"".join(units), np.cumsum([len(u) for u in units])
        last = np.frombuffer(data, np.uint8)[ends - 1]
        alone = (last <= 0x20) | (last >= 0x7F) | (np.append(np.diff(ends // _TOGETHER), 1) > 0)
        found = self._tokens(data, ends, np.flatnonzero(alone))
        whole, a_end, a_ids, b_end, b_ids = found
        n = len(units)
        a_unit, b_unit = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        first = np.searchsorted(b_end, a_end - self.a_size[a_ids], "right")
        many = np.searchsorted(b_end - self.b_size[b_ids], a_end, "left") - first
        links = np.repeat(a_ids, many) * len(self.b_size) + b_ids[np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
        a_cut, b_cut = np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)
        count = lambda of, weights=None: np.bincount(of, weights, n).astype(np.int64)
        counts = np.column_stack([count(a_unit), count(b_unit), count(a_unit[a_cut]), count(a_unit, many)])
        # a group's first ids, then its second ones, each with the mark behind it
        group = np.concatenate([np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut])
        order = np.argsort(group, kind="stable")
        shown = np.concatenate([self.a_shown[a_ids, a_cut.astype(int)], self.b_shown[b_ids, b_cut.astype(int)]])[order].tolist()
        upto = np.append(0, np.cumsum(counts[:, 0] + counts[:, 1])).tolist()
        self.groups += [b"".join(shown[i:j]) for i, j in zip(upto, upto[1:])]
        self.known.update(zip(units, range(len(self.known), len(self.known) + n)))
        self.whole, self.counts, self.links = np.concatenate([self.whole, whole]), np.concatenate([self.counts, counts]), np.concatenate([self.links, links])

    def _tokens(self, data: bytes, ends: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(whether both vocabularies give each unit back, ends and ids of tokens of the first, of the second) for units up to ``ends``, tokenized together up to each of ``cuts``."""
        borders = [0, *ends[cuts].tolist()]
        spans = [data[i:j] for i, j in zip(borders, borders[1:])]
        texts = [x.decode() for x in spans]
        both = [[e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)], self.b.encode([t[1:] for t in texts], num_threads=1)]
        flat = [np.fromiter(chain.from_iterable(x), np.int64, sum(map(len, x))) for x in both]
        size = [self.a_size[flat[0]], self.b_size[flat[1]]]
        span = [np.repeat(np.arange(len(spans)), [len(i) for i in x]) for x in both]
        good = np.array([b"".join([self.b_bytes[i] for i in ids]) == x for ids, x in zip(both[1], spans, strict=True)], bool)
        good &= np.bincount(span[0], size[0], len(spans)) == np.diff(borders)
        at = []
        for z, of in zip(size, span):
            total = np.cumsum(z)
            begun = np.append(0, np.cumsum(np.bincount(of, z, len(spans))))[:-1].astype(np.int64)
            at.append(total - begun[of] + np.array(borders[:-1])[of])
        home = np.searchsorted(cuts, np.arange(len(ends)))  # a unit's span
        # where a border isn't one for both, and where a unit isn't given back, the span's units are asked for one by one
        np.logical_and.at(good, home, np.isin(ends, at[0]) & np.isin(ends, at[1]))
        again = np.flatnonzero(~good[home] & (np.bincount(home)[home] > 1))
        whole, kept = good[home], [good[of] for of in span]
        out = [(at[i][kept[i]], flat[i][kept[i]]) for i in (0, 1)]
        if len(again):
            begins = np.append(0, ends[:-1])
            own = b"".join(data[begins[u] : ends[u]] for u in again.tolist())
            to = np.cumsum(ends[again] - begins[again])
            fixed = self._tokens(own, to, np.arange(len(again)))
            whole[again] = fixed[0]
            for i in (0, 1):
                e, ids = fixed[1 + 2 * i], fixed[2 + 2 * i]
                u = np.searchsorted(to, e)
                e = e - to[u] + ends[again[u]]
                order = np.argsort(np.concatenate([out[i][0], e]), kind="stable")
                out[i] = (np.concatenate([out[i][0], e])[order], np.concatenate([out[i][1], ids])[order])
        return whole, *out[0], *out[1]

    def codes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each unit among those that are remembered."""
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)])
        coded = column.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [u for u in distinct if u not in self.known]
        if len(new) + len(self.known) > _REMEMBERED and self.known:
            self.forget()
            new = distinct
        if new:
            self.learn(new)
        return np.array([self.known[u] for u in distinct], np.int64)[coded.indices.to_numpy()]


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for a Python worker."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


_ALIGNED = "tid binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair:long,times:long>>"


def align_part(tools: Aligner, part: pa.RecordBatch, with_groups: bool = False) -> pa.RecordBatch:
    """Measures and linked pairs of each (text, copies); texts aren't empty."""
    data, offsets = utf8(part.column("text"))
    n = part.num_rows
    data, offsets = np.insert(data, offsets[:-1], 0x20), offsets + np.arange(n + 1)
    starts, first = text_units(data, offsets)
    code = tools.codes(data, starts)
    row = np.repeat(np.arange(n), np.diff(np.append(first, len(starts))))
    good = np.ones(n, bool)
    good[row[~tools.whole[code]]] = False
    counts = np.add.reduceat(tools.counts[code], first, axis=0) * good[:, None] if n else np.zeros((0, 4), np.int64)
    ends = np.append(first, len(starts))
    strings = [b"".join([tools.groups[c] for c in code[ends[i] : ends[i + 1]].tolist()])[:-1] if good[i] else b"" for i in range(n)]
    # links of all occurrences, then each text's distinct pairs
    used = good[row]
    code, row = code[used], row[used]
    many = tools.counts[code, 3]
    before = np.cumsum(tools.counts[:, 3]) - tools.counts[:, 3]
    pair = tools.links[np.repeat(before[code] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
    ids = len(tools.a_size) * len(tools.b_size)
    placed = np.sort(np.repeat(row, many) * ids + pair)
    new = np.flatnonzero(np.append(True, placed[1:] != placed[:-1])) if len(placed) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(placed)))
    lists = np.append(0, np.cumsum(np.bincount(placed[new] // ids, minlength=n))).astype(np.int32)
    raw = data.tobytes()
    columns = [
        pa.array([hashlib.sha256(raw[offsets[i] + 1 : offsets[i + 1]]).digest() for i in range(n)], pa.binary()),
        part.column("copies"), *(pa.array(counts[:, i]) for i in range(4)),
        pa.array([hashlib.sha256(s).hexdigest() if s else "" for s in strings], pa.string()),
        pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(placed[new] % ids), pa.array(times)], ["pair", "times"])),
    ]
    names = ["tid", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]
    return pa.RecordBatch.from_arrays([*columns, *([pa.array([s.decode() for s in strings], pa.string())] if with_groups else [])], names=[*names, *(["groups"] if with_groups else [])])


def aligned_texts(texts: DataFrame, a_path: str, b_path: str, with_groups: bool = False) -> DataFrame:
    """For each distinct text of a column ``text`` that isn't null or empty: ``tid`` (its SHA-256), copies, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs with how
    often it has them; a pair is the first vocabulary's id times the second's size plus the second's id. ``with_groups``: the groups too, as ``a1,a2|b1;a3|b2,b3``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = aligner(a_path, b_path)
        for batch in batches:
            for part in slices(batch, "text", 6 << 20):
                yield align_part(tools, part, with_groups)

    distinct = texts.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    return distinct.mapInArrow(run, _ALIGNED + (", groups string" if with_groups else ""))


def pair_counts(aligned: DataFrame, b_ids: int) -> DataFrame:
    """(pair, count, best): how many links of the corpus have each pair, and whether no other pair of the same second id has more. ``b_ids``: the second vocabulary's size, which bounds
    the table of greatest counts."""
    counts = aligned.select("copies", F.inline("pairs")).groupBy("pair").agg(F.sum(F.col("times") * F.col("copies")).alias("count"))
    most = counts.groupBy((F.col("pair") % b_ids).alias("b")).agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), F.col("pair") % b_ids == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokenizers(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 16 << 20, with_groups: bool = False) -> DataFrame:
    """One row for each row of ``df``: its id, n_a, n_b, n_groups, n_links, n_best (links whose pair is its second id's commonest), count_sum (over links, of their pair's count in the corpus),
    groups_sha256 and, if asked for, the groups."""
    import sentencepiece

    work = Workspace(df.sparkSession, "align")
    b_ids = sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()
    aligned = work.write(aligned_texts(df.select(F.col(text_col).alias("text")), a_path, b_path, with_groups), "aligned")
    counted = work.write(pair_counts(aligned, b_ids), "pairs")
    weighed = aligned.select("tid", F.inline("pairs")).join(work.joinable(counted, broadcast_bytes), "pair")
    sums = weighed.groupBy("tid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    measures = work.write(aligned.drop("pairs", "copies").join(sums, "tid", "left"), "measures")
    found = df.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.col(text_col), 256)).alias("tid")).join(work.joinable(measures, broadcast_bytes), "tid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shown = [F.coalesce(c, F.lit("")).alias(c) for c in ("groups_sha256", *(["groups"] if with_groups else []))]
    return found.select(F.col("id").alias(id_col), *(zero(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), *shown)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align_tokenizers(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
