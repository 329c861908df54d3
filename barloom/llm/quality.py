"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features describe its own characters and words and those of the lines before and
after it. Training maximizes the likelihood of labelled documents, each line carrying its document's label, by gradient
steps on forward-backward expectations. A document's score is the mean of its lines' marginal probabilities of
being good, weighted by the lines' lengths.

Features are computed on executors from whole texts, vectorised over a batch. Training sees at most about ``max_docs`` distinct labelled
texts (those whose hash falls under the fitting fraction), each once, and of each at most ``max_chains`` chains of ``CHAIN`` lines, spread evenly over it; their
feature rows come to the driver, so these two bound what it gets. Scoring takes every line.

A null text is empty; an empty text is one empty line and has a score like any other. Without labelled rows of both kinds
every score is 0.5. Labels that are null or neither 0 nor 1 are not learned from. Repeated rows count as often as they come; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import slices, split, utf8, word_hashes

CHAIN = 64
_NEVER = -1e200  # the logarithm of nothing
_OWN = 12

_CLASS = np.full(256, 5, np.uint8)  # 0 capital, 1 small, 2 digit, 3 white space, 4 sentence mark, 5 other, 6 within a character
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 4
_CLASS[128:192], _CLASS[192:] = 6, 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in characters plus one, its row). A row without text has one empty line."""
    n_rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(offsets, breaks, "right") - 1
    lines = np.bincount(row_of_break, minlength=n_rows) + 1
    row = np.repeat(np.arange(n_rows), lines)
    last = np.cumsum(lines) - 1
    end = np.empty(len(row), np.int64)
    inner = np.ones(len(row), bool)
    inner[last] = False
    end[last], end[inner] = offsets[1:], breaks
    start = np.empty(len(row), np.int64)
    start[last - lines + 1] = offsets[:-1]
    start[1:][inner[:-1]] = breaks + 1
    kind = _CLASS[data]
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[np.stack([start, end])], axis=0)[0].astype(float)
    capital, small, digit, white, mark, other, within = (total(kind == k) for k in range(7))
    chars = (end - start) - within
    excl, pipe = total(data == ord("!")), total(data == ord("|"))
    begin, _, word_row = split(data, offsets)
    line = np.searchsorted(start, begin, "right") - 1
    # several empty lines start at one place; a word belongs to the last of them, which holds it
    hashes = word_hashes(data, begin)
    words = np.bincount(line, minlength=len(row)).astype(float)
    again = np.zeros(len(begin))
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line, again, len(row))
    order = np.lexsort((hashes, line))
    first = np.ones(len(order))
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], first, len(row))
    c, w, letters = np.maximum(chars, 1), np.maximum(words, 1), np.maximum(capital + small, 1)
    own = np.stack([np.log1p(chars) / 5, capital / letters, digit / c, mark / c, (other - excl - pipe) / c, excl / c, pipe / c, white / c, repeats / w, distinct / w, np.minimum(c / w, 30) / 10, (words < 4).astype(float)], axis=1)
    return own, chars + 1.0, row


def with_neighbours(own: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after within the row (zeros at its ends), flags of ends, and a one."""
    same = row[1:] == row[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][same], after[:-1][same] = own[:-1][same], own[1:][same]
    ends = np.ones((len(own), 3))
    ends[1:, 0], ends[:-1, 1] = ~same, ~same
    return np.concatenate([own, before, after, ends], axis=1)


@dataclass
class LineModel:
    """weights: of the features for good against bad; moves: scores of (state, next state), states bad 0 and good 1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def evidence(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.weights


def _steps(size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, those that are longer than k) for k = 0, 1, ... over runs of the given sizes."""
    order = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
    for k, m in enumerate(alive.tolist()):
        yield k, order[:m]


def _through(x: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Log sums over the state before, of (..., state) and a move."""
    return np.logaddexp(x[..., :1] + moves[0], x[..., 1:] + moves[1])


def marginals(model: LineModel, evidence: np.ndarray, row: np.ndarray, piece: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Probability of good of each line by forward-backward, and the summed expectations of moves (2 x 2).

    Chains are cut into pieces of about the root of the longest one's length. All pieces of the batch advance together: first each piece's matrix of scores from the
    state before it to that at its end, then pieces of a chain in order, then the lines within pieces from what comes into them. So there are steps by the root of the
    longest text's lines, not by its lines."""
    n, moves = len(row), model.moves
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    length = np.diff(np.append(first, n))
    piece = piece or max(CHAIN, int(np.ceil(np.sqrt(length.max()))))
    number = -(-length // piece)
    head = np.cumsum(number) - number  # each chain's first piece
    chain = np.repeat(np.arange(len(first)), number)
    nth = np.arange(len(chain)) - head[chain]
    begin = first[chain] + nth * piece
    size = np.minimum(piece, length[chain] - nth * piece)
    scores = np.stack([np.zeros(n), evidence], axis=1)
    came, goes = np.zeros((len(chain), 2)), np.zeros((len(chain), 2))
    if number.max() > 1:
        matrix = np.full((len(chain), 2, 2), _NEVER)
        matrix[:, [0, 1], [0, 1]] = 0
        for k, own in _steps(size):
            matrix[own] = _through(matrix[own], moves) + scores[begin[own] + k][:, None]
        start = scores[first]  # into a chain comes nothing: its first line is its score alone
        inner = np.full((len(first), 2, 2), _NEVER)
        inner[:, [0, 1], [0, 1]] = start
        firsts = np.where(number > 1)[0]
        for k, own in _steps(size[head[firsts]]):
            if k:
                at = firsts[own]
                inner[at] = _through(inner[at], moves) + scores[first[at] + k][:, None]
        reach = np.logaddexp(inner[:, 0], inner[:, 1])
        for k, own in _steps(number):
            if k:
                came[head[own] + k] = reach[own]
                reach[own] = np.logaddexp(reach[own][:, :1] + matrix[head[own] + k, 0], reach[own][:, 1:] + matrix[head[own] + k, 1])
        ends = [x for x in _steps(number)][:0:-1]
        for k, own in ends:
            ahead = matrix[head[own] + k] + goes[head[own] + k][:, None]
            goes[head[own] + k - 1] = np.logaddexp(ahead[:, :, 0], ahead[:, :, 1])
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    for k, own in _steps(size):
        at = begin[own] + k
        if k:
            forward[at] = scores[at] + _through(forward[at - 1], moves)
        else:
            forward[at] = scores[at] + np.where(nth[own][:, None] == 0, 0.0, _through(came[own], moves))
    last = begin + size - 1
    backward[last] = goes
    for k, own in _steps(size):
        if k:
            at = last[own] - k
            ahead = scores[at + 1] + backward[at + 1]
            backward[at] = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
    pair = np.flatnonzero(row[1:] == row[:-1])
    joint = forward[pair][:, :, None] + moves[None] + (scores[pair + 1] + backward[pair + 1])[:, None, :]
    whole = np.logaddexp(*(forward[pair] + backward[pair]).T)
    expected = np.exp(joint - whole[:, None, None]).sum(axis=0)
    both = forward + backward
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500))), expected


def train(features: np.ndarray, row: np.ndarray, good: np.ndarray, rounds: int = 200, penalty: float = 1e-3) -> LineModel:
    """features, row and label of each line."""
    mean, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale < 1e-6] = 1
    mean[-1], scale[-1] = 0, 1  # the constant
    model = LineModel(mean, scale, np.zeros(features.shape[1]), np.zeros((2, 2)))
    x = (features - mean) / scale
    same = row[1:] == row[:-1]
    pairs = good[:-1][same] * 2 + good[1:][same]
    seen = np.bincount(pairs.astype(int), minlength=4).reshape(2, 2)
    theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    chains = max(1, len(np.unique(row)))
    for k in range(1, rounds + 1):
        p, expected = marginals(model, x @ model.weights, row)
        gradient = np.concatenate([x.T @ (good - p), (seen - expected).ravel()]) / chains - penalty * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        model = LineModel(mean, scale, theta[:-4], theta[-4:].reshape(2, 2))
    return model


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "quality", max_docs: int = 8000, max_chains: int = 8) -> LineModel | None:
    """None if the labelled rows don't hold both labels."""
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("int").alias("good"))
    share = min(1.0, max_docs / max(1, rows.count()))
    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).dropDuplicates(["text", "good"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own, _, row = line_features(*utf8(part.column("text")))
                x = with_neighbours(own, row).astype(np.float32)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                within = np.arange(len(row)) - cut[row]
                chains = -(-np.diff(cut) // CHAIN)
                # the chain a line is in, and those that are taken: every chain of a short text, evenly spread ones of a long text
                nth, every = within // CHAIN, np.maximum(chains / max_chains, 1.0)[row]
                taken = np.floor(np.ceil(nth / every - 1e-9) * every + 1e-9) == nth
                x, row = x[taken], row[taken]
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), part.column("good")], names=["x", "good"])

    got = sample.mapInArrow(run, "x binary, good int").collect()
    if len({r["good"] for r in got}) < 2:
        return None
    got.sort(key=lambda r: (r["good"], bytes(r["x"])))  # the same model whatever order the rows come in
    width = 3 * _OWN + 3
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, width) for r in got]
    lines = np.array([len(x) for x in parts])
    of = np.repeat(np.arange(len(parts)), lines)
    within = np.arange(len(of)) - np.repeat(np.cumsum(lines) - lines, lines)
    return train(np.concatenate(parts).astype(float), of * (2**20) + within // CHAIN, np.repeat([float(r["good"]) for r in got], lines))


def text_scores(model: LineModel | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, lines, and lines whose marginal is 0.5 or more, of each text."""
    own, length, row = line_features(*utf8(texts))
    n = len(texts)
    if model is None:
        p = np.full(len(row), 0.5)
    else:
        p, _ = marginals(model, model.evidence(with_neighbours(own, row)), row)
    mean = np.bincount(row, p * length, n) / np.maximum(np.bincount(row, length, n), 1)
    return np.clip(mean, 0, 1), np.bincount(row, minlength=n).astype(np.int64), np.bincount(row, p >= 0.5, n).astype(np.int64)


def score(df: DataFrame, model: LineModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score, lines, good_lines (of marginal 0.5 or more) for each row."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), *map(pa.array, text_scores(sent.value, part.column("text")))], names=["id", "score", "lines", "good_lines"])

    id_type = df.select(id_col).schema[0].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, score double, lines long, good_lines long")
    return out.withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, model: LineModel | None, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``df``, all columns, whose text scores ``least`` or more. Nothing is shuffled."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                yield part.filter(pa.array(text_scores(sent.value, part.column(text_col))[0] >= least))

    return df.mapInArrow(run, df.schema)


def held_out(id_col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id's decimal text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on_labels(spark: SparkSession, sf_dir: str) -> LineModel | None:
    """The model of ``documents`` with ``labels``, without held-out rows."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fit(docs.where(~held_out()).join(labels, "doc_id"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit_on_labels(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
