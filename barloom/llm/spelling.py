"""Spelling variants grouped by reduced-alphabet generation.

Words are counted over all texts. Each letter of a word is hashed to one of a few symbols, and the one-edit neighbourhood of every reduced word is generated:
itself, each symbol replaced, each left out, each inserted. Neighbourhoods are joined with the reduced vocabulary; words that meet are verified on their letters. Two words one
edit apart always meet, as their reduced words are equal or one edit apart, and how many neighbours a word has depends on its length alone, not on the alphabet.
Being neighbours is mutual, so each pair is generated from one side: replacements by greater symbols from the one with the
smaller symbol, left-out symbols from the longer one, which stand for insertions into the shorter one.

A word's form is the near word that is written most often (of equals the first in code-point order), if that is at least ``dominance`` times as often. Forms grow at least by that
factor from one to the next, so chains are short: their ends are found by doubling, in as many rounds as the greatest count allows.

Vocabulary and candidates are tables over tasks; the reduced vocabulary is broadcast only when its written size is known to be small, else both sides are merge-joined. A
hot word is counted in each task before the shuffle. A reduced word's candidates are rows, never a group in one task.

Null and empty texts have no words. A null id counts as an empty one. Repeated rows count each. An empty table gives no rows. Words of any length take part; neighbourhoods of very
long ones are made in slices and don't carry the word. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Workspace

RUN = "[A-Za-zÀ-ÿ]+"
_LARGE, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 1 << 18  # keys at a time
_CARRIED = 64  # letters


def runs(text: Column) -> Column:
    """The maximal runs of letters, A-Z in small."""
    return F.transform(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _LARGE, _SMALL)))


def slipped(owner: Column, run: Column, one_in: int = 97) -> Column:
    """The run without one letter where a hash of its owner and itself says so, as if mistyped."""
    h = F.crc32(F.concat(F.coalesce(owner.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """(word, n) of the words of a column ``word`` that are long and frequent enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _symbol_values(symbols: int) -> np.ndarray:
    return np.random.default_rng(12).integers(1, 2**63, symbols).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def neighbourhoods(letters: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, key, whether the reduced word is unchanged) for words of one length, a row of code points each. A key is a 64-bit hash of a reduced word; every
    neighbour of a row comes once."""
    n, length = letters.shape
    s = letters.astype(np.int64) * 7 % symbols
    value = _symbol_values(symbols)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(length, _BASE)]))[:length][::-1]
    term = value[s] * power
    after = np.zeros((n, length + 1), np.uint64)
    after[:, :-1] = np.cumsum(term[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    whole = after[:, 0]
    yield np.arange(n), whole, np.ones(n, bool)
    # what stands before a symbol that is left out has powers one lower
    lower = value[s[:, :-1]] * power[1:] if length > 1 else np.zeros((n, 0), np.uint64)
    before = np.zeros((n, length), np.uint64)
    before[:, 1:] = np.cumsum(lower, axis=1, dtype=np.uint64)
    step = max(1, _SLICE // max(n * symbols, 1))
    for i in range(0, length, step):
        part = s[:, i : i + step]
        first = np.ones(part.shape, bool)  # of a run of equal symbols, any of which leaves the same
        if i:
            first[:, 0] = part[:, 0] != s[:, i - 1]
        first[:, 1:] = part[:, 1:] != part[:, :-1]
        row, at = np.nonzero(first)
        yield row, before[row, at + i] + after[row, at + i + 1], np.zeros(len(row), bool)
        row, at, to = np.nonzero(np.arange(symbols) > part[:, :, None])
        own = part[row, at]
        yield row, whole[row] + (value[to] - value[own]) * power[at + i], np.zeros(len(row), bool)


def _by_length(words: pa.Array, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of words, their code points as a matrix) for each length, in parts of bounded size."""
    texts = np.array(words.to_pylist(), object)
    lengths = np.array([len(t) for t in texts], np.int64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        for part in np.array_split(at, max(1, len(at) * int(length) // most)):
            if len(part):
                yield part, np.frombuffer("".join(texts[part]).encode("utf-32-le"), np.uint32).reshape(len(part), length)


def _keys(words: DataFrame, carried: list[str], symbols: int, whole: bool) -> DataFrame:
    """(key, ``carried`` columns, same) of reduced words themselves (``whole``), or of their neighbourhoods, where ``same`` says that nothing was changed. What is carried comes again with each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, letters in _by_length(batch.column("word")):
                for row, key, same in neighbourhoods(letters, symbols):
                    at = pa.array(places[row])
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch.column(c).take(at) for c in carried), pa.array(same)], names=["key", *carried, "same"])
                    if whole:
                        break

    fields = ", ".join(f"{c} {words.schema[c].dataType.simpleString()}" for c in carried)
    return words.mapInArrow(run, f"key long, {fields}, same boolean")


def near_words(vocabulary: DataFrame, work: Workspace, symbols: int = 8, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """(word, n, near, near_n): each two words of the written table ``vocabulary`` that differ by one inserted, deleted or replaced letter, both ways round."""
    words = vocabulary.withColumn("hash", F.xxhash64("word"))
    reduced = work.write(_keys(words, ["word", "n"], symbols, True).select("key", F.col("word").alias("near"), F.col("n").alias("near_n")), "reduced")
    there = work.joinable(reduced, broadcast_bytes)
    # a long word has many keys: they carry its hash, and it comes back for those that met
    short = F.length("word") <= _CARRIED
    met = _keys(words.where(short), ["word", "n"], symbols, False).join(there, "key").select("same", "word", "n", "near", "near_n")
    again = words.where(~short)
    long = _keys(again, ["hash"], symbols, False).join(there, "key").select("same", "hash", "near", "near_n").join(again, "hash").select("same", "word", "n", "near", "near_n")
    met = met.unionByName(long).where(~F.col("same") | (F.col("word") < F.col("near")))
    # distinct, should two neighbours of one word share a hash
    found = work.write(met.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct(), "near")
    return found.unionByName(found.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def chain_ends(links: DataFrame, rounds: int, work: Workspace) -> DataFrame:
    """(word, root) for ``links`` (word, form): the last of each chain of at most 2 ** ``rounds`` links."""
    ends = work.write(links.select("word", F.col("form").alias("root")), "ends")
    for _ in range(rounds):
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ends = work.write(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "ends")
    return ends


def spelling_groups(vocabulary: DataFrame, dominance: int = 2, symbols: int = 8) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a vocabulary (word, n) of distinct words."""
    work = Workspace(vocabulary.sparkSession, "spelling")
    words = work.write(vocabulary.select("word", "n"), "words")
    most = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    best = near_words(words, work, symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), most.alias("best"))
    often = -F.col("best.m")
    judged = words.join(best, "word", "left").withColumn("strong", F.coalesce(often >= dominance * F.col("n"), F.lit(False)))
    judged = work.write(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("strong"), F.col("best.near")).alias("form"), F.when(F.col("strong"), often).alias("form_n")), "forms")
    span = judged.agg(F.min("n"), F.max("n")).first()
    # each link multiplies the count by the dominance at least
    longest = log(max(span[1] or 1, 1) / max(span[0] or 1, 1), dominance) + 1
    roots = chain_ends(judged.where("form is not null"), ceil(log(max(longest, 2), 2)), work)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents``, from five letters and three occurrences on, with some runs mistyped by a hash, and the forms they are variants of."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("run"))
    return spelling_groups(vocabulary(found.select(slipped(F.col("doc_id"), F.col("run")).alias("word")), 5, 3))


OP12_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
owned AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
bytes AS (SELECT run, k, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [192 + ord(c)::BIGINT // 64, 128 + ord(c)::BIGINT % 64] END)) AS b FROM owned),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS h FROM bytes, tab),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(k)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND n >= 3),
cuts AS (SELECT word, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (SELECT x.word, y.word AS near FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, w.word FROM cuts x JOIN words w ON w.word = x.a || x.b
  UNION SELECT w.word, x.word FROM cuts x JOIN words w ON w.word = x.a || x.b),
best AS (SELECT p.word, count(*) AS n_near, min((-f.n, near)) AS m FROM pairs p JOIN words f ON f.word = p.near GROUP BY 1),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -m[1] >= 2 * w.n THEN m[2] END AS form, CASE WHEN -m[1] >= 2 * w.n THEN -m[1] END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT k.word, f.form FROM walk k JOIN forms f ON k.at = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT k.word, k.at FROM walk k JOIN forms f ON k.at = f.word WHERE f.form IS NULL)
SELECT f.word, form, e.at AS root, n, n_near, form_n FROM forms f JOIN ends e ON e.word = f.word
"""
