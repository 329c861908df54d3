"""Language identification by words first, and character n-grams for unseen words.

The model holds log frequencies by language of words (runs of letters, lower-cased) and of character n-grams within marked
words. A known word scores its log frequencies. An unseen word scores the mean log frequencies of its known n-grams of the
greatest length that has any, from ``longest`` down to 1. A text's language is that of the greatest sum; ties go to the first
in alphabetical order. The score is the posterior of that language under equal priors.

Learning counts on Spark over at most about ``max_docs`` distinct labelled texts of each language, and ``max_total`` of all (all where there are fewer; else those
whose hash falls under the fitting fraction), each once. All languages, and all words and n-grams of these texts are learned: the bound of the sample bounds
the model, which is sent to executors as the non-zero counts alone.

Texts that are null or have no letter are ``und`` with score 0, as is everything when nothing was learned. Repeated rows
each get a prediction, and count once in learning. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Workspace
from ._words import slices, split, utf8, word_hashes

UNKNOWN = "und"
_MEMO = 200_000


@dataclass
class Scores:
    """Log frequencies by language of keys: ``base`` of a language for a key it hasn't, and what the languages that have a key add to that."""

    base: np.ndarray  # languages
    begin: np.ndarray  # keys + 1: where a key's languages begin
    lang: np.ndarray
    more: np.ndarray

    @classmethod
    def of(cls, key: np.ndarray, lang: np.ndarray, n: np.ndarray, keys: int, languages: int) -> "Scores":
        """From counts n of (key, lang), keys in order."""
        total = np.log(np.bincount(lang, n, languages) + 0.5 * keys)
        begin = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=keys))])
        return cls(np.log(0.5) - total, begin, lang.astype(np.int32), np.log(n + 0.5) - np.log(0.5))

    def sums(self, keys: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
        """rows x languages: summed scores of keys that belong to the rows ``of``."""
        size = self.begin[keys + 1] - self.begin[keys]
        at = np.repeat(self.begin[keys] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        k = len(self.base)
        found = np.bincount(np.repeat(of, size) * k + self.lang[at], self.more[at], rows * k).reshape(rows, k)
        return found + np.bincount(of, minlength=rows)[:, None] * self.base


@dataclass
class LanguageModel:
    languages: list[str]
    word_keys: np.ndarray  # sorted hashes
    words: Scores
    grams: dict[str, tuple[int, int]]  # to its length and its place among those of the length
    by_length: dict[int, Scores]
    longest: int

    def unseen(self, word: str) -> np.ndarray | None:
        """Scores of a word that the model doesn't know; None if not even a letter of it is known."""
        marked = f"_{word}_"
        for n in range(self.longest, 0, -1):
            known = [g[1] for i in range(len(marked) - n + 1) if (g := self.grams.get(marked[i : i + n])) is not None]
            if known:
                return self.by_length[n].sums(np.array(known), np.zeros(len(known), np.int64), 1)[0] / len(known)
        return None


NOTHING = Scores(np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0))


def letters(text: Column) -> Column:
    """Lower-cased runs of letters with one space between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 1500, max_total: int = 12_000, longest: int = 5) -> LanguageModel:
    rows = df.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    languages = sorted(totals)
    if not languages:
        return LanguageModel([], np.zeros(0, np.uint64), NOTHING, {}, {}, longest)
    most = min(max_docs, max(1, max_total // len(languages)))
    share = F.create_map(*(F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, most / n))))
    uniform = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(uniform < share[F.col("lang")]).dropDuplicates(["lang", "text"])
    of_word = Workspace(df.sparkSession, "language").write(sample.select("lang", F.explode(F.split(letters(F.col("text")), " ")).alias("key")).where("key <> ''").groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n")), "words")
    marked = F.concat(F.lit("_"), F.col("key"), F.lit("_"))
    of_size = lambda n: F.transform(F.sequence(F.lit(1), F.length(marked) - (n - 1)), lambda i: F.substring(marked, i, F.lit(n)))
    grams = F.flatten(F.array(*(F.when(F.length(marked) >= n, of_size(n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1))))
    of_gram = of_word.select("lang", "n", F.explode(grams).alias("key")).groupBy("lang", "key").agg(F.sum("n").alias("n"))

    def counted(table: DataFrame) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, and (key, lang, n) of each count in order of keys; what the bounded sample has."""
        got = table.toArrow()
        keys = got.column("key").combine_chunks().dictionary_encode()
        lang = np.searchsorted(np.array(languages, object), got.column("lang").to_pylist())
        key = keys.indices.to_numpy()
        order = np.lexsort((lang, key))
        return keys.dictionary, key[order], lang[order], got.column("n").to_numpy()[order].astype(float)

    names, key, lang, n = counted(of_word)
    if not len(names):
        return LanguageModel([], np.zeros(0, np.uint64), NOTHING, {}, {}, longest)
    data, offsets = utf8(names)
    hashes = word_hashes(data, split(data, offsets)[0])
    rank = np.argsort(np.argsort(hashes))
    by = np.lexsort((lang, rank[key]))
    words = Scores.of(rank[key][by], lang[by], n[by], len(names), len(languages))
    names, key, lang, n = counted(of_gram)
    texts = names.to_pylist()
    size = np.array([len(x) for x in texts])
    known: dict[str, tuple[int, int]] = {}
    by_length: dict[int, Scores] = {}
    for length in np.unique(size).tolist():
        place = np.cumsum(size == length) - 1
        own = size[key] == length
        by_length[length] = Scores.of(place[key[own]], lang[own], n[own], int((size == length).sum()), len(languages))
        known |= {x: (length, int(i)) for x, i, k in zip(texts, place, size, strict=True) if k == length}
    return LanguageModel(languages, np.sort(hashes), words, known, by_length, longest)


def score_batch(model: LanguageModel, texts: pa.Array, memo: dict[bytes, np.ndarray | None]) -> np.ndarray:
    """texts x languages: summed scores of texts that ``letters`` made."""
    n = len(texts)
    data, offsets = utf8(texts)
    starts, ends, row = split(data, offsets)
    keys = word_hashes(data, starts)
    at = np.minimum(np.searchsorted(model.word_keys, keys), len(model.word_keys) - 1)
    known = model.word_keys[at] == keys
    total = model.words.sums(at[known], row[known], n)
    if len(memo) > _MEMO:
        memo.clear()
    raw = data.tobytes()
    for s, e, i in zip(starts[~known].tolist(), ends[~known].tolist(), row[~known].tolist(), strict=True):
        word = raw[s:e]
        if word not in memo:
            memo[word] = model.unseen(word.decode())
        if (own := memo[word]) is not None:
            total[i] += own
    return total


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, lang_pred, score for each row of ``df``."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = sent.value, {}
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                best, score = np.full(n, len(names) - 1), np.zeros(n)
                if own.languages:
                    total = score_batch(own, part.column("text"), memo)
                    some = np.diff(utf8(part.column("text"))[1]) > 0
                    best = np.where(some, total.argmax(axis=1), best)
                    weight = np.exp(total - total.max(axis=1, keepdims=True))
                    score = np.where(some, 1 / weight.sum(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names[best], pa.string()), pa.array(score)], names=["id", "lang_pred", "score"])

    id_type = df.select(id_col).schema[0].dataType.simpleString()
    out = df.select(F.col(id_col).alias("id"), letters(F.col(text_col)).alias("text")).mapInArrow(run, f"id {id_type}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = fit(docs.where(~F.coalesce(held_out, F.lit(False))))
    return predict(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
