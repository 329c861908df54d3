"""Substring dedup over a log-structured index of window fingerprints.

A window is ``window`` consecutive words. Every window has an anchor: its word sequence of ``GRAM`` words with
the least hash, the leftmost of equals. Equal windows have equal anchors at equal offsets, so the index holds
one entry for each anchor (about a tenth of the windows), and loses no repeated window.

* ``anchors``: for each text, anchor fingerprint ``fp``, digest ``ctx`` (SHA-256) of all words that windows of this
  anchor can reach, and the windows' starts. Two anchors with equal (fp, ctx) have the same windows.
* ``FingerprintIndex``: a folder of immutable runs sorted by (fp, ctx) and bucketed by fp, which any session may open again. ``ingest`` reduces a batch to counts, writes
  it as one more run, and merge-joins that run with each run of history, bucket by bucket, without a shuffle: fingerprints that the batch has
  twice or shares with history are its hits. ``compact`` merges runs when there are too many.
* ``kept_words``: only fingerprints that are hits can repeat. An anchor whose (fp, ctx) repeats is settled: all its windows repeat. If only fp
  repeats, the windows themselves are verified by SHA-256 of their words, through one representative of each ctx. Texts lose each word that a
  repeated window covers.

Digests are 64 bits beside the 64 of the fingerprint, 128 bits together. No step gathers a group: counts are
combined before the shuffle, and hot fingerprints meet in sort-merge joins.

Null and empty texts have no words. A text shorter than the window keeps all its words. Rows with equal id
and text count as separate occurrences and get the same result. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.scratch import at_end, shared_folder

from ._shared import Workspace
from ._words import U, doubled, mix, slices, split, utf8, word_hashes

GRAM = 16
_BEFORE, _AFTER = U(0x51ED270B7F3C6A91), U(0xA3B195354A39B70D)


def _padded(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows, each row between ``window - GRAM`` marks before and ``window`` after; also each
    row's first word's place, its number of words, and the rows of words."""
    starts, _, row = split(data, offsets)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    reach = window - GRAM
    first = np.cumsum(np.concatenate([[0], counts + reach + window]))[:-1] + reach
    words = np.empty(int(counts.sum()) + (reach + window) * len(counts), U)
    words[:] = _AFTER
    for k in range(reach):
        words[first - 1 - k] = _BEFORE
    within = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    words[first[row] + within] = word_hashes(data, starts)
    return words, first, counts, row


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, prefix: list[bytes]) -> np.ndarray:
    """64 bits of SHA-256 of ``prefix`` and the words from ``first`` to before ``last``, joined by one space."""
    if not len(starts):
        return np.zeros(0, np.int64)
    size = ends - starts + 1
    at = np.cumsum(size) - size
    spaced = data[np.minimum(np.repeat(starts - at, size) + np.arange(int(size.sum())), len(data) - 1)]
    spaced[at + size - 1] = 32
    raw, cut = spaced.tobytes(), np.append(at, len(spaced))
    sha = hashlib.sha256
    return np.frombuffer(b"".join([sha(x + raw[a:b]).digest()[:8] for x, a, b in zip(prefix, cut[first].tolist(), cut[last].tolist(), strict=True)]), np.int64)


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """For each place, the place of the least of the ``span`` values from there on, the leftmost of equals."""
    at = np.arange(len(h))
    best, have = at, 1
    while have < span:
        step = min(have, span - have)
        other = np.concatenate([best[step:], best[len(best) - step :]])
        best = np.where(h[other] < h[best], other, best)
        have += step
    return best


def _row_anchors(batch: pa.RecordBatch, window: int) -> dict[str, np.ndarray]:
    data, offsets = utf8(batch.column("text"))
    words, first, counts, _ = _padded(data, offsets, window)
    empty = np.zeros(0, np.int64)
    rows = np.flatnonzero(counts >= window)
    if len(rows) == 0:
        return {"row": empty, "p": empty, "lo": empty, "hi": empty, "fp": empty, "ctx": empty}
    gram = doubled(words, 4)[-1]
    n_windows = counts[rows] - window + 1
    row = np.repeat(rows, n_windows)
    start = np.arange(int(n_windows.sum())) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    place = first[row] + start
    # the sequences are ranked by another function of them than the fingerprint
    anchor = _least(mix(gram ^ U(0x632BE59BD9B4E019)), window - GRAM + 1)[place]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(new)) - 1
    p, row = anchor[begin], row[begin]
    begins, ends, _ = split(data, offsets)
    own = np.cumsum(counts) - counts  # each row's first word
    p -= first[row]
    reach = window - GRAM
    lo, hi = p - reach, p + window
    missing = np.stack([np.maximum(-lo, 0), np.maximum(hi - counts[row], 0)], axis=1).astype(np.uint8)
    ctx = _digests(data, begins, ends, own[row] + np.maximum(lo, 0), own[row] + np.minimum(hi, counts[row]), [m.tobytes() for m in missing])
    return {"row": row, "p": p, "lo": start[begin], "hi": start[end], "fp": mix(gram[p + first[row]] + U(1)).view(np.int64), "ctx": ctx}


def anchors(texts: DataFrame, window: int) -> DataFrame:
    """(rid, fp, ctx, p, lo, hi): an anchor at word p is that of the windows which start at words lo to hi."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                a = _row_anchors(part, window)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid").take(pa.array(a["row"])), pa.array(a["fp"]), pa.array(a["ctx"]), *(pa.array(a[k].astype(np.int32)) for k in ("p", "lo", "hi"))],
                    names=["rid", "fp", "ctx", "p", "lo", "hi"],
                )

    return texts.select("rid", "text").mapInArrow(run, "rid binary, fp long, ctx long, p int, lo int, hi int")


class FingerprintIndex:
    """Runs of (fp, ctx, n), how often an anchor has been seen, in a folder that sessions may open again.

    The folder has a manifest for each change, which is written once and never altered: the runs, the batches' anchors and their hits. What a failed change left behind
    isn't in a manifest and so isn't read."""

    def __init__(self, spark: SparkSession, path: str | None = None, fan_in: int = 4, buckets: int | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.path, self._own = path or f"{shared_folder(spark)}/barloom-windows-{uuid.uuid4().hex[:12]}", path is None
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        known = sorted(x.getPath().getName() for x in self._fs.globStatus(self._hadoop(f"{self.path}/manifest/*.json")) or [])
        if known:
            self.state = json.loads(spark.read.text(f"{self.path}/manifest/{known[-1]}", wholetext=True).first()[0])
        else:
            self.state = {"version": 0, "buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": [], "anchors": [], "hits": []}

    def _commit(self, **changes) -> None:
        state = self.state | changes | {"version": self.state["version"] + 1}
        out = self._fs.create(self._hadoop(f"{self.path}/manifest/{state['version']:09d}.json"), False)  # fails if another session was first
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self._own and state["version"] == 1:  # an index that nobody named goes with the application
            at_end(self.spark, self.path)
        self.state = state

    def _new(self, kind: str) -> str:
        return f"{self.path}/{kind}/{self.state['version'] + 1:09d}-{uuid.uuid4().hex[:8]}"

    def _run(self, path: str) -> DataFrame:
        """A run as a bucketed table, so that joins and sums by fp need no shuffle of it."""
        name = "barloom_run_" + hashlib.md5(path.encode()).hexdigest()[:16]
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fp BIGINT, ctx BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp, ctx) INTO {self.state['buckets']} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _write_run(self, counted: DataFrame) -> str:
        path, b = self._new("runs"), self.state["buckets"]
        name = "barloom_run_" + hashlib.md5(path.encode()).hexdigest()[:16]
        counted.repartition(b, "fp").write.format("parquet").bucketBy(b, "fp").sortBy("fp", "ctx").option("path", path).saveAsTable(name)
        return path

    @property
    def runs(self) -> list[DataFrame]:
        return [self._run(x) for x in self.state["runs"]]

    def anchors(self) -> DataFrame:
        return self.spark.read.parquet(*self.state["anchors"])

    def hits(self) -> DataFrame:
        """Fingerprints that have occurred more than once, over all batches."""
        return self.spark.read.parquet(*self.state["hits"]).distinct()

    def ingest(self, texts: DataFrame, window: int) -> DataFrame:
        """Adds the anchors of a batch (rid, text). Returns the batch's hits: fingerprints it has more than once, or that history has."""
        placed, hits = self._new("anchors"), self._new("hits")
        anchors(texts, window).write.parquet(placed)
        found = self.spark.read.parquet(placed)
        written = self._write_run(_merged(found.select("fp", "ctx", F.lit(1).cast("long").alias("n"))))
        run = self._run(written)
        own = run.groupBy("fp").agg(F.sum("n").alias("n")).where("n > 1").select("fp")
        shared = [run.select("fp").join(past.select("fp").hint("merge"), "fp", "left_semi") for past in self.runs]
        reduce(DataFrame.union, shared, own).write.parquet(hits)
        self._commit(runs=[*self.state["runs"], written], anchors=[*self.state["anchors"], placed], hits=[*self.state["hits"], hits])
        if len(self.state["runs"]) > self.fan_in:
            self.compact()
        return self.spark.read.parquet(hits).distinct()

    def entries(self, fps: DataFrame, work: Workspace) -> DataFrame:
        """(fp, ctx, n, contexts) of the given fingerprints over all runs: how often an anchor was seen, and with how many ctx its fp."""
        # summed from written tables: Spark 4.1 takes a union of bucketed tables for bucketed, but reads it in other partitions
        merged = _merged(reduce(DataFrame.union, [work.write(run.join(fps.hint("merge"), "fp", "left_semi"), "entries") for run in self.runs]))
        # by fp and its hash: another step than the sums, so that Spark may split a fingerprint with very many contexts
        keyed = lambda df: df.withColumn("h", F.xxhash64("fp"))
        return keyed(merged).join(keyed(merged.groupBy("fp").agg(F.count(F.lit(1)).alias("contexts"))).hint("merge"), ["fp", "h"]).drop("h")

    def compact(self) -> None:
        """All runs merged into one sorted run; the old ones are deleted once it is in the manifest."""
        old = self.state["runs"]
        if len(old) > 1:
            whole = self._write_run(_merged(self.spark.read.parquet(*old)))
            self._commit(runs=[whole])
            for x in old:
                self.spark.sql("DROP TABLE IF EXISTS barloom_run_" + hashlib.md5(x.encode()).hexdigest()[:16])
                self._fs.delete(self._hadoop(x), True)

    def delete(self) -> None:
        for x in self.state["runs"]:
            self.spark.sql("DROP TABLE IF EXISTS barloom_run_" + hashlib.md5(x.encode()).hexdigest()[:16])
        self._fs.delete(self._hadoop(self.path), True)


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("fp", "ctx").agg(F.sum("n").alias("n"))


def _repeated(index: FingerprintIndex, texts: DataFrame, window: int, work: Workspace) -> DataFrame:
    """(rid, start, stop): word ranges that repeated windows cover."""
    # fingerprints that occur once are most, and leave here
    shared = work.write(index.entries(index.hits(), work), "shared")
    placed = work.write(index.anchors().join(shared.hint("merge"), ["fp", "ctx"]), "placed")
    settled = placed.where("n > 1").select("rid", F.col("lo").alias("start"), (F.col("hi") + window).alias("stop"))
    # where a fingerprint has several contexts, one place of each is asked; their windows are compared one by one
    place = F.struct("rid", "p", "lo", "hi").alias("rep")
    single = placed.where("contexts > 1 and n = 1").select(place, "fp", F.lit(True).alias("alone"))
    several = placed.where("contexts > 1 and n > 1").groupBy("fp", "ctx").agg(F.min(F.struct("rid", "p", "lo", "hi")).alias("rep"))
    rivals = single.unionByName(several.select("rep", "fp", F.lit(False).alias("alone"))).select("rep.*", "fp", "alone")
    asked = rivals.groupBy("rid").agg(F.collect_list(F.struct("p", "lo", "hi", "fp", "alone")).alias("asked"))
    windows = texts.select("rid", "text").join(asked, "rid").dropDuplicates(["rid"])  # equal rows: one is asked

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = utf8(part.column("text"))
                begins, ends, of = split(data, offsets)
                counts = np.bincount(of, minlength=part.num_rows)
                own = np.cumsum(counts) - counts
                entries = part.column("asked")
                row = np.repeat(np.arange(part.num_rows), np.diff(entries.offsets.to_numpy()))
                flat = entries.flatten()
                lo, hi, p = (flat.field(k).to_numpy().astype(np.int64) for k in ("lo", "hi", "p"))
                n = hi - lo + 1
                which = np.repeat(np.arange(len(lo)), n)
                start = lo[which] + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = own[row[which]] + start
                # equal windows have the anchor at an equal offset
                value = _digests(data, begins, ends, at, at + window, [bytes([x]) for x in (p[which] - start).tolist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid").take(pa.array(row[which])), flat.field("fp").take(pa.array(which)), pa.array(value), flat.field("alone").take(pa.array(which)), pa.array(start.astype(np.int32))],
                    names=["rid", "fp", "hash", "alone", "start"],
                )

    compared = work.write(windows.mapInArrow(hashes, "rid binary, fp long, hash long, alone boolean, start int"), "compared")
    twice = compared.groupBy("fp", "hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("fp", "hash")
    edges = compared.where("alone").join(twice, ["fp", "hash"]).select("rid", "start", (F.col("start") + window).alias("stop"))
    return settled.unionByName(edges)


def identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, rid): equal rows share a rid of 128 bits; all of them occur, as often as they are given."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("rid", F.unhex(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit("\u0001"), F.col("text")))))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, batches: int = 2, fan_in: int = 4) -> DataFrame:
    """Texts without the words of repeated windows: ``id_col``, n_words, n_removed, kept (its words joined by one space).

    ``batches``: into so many parts the rows are dealt, which a new index ingests one after another.
    """
    index, texts = FingerprintIndex(df.sparkSession, fan_in=fan_in), identified(df, id_col, text_col)
    for b in range(int(batches)):
        index.ingest(texts.where(F.pmod(F.xxhash64("rid"), F.lit(int(batches))) == b), window)
    return kept_words(index, df, id_col, text_col, window)


def kept_words(index: FingerprintIndex, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """``remove_repeats`` for the rows that an index has ingested, all of them."""
    if not GRAM < window < 64:
        raise ValueError(f"window must be from {GRAM + 1} to 63")
    work, texts = Workspace(df.sparkSession, "substring"), identified(df, id_col, text_col)
    gone = work.write(_repeated(index, texts, window, work), "ranges")
    ranges = gone.groupBy("rid").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, cuts in zip(batch.column("text"), batch.column("ranges"), strict=True):
                words = text.as_py().encode().split()
                n_words.append(len(words))
                if cuts.is_valid:
                    fields = cuts.values
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, fields.field("start").to_numpy(), 1)
                    np.add.at(depth, fields.field("stop").to_numpy(), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    id_type = df.select(id_col).schema[0].dataType.simpleString()
    out = texts.join(ranges, "rid", "left").select("id", "text", "ranges").mapInArrow(cut, f"id {id_type}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_col)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs, window=35).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The rules of the operator word for word, without fingerprints.
OP2_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
k AS (SELECT doc_id, i, sha256(array_to_string(words[i:i+34], ' ')) AS k FROM s),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM k) WHERE c > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM d),
a AS (SELECT doc_id, list(j) AS js FROM g GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(js), 0)::BIGINT AS n_removed,
       sha256(CASE WHEN js IS NULL THEN array_to_string(words, ' ')
                   ELSE array_to_string(list_filter(words, lambda x, i: NOT list_contains(js, i)), ' ') END) AS kept_sha256
FROM w LEFT JOIN a USING (doc_id)
"""
