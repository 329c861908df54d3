"""Chat transcripts: roles recovered by a hidden Markov model, then canonical turns.

A transcript is blocks of text in order. A block's first line may carry a speaker marker (``User:``, ``### Response:``, ``[INST]``,
``<|assistant|>``, or ``>>``, which tells that somebody else speaks but not who). States of the model are the roles; a line's
observations are its marker, its length, its end mark, whether it is the transcript's first, and whether it begins a block. From
one line to the next the role stays, unless the next line begins a block; then it moves by the model's role table. Viterbi gives the
most probable roles of all lines; lines of one role that no marker parts make a turn, which is rendered as
``<|role|>\\n`` text ``<|end|>\\n`` without the markers.

The model is fitted on labelled turns by smoothed counts over at most about ``max_rows`` of them; for named markers the counts start from the role they name.

Transcripts are range-partitioned by (conversation, order) and checkpointed, so a conversation of any length is spread over as many
partitions as it fills. Each partition reduces the part of a conversation that crosses its border to one matrix of best scores from the
role before it to the role at its end; the driver gets at most two such matrices a partition, and gives back the roles at the borders. A
long conversation's result is that of Viterbi over the whole, wherever it was cut: scores are whole numbers, so sums don't depend on their order, and
a little of a hash of each line's block and place goes into them, so that no two paths tie.

Null texts are empty; an empty block is one empty line. Null conversations form one. Blocks with equal order stand in order of
their text. Repeated rows are blocks each. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import shared_folder
from ._words import mix

ROLES = ["system", "user", "assistant"]
_NAMES = {
    "system": 0, "sys": 0, "instruction": 0, "instructions": 0, "context": 0,
    "user": 1, "human": 1, "question": 1, "q": 1, "prompter": 1, "customer": 1, "inst": 1, "input": 1,
    "assistant": 2, "ai": 2, "bot": 2, "answer": 2, "a": 2, "response": 2, "model": 2, "agent": 2, "gpt": 2, "output": 2,
}
_MARKER = re.compile(r"\s*(?:(>>+)|\*{0,2}(?:\[/?|<\|?/?|#{1,4}\s*)?(?:im_start\|?>)?\s*([A-Za-z]{1,12})\s*(?:\]|\|?>|:)\s*\*{0,2}:?)\s*")
#: marker classes: none, somebody else, then one for each role
_NO_MARKER, _OTHER = 0, 1
#: Scores are in these parts of a nat; what can't be is far below what can.
_UNIT, _NEVER = 1 << 24, -(1 << 50)
_STAY = np.where(np.eye(3, dtype=bool), 0, _NEVER)
_LENGTHS = np.array([1, 20, 40, 60, 80, 110, 140, 170, 200, 240, 300, 400, 600, 1000])


def read_marker(line: str) -> tuple[int, str]:
    """(marker class, the line without it)"""
    m = _MARKER.match(line)
    if m:
        if m[1]:
            return _OTHER, line[m.end() :]
        role = _NAMES.get(m[2].lower())
        if role is not None:
            return 2 + role, line[m.end() :]
    return _NO_MARKER, line


def observe(text: str, first: bool, at: object = None) -> tuple[list[str], np.ndarray]:
    """Lines without markers, and for each: marker, length class of the line, length class of the block, last mark, first of all, begins a block, a number of its own."""
    lines, out = [], []
    whole = int(np.searchsorted(_LENGTHS, len(text), "right"))
    own = zlib.crc32(f"{at}|{text}".encode("utf-8", "replace"))
    for i, line in enumerate(text.split("\n")):
        marker, rest = read_marker(line)
        lines.append(rest)
        end = {"?": 1, ":": 2, ".": 3, "!": 4}.get(rest.rstrip()[-1:], 0)
        out.append((marker, int(np.searchsorted(_LENGTHS, len(rest), "right")), whole, end, int(first and i == 0), int(i == 0), own * 4_000_037 + i * 4))
    return lines, np.array(out, np.int64)


@dataclass
class ChatModel:
    start: np.ndarray  # log probability of the first line's role
    move: np.ndarray  # from role to role where a block begins
    marker: np.ndarray  # role x marker class
    length: np.ndarray  # role x length class of a block
    end: np.ndarray  # role x last mark

    def fixed(self) -> "ChatModel":
        """The same in whole numbers."""
        return ChatModel(*(np.rint(x * _UNIT).astype(np.int64) for x in (self.start, self.move, self.marker, self.length, self.end)))

    def emission(self, seen: np.ndarray) -> np.ndarray:
        """lines x roles; a block's length counts once, at its first line."""
        score = self.marker[:, seen[:, 0]].T + self.end[:, seen[:, 3]].T
        apart = (mix(seen[:, 6:].astype(np.uint64) + np.arange(3, dtype=np.uint64)) & np.uint64(1023)).astype(np.int64)
        return score + np.where(seen[:, 5:6] == 1, self.length[:, seen[:, 2]].T, 0) + apart

    def step(self, seen: np.ndarray) -> np.ndarray:
        """Scores from role to role into this line."""
        if seen[4]:
            return np.broadcast_to(self.start, (3, 3))
        if seen[5] or seen[0]:
            return self.move
        return _STAY


def _log(counts: np.ndarray) -> np.ndarray:
    return np.log((counts + 0.5) / (counts + 0.5).sum(axis=-1, keepdims=True))


def fit(turns: DataFrame, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", max_rows: int = 20_000) -> ChatModel:
    """Counts over labelled turns of about ``max_rows`` rows, whole conversations by their hash."""
    known = turns.where(F.col(role_col).isin(ROLES)).select(F.col(conv_col).alias("conv"), F.col(order_col).alias("at"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    share = min(1.0, max_rows / max(1, known.count()))
    sample = known.where(F.pmod(F.xxhash64("conv"), F.lit(1 << 30)) < int(share * (1 << 30)))
    near = Window.partitionBy("conv").orderBy("at", "text")
    last = F.trim(F.col("text")).substr(-1, 1)
    mark = F.when(last == "?", 1).when(last == ":", 2).when(last == ".", 3).when(last == "!", 4).otherwise(0)
    size = sum((F.length("text") >= int(b)).cast("int") for b in _LENGTHS)

    @F.pandas_udf("int")
    def named(text: pd.Series) -> pd.Series:
        return text.map(lambda t: read_marker(t.split("\n", 1)[0])[0])

    table = sample.select("role", F.lag("role").over(near).alias("before"), size.alias("size"), mark.alias("mark"), named("text").alias("marker"))
    counted = table.groupBy("role", "before", "size", "mark", "marker").count().collect()  # a few hundred rows at most
    start, move, length, end, names = np.zeros(3), np.zeros((3, 3)), np.zeros((3, len(_LENGTHS) + 1)), np.zeros((3, 5)), np.zeros((3, 3))
    for r in counted:
        k, n = ROLES.index(r["role"]), r["count"]
        if r["before"] is None:
            start[k] += n
        else:
            move[ROLES.index(r["before"]), k] += n
        length[k, r["size"]] += n
        end[k, r["mark"]] += n
        if r["marker"] > _OTHER:
            names[k, r["marker"] - 2] += n
    # no marker and the nameless one say nothing of the role; a named one is right nearly always, but for what the labelled turns tell
    told = np.where(np.eye(3, dtype=bool), 99.0, 0.5) + names
    marker = np.log(np.column_stack([np.full((3, 2), 0.2), 0.6 * told / told.sum(axis=1, keepdims=True)]))
    # last marks are of whole blocks; lines within them end as they may
    return ChatModel(_log(start), _log(move), marker, _log(length), 0.2 * _log(end))


def _best(model: ChatModel, seen: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores at the last line from those before the first (one row for each), and the best roles before each line."""
    emission, back = model.emission(seen), np.zeros((len(seen), 3), np.int8)
    score = entry
    for t in range(len(seen)):
        reach = score[:, None] + model.step(seen[t])
        back[t] = reach.argmax(axis=0)
        score = reach.max(axis=0) + emission[t]
    return score, back


def _matrix(model: ChatModel, seen: np.ndarray) -> np.ndarray:
    """Best scores from each role before the lines to each role at their end."""
    return np.stack([_best(model, seen, np.where(np.arange(3) == k, 0, _NEVER))[0] for k in range(3)])


def _path(back: np.ndarray, last: int) -> tuple[list[int], int]:
    """Roles of the lines given the last one, and the role before them."""
    roles, now = [], last
    for t in range(len(back) - 1, -1, -1):
        roles.append(now)
        now = int(back[t, now])
    return roles[::-1], now


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple[int, str, bool]]]]:
    """(conversation, its blocks in this partition) one after another; a block is (place, text, first of all)."""
    conv, blocks = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "at", "text", "first")), strict=True):
            if blocks and row[0] != conv:
                yield conv, blocks
                blocks = []
            conv = row[0]
            blocks.append(row[1:])
    if blocks:
        yield conv, blocks


def recover_turns(blocks: DataFrame, model: ChatModel, conv_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """A row for each block, in its conversation's order: ``conv_col``, ``order_col``, role (of its first line), roles (of its lines, as
    letters s, u, a), content (lines without markers), opens (it begins a turn), rendered (its part of the canonical text: the parts
    of a conversation in order are its rendering, but for the end mark, which comes with the part that is last of its turn)."""
    spark = blocks.sparkSession
    shared_folder(spark)
    rows = blocks.select(F.col(conv_col).alias("conv"), F.col(order_col).alias("at"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    firsts = rows.groupBy("conv").agg(F.min(F.struct("at", "text")).alias("least"))
    tagged = rows.join(firsts.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of"))).select("conv", "at", "text", F.struct("at", "text").eqNullSafe(F.col("least")).alias("head"), F.monotonically_increasing_id().alias("nth"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    # equal rows may be many: the running number parts them
    dealt = tagged.repartitionByRange("conv", "at", "text", "nth").sortWithinPartitions("conv", "at", "text", "nth").select("conv", "at", "text", F.col("head").alias("first")).checkpoint()
    sent = spark.sparkContext.broadcast(model.fixed())

    def seen_of(blocks: list[tuple], leads: bool) -> tuple[list[list[str]], np.ndarray]:
        lines, seen, open_ = [], [], leads
        for at, text, first in blocks:
            own, s = observe(text, first and open_, at)
            open_ = open_ and not first  # of equal heads the first only
            lines.append(own)
            seen.append(s)
        return lines, np.concatenate(seen)

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept = TaskContext.get().partitionId(), []
        for conv, own in _pieces(batches):  # the first and the last conversation may go on beyond
            kept = [*kept[:1], (conv, own)] if kept else [(conv, own)]
        out = [{"part": part, "place": i, "conv": str(conv), "null": conv is None, "starts": bool(own[0][2]), "best": _matrix(sent.value, seen_of(own, True)[1]).ravel().tolist()} for i, (conv, own) in enumerate(kept)]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("place", pa.int32()), ("conv", pa.string()), ("null", pa.bool_()), ("starts", pa.bool_()), ("best", pa.list_(pa.int64()))]))

    ends = sorted(dealt.mapInArrow(borders, "part int, place int, conv string, null boolean, starts boolean, best array<long>").collect(), key=lambda r: (r["part"], r["place"]))
    # chains of border pieces of one conversation in consecutive partitions -> (role before, role at the end) of each piece
    fixed: dict[tuple[int, int], tuple[int, int]] = {}
    k = 0
    while k < len(ends):
        chain = [ends[k]]
        while k + 1 < len(ends) and ends[k + 1]["place"] == 0 and (ends[k + 1]["conv"], ends[k + 1]["null"]) == (chain[0]["conv"], chain[0]["null"]) and ends[k + 1]["part"] > chain[-1]["part"]:
            k += 1
            chain.append(ends[k])
        k += 1
        if len(chain) > 1:
            scores, trace = np.zeros(3, np.int64), []
            for piece in chain:
                reach = scores[:, None] + np.array(piece["best"], np.int64).reshape(3, 3)
                trace.append(reach.argmax(axis=0))
                scores = reach.max(axis=0)
            role = int(scores.argmax())
            for piece, back in zip(chain[::-1], trace[::-1], strict=True):
                before = int(back[role])
                fixed[(piece["part"], piece["place"])] = (before, role)
                role = before
    known = spark.sparkContext.broadcast((fixed, {(r["part"], r["place"]) for r in ends}))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own_model, (border, _) = TaskContext.get().partitionId(), sent.value, known.value
        conv_type = None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [conv_type, at_type, pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv", "at", "role", "roles", "content", "opens", "rendered"])

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal conv_type, at_type
            for batch in batches:
                conv_type, at_type = batch.schema.field("conv").type, batch.schema.field("at").type
                yield batch

        at_type = None
        pieces = _pieces(typed())
        ahead = next(pieces, None)
        n = 0
        while ahead is not None:
            conv, own = ahead
            ahead = next(pieces, None)
            place = 0 if n == 0 else 1 if ahead is None else None
            n += 1
            lines, seen = seen_of(own, True)
            before, last = border.get((part, place), (None, None)) if place is not None else (None, None)
            entry = np.zeros(3, np.int64) if before is None else np.where(np.arange(3) == before, 0, _NEVER)
            scores, back = _best(own_model, seen, entry)
            roles, _ = _path(back, int(scores.argmax()) if last is None else last)
            done, now = 0, None if own[0][2] else before
            for (at, _, _), text in zip(own, lines, strict=True):
                mine = roles[done : done + len(text)]
                rendered, opens = [], mine[0] != now or bool(seen[done, 0]) or bool(seen[done, 4])
                for i, (role, line) in enumerate(zip(mine, text, strict=True)):
                    turns = role != now or bool(seen[done + i, 0]) or bool(seen[done + i, 4])
                    if turns:
                        rendered.append(("" if now is None else "<|end|>\n") + f"<|{ROLES[role]}|>\n{line}\n")
                    else:
                        rendered.append(line + "\n")
                    now = role
                done += len(text)
                out.append((conv, at, ROLES[mine[0]], "".join(ROLES[r][0] for r in mine), "\n".join(text), opens, "".join(rendered)))
            if len(out) >= 4096:
                yield flush()
                out.clear()
        if out:
            yield flush()

    types = {f.name: f.dataType.simpleString() for f in dealt.schema}
    found = dealt.mapInArrow(label, f"conv {types['conv']}, at {types['at']}, role string, roles string, content string, opens boolean, rendered string")
    return found.withColumnsRenamed({"conv": conv_col, "at": order_col})


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of ``conversations`` from their texts alone: each turn stands behind a nameless marker. The model is fitted on labelled turns."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    blocks = turns.select("conv_id", "turn", F.concat(F.lit(">> "), F.coalesce("text", F.lit(""))).alias("text"))
    found = recover_turns(blocks, fit(turns))
    return found.select("conv_id", "turn", "role", "roles", "opens", F.length("content").cast("long").alias("n_chars"), F.sha2("rendered", 256).alias("rendered_sha256"))
