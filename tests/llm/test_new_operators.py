"""Nearest neighbours, spelling groups and token alignment against plain versions, and on edge rows."""

import hashlib
import os
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import re
from pyspark.sql import functions as F

from barloom.llm import partition_index, registry, spelling, token_align
from barloom.llm._shared import Workspace

D = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- spelling


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows):
    small, counts = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}), Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(small)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_groups(counts):
    form, n_near = {}, {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form[w], n_near[w] = (best if best is not None and counts[best] >= 2 * n else None), len(near)
    out = set()
    for w in counts:
        end = w
        while form[end]:
            end = form[end]
        out.add((w, form[w], end, counts[w], n_near[w], counts[form[w]] if form[w] else None))
    return out


def test_spelling_small(spark):
    rng = np.random.default_rng(5)
    roots = ["walked", "walker", "stone", "stones", "caféés", "Øresund", "banana", "aaaaa", "aaaaaa", "Stone", "STONE"]
    texts = []
    for _ in range(2000):
        w = str(rng.choice(roots))
        if rng.random() < 0.3:
            at = int(rng.integers(len(w)))
            w = w[:at] + str(rng.choice(["", "a", "e", "é", w[at] * 2])) + w[at + 1 :]
        texts.append(w)
    rows = [(int(i), " ".join(texts[i * 10 : i * 10 + 10])) for i in range(200)] + [(None, "stone stone,stones"), (3, None), (4, ""), (5, "x" * 30_000 + " " + "x" * 29_999), (5, "x" * 30_000 + " " + "x" * 29_999), (6, ("x" * 30_000 + " ") * 7 + "123 ×÷×÷× " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("word", "n", "key", "run", "near")))
    words = spelling.vocabulary(df.select(F.explode(spelling.runs(F.col("text"))).alias("run"), "doc_id").select(spelling.slipped(F.col("doc_id"), F.col("run")).alias("word")), 5, 3)
    counts = plain_words(rows)
    assert {(r["word"], r["n"]) for r in words.collect()} == set(counts.items()) and len(counts) > 20
    for symbols in (2, 8):
        got = spelling.spelling_groups(words, symbols=symbols)
        assert {tuple(r) for r in got.collect()} == plain_groups(counts) and got.count() == len(counts)
    assert spelling.spelling_groups(words.where("false")).count() == 0


def test_neighbourhoods_are_full_from_one_side():
    """A word's own reduced form, those with one symbol left out and those with a greater symbol, each once."""
    s = np.array([[ord("a") + i for i in (0, 0, 1, 2, 2, 2)]], np.uint32)
    keys = [k for _, keys, _ in spelling.neighbourhoods(s, 3) for k in keys.tolist()]
    reduced = (s[0].astype(int) * 7 % 3).tolist()
    value, base = spelling._symbol_values(3).tolist(), int(spelling._BASE)
    key = lambda word: sum(value[c] * pow(base, len(word) - 1 - i, 2**64) for i, c in enumerate(word)) % 2**64
    want = {tuple(reduced)} | {tuple(reduced[:i] + reduced[i + 1 :]) for i in range(6)} | {tuple([*reduced[:i], c, *reduced[i + 1 :]]) for i in range(6) for c in range(reduced[i] + 1, 3)}
    assert len(keys) == len(set(keys)) and set(keys) == {key(w) for w in want}
    # slices change nothing
    many = np.repeat(s, 3, axis=0)
    whole = sorted((r, k) for rows, keys, _ in spelling.neighbourhoods(many, 3) for r, k in zip(rows.tolist(), keys.tolist()))
    spelling._SLICE, kept = 9, spelling._SLICE
    try:
        assert whole == sorted((r, k) for rows, keys, _ in spelling.neighbourhoods(many, 3) for r, k in zip(rows.tolist(), keys.tolist()))
    finally:
        spelling._SLICE = kept


def test_spelling_without_broadcast(spark):
    rows = [(w, n) for w, n in (("hello", 50), ("hallo", 20), ("hullo", 9), ("hell", 7), ("helloo", 3), ("other", 8))]
    df = spark.createDataFrame(rows, "word string, n long")
    near = [sorted(tuple(r) for r in spelling.near_words(df, Workspace(spark, "t"), broadcast_bytes=b).collect()) for b in (-1, 1 << 20)]
    assert near[0] == near[1] == sorted((a, n, b, m) for a, n in rows for b, m in rows if one_edit(a, b))


def test_chains_end(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)], "word string, form string")
    assert {r["root"] for r in spelling.chain_ends(links, 4, Workspace(spark, "t")).collect()} == {"w13"}


def test_spelling_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{D}/documents.parquet'")
    got = registry.QUERIES["op12_spelling_groups"](spark, D)
    cur = con.execute(registry.SQL["op12_spelling_groups"])
    names = [x[0] for x in cur.description]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(cur.fetchall())


# ---- token alignment


def letters_of_bytes():
    """The letters of a byte-level vocabulary: visible bytes are themselves, the others follow from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), letters_of_bytes()
    a.encode_special_tokens = True
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for _, text in rows:
        ia, ib = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        spelt = [[bytes(letters[c] for c in a.id_to_token(i)) for i in ia], [piece(i) for i in ib]]
        if not text or any(b"".join(s) != (" " + text).encode() for s in spelt):
            found.append(None)
            continue
        ends = [np.cumsum([len(t) for t in s]) for s in spelt]
        begins = [e - [len(t) for t in s] for e, s in zip(ends, spelt)]
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0].tolist()) & set(ends[1].tolist())):
            p, q = (int(np.searchsorted(e, cut, "right")) for e in ends)
            groups.append((ia[i:p], ib[j:q]))
            i, j = p, q
        links = [(ia[x], ib[y]) for x in range(len(ia)) for y in np.flatnonzero((begins[1] < ends[0][x]) & (ends[1] > begins[0][x])).tolist()]
        found.append((len(ia), len(ib), groups, links))
    counts, best = Counter(x for f in found if f for x in f[3]), Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for (i, _), f in zip(rows, found):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, "", ""))
        else:
            shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in f[2])
            out.append((i, f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), hashlib.sha256(shown.encode()).hexdigest(), shown))
    return out


TEXTS = [
    "The quick brown fox, don't you think?", "The quick brown fox, don't you think?", None, "", " ", "  two  spaces  ", "a\n\nb\tc \n", "<|endoftext|> <s> </s> plain", "x▁y lost", "日本 語 \U0001f600 end ", "nul \x00 \x85   　 x  y   z",
    "é é ﬁ ²", "z" * 3000 + " " + "q " * 2000, "12345678901234567890 3.14159", " ".join(f"word{i % 37}" for i in range(4000)), "　", "ends with a wide space　 ", "tab\t x", "\r\n x",
]


@pytest.mark.parametrize("limit", [-1, 16 << 20])
def test_alignment_small(spark, limit):
    rows = [(i if i != 5 else None, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(1).alias(c) for c in ("tid", "copies", "pairs", "pair", "count", "n_a", "groups")))
    got = token_align.align_tokenizers(df, A, B, broadcast_bytes=limit, with_groups=True)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_alignment(rows), key=key)


def test_alignment_query(spark):
    """The whole table, and an empty one."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = registry.QUERIES["op13_token_alignment"](spark, D)
    assert sorted(map(tuple, got.collect())) == sorted(x[:8] for x in plain_alignment(rows))
    assert token_align.align_tokenizers(docs.where("false"), A, B).count() == 0


def test_units_are_forgotten():
    tools, fresh = (token_align.Aligner(A, B) for _ in range(2))
    kept, token_align._REMEMBERED = token_align._REMEMBERED, 3
    try:
        for words in ("one two three four", "two five one six", "seven one"):
            part = pa.record_batch({"text": [words, words + "!"], "copies": [1, 1]})
            assert token_align.align_part(tools, part, True).equals(token_align.align_part(fresh, part, True))
            token_align._REMEMBERED = 3
    finally:
        token_align._REMEMBERED = kept


# ---- nearest neighbours


def plain_nearest(rows, k=20):
    """(query, rank, id, score) of all rows, scores added in order."""
    out = []
    for q, x in rows:
        if q % 20 == 0:
            scores = []
            for i, y in rows:
                if i != q:
                    s = 0.0
                    for a, b in zip(x, y):
                        s += a * b
                    scores.append((-s, i))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return out


def asked(df, **settings):
    return partition_index.nearest_neighbours(df, F.col("id") % 20 == 0, **settings)


def test_nearest_small(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(200)]  # many ties
    rows += [(i, [1.0, 0.0, 2.0, 0.0, -1.0, 1.0]) for i in range(200, 300)]  # one vector very often
    rows = [(i, v) for i, v in rows if any(v)]
    out = [(1000, None), (1020, [0.0] * 6), (1040, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1060, [float("nan")] + [1.0] * 5), (1080, [float("inf")] + [1.0] * 5), (1100, [1.0] * 5), (1120, []), (None, [9.0] * 6), rows[0], rows[0]]
    df = spark.createDataFrame(rows + out, "vec_id long, embedding array<double>").select("*", *(F.lit(1).alias(c) for c in ("id", "vec", "part", "ids", "block", "label")))
    assert sorted(map(tuple, asked(df).collect())) == sorted(plain_nearest(rows))
    few = df.where("vec_id < 5")
    assert sorted(map(tuple, asked(few).collect())) == sorted(plain_nearest([r for r in rows if r[0] < 5]))
    assert asked(df.where("vec_id = 0")).count() == 0 and asked(df.where("false")).count() == 0
    again = df.unionByName(spark.createDataFrame([(40, [-9.0] * 6)], "vec_id long, embedding array<double>"), allowMissingColumns=True)
    assert {tuple(r) for r in asked(again).where("query_id = 40").collect()} == {r for r in plain_nearest([(i, v if i != 40 else [-9.0] * 6) for i, v in rows]) if r[0] == 40}


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "vec_id long, embedding array<double>")
    whole = sorted(map(tuple, asked(df, rows_per_part=100, recall=1.0).collect()))
    monkeypatch.setattr(partition_index, "_BLOCK", 40)
    monkeypatch.setattr(partition_index, "_CHUNK", 5)
    assert sorted(map(tuple, asked(df, rows_per_part=100, recall=1.0).collect())) == whole


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(6)
    middle = rng.normal(size=(8, 16)) * 4
    x = middle[np.arange(800) % 8] + rng.normal(size=(800, 16))
    near = partition_index.neighbour_graph(x, 10)
    part = partition_index.balanced_parts(x, near, 3)
    assert np.bincount(part).tolist() == [100] * 8
    assert np.mean(part[np.repeat(np.arange(800), 10)] == part[near.ravel()]) > 0.8
    router = partition_index.fit_router(x, 3, 10, 0.95)
    assert router.probes <= 4


def test_shelves():
    shelf, blocks = partition_index.shelved(np.array([3, 4, 0, 9, 25, 1, 2]), 10)
    assert shelf.tolist() == [0, 0, 0, 1, 2, 3, 3] and blocks.tolist() == [1, 1, 3, 1]


def test_nearest_recall(spark):
    """Parts are visited as the classifier says, and hold at least nine in ten of the true neighbours."""
    got = asked(spark.read.parquet(f"{D}/embeddings.parquet"), rows_per_part=60)
    rows = [(r["vec_id"], list(map(float, r["embedding"]))) for r in spark.read.parquet(f"{D}/embeddings.parquet").collect()]
    want, have = {(q, i) for q, _, i, _ in plain_nearest(rows)}, {(r["query_id"], r["vec_id"]) for r in got.collect()}
    assert len(have) == len(want) and len(want & have) >= 0.9 * len(want)
    assert {tuple(r) for r in registry.QUERIES["op11_nearest_neighbours"](spark, D).collect()} == set(plain_nearest(rows))
