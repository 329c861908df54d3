"""The pipeline's stages, each on what the one before kept."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from barloom.llm import decontaminate, near_dedup

D = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path}/{name}"
        before = docs
        stage(spark, docs, D).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= n
            n = docs.count()
        if name == "near_dedup":
            classes = near_dedup.near_duplicates(docs)
            assert classes.select("class_id").distinct().count() == docs.count()
        if name == "decontamination":
            items = spark.read.parquet(f"{D}/benchmark.parquet")
            assert decontaminate.contamination(docs, items).count() == 0
            gone = {r[0] for r in before.select("doc_id").subtract(docs.select("doc_id")).collect()}
            texts = [decontaminate.normalized(r[0]) for r in items.select("text").collect()]
            for r in before.collect():
                assert (r["doc_id"] in gone) >= any(t in decontaminate.normalized(r["text"]) for t in texts)
    assert {r[0] for r in docs.select("doc_id").distinct().collect()} == {r[0] for r in before.select("doc_id").collect()}
    assert corpus_pipeline.run(spark, D).count() == docs.count()


def test_one_whole_copy_of_a_repeated_document_stays(spark):
    copied = "\n".join(f"line {i} of a text that many pages repeat" for i in range(12))
    rows = [(i, copied, "en", "s", len(copied)) for i in range(50)]
    rows += [(100 + i, f"menu\nown words {i * 7919} of page {i} and of no other {i * 104729}", "en", "s", 9) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (corpus_pipeline.line_stage, corpus_pipeline.near_duplicate_stage, corpus_pipeline.decontamination_stage):
        docs = stage(spark, docs, D)
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got.pop(0) == copied
    assert len(got) == 100 and all(t.startswith("own words") for t in got.values())


DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda".split()
TEXT = " ".join(WORDS[i * i % 11] + str(i % 13) for i in range(300))
ROWS = [(1, TEXT, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "one two", "de", None, 7), (5, TEXT, "en", "a", 1), (5, TEXT, "en", "a", 1), (7, "x" * 300_000, "en", "b", 1), (8, "\n\n \t", "fr", "b", 4), (9, "word\n" * 50_000, "es", "c", 3)]


def test_stages_on_edge_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns with clashing names, and an empty table."""
    clash = ("tid", "rid", "row", "key", "lines", "score", "kept", "h", "n", "id", "pivot", "kind")
    edge = spark.createDataFrame(ROWS, DOC).select("*", *(F.lit(i).alias(c) for i, c in enumerate(clash)))
    for given, few in ((edge, False), (spark.createDataFrame([], DOC), True)):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            path = f"file://{tmp_path}/{few}-{name}"
            stage(spark, docs, D).write.parquet(path)
            before, docs = docs, spark.read.parquet(path)
            if name != "packing":
                assert docs.columns == given.columns and docs.count() <= before.count()
            if name == "line_dedup":  # rows stay, and n_chars follows the text
                assert docs.count() == before.count() and docs.where("text is not null and n_chars <> length(text)").isEmpty()
            if name == "near_dedup" and not few:
                left = Counter(r["doc_id"] for r in docs.collect())
                assert max(left.values()) == 1 and not {1, 5} <= set(left)
        assert docs.isEmpty() == before.isEmpty()


def test_stages_keep_every_row_that_has_no_fault(spark):
    """Each stage by itself on the edge rows: quality scores, lines, classes and benchmark items by the operators' own tests; here nothing else may go."""
    docs = spark.createDataFrame(ROWS, DOC)
    model = corpus_pipeline.quality.fit_on_labels(spark, D)
    scores = {(r["id"], r["n"]): r["score"] for r in corpus_pipeline.quality.score(docs.withColumn("k", F.monotonically_increasing_id()), model, "k").select(F.col("k").alias("id"), F.lit(0).alias("n"), "score").collect()}
    assert corpus_pipeline.quality_stage(spark, docs, D).count() == sum(x >= 0.3 for x in scores.values())
    assert Counter(r[0] for r in corpus_pipeline.near_duplicate_stage(spark, docs, D).select("doc_id").collect()) == Counter([1, 2, 3, None, 7, 8, 9])
    assert corpus_pipeline.decontamination_stage(spark, docs, D).count() == len(ROWS)
    packed = corpus_pipeline.packing_stage(spark, docs, D).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("length").alias("least")).collect()
    assert {r["doc_id"] for r in packed} == {1, 2, 3, None, 5, 7, 8, 9} and all(r["least"] >= 1 for r in packed)


def test_packed_sequences_hold_all_tokens(spark, tmp_path):
    """What the last stage writes is the sequences themselves: read back, a sequence's pieces one after another, and a document's tokens from these."""
    from tokenizers import Tokenizer

    path = f"file://{tmp_path}/packed"
    corpus_pipeline.packing_stage(spark, spark.createDataFrame(ROWS, DOC), D).write.parquet(path)
    t = Tokenizer.from_file(corpus_pipeline.packing.word_vocabulary())
    want = Counter((r[0], tuple([*t.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in ROWS)
    sequences, documents = {}, {}
    stored = spark.read.parquet(path).withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id()}).orderBy("at").collect()
    for r in stored:
        tokens = sequences.setdefault(r["sequence_id"], [])
        assert r["offset"] == len(tokens) and len(r["ids"]) == r["length"]
        tokens += r["ids"]
        assert len(tokens) <= 4096
        # copies of a document are told apart by nothing but their number
        documents.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], tuple(r["ids"])))
    assert len({(r["sequence_id"], r["file"]) for r in stored}) == len(sequences)
    whole = {}
    for (doc, piece), found in sorted(documents.items(), key=lambda x: x[0][1]):
        for k, (start, ids) in enumerate(sorted(found)):
            before = whole.setdefault((doc, k), [])
            assert start == len(before) and bool(piece) == bool(before)
            before += ids
    assert Counter((doc, tuple(ids)) for (doc, _), ids in whole.items()) == want
