"""Line dedup by site-relative frequency.

Rows are grouped by host. A line's ratio is the number of the host's pages that contain it, divided by the
host's pages; lines on more than one page whose ratio is above ``ratio`` are boilerplate of that host and are dropped from its
pages, wherever they stand. A host's pages are its distinct texts (null is one), so that a text repeated often doesn't turn its own lines into
boilerplate; near copies are pages each. All of it is DataFrame functions: distinct lines of a page are
exploded as two hashes (128 bits), counts are combined before the shuffle, and what is left for a host is small by
its definition (a page has each distinct line once, so at most mean distinct lines / ratio), whatever its pages. Pages stay where they are if what was found for
all hosts is less than ``broadcast_bytes`` once it is written; else they are merge-joined with it by host, and Spark splits large hosts.

Null hosts form one host of their own. A null text stays null and counts as a page without lines; an empty text has
one empty line. Blank lines are never dropped. A page whose lines are all dropped becomes an empty text. Repeated rows all stay.
Other columns are carried along, also ones named like those in here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Workspace


def _line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def site_boilerplate(df: DataFrame, host: Column, text: Column, ratio: float) -> DataFrame:
    """(host, lines): the keys of each host's boilerplate lines, for hosts that have any."""
    keys = F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""), _line_key))
    # a page by its digest and its lines' keys, so that no text is shuffled
    pages = df.select(host.alias("host"), F.unhex(F.md5(text)).alias("digest"), keys.alias("keys")).dropDuplicates(["host", "digest"])
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = pages.select("host", F.explode("keys").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = counts.join(totals.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > ratio * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_site_boilerplate(df: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, broadcast_bytes: int = 16 << 20) -> DataFrame:
    """``df`` with the boilerplate lines of each host taken out of ``text_col``; all its columns and rows stay."""
    work = Workspace(df.sparkSession, "lines")
    found = work.write(site_boilerplate(df, F.col(host_col), F.col(text_col), ratio), "boilerplate")
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    joined = rows.join(work.joinable(found, broadcast_bytes).withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("lines", _line_key(x))), "\n")
    text = F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept)
    return joined.select("row", text.alias("kept")).select(*(F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in df.columns))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ``documents`` on more than one in twenty texts of their source are dropped."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_lines = lambda c: F.coalesce(F.size(F.split(c, "\n", -1)), F.lit(0)).cast("long")
    kept = drop_site_boilerplate(docs.withColumn("before", n_lines("text")))
    # a text from which all lines went is as empty as one that had a single empty line
    return kept.select("doc_id", F.col("before").alias("n_lines"), F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("kept_md5"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT DISTINCT source, text, ls FROM d),
t AS (SELECT source, count(*) AS pages FROM p GROUP BY source),
l AS (SELECT source, x, count(*) AS n FROM (SELECT source, unnest(list_distinct(ls)) AS x FROM p) WHERE trim(x) <> '' GROUP BY source, x),
b AS (SELECT l.source, list(x) AS xs FROM l JOIN t ON l.source IS NOT DISTINCT FROM t.source WHERE n > 1 AND n > 0.05 * pages GROUP BY l.source),
k AS (SELECT doc_id, ls, CASE WHEN xs IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x: NOT list_contains(xs, x)), chr(10)) END AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, length(kept)::BIGINT AS n_chars_kept, md5(kept) AS kept_md5 FROM k
"""
