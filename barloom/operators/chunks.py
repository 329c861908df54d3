"""Windows over long series in parts, so that one symbol with very many rows isn't one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.scratch import written


def overlapping(df: DataFrame, back: int = 0, ahead: int = 0, chunk: int = 50_000) -> DataFrame:
    """Rows (symbol, idx, ...) with ``_part``, the chunk of ``idx`` they are seen in. Rows near a border come again in the neighbouring chunk, whose windows
    reach ``back`` rows before and ``ahead`` rows after their own; ``own_rows`` drops them again."""
    chunk = max(chunk, back, ahead, 1)
    home, within = F.floor(F.col("idx") / chunk), F.col("idx") % chunk
    parts = F.array_compact(F.array(home, F.when(within >= chunk - back, home + 1), F.when((within < ahead) & (home > 0), home - 1)))
    return df.withColumns({"_home": home, "_parts": parts}).withColumn("_part", F.explode("_parts")).drop("_parts")


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("_part = _home").drop("_part", "_home")


def by_chunk() -> Window:
    """A chunk's bars in order."""
    return Window.partitionBy("symbol", "_part").orderBy("idx")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by the columns over the session's number of shuffle partitions, for groups that cost more than their bytes tell: adaptive execution doesn't merge these partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def carried_last(df: DataFrame, value: str, order: list[str], into: str, part: Column | None = None) -> DataFrame:
    """``df`` (symbol, ts, ...) with the last ``value`` that isn't null up to each row in the given order, which begins with ts: by parts of time (months
    unless told otherwise), and across them by what each part has last."""
    rows = df.withColumn("_part", F.date_trunc("month", "ts") if part is None else part)
    near = Window.partitionBy("symbol", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = rows.groupBy("symbol", "_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    past = Window.partitionBy("symbol").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("symbol", "_part", F.last("_end", ignorenulls=True).over(past).alias("_past"))
    joined = rows.withColumn("_near", F.last(value, ignorenulls=True).over(near)).join(carried, ["symbol", "_part"])
    return joined.withColumn(into, F.coalesce("_near", "_past")).drop("_near", "_past", "_part")


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` written in the given order with each row's range ``_range`` and ``_place`` in it from 0."""
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ranged")
    # the id counts a partition's rows in its lower 33 bits
    return rows.withColumns({"_range": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")


def _with_sums_before(rows: DataFrame, amount: Column) -> DataFrame:
    """``_before``: the sum of ``amount`` over all earlier ranges, of which there are as many as partitions."""
    before, total = [], 0
    for number, n in sorted(rows.groupBy("_range").agg(F.sum(amount)).collect()):
        before.append((number, total))
        total += n
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(before, "_range long, _before long")), "_range")


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """``df`` with the running number of each row from 0 in the given order, which must not tie: ranges of it are numbered by themselves, and what the ranges before hold is added."""
    rows = _with_sums_before(_ranged(df, order), F.lit(1))
    return rows.withColumn(into, F.col("_place") + F.col("_before")).drop("_place", "_range", "_before")


def running_count(df: DataFrame, order: list[str], counts: str, into: str) -> DataFrame:
    """``df`` with the number of rows up to each row in the given order for which the boolean column ``counts`` is true, by ranges as well."""
    amount = F.col(counts).cast("long")
    run = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    rows = _with_sums_before(_ranged(df, order), amount)
    return rows.withColumn(into, F.sum(amount).over(run) + F.col("_before")).drop("_place", "_range", "_before")
