"""Tables about grid and Monte-Carlo results, and about closed positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.scalar import number_or_zero
from barloom.sources.scratch import written

from .chunks import by_chunk, numbered, overlapping, own_rows, running_count


def with_gain_per_signal(results: DataFrame) -> DataFrame:
    return results.withColumn("Gain_signal", F.try_divide("Net_Gain", F.col("Num_Signals").cast("double")))


def best_combos(results: DataFrame, params: list[str], least: tuple[str, ...] = ("DD_pct",), most: tuple[str, ...] = ("Net_Gain_pct", "Sharpe"), digits: int | None = None) -> DataFrame:
    """The combination with the best value of each metric, the first of those equal (to ``digits`` decimals, if given); nulls never win."""
    rows = []
    as_compared = lambda c: c if digits is None else F.round(c, digits)
    for metric in (*most, *least):
        sign = -1 if metric in least else 1
        pick = F.max_by(F.struct("combo_id", *params, F.col(metric).alias("value")), F.struct((as_compared(F.col(metric)) * sign).alias("v"), -F.col("combo_id")))
        rows.append(results.where(F.col(metric).isNotNull()).agg(pick.alias("x")).select(F.lit(metric).alias("metric"), "x.*").where("combo_id is not null"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def unpivoted(results: DataFrame, params: list[str], keep: list[str]) -> DataFrame:
    """(keep, param, value): a row for each parameter; booleans count as 0 and 1."""
    each = F.explode(F.array(*(F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in params)))
    return results.select(*keep, each.alias("x")).select(*keep, "x.*")


def parameter_profile(results: DataFrame, params: list[str]) -> DataFrame:
    rows = unpivoted(results, params, ["Net_Gain_pct", "Win_Ratio"])
    return rows.groupBy("param", "value").agg(F.sum("Net_Gain_pct").alias("sum_gain_pct"), (F.avg("Win_Ratio") * 100).alias("win_pct"))


def parameter_correlation(results: DataFrame, params: list[str], least_combos: int = 5) -> DataFrame:
    """Pearson correlation of each parameter with Net_Gain; null for a constant parameter or too few combinations."""
    rows = unpivoted(results, params, ["Net_Gain"])
    found = rows.groupBy("param").agg(F.corr("value", "Net_Gain").alias("c"), F.count_distinct("value").alias("values"), F.count(F.lit(1)).alias("n"), F.count_distinct("Net_Gain").alias("gains"))
    return found.select("param", F.when((F.col("values") > 1) & (F.col("gains") > 1) & (F.col("n") >= least_combos), F.col("c")).alias("correlation"))


def parameter_information(results: DataFrame, params: list[str], bins: int = 10) -> DataFrame:
    """Mutual information (nats) of each parameter and Net_Gain in ``bins`` equally filled classes, from counts."""
    placed = numbered(results, ["Net_Gain", "combo_id"], "_p")
    sized = placed.crossJoin(F.broadcast(placed.agg(F.count(F.lit(1)).alias("_n"))))
    size, larger = F.floor(F.col("_n") / bins), F.col("_n") % bins  # the first classes hold one more
    ranked = sized.withColumn("bin", F.when(F.col("_p") < larger * (size + 1), F.floor(F.col("_p") / (size + 1))).otherwise(larger + F.floor((F.col("_p") - larger * (size + 1)) / F.greatest(size, F.lit(1)))))
    rows = unpivoted(ranked, params, ["bin"])
    joint = rows.groupBy("param", "value", "bin").agg(F.count(F.lit(1)).alias("nxy"))
    by = lambda c: Window.partitionBy("param", *c)
    full = joint.withColumns({"nx": F.sum("nxy").over(by(["value"])), "ny": F.sum("nxy").over(by(["bin"])), "n": F.sum("nxy").over(by([]))})
    return full.groupBy("param").agg(F.sum(F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))).alias("information"))


def digamma(n: Column) -> Column:
    """The digamma function of positive numbers: by its series six further on, less the steps up to there."""
    z = n + 6
    series = F.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8) - 1 / (132 * z**10)
    for i in range(6):
        series = series - 1 / (n + i)
    return series


def nearest_information(results: DataFrame, params: list[str], k: int = 3, chunk: int = 50_000) -> DataFrame:
    """Mutual information (nats) of each parameter and Net_Gain by nearest neighbours: among the combinations that share a parameter's value, the distance to the ``k`` th nearest gain says how
    many of all combinations lie nearer. Values of one combination alone are left out; equal gains are at no distance, and count where the distance is none. Never negative; null
    gains take no part.

    Neighbours are looked up in one sorted order cut into chunks, and what lies nearer is counted by ranks over ranges, so no parameter and no value is one task."""
    rows = unpivoted(results.where("Net_Gain is not null"), params, ["combo_id", "Net_Gain"]).withColumnsRenamed({"combo_id": "id", "Net_Gain": "y"})
    many = rows.groupBy("param", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = numbered(rows.join(many, ["param", "value"]), ["param", "value", "y", "id"], "idx").withColumn("symbol", F.lit(""))
    near = []
    for step in (F.lag, F.lead):
        for j in range(1, k + 1):
            other = lambda c, step=step, j=j: step(c, j).over(by_chunk())
            near.append(F.when((other("param") == F.col("param")) & (other("value") == F.col("value")), F.struct(F.abs(other("y") - F.col("y")).alias("d"), other("y").alias("y"))))
    asked = own_rows(overlapping(rows, back=k, ahead=k, chunk=chunk).withColumn("near", F.sort_array(F.array_compact(F.array(*near)))))
    asked = asked.withColumn("k", F.least(F.lit(k), F.col("c") - 1).cast("int")).withColumn("last", F.element_at("near", F.col("k")))
    # strictly between, where the border that the neighbour stands on is its own value; equal values, if there is no distance
    d, last = F.col("last.d"), F.col("last.y")
    low, high = F.when(last < F.col("y"), last).otherwise(F.col("y") - d), F.when(last > F.col("y"), last).otherwise(F.col("y") + d)
    asked = written(asked.select("param", "id", "y", "c", "k", (d == 0).alias("tied"), low.alias("low"), high.alias("high")), "asked")
    probe = lambda v, at, end: asked.select("param", "id", v.alias("v"), at.alias("at"), F.lit(end).alias("end"))
    stand = asked.select("param", "id", F.col("y").alias("v"), F.lit(1).alias("at"), F.lit(0).alias("end"))
    # below everything equal, or above it
    borders = probe(F.col("low"), F.when(F.col("tied"), 0).otherwise(2), 1).unionByName(probe(F.col("high"), F.when(F.col("tied"), 2).otherwise(0), 2))
    ranked = running_count(stand.unionByName(borders).withColumn("is", F.col("end") == 0), ["param", "v", "at", "end", "id"], "is", "rank").where("end > 0")
    inside = ranked.groupBy("param", "id").agg((F.max(F.when(F.col("end") == 2, F.col("rank"))) - F.max(F.when(F.col("end") == 1, F.col("rank")))).alias("m"))
    found = asked.join(inside, ["param", "id"]).groupBy("param").agg((digamma(F.count(F.lit(1)).cast("double")) + F.avg(digamma(F.col("k"))) - F.avg(digamma(F.col("c"))) - F.avg(digamma(F.col("m")))).alias("i"))
    return found.select("param", F.greatest("i", F.lit(0.0)).alias("information"))


def path_summary(results: DataFrame, params: list[str]) -> DataFrame:
    """Means over paths by combination, without nulls, and numbers of paths and rows."""
    return results.groupBy(*params).agg(*(F.avg(c).alias(f"mean_{c}") for c in ("Net_Gain", "Net_Gain_pct", "Win_Ratio", "DD_pct", "Sharpe")), F.count_distinct("path_index").alias("paths"), F.count(F.lit(1)).alias("rows"))


def path_means(results: DataFrame, initial: float) -> DataFrame:
    """By path: mean balance and drawdown over combinations, and the gain they mean."""
    rows = results.groupBy("path_index").agg(F.avg("Final_Balance").alias("balance"), F.avg("DD_pct").alias("dd"))
    return rows.withColumn("gain_pct", (F.col("balance") / initial - 1) * 100)


def path_quantiles(means: DataFrame) -> DataFrame:
    """Median, sample deviation and share of losses (percent) of gains by path."""
    return means.agg(F.percentile("gain_pct", F.lit(0.5)).alias("p50"), F.stddev_samp("gain_pct").alias("std"), (F.avg((F.col("gain_pct") < 0).cast("double")) * 100).alias("pct_negative"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(bin, n) over max(10, min(50, rows)) equal bins from the least to the greatest value, the last bin closed."""
    span = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.greatest(F.lit(10), F.least(F.lit(50), F.count(column))).cast("int").alias("bins"))
    share = F.when(F.col("hi") > F.col("lo"), (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    rows = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(span))
    return rows.groupBy(F.least(F.floor(share * F.col("bins")), F.col("bins") - 1).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def strategy_curve(equity: DataFrame, benchmark: DataFrame, initial: float, keys: tuple[str, ...] = ("combo_id",)) -> DataFrame:
    """Gain and drawdown (not above 0) in percent at each time, beside a benchmark's change."""
    run = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max("balance").over(run)
    rows = equity.select(*keys, "ts", ((F.col("balance") / initial - 1) * 100).alias("gain_pct"), ((F.col("balance") / peak - 1) * 100).alias("dd_pct"))
    return rows.join(benchmark, "ts", "left")


def closed_position_rates(positions: DataFrame, profit: str = "netProfit") -> DataFrame:
    """Positions, wins and win rate by symbol, and in total (symbol null). Profit that isn't a number counts as 0."""
    rows = positions.select(F.coalesce("symbol", F.lit("UNKNOWN")).alias("symbol"), number_or_zero(F.col(profit)).alias("p"))
    return rows.rollup("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p") > 0).alias("wins"), (F.avg((F.col("p") > 0).cast("double")) * 100).alias("win_pct"), F.sum("p").alias("net"))


def profitability_pct(final: Column, initial: Column) -> Column:
    return F.when(initial != 0, (final / F.when(initial != 0, initial) - 1) * 100)
