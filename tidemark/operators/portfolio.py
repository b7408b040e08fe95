"""Holdings and forecasts: similarity, exposure, performance against a benchmark, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def similarity(held: DataFrame, to: str, holder: str = "holder", asset: str = "asset", weight: str = "weight") -> DataFrame:
    """Cosine and Jaccard similarity of every holder with the one named ``to``.

    One holder's positions are joined with all others by asset: as many rows as holdings,
    never a row for each pair of holders.
    """
    h = held.groupBy(F.col(holder).alias("holder"), F.col(asset).alias("asset")).agg(F.sum(weight).cast("double").alias("w"))
    own = h.where(F.col("holder") == to).select("asset", F.col("w").alias("w0"))
    size = F.broadcast(own.agg(F.sqrt(F.sum(F.col("w0") * F.col("w0"))).alias("len0"), F.count(F.lit(1)).alias("n0")))  # one row
    both = h.join(own, "asset", "left").groupBy("holder").agg(
        F.sum(F.col("w") * F.coalesce("w0", F.lit(0.0))).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"), F.count("w0").alias("common"), F.count(F.lit(1)).alias("n")
    )
    return both.crossJoin(size).select(
        "holder", F.try_divide("dot", F.col("len") * F.col("len0")).alias("cosine"), F.try_divide(F.col("common").cast("double"), (F.col("n") + F.col("n0") - F.col("common")).cast("double")).alias("jaccard")
    )


def exposure(held: DataFrame, by: str, part: str, amount: str, most: float = 0.25) -> DataFrame:
    """Each part's share of its holder's total, and whether it is over ``most``."""
    sums = held.groupBy(by, part).agg(F.sum(amount).alias("amount"))
    share = F.try_divide(F.col("amount").cast("double"), F.sum("amount").over(W.partitionBy(by)).cast("double"))
    return sums.withColumn("share", share).withColumn("over", F.col("share") > most)


def against_benchmark(returns: DataFrame, benchmark: DataFrame, by: str = "portfolio", day: str = "day", ret: str = "ret") -> DataFrame:
    """Cumulative return of each portfolio and of the benchmark on the same days, and the lead."""
    joined = returns.select(by, day, F.col(ret).alias("own")).join(benchmark.select(day, F.col(ret).alias("base")), day)
    upto = W.partitionBy(by).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
    grown = lambda c: F.exp(F.sum(F.log1p(F.col(c))).over(upto)) - 1
    out = joined.withColumns({"cumulative": grown("own"), "benchmark": grown("base")})
    return out.withColumn("lead", F.col("cumulative") - F.col("benchmark")).drop("own", "base")


def accuracy(calls: DataFrame, by: str = "analyst") -> DataFrame:
    """From ``direction`` (1 or -1), ``ret``, ``opened``, ``closed``: calls, win rate, mean result, mean days held."""
    result = F.col("direction") * F.col("ret")
    return calls.groupBy(by).agg(
        F.count(F.lit(1)).alias("calls"), (F.count_if(result > 0) / F.count(F.lit(1))).alias("win_rate"), F.avg(result).alias("mean_result"), F.avg(F.date_diff("closed", "opened")).alias("mean_days")
    )


def slope(y: str, x: str) -> Column:
    """Slope of ``y`` over ``x``; 0 where what is left of it is rounding, whose sign changes with the order of the rows."""
    return F.when(F.abs(F.corr(y, x)) < 1e-12, F.lit(0.0)).otherwise(F.regr_slope(y, x))


def trends_apart(rows: DataFrame, by: str, x: str, rising: str, other: str, flat: float | None = None) -> DataFrame:
    """Groups where ``rising`` has a positive slope over ``x`` while ``other`` falls, or stays within
    ``flat`` (share of its mean a step)."""
    slopes = rows.groupBy(by).agg(slope(rising, x).alias("rising_slope"), slope(other, x).alias("other_slope"), F.avg(other).alias("other_mean"))
    calm = F.col("other_slope") < 0 if flat is None else F.abs(F.try_divide("other_slope", "other_mean")) <= flat
    return slopes.where((F.col("rising_slope") > 0) & calm)


def replay(signals: DataFrame, prices: DataFrame, by: str, days: list[int], day: str = "day", price: str = "close") -> DataFrame:
    """Backtest: each signal's return after each of ``days`` trading days, by the price of its own day.

    Only prices at or after the signal are used for results and only those before it existed
    when it was given: the signal's own columns must come from rows up to its day.
    """
    w = W.partitionBy(by).orderBy(day)
    ahead = prices.select(by, day, *(F.try_divide(F.lead(price, d).over(w), F.col(price)).alias(f"r{d}") for d in days))
    long = signals.join(ahead, [by, day]).withColumn("x", F.explode(F.array(*(F.struct(F.lit(d).alias("horizon"), (F.col(f"r{d}") - 1).alias("ret")) for d in days))))
    return long.select(*signals.columns, "x.*").where("ret IS NOT NULL")
