"""Company comparison: growth, ratios, scores, ranks, screens, scenarios, concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.scans import in_order


def growth(rows: DataFrame, by: str, year: str, value: str) -> DataFrame:
    """Change against the year before and compound growth since the first year."""
    w = W.partitionBy(by).orderBy(year)
    first, first_year = F.first(value).over(w), F.first(year).over(w)
    years = (F.col(year) - first_year).cast("double")
    cagr = F.when(years > 0, F.pow(F.try_divide(F.col(value), first), 1.0 / F.nullif(years, F.lit(0.0))) - 1)
    return rows.withColumns({"yoy": F.try_divide(F.col(value) - F.lag(value).over(w), F.lag(value).over(w)), "cagr": cagr})


def against_peers(rows: DataFrame, group: str, value: str) -> DataFrame:
    mean = F.avg(value).over(W.partitionBy(group))
    return rows.withColumns({"peer_mean": mean, "relative": F.try_divide(F.col(value), mean) - 1})


def seasonal_mean(rows: DataFrame, by: list[str], value: str, season: Column) -> DataFrame:
    return rows.withColumn("season", season).groupBy(*by, "season").agg(F.avg(value).alias("season_mean"), F.count(F.lit(1)).alias("periods"))


#: Weights of the score in percent.
WEIGHTS = {"quality": 20, "valuation": 20, "growth": 20, "cash": 15, "management": 15, "risk": 10}


def weighted_score(rows: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """Scores of 0 to 1 for each part, weighted to 100."""
    total = F.lit(0.0)
    for part, weight in (weights or WEIGHTS).items():
        total = total + F.coalesce(F.col(part), F.lit(0.0)) * float(weight)
    return rows.withColumn("score", total)


def places(rows: DataFrame, value: str, out: str, tie: str | None = None, descending: bool = False) -> DataFrame:
    """The rank of every row among all (from 1) as ``out``, and their number as ``all_``.

    With ``tie`` rows are numbered, without it equal values share the first place. Rows are
    sorted by value and tie (or a hash) together, so a value that most rows have is spread like any other;
    places follow from the counts of the partitions. A value that starts in an earlier partition
    takes its place from there. Bounds of partitions, not rows, reach the driver.
    """
    by = F.desc(value) if descending else F.asc(value)
    if tie:
        placed = in_order(rows, by, F.col(tie)).withColumn(out, F.col("place_") + 1)
        return placed.crossJoin(F.broadcast(placed.agg(F.count(F.lit(1)).alias("all_")))).drop("place_")  # one row
    spread = in_order(rows.withColumn("spread_", F.xxhash64(*rows.columns)), by, F.col("spread_"), parts=True).drop("spread_")
    own = spread.withColumn("from_", F.min("place_").over(W.partitionBy("part_", value)))
    ends = [F.count(F.lit(1)).alias("n"), F.min_by(value, "place_").alias("head"), F.max_by(value, "place_").alias("tail"), F.min("place_").alias("at"), F.max_by("from_", "place_").alias("tail_at")]
    bounds = own.groupBy("part_").agg(*ends).orderBy("part_").collect()
    heads, before = [], None
    for b in bounds:  # a run that fills whole partitions keeps the place where it began
        start = before[1] if before is not None and before[0] == b.head else b.at
        heads.append((b.part_, b.head, start))
        before = (b.tail, start if b.tail == b.head else b.tail_at)
    firsts = F.broadcast(rows.sparkSession.createDataFrame(heads, T.StructType([T.StructField("part_", T.IntegerType()), T.StructField("head_", rows.schema[value].dataType), T.StructField("head_at_", T.LongType())])))
    placed = own.join(firsts, "part_").withColumn(out, F.when(F.col(value).eqNullSafe(F.col("head_")), F.col("head_at_")).otherwise(F.col("from_")) + 1)
    return placed.withColumn("all_", F.lit(sum(b.n for b in bounds)).cast("long")).drop("part_", "place_", "from_", "head_", "head_at_")


def percent_rank_of_all(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``percent_rank`` over all rows."""
    ranked_ = places(rows, value, "rank_")
    share = F.coalesce(F.try_divide((F.col("rank_") - 1).cast("double"), (F.col("all_") - 1).cast("double")), F.lit(0.0))
    return ranked_.withColumn(out, share).drop("rank_", "all_")


def ranked(rows: DataFrame, score: str, tie: str) -> DataFrame:
    call = F.when(F.col(score) >= 70, "buy").when(F.col(score) >= 50, "hold").otherwise("avoid")
    return places(rows, score, "rank", tie, descending=True).drop("all_").withColumn("recommendation", call)


def percent_ranks(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    return rows.withColumns({f"{v}_pct": F.percent_rank().over(W.partitionBy(by).orderBy(v)) for v in values})


def superlatives(rows: DataFrame, name: str, metrics: list[str]) -> DataFrame:
    """The best of each metric: ``metric, winner, value``."""
    best = rows.agg(*(F.max_by(F.struct(F.col(name).alias("winner"), F.col(m).cast("double").alias("value")), F.struct(F.col(m), F.col(name))).alias(m) for m in metrics))
    long = best.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}.winner").alias("winner"), F.col(f"{m}.value").alias("value")) for m in metrics))).alias("x"))
    return long.select("x.*")


def lot_size(price: Column, budget: float = 1500.0, lot: int = 100) -> Column:
    """Shares in whole lots that the budget buys."""
    return (F.floor(F.lit(budget) / (price * lot)) * lot).cast("long")


def net_present_value(flows: Column, rate: float) -> Column:
    """Discounted sum of an array of yearly flows, the first after one year."""
    indexed = F.transform(flows, lambda x, i: x / F.pow(F.lit(1.0 + rate), (i + 1).cast("double")))
    return F.aggregate(indexed, F.lit(0.0), lambda a, x: a + x)


def expected_value(scenarios: DataFrame, by: str) -> DataFrame:
    """Probability-weighted value; ``complete`` says whether the probabilities sum to one."""
    p = F.sum("probability")
    return scenarios.groupBy(by).agg(F.sum(F.col("probability") * F.col("value")).alias("expected"), (F.abs(p - 1.0) < 1e-9).alias("complete"))


def correlations(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Pairwise correlation in long form: one pass, all pairs aggregated side by side."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = wide.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    return got.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"c{i}"), 6).alias("corr")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def concentration(rows: DataFrame, by: str, part: str, amount: str) -> DataFrame:
    """Herfindahl index of the shares of ``part`` in each ``by``."""
    sums = rows.groupBy(by, part).agg(F.sum(amount).alias("v"))
    return sums.groupBy(by).agg((F.sum(F.col("v") * F.col("v")) / (F.sum("v") * F.sum("v"))).alias("hhi"), F.count(F.lit(1)).alias("parts"))


def posture(acceleration: Column) -> Column:
    return F.when(acceleration > 0, "accelerating").when(acceleration < 0, "decelerating").otherwise("stable")


def hit_rate(trades: DataFrame, by: str, ret: str) -> DataFrame:
    """Win rate, mean, deviation and their ratio."""
    out = trades.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col(ret) > 0) / F.count(F.lit(1))).alias("win_rate"), F.avg(ret).alias("mean_ret"), F.stddev_samp(ret).alias("dev_ret"))
    return out.withColumn("sharpe", F.try_divide("mean_ret", F.nullif("dev_ret", F.lit(0.0))))


def spread_z(rows: DataFrame, back: int = 10) -> DataFrame:
    """z-score of the spread of a pair (``day, a, b``) within each ``pair``."""
    w = W.partitionBy("pair").orderBy("day").rowsBetween(-back, -1)
    out = rows.withColumn("spread", F.col("a") - F.col("b"))
    return out.withColumn("spread_z", F.try_divide(F.col("spread") - F.avg("spread").over(w), F.nullif(F.stddev_samp("spread").over(w), F.lit(0.0))))
