"""Capital-flow, derivatives and concentration anomalies; thresholds are parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.indicators import recent_events


def by_day() -> W:
    return W.partitionBy("symbol").orderBy("day")


def daily_flows(ticks: DataFrame, large: float = 200.0) -> DataFrame:
    """Signed money of large and small orders a day; even ids buy, odd ids sell."""
    signed = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    big = F.col("value") >= large
    part = lambda cond, v: F.sum(F.when(cond, v).otherwise(0.0))
    return ticks.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("day")).agg(
        F.sum(signed).alias("net"),
        part(big, signed).alias("large_net"),
        part(~big, signed).alias("small_net"),
        part(big & (signed > 0), signed).alias("large_in"),
        part(big & (signed < 0), -signed).alias("large_out"),
    )


def outflow_runs(flows: DataFrame, least: int = 2) -> DataFrame:
    """Runs of days with net outflow: ``symbol, first_day, last_day, days, total``."""
    n = F.row_number().over(by_day())
    same = W.partitionBy("symbol", F.col("net") < 0).orderBy("day")
    island = n - F.row_number().over(same)
    runs = flows.withColumn("island", island).where("net < 0")
    out = runs.groupBy("symbol", "island").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"), F.sum("net").alias("total"))
    return out.where(F.col("days") >= least).drop("island")


def against_recent(rows: DataFrame, value: str = "net", back: int = 3) -> DataFrame:
    """A value against the mean of the ``back`` rows before it, as a relative difference."""
    w = by_day().rowsBetween(-back, -1)
    base = F.when(F.count(F.lit(1)).over(w) == back, F.avg(value).over(w))
    return rows.withColumn("base", base).withColumn("excess", F.try_divide(F.col(value) - F.col("base"), F.abs("base")))


def joint_rise(rows: DataFrame, first: str, second: str, back: int = 21) -> DataFrame:
    """Days on which both values exceed the day before and their mean of the ``back`` days before."""
    w = by_day().rowsBetween(-back, -1)
    up = lambda c: (F.col(c) > F.lag(c).over(by_day())) & (F.col(c) > F.avg(c).over(w))
    return rows.withColumn("joint", F.coalesce(up(first) & up(second), F.lit(False))).where("joint").drop("joint")


def divergence(flows: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Large and small orders flow in opposite directions and large in/out differ by ``ratio``."""
    uneven = F.try_divide(F.greatest("large_in", "large_out"), F.least("large_in", "large_out"))
    return flows.withColumn("ratio", uneven).where((F.signum("large_net") * F.signum("small_net") < 0) & (F.col("ratio") >= ratio))


def unusual_trades(trades: DataFrame, volume: str, interest: str, least: float = 5.0) -> DataFrame:
    """Every trade whose volume is at least ``least`` times the open interest."""
    return trades.withColumn("v_oi", F.try_divide(F.col(volume).cast("double"), F.col(interest).cast("double"))).where(F.col("v_oi") >= least)


def historical_percentile(rows: DataFrame, value: str, back: int = 252) -> DataFrame:
    """Share of the last ``back`` values (the current one included) that are not larger, times 100."""
    w = by_day().rowsBetween(-back + 1, 0)
    seen = F.collect_list(value).over(w)
    return rows.withColumn("percentile", 100.0 * F.size(F.filter(seen, lambda x: x <= F.col(value))) / F.size(seen))


def rising_days(rows: DataFrame, value: str, days: int = 2) -> DataFrame:
    """Rows after ``days`` rises in a row."""
    up = F.when(F.col(value) > F.lag(value).over(by_day()), 1).otherwise(0)
    return rows.withColumn("up_", up).withColumn("ups_", F.sum("up_").over(by_day().rowsBetween(-days + 1, 0))).where(F.col("ups_") == days).drop("up_", "ups_")


def realised_volatility(bars: DataFrame, back: int = 20, year: int = 252) -> DataFrame:
    ret = F.ln(F.col("close") / F.lag("close").over(by_day()))
    return bars.withColumn("ret", ret).withColumn("hv", F.stddev_samp("ret").over(by_day().rowsBetween(-back + 1, 0)) * (year**0.5))


def volatility_premium(bars: DataFrame, implied: str = "iv", least: float = 0.0, back: int = 20) -> DataFrame:
    return realised_volatility(bars, back).withColumn("premium", F.col(implied) - F.col("hv")).where(F.col("premium") >= least)


def heaviest_zone(rows: DataFrame, by: str, price: str, amount: str, width: float = 50.0) -> DataFrame:
    """The price bucket that holds most: ``low, high, amount, share``."""
    bucket = (F.floor(F.col(price) / width) * width).cast("double")
    sums = rows.groupBy(by, bucket.alias("low")).agg(F.sum(amount).alias("held"))
    best = sums.groupBy(by).agg(F.max_by(F.struct("low", "held"), F.struct(F.round("held", 6), -F.col("low"))).alias("b"), F.sum("held").alias("total"))
    return best.select(by, F.col("b.low").alias("low"), (F.col("b.low") + width).alias("high"), F.round(F.col("b.held") / F.col("total"), 6).alias("share"))


def top_brokers(rows: DataFrame, by: str, broker: str, amount: str, k: int = 2) -> DataFrame:
    """The ``k`` largest net buyers and sellers of each symbol."""
    net = rows.groupBy(by, broker).agg(F.round(F.sum(amount), 4).alias("net"))
    rank = lambda o: F.row_number().over(W.partitionBy(by).orderBy(o, broker)).cast("long")
    both = net.withColumns({"buy_rank": rank(F.desc("net")), "sell_rank": rank(F.asc("net"))})
    return both.where((F.col("buy_rank") <= k) | (F.col("sell_rank") <= k))


def only_market(rows: DataFrame, dimension: str, restricted: list[str], symbol: str = "symbol", market: str = "HK") -> DataFrame:
    """Restricted dimensions count only for symbols of the market."""
    return rows.where(~F.col(dimension).isin(restricted) | F.col(symbol).startswith(f"{market}."))


def calm_drops(bars: DataFrame, implied: str = "iv", drop: float = -0.05, most_change: float = 0.05, back: int = 5) -> DataFrame:
    """Days on which the price fell over ``back`` rows while implied volatility hardly moved."""
    w = by_day()
    price = F.try_divide(F.col("close"), F.lag("close", back).over(w)) - 1
    vol = F.try_divide(F.col(implied), F.lag(implied, back).over(w)) - 1
    return bars.withColumns({"price_change": price, "iv_change": vol}).where((F.col("price_change") <= drop) & (F.abs("iv_change") <= most_change))


def co_movement(options: DataFrame, stock: DataFrame, least: float = 0.3) -> DataFrame:
    """Days on which option volume and open interest both grow by ``least``, with the share's own change.

    ``options``: ``symbol, day, volume, interest``; ``stock``: ``symbol, day, close``; joined by symbol and day.
    """
    w = by_day()
    step = lambda c: F.try_divide(F.col(c).cast("double"), F.lag(c).over(w).cast("double")) - 1
    moved = options.withColumns({"volume_change": step("volume"), "interest_change": step("interest")})
    priced = stock.select("symbol", "day", step("close").alias("price_change"))
    out = moved.join(priced, ["symbol", "day"]).where((F.col("volume_change") >= least) & (F.col("interest_change") >= least))
    return out.withColumn("reading", F.when(F.col("price_change") > 0, "long").when(F.col("price_change") < 0, "short").otherwise("open"))


def capital_anomalies(flows: DataFrame, symbol: str, days: int = 7, filters: list[str] | None = None, ratio: float = 2.0, excess: float = 1.0) -> DataFrame:
    """Capital-flow events of one symbol: ``symbol, day, indicator, event``.

    ``flows`` as from ``daily_flows``, with ``short_number`` and ``short_ratio`` where known.
    """
    own = flows.where(F.col("symbol") == symbol)
    event = lambda df, name, what: df.select("symbol", "day", F.lit(name).alias("indicator"), F.lit(what).alias("event"))
    found = {
        "capital_distribution": lambda: event(divergence(own, ratio), "capital_distribution", "large_against_small"),
        "capital_flow": lambda: event(against_recent(own.withColumn("out_", -F.col("net")), "out_").where((F.col("net") < 0) & (F.col("excess") >= excess)), "capital_flow", "outflow_speeds_up"),
        "outflow_run": lambda: outflow_runs(own).select("symbol", F.col("last_day").alias("day"), F.lit("outflow_run").alias("indicator"), F.concat(F.lit("days_"), F.col("days").cast("string")).alias("event")),
    }
    if {"short_number", "short_ratio"} <= set(flows.columns):
        found["short_sell_ratio"] = lambda: event(joint_rise(own, "short_number", "short_ratio"), "short_sell_ratio", "number_and_ratio_rise")
    asked = [n for n in found if not filters or n in filters]
    if not asked:
        raise ValueError("no such dimension")
    return recent_events([found[n]() for n in asked], own, days)


def derivatives_anomalies(rows: DataFrame, symbol: str, days: int = 7, filters: list[str] | None = None, percentile: float = 90.0, back: int = 252, premium: float = 0.0) -> DataFrame:
    """Derivatives events of one symbol from ``symbol, day, close, iv, put_call, volume, interest``."""
    own = rows.where(F.col("symbol") == symbol)
    event = lambda df, name, what: df.select("symbol", "day", F.lit(name).alias("indicator"), F.lit(what).alias("event"))
    high = lambda value: historical_percentile(own, value, back).where(F.col("percentile") >= percentile)
    found = {
        "iv_percentile": lambda: event(high("iv"), "iv_percentile", "iv_high"),
        "iv_hv_premium": lambda: event(volatility_premium(own, "iv", premium), "iv_hv_premium", "iv_over_hv"),
        "put_call": lambda: event(high("put_call"), "put_call", "puts_high"),
        "put_call_run": lambda: event(rising_days(own, "put_call", 2), "put_call_run", "rises_two_days"),
        "calm_drop": lambda: event(calm_drops(own), "calm_drop", "price_falls_iv_flat"),
        "co_movement": lambda: co_movement(own, own).select("symbol", "day", F.lit("co_movement").alias("indicator"), F.col("reading").alias("event")),
    }
    asked = [n for n in found if not filters or n in filters]
    if not asked:
        raise ValueError("no such dimension")
    return recent_events([found[n]() for n in asked], own, days)
