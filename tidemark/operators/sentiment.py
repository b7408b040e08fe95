"""Community sentiment: stance shares of each symbol and of the whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stance(quality: Column | str, toxic: Column | str) -> Column:
    q, t = (F.col(c) if isinstance(c, str) else c for c in (quality, toxic))
    return F.when(t == 1, "bearish").when(q == 1, "bullish").otherwise("neutral")


def _shares() -> list[Column]:
    n = F.count(F.lit(1))
    share = lambda s: F.round(100.0 * F.count_if(F.col("stance") == s) / n, 6)
    return [n.alias("post_count"), share("bullish").alias("bull_pct"), share("bearish").alias("bear_pct"), share("neutral").alias("neutral_pct")]


def by_symbol(posts: DataFrame, symbol: str = "symbol") -> DataFrame:
    return posts.groupBy(symbol).agg(*_shares())


def with_group(posts: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Symbols and, as ``(group)``, the union of all retained posts."""
    return posts.rollup(symbol).agg(F.grouping(symbol).alias("g"), *_shares()).withColumn(symbol, F.when(F.col("g") == 1, "(group)").otherwise(F.col(symbol))).drop("g")


def label(shares: DataFrame, near: float = 15.0, both: float = 25.0, weak: float = 10.0) -> DataFrame:
    """Mixed where both sides are meaningful and close, else the dominant side, else neutral."""
    bull, bear = F.col("bull_pct"), F.col("bear_pct")
    mixed = (F.abs(bull - bear) < near) & (bull >= both) & (bear >= both)
    clear = F.greatest(bull, bear) >= weak
    side = F.when(mixed, "mixed").when(clear & (bull > bear), "bullish").when(clear & (bear > bull), "bearish").otherwise("neutral")
    return shares.withColumn("label", side)


def drivers(posts: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Each symbol's share of the group's bullish and bearish posts."""
    counts = posts.groupBy(symbol).agg(F.count_if(F.col("stance") == "bullish").alias("bull"), F.count_if(F.col("stance") == "bearish").alias("bear"))
    total = F.broadcast(counts.agg(F.sum("bull").alias("all_bull"), F.sum("bear").alias("all_bear")))  # one row
    share = lambda c: F.round(F.try_divide(100.0 * F.col(c), F.col(f"all_{c}").cast("double")), 6)
    return counts.crossJoin(total).select(symbol, "bull", "bear", share("bull").alias("bull_share"), share("bear").alias("bear_share"))


def data_window(posts: DataFrame, ts: str = "ts", symbol: str = "symbol") -> DataFrame:
    """Earliest and latest post before any filter, shown at UTC+8."""
    show = lambda c: F.date_format(F.from_utc_timestamp(c.cast("timestamp"), "Asia/Shanghai"), "yyyy-MM-dd HH:mm")
    return posts.groupBy(symbol).agg(show(F.min(ts)).alias("time_range_earliest"), show(F.max(ts)).alias("time_range_latest"))
