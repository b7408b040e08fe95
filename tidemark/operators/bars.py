"""Price bars from ticks, and the lines and setups read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import scans


def ohlcv(ticks: DataFrame, width: str = "1 day", by: str = "event_type", value: str = "value", ident: str = "event_id") -> DataFrame:
    """``symbol, start, open, high, low, close, volume, turnover`` of tumbling windows; partial sums before the shuffle."""
    order = F.struct("ts", ident)
    return (
        ticks.groupBy(F.col(by).alias("symbol"), F.window(F.col("ts").cast("timestamp_ntz"), width).alias("w"))
        .agg(
            F.min_by(value, order).alias("open"),
            F.max(value).alias("high"),
            F.min(value).alias("low"),
            F.max_by(value, order).alias("close"),
            F.count(F.lit(1)).alias("volume"),
            F.sum(value).alias("turnover"),
        )
        .select("symbol", F.col("w.start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "volume", "turnover")
    )


def daily(ticks: DataFrame) -> DataFrame:
    return ohlcv(ticks).withColumn("day", F.to_date("start")).drop("start")


def pivots(days: DataFrame) -> DataFrame:
    """Range lines (the day before's high and low) and the nearest older extremes beyond them."""
    w = scans.inside()
    lined = scans.with_rows_before(scans.ordered(days), 1, {"range_high": F.lag("high").over(w), "range_low": F.lag("low").over(w)})
    above = scans.lowest_earlier_above(lined, F.col("high"), F.col("range_high"), "swing_high")
    below = scans.lowest_earlier_above(lined, -F.col("low"), -F.col("range_low"), "swing_low").withColumn("swing_low", -F.col("swing_low"))
    return lined.join(above, ["key_", "place_"], "left").join(below, ["key_", "place_"], "left").drop("key_", "place_", "block_")


def trade_plan(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """Stop and target of each entry: the stop is the confirming candle's far side, the target the
    opposite range line, and ``reward_risk`` their distances from the price that is crossed."""
    both = entries.where("entry != 'wait'").join(lines.select("symbol", "day", "range_high", "range_low"), ["symbol", "day"])
    buy = F.col("entry") == "buy"
    priced = both.withColumns({"price": F.when(buy, F.col("sneaky_high")).otherwise(F.col("sneaky_low")), "stop": F.when(buy, F.col("sneaky_low")).otherwise(F.col("sneaky_high")), "target": F.when(buy, F.col("range_high")).otherwise(F.col("range_low"))})
    return priced.withColumn("reward_risk", F.try_divide(F.abs(F.col("target") - F.col("price")), F.abs(F.col("price") - F.col("stop")))).drop("range_high", "range_low", "sneaky_high", "sneaky_low")


def three_candles(bars: DataFrame) -> DataFrame:
    """The first three bars of each day; ``entry`` says which side the third crosses the second on."""
    day = W.partitionBy("symbol", F.to_date("start")).orderBy("start")
    n = F.row_number().over(day)
    third = (
        bars.withColumn("n", n).withColumn("sneaky_high", F.lag("high").over(day)).withColumn("sneaky_low", F.lag("low").over(day)).where("n = 3")
    )
    side = F.when((F.col("high") > F.col("sneaky_high")) & (F.col("low") >= F.col("sneaky_low")), "buy").when((F.col("low") < F.col("sneaky_low")) & (F.col("high") <= F.col("sneaky_high")), "sell").otherwise("wait")
    return third.select("symbol", F.to_date("start").alias("day"), "sneaky_high", "sneaky_low", side.alias("entry"))
