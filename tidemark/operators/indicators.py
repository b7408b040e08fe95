"""Technical indicators over bars (``symbol, day, open, high, low, close, volume``).

Finite frames are window functions. MACD and KDJ are recursive: their states are scanned
over blocks of days (``scans``), so a symbol's history is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import scans


def by_day() -> W:
    return W.partitionBy("symbol").orderBy("day")


def last(n: int):
    return by_day().rowsBetween(-n + 1, 0)


def when_full(n: int, value: Column) -> Column:
    """Null until ``n`` rows are there."""
    return F.when(F.count(F.lit(1)).over(last(n)) == n, value)


def mean(n: int, column: str = "close") -> Column:
    return when_full(n, F.avg(column).over(last(n)))


def crossings(rows: DataFrame, fast: str, slow: str, out: str = "cross") -> DataFrame:
    """``golden`` where fast rises above slow, ``death`` where it falls below."""
    above = F.col(fast) > F.col(slow)
    before = F.lag(above).over(by_day())
    return rows.withColumn(out, F.when(above & ~before, "golden").when(~above & before, "death"))


def moving_averages(bars: DataFrame, fast: int = 5, slow: int = 10) -> DataFrame:
    return crossings(bars.withColumns({"ma_fast": mean(fast), "ma_slow": mean(slow)}), "ma_fast", "ma_slow")


def bollinger(bars: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    off = width * F.stddev_pop("close").over(last(n))
    mid = F.avg("close").over(last(n))
    return bars.withColumns({"mid": when_full(n, mid), "upper": when_full(n, mid + off), "lower": when_full(n, mid - off)})


def _change(bars: DataFrame) -> DataFrame:
    return bars.withColumn("change", F.col("close") - F.lag("close").over(by_day()))


def rsi(bars: DataFrame, n: int = 6) -> DataFrame:
    """Mean gain over mean absolute change of ``n`` rows, times 100, with its zone."""
    w = last(n)
    gain, move = F.avg(F.when(F.col("change").isNotNull(), F.greatest("change", F.lit(0.0)))).over(w), F.avg(F.abs("change")).over(w)
    out = _change(bars).withColumn("rsi", F.when(F.count("change").over(w) == n, F.try_divide(100 * gain, move)))
    return out.withColumn("zone", F.when(F.col("rsi") >= 70, "overbought").when(F.col("rsi") <= 30, "oversold"))


def cci(bars: DataFrame, n: int = 14) -> DataFrame:
    w = last(n)
    out = bars.withColumn("tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    out = out.withColumns({"tps_": F.collect_list("tp").over(w), "mean_": F.avg("tp").over(w)})
    spread = F.aggregate("tps_", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("mean_"))) / F.size("tps_")
    value = F.try_divide(F.col("tp") - F.col("mean_"), 0.015 * spread)
    return out.withColumn("cci", F.when(F.size("tps_") == n, value)).drop("tps_", "mean_")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    rows = scans.ordered(bars)
    out = scans.smoothed(rows, "close", {"fast_": (2.0 / (fast + 1), 1.0), "slow_": (2.0 / (slow + 1), -1.0)}, ("dea", 2.0 / (signal + 1)))
    out = out.withColumn("dif", F.col("fast_") - F.col("slow_"))
    above, w = F.col("dif") > F.col("dea"), scans.inside()
    earlier = F.col("before_")["fast_"] - F.col("before_")["slow_"] > F.col("before_")["dea"]  # of the block before
    before = F.when(F.row_number().over(w) > 1, F.lag(above).over(w)).otherwise(earlier)
    out = out.withColumns({"macd": 2 * (F.col("dif") - F.col("dea")), "cross": F.when(above & ~before, "golden").when(~above & before, "death")})
    return out.drop("fast_", "slow_", "before_", "key_", "place_", "block_")


def kdj(bars: DataFrame, n: int = 9) -> DataFrame:
    """K and D start at 50 and move by a third; J = 3K - 2D."""
    w = scans.inside().rowsBetween(-n + 1, 0)
    rows = scans.with_rows_before(scans.ordered(bars), n - 1, {"low_": F.min("low").over(w), "high_": F.max("high").over(w)})
    rows = rows.withColumn("rsv", F.coalesce(F.try_divide(100 * (F.col("close") - F.col("low_")), F.col("high_") - F.col("low_")), F.lit(50.0)))
    out = scans.smoothed(rows, "rsv", {"k": (1 / 3, 1.0)}, ("d", 1 / 3), first=50.0)
    return out.withColumn("j", 3 * F.col("k") - 2 * F.col("d")).drop("low_", "high_", "before_", "key_", "place_", "block_")


def bias(bars: DataFrame, n: int = 6) -> DataFrame:
    return bars.withColumn("bias", when_full(n, 100 * F.try_divide(F.col("close") - F.avg("close").over(last(n)), F.avg("close").over(last(n)))))


def williams(bars: DataFrame, n: int = 10) -> DataFrame:
    low, high = F.min("low").over(last(n)), F.max("high").over(last(n))
    return bars.withColumn("wmsr", when_full(n, F.try_divide(100 * (high - F.col("close")), high - low)))


def psychological(bars: DataFrame, n: int = 12) -> DataFrame:
    w = last(n)
    return _change(bars).withColumn("psy", F.when(F.count("change").over(w) == n, 100.0 * F.count_if(F.col("change") > 0).over(w) / n))


def volume_ratio(bars: DataFrame, n: int = 12) -> DataFrame:
    w = last(n)
    part = lambda cond: F.sum(F.when(cond, F.col("volume").cast("double")).otherwise(0.0)).over(w)
    up, down, flat = part(F.col("change") > 0), part(F.col("change") < 0), part(F.col("change") == 0)
    return _change(bars).withColumn("vr", F.when(F.count("change").over(w) == n, F.try_divide(100 * (up + flat / 2), down + flat / 2)))


def sentiment_ratios(bars: DataFrame, n: int = 12) -> DataFrame:
    """AR: highs above opens against opens above lows; BR: the same around the close before."""
    w = last(n)
    before = F.lag("close").over(by_day())
    out = bars.withColumns({"up_": F.when(before.isNotNull(), F.greatest(F.col("high") - before, F.lit(0.0))), "down_": F.greatest(before - F.col("low"), F.lit(0.0))})
    ar = F.try_divide(100 * F.sum(F.col("high") - F.col("open")).over(w), F.sum(F.col("open") - F.col("low")).over(w))
    br = F.try_divide(100 * F.sum("up_").over(w), F.sum("down_").over(w))
    full = F.count("up_").over(w) == n
    return out.withColumns({"ar": F.when(full, ar), "br": F.when(full, br)}).drop("up_", "down_")


def oscillator(bars: DataFrame, n: int = 10) -> DataFrame:
    return bars.withColumn("osc", when_full(n, F.col("close") - F.avg("close").over(last(n))))


def candles(bars: DataFrame) -> DataFrame:
    """Doji and engulfing patterns."""
    body = F.abs(F.col("close") - F.col("open"))
    o, c = F.lag("open").over(by_day()), F.lag("close").over(by_day())
    rise, fall = F.col("close") > F.col("open"), F.col("close") < F.col("open")
    pattern = (
        F.when(body <= 0.1 * (F.col("high") - F.col("low")), "doji")
        .when(rise & (c < o) & (F.col("open") <= c) & (F.col("close") >= o), "bullish_engulfing")
        .when(fall & (c > o) & (F.col("open") >= c) & (F.col("close") <= o), "bearish_engulfing")
    )
    return bars.withColumn("pattern", pattern)


INDICATORS = {
    "MA": moving_averages, "BOLL": bollinger, "RSI": rsi, "CCI": cci, "MACD": macd, "KDJ": kdj, "BIAS": bias, "WMSR": williams, "PSY": psychological, "VR": volume_ratio, "ARBR": sentiment_ratios, "OSC": oscillator, "KLINE": candles,
}


def _band(value: str, low: float, high: float) -> Column:
    return F.when(F.col(value) > high, "overbought").when(F.col(value) < low, "oversold")


#: Indicator filters and what counts as an event of each; zones are the usual ones and can be passed anew.
EVENTS: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[], Column]]] = {
    "MA": (moving_averages, lambda: F.col("cross")),
    "MACD": (macd, lambda: F.col("cross")),
    "BOLL": (bollinger, lambda: F.when(F.col("close") > F.col("upper"), "above_upper").when(F.col("close") < F.col("lower"), "below_lower")),
    "RSI6": (lambda b: rsi(b, 6), lambda: F.col("zone")),
    "RSI12": (lambda b: rsi(b, 12), lambda: F.col("zone")),
    "RSI24": (lambda b: rsi(b, 24), lambda: F.col("zone")),
    "CCI": (cci, lambda: _band("cci", -100, 100)),
    "KDJ": (kdj, lambda: _band("k", 20, 80)),
    "BIAS": (bias, lambda: _band("bias", -10, 10)),
    "WMSR": (williams, lambda: F.when(F.col("wmsr") < 20, "overbought").when(F.col("wmsr") > 80, "oversold")),
    "PSY": (psychological, lambda: _band("psy", 25, 75)),
    "VR": (volume_ratio, lambda: _band("vr", 40, 160)),
    "AR": (sentiment_ratios, lambda: _band("ar", 50, 150)),
    "BR": (sentiment_ratios, lambda: _band("br", 40, 300)),
    "OSC": (oscillator, lambda: F.when((F.col("osc") > 0) & (F.lag("osc").over(by_day()) <= 0), "turns_up").when((F.col("osc") < 0) & (F.lag("osc").over(by_day()) >= 0), "turns_down")),
    "KLINE": (candles, lambda: F.col("pattern")),
}


def technical_anomalies(bars: DataFrame, symbol: str, days: int = 7, filters: list[str] | None = None) -> DataFrame:
    """Events of the chosen indicators for one symbol in the last ``days`` days: ``symbol, day, indicator, event``.

    ``RSI`` stands for its three lengths and ``ARBR`` for both ratios.
    """
    several = {"RSI": ("RSI6", "RSI12", "RSI24"), "ARBR": ("AR", "BR")}
    asked = [n for f in filters or EVENTS for n in several.get(f.upper(), (f.upper(),)) if n in EVENTS]
    if not asked:
        raise ValueError("no such indicator")
    own = bars.where(F.col("symbol") == symbol)
    parts = [EVENTS[n][0](own).withColumn("event", EVENTS[n][1]()).select("symbol", "day", F.lit(n).alias("indicator"), "event") for n in dict.fromkeys(asked)]
    return recent_events(parts, own, days)


def recent_events(parts: list[DataFrame], rows: DataFrame, days: int) -> DataFrame:
    """The events of all parts within ``days`` days of the last day in ``rows``."""
    newest = F.broadcast(rows.agg(F.max("day").alias("newest")))  # one row
    found = reduce(DataFrame.union, parts)
    return found.where("event IS NOT NULL").crossJoin(newest).where(F.col("day") >= F.date_sub("newest", days)).drop("newest")
