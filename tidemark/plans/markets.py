"""Queries of bars, indicators and anomalies over ``events`` as ticks of five symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import anomaly, bars, equity, indicators, linking
from tidemark.plans.registry import Registry
from tidemark.session import table

R = Registry()

OHLC = "first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume, sum(value) AS turnover"
B = f"b AS (SELECT event_type AS symbol, ts::DATE AS day, {OHLC} FROM events GROUP BY 1, 2)"
W = "PARTITION BY symbol ORDER BY day"


def last(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def days(spark, sf):
    return bars.daily(table(spark, sf, "events"))


def shown(df, *values: str, keys=("symbol", "day"), also=()):
    """Keys and values, rounded; what the oracle is compared with."""
    return df.select(*keys, *(F.round(v, 5).alias(v) for v in values), *also)


@R.add(f"WITH {B} SELECT symbol, day, open, high, low, close, volume, round(turnover, 4) AS turnover FROM b")
def ohlcv_daily(spark, sf):
    return days(spark, sf).withColumn("turnover", F.round("turnover", 4))


@R.add(f"SELECT event_type AS symbol, strftime(time_bucket(INTERVAL '15 minutes', ts), '%Y-%m-%d %H:%M') AS start, {OHLC.replace('sum(value)', 'round(sum(value), 4)')} FROM events GROUP BY 1, 2")
def ohlcv_15m(spark, sf):
    out = bars.ohlcv(table(spark, sf, "events"), "15 minutes")
    return out.withColumns({"start": F.date_format("start", "yyyy-MM-dd HH:mm"), "turnover": F.round("turnover", 4)})


@R.add(
    f"""WITH {B}, p AS (SELECT symbol, day, lag(high) OVER w AS range_high, lag(low) OVER w AS range_low FROM b WINDOW w AS ({W}))
SELECT p.*, (SELECT min(b.high) FROM b WHERE b.symbol = p.symbol AND b.day < p.day AND b.high > p.range_high) AS swing_high,
  (SELECT max(b.low) FROM b WHERE b.symbol = p.symbol AND b.day < p.day AND b.low < p.range_low) AS swing_low FROM p"""
)
def pivot_lines(spark, sf):
    return bars.pivots(days(spark, sf)).select("symbol", "day", "range_high", "range_low", "swing_high", "swing_low")


@R.add(
    f"""WITH q AS (SELECT event_type AS symbol, time_bucket(INTERVAL '15 minutes', ts) AS start, {OHLC} FROM events GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER w AS n, lag(high) OVER w AS sneaky_high, lag(low) OVER w AS sneaky_low FROM q WINDOW w AS (PARTITION BY symbol, start::DATE ORDER BY start))
SELECT symbol, start::DATE AS day, sneaky_high, sneaky_low, CASE WHEN high > sneaky_high AND low >= sneaky_low THEN 'buy' WHEN low < sneaky_low AND high <= sneaky_high THEN 'sell' ELSE 'wait' END AS entry FROM n WHERE n = 3"""
)
def three_candle_entry(spark, sf):
    return bars.three_candles(bars.ohlcv(table(spark, sf, "events"), "15 minutes"))


@R.add(
    f"""WITH {B}, a AS (SELECT symbol, day, CASE WHEN count(*) OVER {last(5)} = 5 THEN avg(close) OVER {last(5)} END AS ma_fast, CASE WHEN count(*) OVER {last(10)} = 10 THEN avg(close) OVER {last(10)} END AS ma_slow FROM b),
c AS (SELECT *, ma_fast > ma_slow AS above, lag(ma_fast > ma_slow) OVER ({W}) AS before FROM a)
SELECT symbol, day, round(ma_fast, 5) AS ma_fast, round(ma_slow, 5) AS ma_slow, CASE WHEN above AND NOT before THEN 'golden' WHEN NOT above AND before THEN 'death' END AS cross FROM c"""
)
def ma_cross(spark, sf):
    return shown(indicators.moving_averages(days(spark, sf)), "ma_fast", "ma_slow", also=["cross"])


@R.add(
    f"""WITH {B}, a AS (SELECT symbol, day, avg(close) OVER {last(20)} AS m, stddev_pop(close) OVER {last(20)} AS s, count(*) OVER {last(20)} AS c FROM b)
SELECT symbol, day, CASE WHEN c = 20 THEN round(m, 5) END AS mid, CASE WHEN c = 20 THEN round(m + 2 * s, 5) END AS upper, CASE WHEN c = 20 THEN round(m - 2 * s, 5) END AS lower FROM a"""
)
def boll(spark, sf):
    return shown(indicators.bollinger(days(spark, sf)), "mid", "upper", "lower")


CH = f"{B}, h AS (SELECT *, close - lag(close) OVER ({W}) AS change FROM b)"


def rsi_sql(n: int) -> str:
    return f"""WITH {CH}, r AS (SELECT symbol, day, CASE WHEN count(change) OVER {last(n)} = {n} THEN 100 * avg(greatest(change, 0)) FILTER (WHERE change IS NOT NULL) OVER {last(n)} / nullif(avg(abs(change)) OVER {last(n)}, 0) END AS rsi FROM h)
SELECT symbol, day, round(rsi, 5) AS rsi, CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' END AS zone FROM r"""


for _n in (6, 12, 24):
    R.add(rsi_sql(_n), f"rsi{_n}")(lambda spark, sf, n=_n: shown(indicators.rsi(days(spark, sf), n), "rsi", also=["zone"]))


@R.add(
    f"""WITH {B}, t AS (SELECT symbol, day, (high + low + close) / 3 AS tp FROM b),
w AS (SELECT *, list(tp) OVER {last(14)} AS tps, avg(tp) OVER {last(14)} AS m FROM t)
SELECT symbol, day, CASE WHEN len(tps) = 14 THEN round((tp - m) / nullif(0.015::DOUBLE * list_sum(list_transform(tps, lambda x: abs(x - m))) / len(tps), 0), 4) END AS cci FROM w"""
)
def cci(spark, sf):
    return indicators.cci(days(spark, sf)).select("symbol", "day", F.round("cci", 4).alias("cci"))


def ema_sql(column: str, n: int) -> str:
    return f"list_reduce(list({column}) OVER ({W} ROWS UNBOUNDED PRECEDING), lambda a, x: a + (x - a) * {2 / (n + 1)!r}::DOUBLE)"


@R.add(
    f"""WITH {B}, d AS (SELECT symbol, day, {ema_sql('close', 12)} - {ema_sql('close', 26)} AS dif FROM b), e AS (SELECT *, {ema_sql('dif', 9)} AS dea FROM d),
c AS (SELECT *, dif > dea AS above, lag(dif > dea) OVER ({W}) AS before FROM e)
SELECT symbol, day, round(dif, 5) AS dif, round(dea, 5) AS dea, round(2 * (dif - dea), 5) AS macd, CASE WHEN above AND NOT before THEN 'golden' WHEN NOT above AND before THEN 'death' END AS cross FROM c"""
)
def macd(spark, sf):
    return shown(indicators.macd(days(spark, sf)), "dif", "dea", "macd", also=["cross"])


def third_sql(column: str) -> str:
    return f"list_reduce(list_prepend(50.0::DOUBLE, list({column}) OVER ({W} ROWS UNBOUNDED PRECEDING)), lambda a, x: a * {2 / 3!r}::DOUBLE + x / 3)"


@R.add(
    f"""WITH {B}, r AS (SELECT symbol, day, coalesce(100 * (close - min(low) OVER {last(9)}) / nullif(max(high) OVER {last(9)} - min(low) OVER {last(9)}, 0), 50) AS rsv FROM b),
k AS (SELECT *, {third_sql('rsv')} AS k FROM r), d AS (SELECT *, {third_sql('k')} AS d FROM k)
SELECT symbol, day, round(rsv, 5) AS rsv, round(k, 5) AS k, round(d, 5) AS d, round(3 * k - 2 * d, 5) AS j FROM d"""
)
def kdj(spark, sf):
    return shown(indicators.kdj(days(spark, sf)), "rsv", "k", "d", "j")


@R.add(f"WITH {B} SELECT symbol, day, CASE WHEN count(*) OVER {last(6)} = 6 THEN round(100 * (close - avg(close) OVER {last(6)}) / avg(close) OVER {last(6)}, 5) END AS bias FROM b")
def bias(spark, sf):
    return shown(indicators.bias(days(spark, sf)), "bias")


@R.add(f"WITH {B} SELECT symbol, day, CASE WHEN count(*) OVER {last(10)} = 10 THEN round(100 * (max(high) OVER {last(10)} - close) / nullif(max(high) OVER {last(10)} - min(low) OVER {last(10)}, 0), 5) END AS wmsr FROM b")
def wmsr(spark, sf):
    return shown(indicators.williams(days(spark, sf)), "wmsr")


@R.add(f"WITH {CH} SELECT symbol, day, CASE WHEN count(change) OVER {last(12)} = 12 THEN round(100.0::DOUBLE * count(*) FILTER (WHERE change > 0) OVER {last(12)} / 12, 5) END AS psy FROM h")
def psy(spark, sf):
    return shown(indicators.psychological(days(spark, sf)), "psy")


@R.add(
    f"""WITH {CH}, v AS (SELECT symbol, day, count(change) OVER w AS c, sum(CASE WHEN change > 0 THEN volume ELSE 0 END) OVER w AS u, sum(CASE WHEN change < 0 THEN volume ELSE 0 END) OVER w AS d, sum(CASE WHEN change = 0 THEN volume ELSE 0 END) OVER w AS f FROM h WINDOW w AS {last(12)})
SELECT symbol, day, CASE WHEN c = 12 THEN round(100.0::DOUBLE * (u + f / 2) / nullif(d + f / 2, 0), 5) END AS vr FROM v"""
)
def vr(spark, sf):
    return shown(indicators.volume_ratio(days(spark, sf)), "vr")


@R.add(
    f"""WITH {B}, p AS (SELECT *, lag(close) OVER ({W}) AS pc FROM b), u AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - pc, 0) END AS up, CASE WHEN pc IS NOT NULL THEN greatest(pc - low, 0) END AS dn FROM p)
SELECT symbol, day, CASE WHEN count(up) OVER {last(12)} = 12 THEN round(100 * sum(high - open) OVER {last(12)} / nullif(sum(open - low) OVER {last(12)}, 0), 4) END AS ar,
  CASE WHEN count(up) OVER {last(12)} = 12 THEN round(100 * sum(up) OVER {last(12)} / nullif(sum(dn) OVER {last(12)}, 0), 4) END AS br FROM u"""
)
def arbr(spark, sf):
    out = indicators.sentiment_ratios(days(spark, sf))
    return out.select("symbol", "day", F.round("ar", 4).alias("ar"), F.round("br", 4).alias("br"))


@R.add(f"WITH {B} SELECT symbol, day, CASE WHEN count(*) OVER {last(10)} = 10 THEN round(close - avg(close) OVER {last(10)}, 5) END AS osc FROM b")
def osc(spark, sf):
    return shown(indicators.oscillator(days(spark, sf)), "osc")


@R.add(
    f"""WITH {B}, p AS (SELECT *, lag(open) OVER ({W}) AS o, lag(close) OVER ({W}) AS c FROM b)
SELECT symbol, day, CASE WHEN abs(close - open) <= 0.1::DOUBLE * (high - low) THEN 'doji' WHEN close > open AND c < o AND open <= c AND close >= o THEN 'bullish_engulfing'
  WHEN close < open AND c > o AND open >= c AND close <= o THEN 'bearish_engulfing' END AS pattern FROM p"""
)
def candle_patterns(spark, sf):
    return indicators.candles(days(spark, sf)).select("symbol", "day", "pattern")


@R.add(
    f"""WITH {CH}, r AS (SELECT symbol, day, CASE WHEN count(change) OVER {last(6)} = 6 THEN 100 * avg(greatest(change, 0)) FILTER (WHERE change IS NOT NULL) OVER {last(6)} / nullif(avg(abs(change)) OVER {last(6)}, 0) END AS rsi FROM h),
t AS (SELECT symbol, day, (high + low + close) / 3 AS tp FROM b), w AS (SELECT *, list(tp) OVER {last(14)} AS tps, avg(tp) OVER {last(14)} AS m FROM t),
c AS (SELECT symbol, day, CASE WHEN len(tps) = 14 THEN (tp - m) / nullif(0.015::DOUBLE * list_sum(list_transform(tps, lambda x: abs(x - m))) / len(tps), 0) END AS cci FROM w),
a AS (SELECT symbol, day, 'RSI6' AS indicator, CASE WHEN rsi >= 70 THEN 'overbought' WHEN rsi <= 30 THEN 'oversold' END AS event FROM r
  UNION ALL SELECT symbol, day, 'CCI', CASE WHEN cci > 100 THEN 'overbought' WHEN cci < -100 THEN 'oversold' END FROM c)
SELECT * FROM a WHERE symbol = 'click' AND event IS NOT NULL AND day >= (SELECT max(day) FROM b WHERE symbol = 'click') - 14"""
)
def technical_anomalies(spark, sf):
    return indicators.technical_anomalies(days(spark, sf), "click", 14, ["RSI6", "CCI"])


FL = """f AS (SELECT event_type AS symbol, ts::DATE AS day, sum(s) AS net, sum(CASE WHEN value >= 200 THEN s ELSE 0 END) AS large_net, sum(CASE WHEN value < 200 THEN s ELSE 0 END) AS small_net,
  sum(CASE WHEN value >= 200 AND s > 0 THEN s ELSE 0 END) AS large_in, sum(CASE WHEN value >= 200 AND s < 0 THEN -s ELSE 0 END) AS large_out
  FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN value ELSE -value END AS s FROM events) GROUP BY 1, 2)"""


def flows(spark, sf):
    return anomaly.daily_flows(table(spark, sf, "events"))


@R.add(
    f"""WITH {FL}, g AS (SELECT *, row_number() OVER ({W}) - row_number() OVER (PARTITION BY symbol, net < 0 ORDER BY day) AS island FROM f)
SELECT symbol, min(day) AS first_day, max(day) AS last_day, count(*) AS days, round(sum(net), 4) AS total FROM g WHERE net < 0 GROUP BY symbol, island HAVING count(*) >= 2"""
)
def flow_runs(spark, sf):
    return anomaly.outflow_runs(flows(spark, sf)).withColumn("total", F.round("total", 4))


@R.add(
    f"""WITH {FL}, a AS (SELECT symbol, day, net, CASE WHEN count(*) OVER w = 3 THEN avg(net) OVER w END AS base FROM f WINDOW w AS ({W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT symbol, day, round(net, 4) AS net, round(base, 4) AS base, round((net - base) / abs(base), 4) AS excess FROM a"""
)
def flow_vs_mean3(spark, sf):
    out = anomaly.against_recent(flows(spark, sf))
    return out.select("symbol", "day", *(F.round(c, 4).alias(c) for c in ("net", "base", "excess")))


@R.add(
    f"""WITH {FL}, x AS (SELECT symbol, day, large_out, large_out / nullif(large_in, 0) AS ratio FROM f),
y AS (SELECT *, lag(large_out) OVER ({W}) AS p1, lag(ratio) OVER ({W}) AS p2, avg(large_out) OVER w AS a1, avg(ratio) OVER w AS a2 FROM x WINDOW w AS ({W} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING))
SELECT symbol, day, round(large_out, 4) AS large_out, round(ratio, 4) AS ratio FROM y WHERE large_out > p1 AND large_out > a1 AND ratio > p2 AND ratio > a2"""
)
def short_joint(spark, sf):
    rows = flows(spark, sf).select("symbol", "day", "large_out", F.try_divide("large_out", "large_in").alias("ratio"))
    return anomaly.joint_rise(rows, "large_out", "ratio").select("symbol", "day", F.round("large_out", 4).alias("large_out"), F.round("ratio", 4).alias("ratio"))


@R.add(
    f"""WITH {FL}, x AS (SELECT *, greatest(large_in, large_out) / nullif(least(large_in, large_out), 0) AS ratio FROM f)
SELECT symbol, day, round(large_net, 4) AS large_net, round(small_net, 4) AS small_net, round(ratio, 4) AS ratio FROM x WHERE sign(large_net) * sign(small_net) < 0 AND ratio >= 1.2"""
)
def flow_divergence(spark, sf):
    out = anomaly.divergence(flows(spark, sf), 1.2)
    return out.select("symbol", "day", *(F.round(c, 4).alias(c) for c in ("large_net", "small_net", "ratio")))


@R.add(f"WITH {FL} SELECT symbol, day, round(100.0::DOUBLE * (SELECT count(*) FROM f g WHERE g.symbol = f.symbol AND g.day <= f.day AND g.day > f.day - 20 AND g.net <= f.net) / (SELECT count(*) FROM f g WHERE g.symbol = f.symbol AND g.day <= f.day AND g.day > f.day - 20), 5) AS percentile FROM f")
def hist_percentile(spark, sf):
    return shown(anomaly.historical_percentile(flows(spark, sf), "net", 20), "percentile")


@R.add(
    f"""WITH {FL}, u AS (SELECT symbol, day, net, (net > lag(net) OVER ({W})) AS up FROM f), v AS (SELECT *, sum(CASE WHEN up THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM u)
SELECT symbol, day, round(net, 4) AS net FROM v WHERE s = 2"""
)
def rising_two_days(spark, sf):
    return anomaly.rising_days(flows(spark, sf), "net", 2).select("symbol", "day", F.round("net", 4).alias("net"))


@R.add(
    f"""WITH {B}, r AS (SELECT symbol, day, high, low, close, ln(close / lag(close) OVER ({W})) AS ret FROM b), h AS (SELECT *, stddev_samp(ret) OVER {last(20)} * {252**0.5!r}::DOUBLE AS hv FROM r)
SELECT symbol, day, round(hv, 5) AS hv, round((high - low) / close - hv, 5) AS premium FROM h WHERE (high - low) / close - hv >= 0"""
)
def iv_hv_premium(spark, sf):
    rows = days(spark, sf).withColumn("iv", (F.col("high") - F.col("low")) / F.col("close"))
    return shown(anomaly.volatility_premium(rows), "hv", "premium")


@R.add("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, p_size, round(l_quantity / p_size, 5) AS v_oi FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity / p_size >= 20")
def voi_unusual(spark, sf):
    """Trades whose volume is a multiple of the open interest; all of them."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    trades = lines.join(table(spark, sf, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
    return anomaly.unusual_trades(trades, "l_quantity", "p_size", 20.0).withColumn("v_oi", F.round("v_oi", 5))


@R.add(
    """WITH z AS (SELECT p_brand, floor(p_retailprice / 50.0::DOUBLE) * 50 AS low, sum(l_quantity) AS held FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), t AS (SELECT *, sum(held) OVER (PARTITION BY p_brand) AS total FROM z)
SELECT p_brand, low, low + 50 AS high, round(held / total, 6) AS share FROM t QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY round(held, 6) DESC, low) = 1"""
)
def price_zone(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_quantity")
    rows = lines.join(table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return anomaly.heaviest_zone(rows, "p_brand", "p_retailprice", "l_quantity")


@R.add(
    """WITH n AS (SELECT event_type AS symbol, 'user_' || user_id AS broker, round(sum(CASE WHEN event_id % 2 = 0 THEN value ELSE -value END), 4) AS net FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY net DESC, broker) AS buy_rank, row_number() OVER (PARTITION BY symbol ORDER BY net, broker) AS sell_rank FROM n)
SELECT * FROM r WHERE buy_rank <= 2 OR sell_rank <= 2"""
)
def broker_topn(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("broker"), F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(-F.col("value")).alias("amount"))
    return anomaly.top_brokers(rows, "symbol", "broker", "amount")


@R.add("WITH f AS (SELECT event_id, event_type, CASE WHEN user_id % 2 = 0 THEN 'HK.' ELSE 'US.' END || user_id AS symbol FROM events) SELECT * FROM f WHERE event_type NOT IN ('signup', 'error') OR starts_with(symbol, 'HK.')")
def market_dimension_filter(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", F.concat(F.when(F.col("user_id") % 2 == 0, "HK.").otherwise("US."), F.col("user_id").cast("string")).alias("symbol"))
    return anomaly.only_market(rows, "event_type", ["signup", "error"])


@R.add(
    """SELECT p.event_id, p.user_id, v.event_id AS seen_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts"""
)
def asof_signal_price(spark, sf):
    """Each purchase with the latest view of the same user before it."""
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    bought, seen = rows.where("event_type = 'purchase'").drop("event_type"), rows.where("event_type = 'view'").drop("event_type")
    return linking.as_of(bought, seen, "user_id", "ts", "event_id", "event_id", "seen_id").select("event_id", "user_id", "seen_id")


@R.add(
    """SELECT p.event_id, v.event_id AS view_id FROM events p JOIN events v ON p.user_id = v.user_id AND p.event_type = 'purchase' AND v.event_type = 'view'
WHERE abs(date_diff('second', p.ts, v.ts)) <= 7200"""
)
def events_within_window(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    p = rows.where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").alias("p_ts"))
    v = rows.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("v_ts"))
    return linking.within(p, v, "user_id", "p_ts", "v_ts", 120).select("event_id", "view_id")


@R.add(
    f"""WITH {B}, s AS (SELECT symbol, day, (close > open) AS up, lead(close) OVER ({W}) / close - 1 AS ret FROM b)
SELECT symbol, count(*) AS n, round(count(*) FILTER (WHERE ret > 0)::DOUBLE / count(*), 6) AS win_rate, round(avg(ret), 5) AS mean_ret, round(stddev_samp(ret), 5) AS dev_ret, round(avg(ret) / nullif(stddev_samp(ret), 0), 4) AS sharpe
FROM s WHERE up AND ret IS NOT NULL GROUP BY symbol"""
)
def backtest_hit_rate(spark, sf):
    """Forward returns of an up-day signal."""
    bars_ = days(spark, sf).withColumn("ret", F.lead("close").over(indicators.by_day()) / F.col("close") - 1).where("close > open AND ret IS NOT NULL")
    out = equity.hit_rate(bars_, "symbol", "ret")
    return out.select("symbol", "n", F.round("win_rate", 6).alias("win_rate"), F.round("mean_ret", 5).alias("mean_ret"), F.round("dev_ret", 5).alias("dev_ret"), F.round("sharpe", 4).alias("sharpe"))


@R.add(
    """WITH d AS (SELECT ts::DATE AS day, avg(value) FILTER (WHERE event_type = 'click') AS a, avg(value) FILTER (WHERE event_type = 'view') AS b FROM events GROUP BY 1), s AS (SELECT day, a - b AS spread FROM d),
z AS (SELECT *, (spread - avg(spread) OVER w) / nullif(stddev_samp(spread) OVER w, 0) AS spread_z FROM s WINDOW w AS (ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT 'click/view' AS pair, day, round(spread, 4) AS spread, round(spread_z, 3) AS spread_z FROM z"""
)
def pair_spread_z(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", ["click", "view"]).agg(F.avg("value"))
    rows = rows.select(F.lit("click/view").alias("pair"), "day", F.col("click").alias("a"), F.col("view").alias("b"))
    return equity.spread_z(rows).select("pair", "day", F.round("spread", 4).alias("spread"), F.round("spread_z", 3).alias("spread_z"))


T = ["click", "error", "purchase", "signup", "view"]
PAIRS = [(a, b) for i, a in enumerate(T) for b in T[i + 1 :]]


@R.add(
    "WITH d AS (PIVOT (SELECT ts::DATE AS day, event_type, value FROM events) ON event_type IN ('click', 'error', 'purchase', 'signup', 'view') USING avg(value) GROUP BY day) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(\"{a}\", \"{b}\"), 6) AS corr FROM d" for a, b in PAIRS)
)
def factor_corr(spark, sf):
    wide = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", T).agg(F.avg("value"))
    return equity.correlations(wide, T)
