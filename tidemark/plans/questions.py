"""Queries of search, ratios, portfolios, anomaly entries and the product's analytical questions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import alerts, anomaly, bars, features, hygiene, portfolio, ratios, search
from tidemark.plans.markets import FL, B, days, flows, last
from tidemark.plans.registry import Registry
from tidemark.session import table

R = Registry()
D = "PARTITION BY symbol ORDER BY day"

NEWS = "n AS (SELECT doc_id AS news_id, doc_id % 3 + 1 AS news_type, source AS title, lang, n_chars AS popularity, doc_id * 7 % 101 AS attention FROM documents)"


def news_items(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("news_id"), (F.col("doc_id") % 3 + 1).alias("news_type"), F.col("source").alias("title"), "lang", F.col("doc_id").alias("publish_time"), F.col("n_chars").alias("popularity"), (F.col("doc_id") * 7 % 101).alias("attention"))


@R.add(f"WITH {NEWS} SELECT news_id, title, lang FROM n WHERE contains(lower(title), 'src1') AND news_type = 1 ORDER BY news_id DESC LIMIT 10")
def news_by_time(spark, sf):
    return search.news(news_items(spark, sf), "SRC1").select("news_id", "title", "lang")


@R.add(f"WITH {NEWS} SELECT news_id, popularity FROM n WHERE contains(lower(title), 'src') AND news_type = 3 AND lang = 'en' ORDER BY popularity DESC, news_id LIMIT 50")
def news_by_popularity(spark, sf):
    """A size over 50 is cut to 50."""
    return search.news(news_items(spark, sf), "src", 200, 3, "en", 1).select("news_id", "popularity")


@R.add(f"WITH {NEWS} SELECT news_id, attention FROM n WHERE contains(lower(title), 'src') AND news_type = 2 ORDER BY attention DESC, news_id LIMIT 20")
def news_by_attention(spark, sf):
    return search.news(news_items(spark, sf), "src", 20, 2, sort_type=3).select("news_id", "attention")


@R.add("SELECT event_type AS symbol, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS position FROM events WHERE event_type IN ('click', 'view') QUALIFY position <= 30")
def community_feed(spark, sf):
    posts = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("event_id").alias("id"), F.col("ts").alias("publish_time"))
    return search.feed(posts, ["view", "click", "view"]).select("symbol", "id", "position")


@R.add("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 50")
def page_by_offset(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars")
    return search.page(rows, [F.desc("n_chars"), F.col("doc_id")], 25, 2)


@R.add("SELECT doc_id FROM documents WHERE doc_id > 40 ORDER BY doc_id LIMIT 25")
def page_by_cursor(spark, sf):
    return search.after(table(spark, sf, "documents").select("doc_id"), "doc_id", 40, 25)


@R.add("""SELECT '{"n_nationkey":' || n_nationkey || ',"place":{"name":"' || n_name || '","regions":["' || r_name || '"]}}' AS record FROM nation JOIN region ON n_regionkey = r_regionkey""")
def records_as_json(spark, sf):
    rows = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return search.as_json(rows.select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.array("r_name").alias("regions")).alias("place")))


@R.add("""SELECT event_id, '{"n":' || user_id || ',"xs":[' || user_id || ',{"y":-3,"z":2.5}]}' AS plain FROM events""")
def plain_numbers(spark, sf):
    """Stored decimals back as whole numbers, through nested lists and objects."""
    stored = F.concat(F.lit('{"n":'), F.col("user_id").cast("string"), F.lit('.000,"xs":['), F.col("user_id").cast("string"), F.lit('.0,{"y":-3.0,"z":2.5}]}'))
    return table(spark, sf, "events").select("event_id", scalars.plain_numbers(stored).alias("plain"))


@R.add("SELECT page_id, replace(replace(replace(url_encode(url), '%20', '+'), '~', '%7E'), '%2A', '*') AS encoded FROM pages")
def url_encoded(spark, sf):
    return table(spark, sf, "pages").select("page_id", scalars.encoded(F.col("url")).alias("encoded"))


@R.add(
    r"""WITH p AS (SELECT doc_id, '$AB and $CDE on #Tag_1 $AB ' || text AS t FROM documents), w AS (SELECT *, list_filter(regexp_split_to_array(lower(t), '[^\p{L}]+'), lambda x: x <> '') AS ws FROM p)
SELECT doc_id, array_to_string(list_distinct(regexp_extract_all(t, '\$([A-Z]{1,6})\b', 1)), ',') = 'AB' AS one, list_contains(regexp_extract_all(t, '\$([A-Z]{1,6})\b', 1), 'CDE') AS has_cde, regexp_extract_all(lower(t), '#([\p{L}\p{N}_]+)', 1)[1] AS first_tag,
  round((len(list_filter(ws, lambda x: x IN ('the', 'la'))) - len(list_filter(ws, lambda x: x IN ('and', 'de'))))::DOUBLE / len(ws), 6) AS score FROM w"""
)
def extracted_signals(spark, sf):
    """Tickers, tags and a lexicon's score of a text."""
    t = F.concat(F.lit("$AB and $CDE on #Tag_1 $AB "), F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", (F.array_join(scalars.tickers(t), ",") == "AB").alias("one"), F.array_contains(scalars.tickers(t), "CDE").alias("has_cde"), F.get(scalars.hashtags(t), F.lit(0)).alias("first_tag"),
        F.round(scalars.lexicon_score(t, ["the", "la"], ["and", "de"]), 6).alias("score"),
    )


@R.add(
    """WITH f AS (SELECT 'user_' || user_id AS entity, arg_max(value, event_id) AS latest_score FROM events GROUP BY user_id), r AS (SELECT * FROM (VALUES ('all', NULL, 100.0::DOUBLE), ('seven', 'user_7', 0.5::DOUBLE)) t(rule_id, entity, threshold)),
a AS (SELECT rule_id, f.entity, latest_score FROM f JOIN r ON (r.entity IS NULL OR r.entity = f.entity) AND latest_score >= threshold), n AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY latest_score DESC, entity) AS k FROM a)
SELECT rule_id, count(*) AS alerts, max(latest_score) AS highest, string_agg(entity, ',' ORDER BY k) FILTER (WHERE k <= 3) AS entities FROM n GROUP BY rule_id"""
)
def alert_digest(spark, sf):
    rules = spark.createDataFrame([("all", None, 100.0), ("seven", "user_7", 0.5)], "rule_id string, entity string, threshold double")
    fired = alerts.rules(features.latest_features(features.mentions(table(spark, sf, "events"))), rules)
    return alerts.digest(fired, most=3).withColumn("entities", F.array_join("entities", ","))


@R.add(
    f"""WITH {FL}, o AS (SELECT symbol, day, large_in AS a, CASE WHEN net < 0 THEN (-net - avg(-net) OVER w) / abs(avg(-net) OVER w) END AS excess, count(*) OVER w AS c, net FROM f WINDOW w AS ({D} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, row_number() OVER ({D}) - row_number() OVER (PARTITION BY symbol, net < 0 ORDER BY day) AS island FROM f),
e AS (SELECT symbol, day, 'capital_distribution' AS indicator, 'large_against_small' AS event FROM f WHERE sign(large_net) * sign(small_net) < 0 AND greatest(large_in, large_out) / nullif(least(large_in, large_out), 0) >= 1.1
  UNION ALL SELECT symbol, day, 'capital_flow', 'outflow_speeds_up' FROM o WHERE excess >= 0.5 AND c = 3
  UNION ALL SELECT symbol, max(day), 'outflow_run', 'days_' || count(*) FROM g WHERE net < 0 GROUP BY symbol, island HAVING count(*) >= 2)
SELECT * FROM e WHERE symbol = 'click' AND day >= (SELECT max(day) FROM f WHERE symbol = 'click') - 30"""
)
def capital_anomalies(spark, sf):
    return anomaly.capital_anomalies(flows(spark, sf), "click", 30, ratio=1.1, excess=0.5)


OPT = f"""{B}, z AS (SELECT symbol, day, close, (high - low) / close AS iv, open / close AS put_call, volume, volume * 2 AS interest FROM b),
x AS (SELECT *, close / lag(close, 5) OVER w - 1 AS pc, iv / lag(iv, 5) OVER w - 1 AS ic, put_call > lag(put_call) OVER w AS up, volume::DOUBLE / lag(volume) OVER w - 1 AS vc, close / lag(close) OVER w - 1 AS step,
  ln(close / lag(close) OVER w) AS ret FROM z WINDOW w AS ({D})),
y AS (SELECT *, up AND lag(up) OVER ({D}) AS twice, stddev_samp(ret) OVER {last(20)} * {252**0.5!r}::DOUBLE AS hv, list(iv) OVER {last(252)} AS ivs FROM x)"""


def options(spark, sf):
    return days(spark, sf).select("symbol", "day", "close", ((F.col("high") - F.col("low")) / F.col("close")).alias("iv"), (F.col("open") / F.col("close")).alias("put_call"), "volume", (F.col("volume") * 2).alias("interest"))


@R.add(
    f"""WITH {OPT}, e AS (SELECT symbol, day, 'iv_percentile' AS indicator, 'iv_high' AS event FROM y WHERE 100.0::DOUBLE * len(list_filter(ivs, lambda v: v <= iv)) / len(ivs) >= 90
  UNION ALL SELECT symbol, day, 'iv_hv_premium', 'iv_over_hv' FROM y WHERE iv - hv >= 0
  UNION ALL SELECT symbol, day, 'put_call_run', 'rises_two_days' FROM y WHERE twice
  UNION ALL SELECT symbol, day, 'co_movement', CASE WHEN step > 0 THEN 'long' WHEN step < 0 THEN 'short' ELSE 'open' END FROM y WHERE vc >= 0.3)
SELECT * FROM e WHERE symbol = 'view' AND day >= (SELECT max(day) FROM b WHERE symbol = 'view') - 40"""
)
def derivatives_anomalies(spark, sf):
    return anomaly.derivatives_anomalies(options(spark, sf), "view", 40, ["iv_percentile", "iv_hv_premium", "put_call_run", "co_movement"])


@R.add(f"WITH {OPT} SELECT symbol, day, round(pc, 5) AS price_change, round(ic, 5) AS iv_change FROM y WHERE pc <= -0.01 AND abs(ic) <= 0.5")
def calm_price_drops(spark, sf):
    """The price falls while implied volatility hardly moves."""
    found = anomaly.calm_drops(options(spark, sf), drop=-0.01, most_change=0.5)
    return found.select("symbol", "day", F.round("price_change", 5).alias("price_change"), F.round("iv_change", 5).alias("iv_change"))


@R.add(f"WITH {OPT} SELECT symbol, day, round(vc, 5) AS volume_change, round(step, 5) AS price_change, CASE WHEN step > 0 THEN 'long' WHEN step < 0 THEN 'short' ELSE 'open' END AS reading FROM y WHERE vc >= 0.1")
def option_stock_co_movement(spark, sf):
    rows = options(spark, sf)
    found = anomaly.co_movement(rows.select("symbol", "day", "volume", "interest"), rows.select("symbol", "day", "close"), 0.1)
    return found.select("symbol", "day", F.round("volume_change", 5).alias("volume_change"), F.round("price_change", 5).alias("price_change"), "reading")


@R.add(
    """WITH q AS (SELECT event_type AS symbol, time_bucket(INTERVAL '15 minutes', ts) AS start, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER w AS n, lag(high) OVER w AS sh, lag(low) OVER w AS sl FROM q WINDOW w AS (PARTITION BY symbol, start::DATE ORDER BY start)),
e AS (SELECT symbol, start::DATE AS day, sh, sl, CASE WHEN high > sh AND low >= sl THEN 'buy' WHEN low < sl AND high <= sh THEN 'sell' ELSE 'wait' END AS entry FROM n WHERE n = 3),
b AS (SELECT event_type AS symbol, ts::DATE AS day, max(value) AS high, min(value) AS low FROM events GROUP BY 1, 2), p AS (SELECT symbol, day, lag(high) OVER (PARTITION BY symbol ORDER BY day) AS rh, lag(low) OVER (PARTITION BY symbol ORDER BY day) AS rl FROM b),
t AS (SELECT symbol, day, entry, CASE WHEN entry = 'buy' THEN sh ELSE sl END AS price, CASE WHEN entry = 'buy' THEN sl ELSE sh END AS stop, CASE WHEN entry = 'buy' THEN rh ELSE rl END AS target FROM e JOIN p USING (symbol, day) WHERE entry <> 'wait')
SELECT *, round(abs(target - price) / nullif(abs(price - stop), 0), 5) AS reward_risk FROM t"""
)
def trade_plan(spark, sf):
    entries = bars.three_candles(bars.ohlcv(table(spark, sf, "events"), "15 minutes"))
    return bars.trade_plan(entries, bars.pivots(days(spark, sf))).withColumn("reward_risk", F.round("reward_risk", 5))


ACC = """a AS (SELECT s_suppkey AS company, s_nationkey AS nation, abs(s_acctbal) + 1 AS cash, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount)) * 0.6::DOUBLE AS cost, sum(l_extendedprice * l_tax) AS operating_cost,
  sum(l_quantity) AS units, count(*) AS lines FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""


def accounts(spark, sf):
    """Suppliers with sums of their lines as accounts."""
    price = F.col("l_extendedprice")
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum(price).alias("revenue"), (F.sum(price * (1 - F.col("l_discount"))) * 0.6).alias("cost"), F.sum(price * F.col("l_tax")).alias("operating_cost"), F.sum("l_quantity").alias("units"), F.count(F.lit(1)).alias("lines"))
    rows = table(spark, sf, "supplier").join(lines, F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.select(F.col("s_suppkey").alias("company"), F.col("s_nationkey").alias("nation"), (F.abs("s_acctbal") + 1).alias("cash"), "revenue", "cost", "operating_cost", "units", "lines")


def rounded(df, *names, keys=("company",), also=()):
    return df.select(*keys, *(F.round(n, 5).alias(n) for n in names), *also)


@R.add(f"WITH {ACC} SELECT company, round((revenue - cost) / revenue, 5) AS gross_margin, round((revenue - cost - operating_cost) / revenue, 5) AS operating_margin FROM a")
def company_margins(spark, sf):
    return rounded(ratios.margins(accounts(spark, sf)), "gross_margin", "operating_margin")


@R.add(f"WITH {ACC}, m AS (SELECT company, units * 50 AS cap, revenue - cost AS earnings, cash * 10 AS book, revenue - operating_cost AS ebitda, cost - cash AS nd FROM a) SELECT company, round(cap / earnings, 5) AS pe, round(cap / book, 5) AS pb, round((cap + nd) / ebitda, 5) AS ev_ebitda, round(earnings / book, 5) AS roe FROM m")
def valuation_multiples(spark, sf):
    c = F.col
    rows = accounts(spark, sf).select("company", F.lit(50.0).alias("price"), c("units").alias("shares"), (c("revenue") - c("cost")).alias("earnings"), (c("cash") * 10).alias("book"), (c("revenue") - c("operating_cost")).alias("ebitda"), (c("cost") - c("cash")).alias("net_debt"))
    return rounded(ratios.multiples(rows), "pe", "pb", "ev_ebitda", "roe")


@R.add(f"WITH {ACC} SELECT company, round((cost - cash) / (revenue - cost), 5) AS net_debt_ebitda, round((revenue - cost) / nullif(operating_cost, 0), 5) AS interest_coverage, round((revenue - cost) / nullif(operating_cost + lines, 0), 5) AS fixed_charge_coverage, round(cash + 100 + revenue - cost - operating_cost, 3) AS liquidity FROM a")
def credit_ratios(spark, sf):
    c = F.col
    rows = accounts(spark, sf).select("company", c("cost").alias("debt"), "cash", F.lit(100).alias("undrawn"), (c("revenue") - c("cost")).alias("ebitda"), c("operating_cost").alias("interest"), (c("operating_cost") + c("lines")).alias("fixed_charges"), (c("revenue") - c("cost") - c("operating_cost")).alias("free_cash"))
    out = ratios.credit(rows)
    return rounded(out, "net_debt_ebitda", "interest_coverage", "fixed_charge_coverage", also=[F.round("liquidity", 3).alias("liquidity")])


@R.add(
    f"""WITH {ACC}, q AS (SELECT company, revenue - cost AS ni, revenue - cost - operating_cost AS oc, revenue, cost, cash, units FROM a)
SELECT company, round(oc - cash, 3) AS free_cash, round(oc / ni, 5) AS cash_conversion, round((ni - oc) / revenue, 5) AS accruals, round(365 * cash / revenue + 365 * units / cost - 365 * (units / 2) / cost, 5) AS cycle_days, round(ni / (cash * 20), 5) AS roic FROM q"""
)
def earnings_quality(spark, sf):
    c = F.col
    income = c("revenue") - c("cost")
    rows = accounts(spark, sf).select("company", income.alias("net_income"), (income - c("operating_cost")).alias("operating_cash"), c("cash").alias("capex"), c("cash").alias("receivable"), c("units").alias("inventory"), (c("units") / 2).alias("payable"), "revenue", "cost", (c("cash") * 20).alias("invested"))
    out = ratios.earnings_quality(rows)
    return rounded(out, "cash_conversion", "accruals", "cycle_days", "roic", also=[F.round("free_cash", 3).alias("free_cash")])


@R.add(f"WITH {ACC} SELECT company, round(lines / units, 5) AS stocks_to_use, round(365 * lines / units, 5) AS days_of_supply FROM a")
def days_of_supply(spark, sf):
    return rounded(ratios.stocks(accounts(spark, sf).select("company", F.col("lines").alias("stock"), F.col("units").alias("use"))), "stocks_to_use", "days_of_supply")


@R.add(
    f"""WITH {ACC}, d AS (SELECT company, units + lines - company % 100 AS after, units, revenue - cost AS e, company % 7 * 1000.0::DOUBLE AS more FROM a), x AS (SELECT company, (after - units) / units AS dilution, ((e + more) / after) / (e / units) - 1 AS eps_change FROM d)
SELECT company, round(dilution, 5) AS dilution, round(eps_change, 5) AS eps_change, CASE WHEN eps_change > 0 THEN 'accretive' WHEN eps_change < 0 THEN 'dilutive' ELSE 'neutral' END AS effect FROM x"""
)
def share_dilution(spark, sf):
    c = F.col
    rows = accounts(spark, sf).select("company", c("units").alias("shares"), c("lines").alias("issued"), (c("company") % 100).alias("bought_back"), (c("revenue") - c("cost")).alias("earnings"), (c("company") % 7 * 1000.0).alias("added_earnings"))
    return rounded(ratios.dilution(rows), "dilution", "eps_change", also=["effect"])


@R.add(
    f"""WITH {ACC}, r AS (SELECT company, revenue - cost - operating_cost AS fc, revenue, cost - cash AS nd, revenue - cost AS eb FROM a), s AS (SELECT *, fc - 0.3::DOUBLE * revenue * (eb / revenue) AS stressed, (fc / revenue >= 0.05)::INT + (nd / eb <= 1.3)::INT AS passed FROM r)
SELECT company, round(stressed, 3) AS stressed_cash, CASE WHEN passed = 2 AND stressed > 0 THEN 'high' WHEN passed >= 1 THEN 'medium' ELSE 'low' END AS resilience FROM s"""
)
def resilience_screen(spark, sf):
    c = F.col
    rows = accounts(spark, sf).select("company", (c("revenue") - c("cost") - c("operating_cost")).alias("free_cash"), "revenue", (c("cost") - c("cash")).alias("net_debt"), (c("revenue") - c("cost")).alias("ebitda"))
    return ratios.resilient(rows, most_leverage=1.3).select("company", F.round("stressed_cash", 3).alias("stressed_cash"), "resilience")


YEARS = "y AS (SELECT r_name AS sector, year(o_orderdate)::INTEGER AS year, sum(o_totalprice) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)"


def sectors(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    places = F.broadcast(table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")))  # 25 nations
    rows = orders.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(F.col("r_name").alias("sector"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("revenue"))


@R.add(
    f"""WITH {YEARS}, g AS (SELECT *, revenue / lag(revenue) OVER w - 1 AS growth FROM y WINDOW w AS (PARTITION BY sector ORDER BY year)), c AS (SELECT *, growth - lag(growth) OVER (PARTITION BY sector ORDER BY year) AS change FROM g)
SELECT sector, year, round(growth, 5) AS growth, CASE WHEN growth >= 0 AND change >= 0 THEN 'expansion' WHEN growth >= 0 THEN 'transition' WHEN change >= 0 THEN 'slowdown' ELSE 'recession' END AS regime FROM c WHERE change IS NOT NULL"""
)
def regime_labels(spark, sf):
    w = W.partitionBy("sector").orderBy("year")
    g = sectors(spark, sf).withColumn("growth", F.try_divide("revenue", F.lag("revenue").over(w)) - 1)
    g = g.withColumn("change", F.col("growth") - F.lag("growth").over(w)).where("change IS NOT NULL")
    return g.select("sector", "year", F.round("growth", 5).alias("growth"), ratios.regime(F.col("growth"), F.col("change")).alias("regime"))


@R.add(f"WITH {YEARS}, l AS (SELECT sector, year, revenue / avg(revenue) OVER (PARTITION BY year) - 1 AS lead FROM y) SELECT sector, year, round(lead, 5) AS lead, CASE WHEN lead > 0.02 THEN 'overweight' WHEN lead < -0.02 THEN 'underweight' ELSE 'neutral' END AS stance FROM l")
def sector_stances(spark, sf):
    return ratios.sector_stance(sectors(spark, sf), "year", "revenue").select("sector", "year", F.round("lead", 5).alias("lead"), "stance")


@R.add("WITH d AS (SELECT event_type AS supplier, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), c AS (SELECT supplier, day, (n - lag(n) OVER (PARTITION BY supplier ORDER BY day))::DOUBLE / lag(n) OVER (PARTITION BY supplier ORDER BY day) AS change FROM d) SELECT supplier, day, CASE WHEN change <= -0.3 THEN 'severe' WHEN change <= -0.1 THEN 'moderate' WHEN change < 0 THEN 'mild' ELSE 'improving' END AS strength FROM c WHERE change IS NOT NULL")
def supply_signals(spark, sf):
    counts = features.velocity(features.per_day(features.mentions(table(spark, sf, "events")), "source"), "source").where("pct_change IS NOT NULL")
    return counts.select(F.col("source").alias("supplier"), "day", ratios.signal_strength(F.col("pct_change")).alias("strength"))


@R.add("""WITH r AS (SELECT doc_id, doc_id * 37 % 100 / 100.0::DOUBLE AS p, doc_id * 53 % 100 / 100.0::DOUBLE AS i FROM documents) SELECT doc_id, CASE WHEN p >= 2 / 3.0::DOUBLE THEN 'high' WHEN p >= 1 / 3.0::DOUBLE THEN 'medium' ELSE 'low' END AS probability_level,
  CASE WHEN i >= 2 / 3.0::DOUBLE THEN 'high' WHEN i >= 1 / 3.0::DOUBLE THEN 'medium' ELSE 'low' END AS impact_level, round(p * i, 6) AS weight FROM r""")
def risk_matrix(spark, sf):
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", (d * 37 % 100 / 100.0).alias("probability"), (d * 53 % 100 / 100.0).alias("impact"))
    return ratios.risk_matrix(rows).select("doc_id", "probability_level", "impact_level", F.round("weight", 6).alias("weight"))


HELD = "h AS (SELECT c_nationkey AS holder, year(o_orderdate)::INTEGER AS year, o_orderpriority AS asset, sum(o_totalprice) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3), wt AS (SELECT *, amount / sum(amount) OVER (PARTITION BY holder, year) AS w FROM h)"


def weights(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    rows = orders.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    held = rows.groupBy(F.col("c_nationkey").alias("holder"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("asset")).agg(F.sum("o_totalprice").alias("amount"))
    return held.withColumn("w", F.col("amount") / F.sum("amount").over(W.partitionBy("holder", "year")))


@R.add(
    f"""WITH {HELD}, k AS (SELECT holder, year, asset, w FROM wt), u AS (SELECT coalesce(a.holder, b.holder) AS holder, coalesce(a.year, b.year + 1) AS year, abs(coalesce(a.w, 0) - coalesce(b.w, 0)) AS m FROM k a FULL JOIN k b ON a.holder = b.holder AND a.asset = b.asset AND a.year = b.year + 1)
SELECT holder, year, round(sum(m) / 2, 6) AS turnover FROM u GROUP BY holder, year"""
)
def factor_turnover(spark, sf):
    return ratios.turnover(weights(spark, sf), "holder", "year", "asset", "w").withColumn("turnover", F.round("turnover", 6))


@R.add(
    """WITH h AS (SELECT c_nationkey AS holder, o_orderdate::DATE AS asset, sum(o_totalprice) AS w FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), o AS (SELECT asset, w AS w0 FROM h WHERE holder = 3),
d AS (SELECT holder, sum(w * coalesce(w0, 0)) AS dot, sqrt(sum(w * w)) AS len, count(w0) AS common, count(*) AS n FROM h LEFT JOIN o USING (asset) GROUP BY holder)
SELECT holder, round(dot / (len * (SELECT sqrt(sum(w0 * w0)) FROM o)), 6) AS cosine, round(common::DOUBLE / (n + (SELECT count(*) FROM o) - common), 6) AS jaccard FROM d"""
)
def portfolio_similarity(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("asset"), F.col("o_totalprice").alias("weight"))
    held = orders.join(table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("holder")), F.col("o_custkey") == F.col("c_custkey"))
    return portfolio.similarity(held, 3).select("holder", F.round("cosine", 6).alias("cosine"), F.round("jaccard", 6).alias("jaccard"))


@R.add(f"WITH {HELD} SELECT holder, year, asset, round(w, 6) AS share, w > 0.25 AS over FROM wt".replace("holder, year, asset, round", "holder || '/' || year AS holder, asset, round"))
def exposure_limits(spark, sf):
    rows = weights(spark, sf).withColumn("holder", F.concat_ws("/", "holder", "year"))
    return portfolio.exposure(rows, "holder", "asset", "amount").select("holder", "asset", F.round("share", 6).alias("share"), "over")


@R.add(
    f"""WITH {B}, r AS (SELECT symbol, day, close / lag(close) OVER ({D}) - 1 AS ret FROM b), m AS (SELECT day, avg(ret) AS base FROM r WHERE ret IS NOT NULL GROUP BY day)
SELECT symbol, day, round(sum(ln(1 + ret)) OVER ({D}), 4) AS log_growth, round(sum(ln(1 + base)) OVER ({D}), 4) AS log_benchmark FROM r JOIN m USING (day) WHERE ret IS NOT NULL"""
)
def portfolio_against_benchmark(spark, sf):
    rows = days(spark, sf).withColumn("ret", F.col("close") / F.lag("close").over(W.partitionBy("symbol").orderBy("day")) - 1).where("ret IS NOT NULL")
    market = rows.groupBy("day").agg(F.avg("ret").alias("ret"))
    out = portfolio.against_benchmark(rows, market, by="symbol")
    return out.select("symbol", "day", F.round(F.log1p("cumulative"), 4).alias("log_growth"), F.round(F.log1p("benchmark"), 4).alias("log_benchmark"))


@R.add(
    f"""WITH {B}, c AS (SELECT symbol AS analyst, CASE WHEN close > open THEN 1 ELSE -1 END AS direction, lead(close, 3) OVER ({D}) / close - 1 AS ret, day AS opened, lead(day, 3) OVER ({D}) AS closed FROM b)
SELECT analyst, count(*) AS calls, round(count(*) FILTER (WHERE direction * ret > 0)::DOUBLE / count(*), 6) AS win_rate, round(avg(direction * ret), 5) AS mean_result, round(avg(closed - opened), 5) AS mean_days FROM c WHERE ret IS NOT NULL GROUP BY analyst"""
)
def forecaster_accuracy(spark, sf):
    w = W.partitionBy("symbol").orderBy("day")
    calls = days(spark, sf).select(F.col("symbol").alias("analyst"), F.when(F.col("close") > F.col("open"), 1).otherwise(-1).alias("direction"), (F.lead("close", 3).over(w) / F.col("close") - 1).alias("ret"), F.col("day").alias("opened"), F.lead("day", 3).over(w).alias("closed"))
    out = portfolio.accuracy(calls.where("ret IS NOT NULL"))
    return out.select("analyst", "calls", F.round("win_rate", 6).alias("win_rate"), F.round("mean_result", 5).alias("mean_result"), F.round("mean_days", 5).alias("mean_days"))


@R.add(
    f"""WITH {B}, s AS (SELECT symbol, day, close, lead(close, 1) OVER ({D}) / close - 1 AS r1, lead(close, 5) OVER ({D}) / close - 1 AS r5, close > max(close) OVER ({D} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS up FROM b)
SELECT symbol, day, 1::INTEGER AS horizon, round(r1, 5) AS ret FROM s WHERE up AND r1 IS NOT NULL UNION ALL SELECT symbol, day, 5::INTEGER, round(r5, 5) FROM s WHERE up AND r5 IS NOT NULL"""
)
def backtest_replay(spark, sf):
    """Signals that use rows up to their day, replayed against the prices after it."""
    prices = days(spark, sf)
    high = F.max("close").over(W.partitionBy("symbol").orderBy("day").rowsBetween(-3, -1))
    signals = prices.withColumn("high_", high).where("close > high_").select("symbol", "day")
    return portfolio.replay(signals, prices, "symbol", [1, 5]).withColumn("ret", F.round("ret", 5))


DAYS = "d AS (SELECT 'user_' || user_id AS entity, ts::DATE AS day, count(*) AS n, avg(value) AS rating, (ts::DATE - DATE '2024-01-01')::DOUBLE AS x FROM events GROUP BY ALL), s AS (SELECT entity, regr_slope(n, x) AS a, regr_slope(rating, x) AS b, avg(rating) AS m FROM d GROUP BY entity)"


def daily_ratings(spark, sf):
    rows = features.mentions(table(spark, sf, "events")).groupBy("entity", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("rating"))
    return rows.withColumn("x", F.date_diff("day", F.lit("2024-01-01").cast("date")).cast("double"))


@R.add(f"WITH {DAYS} SELECT entity, round(a, 6) AS rising_slope, round(b, 4) AS other_slope FROM s WHERE a > 0 AND abs(b / m) <= 0.01")
def interest_up_price_flat(spark, sf):
    out = portfolio.trends_apart(daily_ratings(spark, sf), "entity", "x", "n", "rating", flat=0.01)
    return out.select("entity", F.round("rising_slope", 6).alias("rising_slope"), F.round("other_slope", 4).alias("other_slope"))


@R.add(f"WITH {DAYS} SELECT entity, round(a, 6) AS rising_slope, round(b, 4) AS other_slope FROM s WHERE a > 0 AND b < 0")
def volume_up_ratings_down(spark, sf):
    out = portfolio.trends_apart(daily_ratings(spark, sf), "entity", "x", "n", "rating")
    return out.select("entity", F.round("rising_slope", 6).alias("rising_slope"), F.round("other_slope", 4).alias("other_slope"))


@R.add(
    """WITH p AS (SELECT source AS symbol, 100.0::DOUBLE * count(*) FILTER (WHERE quality = 1 AND toxic <> 1) / count(*) AS bull FROM documents JOIN labels USING (doc_id) GROUP BY 1), u AS (SELECT DISTINCT source AS symbol FROM documents WHERE lang = 'fr' AND doc_id % 13 = 0)
SELECT symbol, round(bull, 6) AS bull_pct FROM p WHERE bull >= 50 AND symbol NOT IN (SELECT symbol FROM u)"""
)
def strong_sentiment_no_upgrade(spark, sf):
    """Strong sentiment, and no upgrade among the symbol's own."""
    from tidemark.operators import sentiment
    from tidemark.plans.texts import posts

    docs = table(spark, sf, "documents")
    upgrades = docs.where("lang = 'fr' AND doc_id % 13 = 0").select(F.col("source").alias("symbol")).distinct()
    strong = sentiment.by_symbol(posts(spark, sf)).where("bull_pct >= 50")
    return strong.join(upgrades, "symbol", "left_anti").select("symbol", "bull_pct")


@R.add(
    """WITH d AS (SELECT 'user_' || user_id AS entity, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2),
q AS (SELECT entity, day, avg(n) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / avg(n) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) - 1 AS m, count(*) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS c FROM d WINDOW w AS (PARTITION BY entity ORDER BY day)),
l AS (SELECT entity, arg_max(round(m, 6), day) AS momentum FROM q WHERE c = 6 GROUP BY entity) SELECT entity, momentum FROM l ORDER BY momentum DESC, entity LIMIT 10"""
)
def strongest_momentum(spark, sf):
    """The ten entities whose latest momentum is highest."""
    counts = features.momentum(features.per_day(features.mentions(table(spark, sf, "events"))), 3).where("momentum IS NOT NULL")
    latest = counts.groupBy("entity").agg(F.max_by(F.round("momentum", 6), "day").alias("momentum"))
    return latest.orderBy(F.desc("momentum"), "entity").limit(10)


@R.add("SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS from_first FROM events WHERE event_id % 3 = 0")
def first_source_with_rows(spark, sf):
    """Sources are asked in turn; the first that has rows answers."""
    events = table(spark, sf, "events").select("event_id")
    answer = hygiene.first_non_empty(events.where("event_id < 0"), events.where("event_id % 3 = 0"), events)
    return answer.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_id") % 3 == 0).alias("from_first"))


@R.add("SELECT event_id, strftime(ts, '%Y%m%d') AS compact, CASE WHEN user_id = 0 THEN 30 ELSE least(greatest(user_id, 1), 50) END::BIGINT AS size, strftime(ts::DATE - 7, '%Y') || '.' || month(ts::DATE - 7) || '.' || day(ts::DATE - 7) || ' - ' || year(ts) || '.' || month(ts) || '.' || day(ts) AS label, 'a,b' AS parts FROM events")
def small_scalars(spark, sf):
    """Compact days, clamped sizes, window labels, comma lists."""
    from tidemark.operators import normalize

    size = scalars.clamp(F.nullif("user_id", F.lit(0)), 1, 50, 30).cast("long")
    parts = F.array_join(normalize.split_list(F.concat(F.lit(" a ,, b, "), F.repeat(F.lit(" "), F.lit(2)))), ",")
    return table(spark, sf, "events").select("event_id", scalars.compact_day(F.col("ts")).alias("compact"), size.alias("size"), normalize.window_label(F.to_date("ts"), 7).alias("label"), parts.alias("parts"))
