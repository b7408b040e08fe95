"""Queries of company comparison, over orders, line items, parts, suppliers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import equity
from tidemark.plans.registry import Registry
from tidemark.session import table

R = Registry()

REV = """rev AS (SELECT n_name AS nation, r_name AS region, year(o_orderdate)::INTEGER AS year, sum(o_totalprice) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""


def nations(spark, sf):
    n = table(spark, sf, "nation")
    return n.join(F.broadcast(table(spark, sf, "region")), n.n_regionkey == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


def revenue(spark, sf):
    """Revenue by nation and year; the nation tables are fixed and small."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations(spark, sf)), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("nation", "region", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("revenue"))


@R.add(f"WITH {REV} SELECT nation, year, round(revenue, 2) AS revenue, round(revenue / lag(revenue) OVER (PARTITION BY nation ORDER BY year) - 1, 6) AS yoy FROM rev")
def revenue_yoy(spark, sf):
    return equity.growth(revenue(spark, sf), "nation", "year", "revenue").select("nation", "year", F.round("revenue", 2).alias("revenue"), F.round("yoy", 6).alias("yoy"))


@R.add(
    f"""WITH {REV}, f AS (SELECT *, first(revenue) OVER w AS r0, first(year) OVER w AS y0 FROM rev WINDOW w AS (PARTITION BY nation ORDER BY year))
SELECT nation, year, CASE WHEN year > y0 THEN round(pow(revenue / r0, 1.0::DOUBLE / nullif(year - y0, 0)) - 1, 6) END AS cagr FROM f"""
)
def revenue_cagr(spark, sf):
    return equity.growth(revenue(spark, sf), "nation", "year", "revenue").select("nation", "year", F.round("cagr", 6).alias("cagr"))


@R.add(f"WITH {REV}, t AS (SELECT nation, region, sum(revenue) AS revenue FROM rev GROUP BY ALL) SELECT nation, region, round(avg(revenue) OVER (PARTITION BY region), 2) AS peer_mean, round(revenue / avg(revenue) OVER (PARTITION BY region) - 1, 6) AS relative FROM t")
def peer_relative(spark, sf):
    totals = revenue(spark, sf).groupBy("nation", "region").agg(F.sum("revenue").alias("revenue"))
    return equity.against_peers(totals, "region", "revenue").select("nation", "region", F.round("peer_mean", 2).alias("peer_mean"), F.round("relative", 6).alias("relative"))


@R.add(
    """WITH m AS (SELECT o_orderpriority AS priority, year(o_orderdate) AS y, month(o_orderdate)::INTEGER AS season, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
SELECT priority, season, round(avg(v), 4) AS season_mean, count(*) AS periods FROM m GROUP BY ALL"""
)
def seasonal_avg(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("v"))
    return equity.seasonal_mean(rows, ["priority"], "v", F.month("month")).withColumn("season_mean", F.round("season_mean", 4))


PARTS = """s AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal, percent_rank() OVER (ORDER BY s_acctbal) AS cash FROM supplier),
q AS (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS rev, avg(l_discount) AS disc, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS returned FROM lineitem GROUP BY 1),
k AS (SELECT s_name AS company, s_nationkey, cash, round(rev, 2) AS rev, percent_rank() OVER (ORDER BY round(rev, 2)) AS growth, round(1 - returned, 6) AS quality, round(1 - disc, 6) AS valuation, round(returned, 6) AS returned FROM s JOIN q ON l_suppkey = s_suppkey)"""


def companies(spark, sf):
    """Suppliers as companies, each part of the score between 0 and 1."""
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"), F.avg("l_discount").alias("disc"), F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("returned")
    )
    s = equity.percent_rank_of_all(table(spark, sf, "supplier"), "s_acctbal", "cash")
    rows = equity.percent_rank_of_all(s.join(lines, F.col("s_suppkey") == F.col("l_suppkey")).withColumn("rev", F.round("rev", 2)), "rev", "growth")
    return rows.select(
        F.col("s_name").alias("company"), "s_nationkey", "cash", "rev", "growth", F.round(1 - F.col("returned"), 6).alias("quality"), F.round(1 - F.col("disc"), 6).alias("valuation"), F.round("returned", 6).alias("returned")
    )


SCORE = "round(quality * 20 + valuation * 20 + growth * 20 + cash * 15, 4)"


@R.add(f"WITH {PARTS}, x AS (SELECT company, {SCORE} AS score FROM k) SELECT company, score, row_number() OVER (ORDER BY score DESC, company) AS rank, CASE WHEN score >= 70 THEN 'buy' WHEN score >= 50 THEN 'hold' ELSE 'avoid' END AS recommendation FROM x")
def weighted_score_rank(spark, sf):
    rows = companies(spark, sf).withColumns({"management": F.lit(None).cast("double"), "risk": F.lit(None).cast("double")})
    scored = equity.weighted_score(rows).select("company", F.round("score", 4).alias("score"))
    return equity.ranked(scored, "score", "company")


@R.add(f"WITH {PARTS} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, arg_max(company, ({m}, company)) AS winner, max({m})::DOUBLE AS value FROM k" for m in ("rev", "cash", "quality")))
def superlatives(spark, sf):
    return equity.superlatives(companies(spark, sf), "company", ["rev", "cash", "quality"])


@R.add(f"WITH {PARTS} SELECT company, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY rev), 6) AS rev_pct, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY quality), 6) AS quality_pct FROM k")
def factor_percentile(spark, sf):
    out = equity.percent_ranks(companies(spark, sf), "s_nationkey", ["rev", "quality"])
    return out.select("company", F.round("rev_pct", 6).alias("rev_pct"), F.round("quality_pct", 6).alias("quality_pct"))


@R.add(f"WITH {PARTS} SELECT company, rev, returned FROM k WHERE growth >= 0.5 AND cash >= 0.5 AND returned <= 0.4")
def screen(spark, sf):
    return companies(spark, sf).where("growth >= 0.5 AND cash >= 0.5 AND returned <= 0.4").select("company", "rev", "returned")


@R.add("SELECT p_partkey, (floor(150000.0::DOUBLE / (p_retailprice * 100)) * 100)::BIGINT AS shares FROM part")
def lot_sizes(spark, sf):
    return table(spark, sf, "part").select("p_partkey", equity.lot_size(F.col("p_retailprice"), 150_000.0).alias("shares"))


@R.add(f"WITH {REV}, t AS (SELECT nation, list(revenue ORDER BY year) AS f FROM rev GROUP BY nation) SELECT nation, round(list_sum(list_transform(f, lambda x, i: x / pow(1.1::DOUBLE, i))), 2) AS npv FROM t")
def npv_by_nation(spark, sf):
    flows = revenue(spark, sf).groupBy("nation").agg(F.array_sort(F.collect_list(F.struct("year", "revenue"))).alias("f"))
    return flows.select("nation", F.round(equity.net_present_value(F.transform("f", lambda x: x["revenue"]), 0.1), 2).alias("npv"))


@R.add(
    """SELECT o_orderpriority AS scenario_set, round(sum(p * v), 4) AS expected, abs(sum(p) - 1) < 1e-9 AS complete FROM (
SELECT o_orderpriority, o_orderstatus, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS p, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) GROUP BY 1"""
)
def scenario_value(spark, sf):
    from pyspark.sql import Window as W

    rows = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("scenario_set"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("value"))
    rows = rows.withColumn("probability", F.col("n") / F.sum("n").over(W.partitionBy("scenario_set")))
    return equity.expected_value(rows, "scenario_set").withColumn("expected", F.round("expected", 4))


@R.add(
    """WITH v AS (SELECT n_name AS nation, s_suppkey, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT nation, round(sum(v * v) / (sum(v) * sum(v)), 6) AS hhi, count(*) AS parts FROM v GROUP BY nation"""
)
def supplier_concentration(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("v"))
    rows = lines.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(nations(spark, sf)), F.col("s_nationkey") == F.col("n_nationkey"))
    return equity.concentration(rows, "nation", "l_suppkey", "v").withColumn("hhi", F.round("hhi", 6))


@R.add(
    """WITH h AS (SELECT c_nationkey AS holder, year(o_orderdate)::INTEGER AS year, sum(o_totalprice) AS position FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
d AS (SELECT *, position - lag(position) OVER (PARTITION BY holder ORDER BY year) AS change FROM h)
SELECT holder, round(sum(greatest(change, 0)), 2) AS accumulated FROM d GROUP BY holder"""
)
def accumulated_holdings(spark, sf):
    """Sum of the positive changes of each holder's position."""
    from pyspark.sql import Window as W

    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    rows = orders.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    held = rows.groupBy(F.col("c_nationkey").alias("holder"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("position"))
    change = F.col("position") - F.lag("position").over(W.partitionBy("holder").orderBy("year"))
    return held.withColumn("change", change).groupBy("holder").agg(F.round(F.sum(F.greatest("change", F.lit(0.0))), 2).alias("accumulated"))
