"""Ratios of company accounts and markets, as Column functions; a ratio without a base is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def over(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.try_divide(a.cast("double"), b.cast("double"))


def margins(rows: DataFrame) -> DataFrame:
    """From ``revenue, cost, operating_cost``: gross and operating margin."""
    gross = F.col("revenue") - F.col("cost")
    return rows.withColumns({"gross_margin": over(gross, "revenue"), "operating_margin": over(gross - F.col("operating_cost"), "revenue")})


def multiples(rows: DataFrame) -> DataFrame:
    """From ``price, shares, earnings, book, ebitda, net_debt``: market value, P/E, P/B, EV/EBITDA, return on equity."""
    cap = F.col("price") * F.col("shares")
    return rows.withColumns({"market_cap": cap, "pe": over(cap, "earnings"), "pb": over(cap, "book"), "ev_ebitda": over(cap + F.col("net_debt"), "ebitda"), "roe": over("earnings", "book")})


def credit(rows: DataFrame) -> DataFrame:
    """From ``debt, cash, undrawn, ebitda, interest, fixed_charges, free_cash``: leverage, coverage, liquidity."""
    return rows.withColumns(
        {
            "net_debt_ebitda": over(F.col("debt") - F.col("cash"), "ebitda"),
            "interest_coverage": over("ebitda", "interest"),
            "fixed_charge_coverage": over("ebitda", "fixed_charges"),
            "liquidity": F.col("cash") + F.col("undrawn") + F.col("free_cash"),
        }
    )


def earnings_quality(rows: DataFrame) -> DataFrame:
    """From ``net_income, operating_cash, capex, receivable, inventory, payable, revenue, cost, invested``:
    cash behind the income, the days of the cash conversion cycle, return on invested capital."""
    days = lambda a, b: 365 * over(a, b)
    return rows.withColumns(
        {
            "free_cash": F.col("operating_cash") - F.col("capex"),
            "cash_conversion": over("operating_cash", "net_income"),
            "accruals": over(F.col("net_income") - F.col("operating_cash"), "revenue"),
            "cycle_days": days("receivable", "revenue") + days("inventory", "cost") - days("payable", "cost"),
            "roic": over("net_income", "invested"),
        }
    )


def stocks(rows: DataFrame) -> DataFrame:
    """From ``stock, use`` of a year: stocks-to-use and days of supply."""
    return rows.withColumns({"stocks_to_use": over("stock", "use"), "days_of_supply": 365 * over("stock", "use")})


def dilution(rows: DataFrame) -> DataFrame:
    """From ``shares, issued, bought_back, earnings, added_earnings``: share of new stock and the change of earnings a share."""
    after = F.col("shares") + F.col("issued") - F.col("bought_back")
    change = over(over(F.col("earnings") + F.col("added_earnings"), after), over("earnings", "shares")) - 1
    return rows.withColumns({"dilution": over(after - F.col("shares"), "shares"), "eps_change": change, "effect": F.when(change > 0, "accretive").when(change < 0, "dilutive").otherwise("neutral")})


def resilient(rows: DataFrame, least_cash: float = 0.05, most_leverage: float = 2.0, shock: float = 0.3) -> DataFrame:
    """High free cash flow and low leverage, and what is left of cash flow when revenue falls by ``shock``.

    From ``free_cash, revenue, net_debt, ebitda``; rating high if it passes both and stays
    positive in stress, medium if one, low if none.
    """
    stressed = F.col("free_cash") - shock * F.col("revenue") * over("ebitda", "revenue")
    strong, light = over("free_cash", "revenue") >= least_cash, over("net_debt", "ebitda") <= most_leverage
    passed = F.coalesce(strong.cast("int"), F.lit(0)) + F.coalesce(light.cast("int"), F.lit(0))
    return rows.withColumns({"stressed_cash": stressed, "resilience": F.when((passed == 2) & (stressed > 0), "high").when(passed >= 1, "medium").otherwise("low")})


def regime(growth: Column, growth_change: Column) -> Column:
    """Expansion, transition (slowing), slowdown (shrinking, but less), recession."""
    return F.when((growth >= 0) & (growth_change >= 0), "expansion").when(growth >= 0, "transition").when(growth_change >= 0, "slowdown").otherwise("recession")


def sector_stance(rows: DataFrame, by: str, value: str, band: float = 0.02) -> DataFrame:
    """A sector's mean against the mean of all its peers in the same period: overweight, neutral, underweight."""
    mean = F.avg(value).over(W.partitionBy(by))
    lead = over(F.col(value), mean) - 1
    return rows.withColumns({"lead": lead, "stance": F.when(lead > band, "overweight").when(lead < -band, "underweight").otherwise("neutral")})


def signal_strength(change: Column) -> Column:
    """Fixed buckets of a relative change of supply: severe, moderate, mild, improving."""
    return F.when(change <= -0.3, "severe").when(change <= -0.1, "moderate").when(change < 0, "mild").otherwise("improving")


def risk_matrix(risks: DataFrame) -> DataFrame:
    """``probability, impact`` (0 to 1) to a cell of the matrix and its weight."""
    level = lambda c: F.when(F.col(c) >= 2 / 3, "high").when(F.col(c) >= 1 / 3, "medium").otherwise("low")
    return risks.withColumns({"probability_level": level("probability"), "impact_level": level("impact"), "weight": F.col("probability") * F.col("impact")})


def turnover(held: DataFrame, by: str, period: str, asset: str, weight: str) -> DataFrame:
    """Half the summed absolute change of weights between periods, assets that come and go included.

    A period's changes are those against the same asset's weight one period before, in one
    window; what is left out of a period counts as sold.
    """
    w = W.partitionBy(by, asset).orderBy(period)
    before = F.when(F.lag(period).over(w) == F.col(period) - 1, F.lag(weight).over(w)).otherwise(F.lit(0.0))
    gone = F.when(F.lead(period).over(w) == F.col(period) + 1, F.lit(0.0)).otherwise(F.col(weight))
    moved = held.withColumns({"in_": F.abs(F.col(weight) - before), "out_": gone})
    here = moved.select(by, F.col(period).alias("p"), F.col("in_").alias("m"))
    next_ = moved.select(by, (F.col(period) + 1).alias("p"), F.col("out_").alias("m"))
    return here.unionByName(next_).groupBy(by, F.col("p").alias(period)).agg((F.sum("m") / 2).alias("turnover"))
