from tidemark.functions import scalars as s
from tidemark.operators import equity, sentiment


def test_scalars(spark):
    df = spark.sql("SELECT TIMESTAMP '2026-07-12 20:30:00' AS ts, 2.0D AS whole, 2.5D AS part, 'Buy $TSLA $TSLA #Moon now good bad good' AS text, 'Bearer k' AS h, 'https://a.b/c?d' AS url, CAST(NULL AS INT) AS n")
    row = df.select(
        s.iso_z(df.ts), s.compact_day(df.ts), s.local_minutes(df.ts), s.whole_or_fraction(df.whole), s.whole_or_fraction(df.part), s.clamp(df.n, 1, 50, 30), s.host(df.url), s.encoded(df.h), s.tickers(df.text), s.hashtags(df.text),
        s.lexicon_score(df.text, ["good"], ["bad"]),
    ).first()
    assert list(row[:10]) == ["2026-07-12T20:30:00Z", "20260712", "2026-07-13 04:30", "2", "2.5", 30, "a.b", "Bearer+k", ["TSLA"], ["moon"]]
    assert abs(row[10] - 1 / 8) < 1e-9


def test_mixed_label_needs_both_sides(spark):
    rows = [("a", 40.0, 30.0), ("b", 40.0, 20.0), ("c", 5.0, 4.0), ("d", 20.0, 60.0)]
    df = spark.createDataFrame(rows, "symbol string, bull_pct double, bear_pct double")
    assert {r.symbol: r.label for r in sentiment.label(df).collect()} == {"a": "mixed", "b": "bullish", "c": "neutral", "d": "bearish"}


def test_scenarios_and_lots(spark):
    df = spark.createDataFrame([("x", 0.5, 10.0), ("x", 0.5, 20.0), ("y", 0.5, 1.0)], "k string, probability double, value double")
    assert {r.k: (r.expected, r.complete) for r in equity.expected_value(df, "k").collect()} == {"x": (15.0, True), "y": (0.5, False)}
    assert spark.sql("SELECT 1.4D AS p").select(equity.lot_size(__import__("pyspark").sql.functions.col("p"))).first()[0] == 1000
