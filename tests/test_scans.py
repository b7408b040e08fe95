"""Scans along an order against plain recurrences, and how their rows are dealt."""

import random
from bisect import bisect_right, insort

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars, equity, indicators, scans


def history(spark, n, seed=1, symbols=("a",), nulls=0.0, day=True):
    r = random.Random(seed)
    out = []
    for s in symbols:
        price = 100.0
        for k in range(n):
            price += r.gauss(0, 1)
            low, high = sorted((price + r.gauss(0, 1), price + r.gauss(0, 2)))
            cell = lambda v: None if r.random() < nulls else v
            out.append((s, k, cell(price), cell(round(high, 2)), cell(round(low, 2)), 10))
    r.shuffle(out)
    return out, spark.createDataFrame(out, "symbol string, day int, close double, high double, low double, volume int")


def average(values, weight, state=None):
    out = []
    for v in values:
        if v is not None:
            state = v if state is None else state + (v - state) * weight
        out.append(state)
    return out


def close_to(a, b):
    assert len(a) == len(b)
    assert all((x is None) == (y is None) and (x is None or abs(x - y) <= 1e-9 * max(1.0, abs(y))) for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("size,nulls", [(512, 0.0), (16, 0.3), (3, 0.7)])
def test_macd_and_kdj_are_the_recurrences(spark, monkeypatch, size, nulls):
    monkeypatch.setattr(scans.ordered, "__defaults__", ("symbol", "day", size))
    monkeypatch.setattr(scans.with_rows_before, "__defaults__", (size,))
    data, rows = history(spark, 700, symbols=("a", "b", None), nulls=nulls)
    got = {s: sorted((r for r in indicators.macd(rows).collect() if r.symbol == s), key=lambda r: r.day) for s in ("a", "b", None)}
    for s, found in got.items():
        own = sorted(d[1:3] for d in data if d[0] == s)
        x = [c for _, c in own]
        dif = [None if a is None else a - b for a, b in zip(average(x, 2 / 13), average(x, 2 / 27), strict=True)]
        # nulls leave all three states, so the signal line only sees days with a close
        seen = [d if v is not None else None for d, v in zip(dif, x, strict=True)]
        dea = average(seen, 2 / 10)
        close_to([r.dif for r in found], dif)
        close_to([r.dea for r in found], dea)
        above = [None if a is None else a > b for a, b in zip([r.dif for r in found], [r.dea for r in found], strict=True)]
        cross = [None] + ["golden" if q and p is False else "death" if p and q is False else None for p, q in zip(above, above[1:], strict=False)]
        assert [r.cross for r in found] == cross
    if size >= 8:
        k9 = {s: sorted((r for r in indicators.kdj(rows).collect() if r.symbol == s), key=lambda r: r.day) for s in ("a", "b", None)}
        for s, found in k9.items():
            own = sorted((d[1:] for d in data if d[0] == s), key=lambda d: d[0])
            rsv = []
            for i in range(len(own)):
                lows, highs = [d[3] for d in own[max(0, i - 8) : i + 1] if d[3] is not None], [d[2] for d in own[max(0, i - 8) : i + 1] if d[2] is not None]
                c = own[i][1]
                rsv.append(100 * (c - min(lows)) / (max(highs) - min(lows)) if c is not None and lows and highs and max(highs) != min(lows) else 50.0)
            k = average(rsv, 1 / 3, 50.0)
            close_to([r.rsv for r in found], rsv)
            close_to([r.k for r in found], k)
            close_to([r.d for r in found], average(k, 1 / 3, 50.0))


@pytest.mark.parametrize("fan,shape", [(256, "walk"), (4, "walk"), (2, "rise"), (3, "fall"), (5, "flat")])
def test_swings_are_the_nearest_older_extremes(spark, monkeypatch, fan, shape):
    monkeypatch.setattr(scans, "FAN", fan)
    data, rows = history(spark, 300, seed=5, symbols=("a", "b"), nulls=0.1 if shape == "walk" else 0)
    if shape != "walk":
        move = {"rise": 1.0, "fall": -1.0, "flat": 0.0}[shape]
        data = [(s, k, 0.0, 5 + k * move, 1 + k * move, 1) for s in "ab" for k in range(300)]
        rows = spark.createDataFrame(data, rows.schema)
    got = {(r.symbol, r.day): (r.range_high, r.range_low, r.swing_high, r.swing_low) for r in bars.pivots(rows).collect()}
    want = {}
    for s in "ab":
        highs, lows, before = [], [], (None, None)
        for _, k, _, high, low, _ in sorted(d for d in data if d[0] == s):
            top, bottom = before
            up = bisect_right(highs, top) if top is not None else len(highs)
            down = [x for x in lows if bottom is not None and x < bottom]
            want[s, k] = (top, bottom, highs[up] if up < len(highs) else None, max(down, default=None))
            before = (high, low)
            for known, v in ((highs, high), (lows, low)):
                if v is not None:
                    insort(known, v)
    assert got == want


@pytest.fixture
def whole_partitions(spark):
    """Small partitions are not put together, so that tests see how rows are dealt."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_symbol_is_many_tasks(spark, whole_partitions):
    n = 60_000
    rows = spark.range(n).select(F.lit("hot").alias("symbol"), F.col("id").cast("int").alias("day"), (100 + F.sin(F.col("id") / 50) * 10).alias("close"))
    out = scans.smoothed(scans.ordered(rows), "close", {"q": (0.2, 1.0)}, ("s", 0.2))
    dealt = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) >= 4 and max(r["count"] for r in dealt) < 0.5 * n
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    x = [r.close for r in rows.orderBy("day").collect()]
    found = [r.q for r in out.orderBy("day").select("q").collect()]
    close_to(found, average(x, 0.2))


def test_flat_prices_never_cross(spark):
    rows = spark.createDataFrame([("a", d, 0.1 if d < 900 else 0.3) for d in range(1500)], "symbol string, day int, close double")
    got = sorted(indicators.macd(rows).collect(), key=lambda r: r.day)
    assert all(r.dif == r.dea == 0 and r.cross is None for r in got[:900]) and got[900].cross == "golden"


def test_no_rows(spark):
    _, rows = history(spark, 3)
    none = rows.where("false")
    assert indicators.macd(none).count() == indicators.kdj(none).count() == bars.pivots(none).count() == 0
    with pytest.raises(ValueError):
        scans.smoothed(scans.ordered(rows), "close", {"q": (0.9, 1.0)}, ("s", 0.2))


@pytest.mark.parametrize("descending", [False, True])
def test_heavy_values_are_spread_and_share_their_place(spark, whole_partitions, descending):
    r = random.Random(2)
    data = [(k, 5.0 if k % 10 else r.choice([None, 1.0, 5.0, r.random() * 10])) for k in range(4000)]
    rows = spark.createDataFrame(data, "k int, v double").repartition(5)
    key = lambda v: (0 if v is None and not descending else 2 if v is None else 1, 0 if v is None else -v if descending else v)
    known = sorted(key(v) for _, v in data)
    first = {}
    for i, x in enumerate(known):
        first.setdefault(x, i + 1)
    shared = equity.places(rows, "v", "place", descending=descending).collect()
    assert all(p.place == first[key(p.v)] and p.all_ == 4000 for p in shared) and len(shared) == 4000
    numbered = equity.places(rows, "v", "place", "k", descending=descending).collect()
    want = {k: i + 1 for i, (_, k) in enumerate(sorted((key(v), k) for k, v in data))}
    assert {p.k: p.place for p in numbered} == want
    dealt = scans.in_order(rows, F.asc("v"), F.asc("k"), parts=True).groupBy("part_").count().collect()
    assert len(dealt) == 4 and max(d["count"] for d in dealt) < 2200
