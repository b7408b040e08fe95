"""Rules of the library's operators on literal rows."""

import datetime as dt
import random
import types

import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import alerts, equity, hygiene, linking, normalize, portfolio, ratios, search
from tidemark.sources import ingest, lake
from tidemark.sources.payloads import SCHEMAS, parsed

DAY = dt.date(2024, 1, 1)


def test_sizes_and_kinds(spark):
    assert [search.clamped(x, 30, 1, 50) for x in (None, 1, 50, 99)] == [30, 1, 50, 50] and search.clamped(1, 10, 3, 20) == 3
    rows = spark.createDataFrame([(1, 1, "50% off", "en", 5, None, 1)], "news_id int, news_type int, title string, lang string, publish_time int, popularity int, attention int")
    assert search.news(rows, "0% O").count() == 1 and search.news(rows, "50_").count() == 0
    for bad in (lambda: search.clamped(0, 1, 1, 2), lambda: search.news(rows, " "), lambda: search.news(rows, "x", news_type=9), lambda: search.news(rows, "x", sort_type=4)):
        with pytest.raises(ValueError):
            bad()


def test_places_are_ranks_over_all(spark):
    r = random.Random(3)
    data = [(i, None if r.random() < 0.05 else float(r.randrange(40))) for i in range(700)]
    rows = spark.createDataFrame(data, "k int, v double")
    known = sorted((v is not None, v or 0.0) for _, v in data)
    for p in equity.places(rows, "v", "place").collect():
        assert p.place == 1 + sum(x < (p.v is not None, p.v or 0.0) for x in known) and p.all_ == 700
    assert equity.percent_rank_of_all(rows.limit(0), "v", "p").count() == 0
    assert equity.percent_rank_of_all(rows.where("k = 0"), "v", "p").first().p == 0


def test_as_of_carries_values_over_buckets(spark):
    r = random.Random(8)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=r.randrange(0, 60 * 24 * 9, 30))
    left = [(i, r.choice("ab"), at()) for i in range(300)]
    right = [(i, r.choice("ab"), at()) for i in range(25)]
    l, rr = spark.createDataFrame(left, "i int, k string, ts timestamp_ntz"), spark.createDataFrame(right, "j int, k string, ts timestamp_ntz")
    for got in linking.as_of(l, rr, "k", "ts", "j", "j", "seen").collect():
        earlier = [(t, j) for j, k, t in right if k == got.k and t <= got.ts]
        assert got.seen == (max(earlier)[1] if earlier else None)


def test_named_rules_and_rules_for_all(spark):
    f = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", None)], "entity string, latest_score double")
    rules = spark.createDataFrame([("all", None, 2.0), ("a1", "a", 1.0), ("x", "x", 0.0)], "rule_id string, entity string, threshold double")
    fired = alerts.rules(f, rules)
    assert sorted((r.rule_id, r.entity) for r in fired.collect()) == [("a1", "a"), ("all", "b")]
    assert {r.rule_id: r.entities for r in alerts.digest(fired).collect()} == {"a1": ["a"], "all": ["b"]}


def test_weak_posts(spark):
    posts = spark.createDataFrame([("🚀🚀 🚀 🚀 🚀",), ("$A $B $C $D",), ("RT @x a long enough post here",), ("a quite normal post with words",), (None,), ("buy buy buy buy buy",)], "text string")
    assert [r.text for r in hygiene.keep_valuable(posts).collect()] == ["a quite normal post with words"]


def test_ratios_without_a_base(spark):
    row = spark.createDataFrame([(0.0, 5.0, 1.0)], "revenue double, cost double, operating_cost double")
    assert ratios.margins(row).first().gross_margin is None
    sold = spark.createDataFrame([("p", 1, "a", 1.0), ("p", 2, "b", 1.0)], "h string, t int, asset string, w double")
    assert {r.t: r.turnover for r in ratios.turnover(sold, "h", "t", "asset", "w").collect()} == {1: 0.5, 2: 1.0, 3: 0.5}


def test_similarity_with_oneself(spark):
    held = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 2.0), ("q", "c", 1.0)], "holder string, asset string, weight double")
    got = {r.holder: (round(r.cosine, 9), r.jaccard) for r in portfolio.similarity(held, "p").collect()}
    assert got == {"p": (1.0, 1.0), "q": (0.0, 0.0)}


def test_every_platform_parses_broken_payloads(spark):
    lines = spark.createDataFrame([("{}",), ("[]",), ('{"id": {"deep": 1}, "labels": 3, "tags": "x", "data": []}',), ("not json",), (None,)], "payload string")
    for name in SCHEMAS:
        raw = parsed(lines.where(F.try_parse_json("payload").isNotNull()), name)
        assert normalize.NORMALIZERS[name](raw, dt.datetime(2024, 2, 1)).count() == 3
        assert ingest.fetch(lines, name, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)).count() <= 3


def test_a_run_without_a_lake_shows_records(spark, tmp_path):
    (tmp_path / "reddit").mkdir()
    (tmp_path / "reddit" / "a.jsonl").write_text('{"id": "1", "created_utc": 1704067200, "title": "t"}\n{"id": "2", "created_utc": 1704063599}\n')
    catalogue = spark.createDataFrame([("reddit", {"limit": "10"}), ("nowhere", None)], "name string, kwargs map<string,string>")
    seen = []
    out = ingest.ingest(spark, catalogue, str(tmp_path), None, dt.datetime(2024, 1, 1), show=seen.append)
    assert [r.source_id for r in seen] == ["1"]  # the hour up to the end, both ends included
    assert {r.connector: (r.ok, r["items"]) for r in out.collect()} == {"reddit": (True, 1), "nowhere": (False, 0)}
    with pytest.raises(ValueError):
        ingest.ingest(spark, catalogue, str(tmp_path), None, dt.datetime(2024, 1, 1), names=["edgar"])


def test_expired_days_and_counts(spark, tmp_path):
    rows = spark.range(10).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id as int))").alias("ts"), F.struct(F.current_timestamp().alias("ingest_ts")).alias("provenance"))
    lake.write_raw_and_bronze(rows, str(tmp_path))
    assert len(lake.expire(spark, f"{tmp_path}/bronze", dt.date(2024, 1, 4))) == 3
    assert sorted(r.source_id for r in lake.bronze(spark, str(tmp_path), until=dt.date(2024, 1, 6)).collect()) == ["3", "4", "5"]
    assert lake.written_items(str(tmp_path / "n"), rows) == 10


def test_no_local_folder_on_a_cluster():
    made = types.SimpleNamespace(conf={}, sparkContext=types.SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError):
        session.shared_folder(made)
