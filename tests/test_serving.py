import datetime as dt

import pytest

from tidemark.operators import alerts, features, hygiene, linking, serving

NOW = dt.datetime(2026, 7, 12)
EV = "array<struct<source:string,s3_uri:string,ts:string,note:string>>"
ITEM = f"entity string, latest_score double, mention_count bigint, evidence {EV}, updated_at string"


def items(spark, *rows):
    return spark.createDataFrame(rows, ITEM)


def ev(*sources):
    return [(s, None, None, None) for s in sources]


def test_filter_runs_after_top_k(spark):
    df = items(spark, ("a", 9.0, 1, ev("x"), None), ("b", 8.0, 1, ev("reddit"), None), ("c", 7.0, 1, ev("reddit"), None))
    assert [r.entity for r in serving.trends(df, 2, source="reddit").collect()] == ["b"]


def test_ties_by_entity_and_null_score_is_zero(spark):
    df = items(spark, ("b", 1.0, 1, None, None), ("a", 1.0, 1, None, None), ("n", None, 1, None, None), ("m", -1.0, 1, None, None))
    assert [r.entity for r in serving.trends(df, 4).collect()] == ["a", "b", "n", "m"]


def test_query_is_literal_and_reads_evidence(spark):
    df = items(spark, ("A_1", 3.0, 1, [], None), ("Ax1", 2.0, 1, [], None), ("z", 1.0, 1, ev("Ra_1"), None), ("q", 0.5, 1, None, None))
    assert [r.entity for r in serving.trends(df, 10, query="a_1").collect()] == ["A_1", "z"]
    assert serving.trends(df, 10, query="").count() == 4
    assert serving.trends(df, 10, query="%").count() == 0


def test_served_row_defaults(spark):
    row = serving.trends(items(spark, ("e1", 5.0, 10, None, "")), 10).first()
    assert (row.entity, row.score, row.mention_count, row.evidence, row.last_seen) == ("e1", 5.0, 10, [], None)
    bare = serving.as_trends(spark.createDataFrame([(0.85,)], "score double")).first()
    assert (bare.entity, bare.score, bare.mention_count, bare.last_seen) == ("unknown", 0.85, 0, None)


def test_detail_only_within_the_first_hundred(spark):
    df = items(spark, *((f"e{i:03}", float(-i), 1, [], None) for i in range(120)))
    assert serving.detail(df, "e099").count() == 1
    assert serving.detail(df, "e100").count() == 0


def test_fallback_keeps_its_order(spark):
    empty = items(spark)
    sample = spark.createDataFrame([("low", 0.1), ("high", 0.9)], "entity string, score double")
    assert [r.entity for r in serving.trends(empty, 2, fallback=sample).collect()] == ["low", "high"]


def test_timeline_ends_at_the_score(spark):
    rows = serving.timeline(spark.createDataFrame([("e1", 5.0)], "entity string, score double"), NOW).orderBy("idx").collect()
    assert len(rows) == 7 and rows[0].value == 3.25 and rows[-1].value == 5.0
    assert rows[-1].date == "2026-07-12T00:00:00Z" and rows[0].date == "2026-07-06T00:00:00Z"


def test_limit_is_checked():
    for bad in (0, 101):
        with pytest.raises(ValueError):
            serving.checked_limit(bad)


def test_dashboard_is_one_row(spark):
    df = items(spark, ("e1", 5.0, 10, ev("reddit"), "2026-07-12"), ("e2", 6.0, 1, [], None))
    row = serving.dashboard(serving.trends(df, 5), spark.createDataFrame([("a",), ("b",)], "name string")).first()
    assert row.signal_count == 2 and row.platform_count == 2
    assert [t.entity for t in row.top_trends] == ["e2", "e1"]


def test_threshold_is_inclusive_and_missing_is_zero(spark):
    df = spark.createDataFrame([("a", 0.8), ("b", 0.79), ("c", None)], "entity string, score double")
    assert [r.entity for r in alerts.above_threshold(df).collect()] == ["a"]


def feature(spark, *rows):
    return spark.createDataFrame(rows, "entity string, latest_score double, mention_count bigint, updated_at timestamp")


def test_merge_adds_counts_and_keeps_the_last_score(spark):
    a = feature(spark, ("p", 2.5, 3, dt.datetime(2026, 1, 1)))
    b = feature(spark, ("p", 1.0, 4, dt.datetime(2026, 1, 2)))
    row = features.merge_features(a, b).first()
    assert (row.latest_score, row.mention_count) == (1.0, 7)


def test_merge_is_associative(spark):
    a, b, c = (feature(spark, ("p", float(i), i, dt.datetime(2026, 1, i)), ("q", 0.0, 1, dt.datetime(2026, 1, 4 - i))) for i in (1, 2, 3))
    left = features.merge_features(features.merge_features(a, b), c)
    right = features.merge_features(a, features.merge_features(b, c))
    assert sorted(left.collect()) == sorted(right.collect())


def test_first_filled_treats_empty_as_missing(spark):
    df = spark.createDataFrame([("", "b"), (None, ""), ("a", "b")], "x string, y string")
    assert [r.k for r in df.select(features.first_filled("x", "y", default="unknown").alias("k")).collect()] == ["b", "unknown", "a"]


def test_mentions_of_two_posts(spark):
    df = spark.createDataFrame([("1", "r/a"), ("2", "r/b")], "id string, subreddit string")
    assert sorted(features.mention_counts(df, "subreddit").collect()) == [("r/a", 1, 1.0), ("r/b", 1, 1.0)]


def test_latest_per_key(spark):
    df = spark.createDataFrame([("s", "1", 1, "old"), ("s", "1", 2, "new"), ("s", "2", 1, "x")], "source string, source_id string, gen int, v string")
    got = hygiene.latest_per_key(df, ["source", "source_id"], [df.gen]).collect()
    assert sorted(r.v for r in got) == ["new", "x"]


def test_aliases(spark):
    known = spark.createDataFrame([("Tesla", "US.TSLA"), ("tsla", "US.TSLA"), ("X", "US.X"), ("x", "HK.X")], "alias string, code string")
    rows = linking.resolve_aliases(spark.createDataFrame([("TESLA",), ("x",), ("?",)], "name string"), known).collect()
    found = {r.name: (r.code, r.ambiguous) for r in rows}
    assert found == {"TESLA": ("US.TSLA", False), "x": ("HK.X", True), "?": (None, False)}


def test_weak_posts(spark):
    rows = [("nice",), ("RT @a look at this long post",), ("$TSLA $AAPL $F $GM",), ("up up up up up up",), ("margins rose because costs fell",), (None,)]
    kept = hygiene.keep_valuable(spark.createDataFrame(rows, "text string")).collect()
    assert [r.text for r in kept] == ["margins rose because costs fell"]
