import datetime as dt
import json

import pytest

from tidemark.operators import normalize
from tidemark.sources import lake, registry, replay

NOW = dt.datetime(2024, 2, 1)


def test_registry():
    assert registry.platform("X") == "twitter" and registry.platform("Reddit") == "reddit"
    with pytest.raises(ValueError):
        registry.platform("nowhere")


def test_arguments():
    assert registry.parse_arguments(["--a-b", "1", "--c=2", "--flag", "--d", "x"]) == {"a_b": "1", "c": "2", "flag": "true", "d": "x"}


def test_replay_prunes_and_skips(spark, tmp_path):
    rows = [{"id": i, "created_utc": 1704067200 + i * 3600, "title": f"t{i}"} for i in range(10)]
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(r) for r in rows] + ["not json"]))
    df = registry.reader(spark, "reddit", {"path": "elsewhere"}, {"path": tmp_path})
    assert df.count() == 10
    late = df.where("ts >= TIMESTAMP_NTZ '2024-01-01 04:00:00' AND ts <= TIMESTAMP_NTZ '2024-01-01 06:00:00'")
    assert sorted(json.loads(r.payload)["id"] for r in late.collect()) == [4, 5, 6]


def test_moments():
    assert replay.moment(1704067200000, "epoch") == replay.moment(1704067200, "epoch") == dt.datetime(2024, 1, 1)
    assert replay.moment("2024-01-01T08:00:00+08:00", "iso") == dt.datetime(2024, 1, 1)
    assert replay.moment("soon", "iso") is None and replay.moment(None, "epoch") is None


def test_tolerant_and_strict_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1}')
    (tmp_path / "b.json").write_text("{broken")
    assert lake.tolerant_json(spark, str(tmp_path)).count() == 1
    good, bad = lake.split_bad(spark, str(tmp_path), "id bigint")
    assert good.cache().count() == 1 and bad.cache().count() == 1
    with pytest.raises(Exception):
        lake.strict_json(spark, str(tmp_path), "id bigint").collect()


def test_signals(spark, tmp_path):
    a, b, c = (tmp_path / n for n in ("a.json", "b.json", "c.json"))
    a.write_text('{"trends": [{"entity": "p", "score": 0.85, "evidence": [{"source": "reddit"}]}]}')
    b.write_text('[{"entity": "q", "score": 0.5}]')
    c.write_text("nothing")
    assert lake.signals(spark, str(a)).first().entity == "p"
    assert lake.signals(spark, str(b)).first().score == 0.5
    assert lake.signals(spark, str(c)).count() == 0
    assert lake.signals(spark, str(tmp_path / "missing.json")).count() == 0
    with pytest.raises(Exception):
        lake.signals(spark, str(tmp_path / "missing.json"), strict=True).collect()


def test_catalogues(spark, tmp_path):
    y = tmp_path / "c.yaml"
    y.write_text("connectors:\n  - name: reddit\n    schedule: hourly\n    kwargs:\n      subreddit: a\n  - name: x\n")
    assert [r.name for r in lake.connector_names(spark, str(y)).collect()] == ["reddit", "x"]
    rows = lake.connectors(spark, str(y)).collect()
    assert rows[0].kwargs == {"subreddit": "a"} and rows[1].schedule is None
    (tmp_path / "s" / "one").mkdir(parents=True)
    (tmp_path / "s" / "one" / "SKILL.md").write_text("---\nname: One\ndescription: >-\n  first\n  second\nmetadata:\n  category: Deep\n---\nbody")
    row = lake.skills(spark, f"{tmp_path}/s/*/SKILL.md").first()
    assert (row.id, row.label, row.description, row.category) == ("one", "One", "first\nsecond", "General")


def test_lake_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([("1", 1704067200, "T", None, "a", 1, 2), ("1", 1704067200, "T", "x", "a", 1, 2)], "id string, created_utc bigint, title string, selftext string, subreddit string, score int, num_comments int")
    lake.write_raw_and_bronze(normalize.reddit(raw, NOW), str(tmp_path))
    got = lake.bronze(spark, str(tmp_path), "reddit", dt.date(2024, 1, 1))
    assert got.count() == 1
    assert lake.bronze(spark, str(tmp_path), since=dt.date(2024, 1, 2)).count() == 0
    assert not lake.write_if_rows(raw.limit(0), str(tmp_path / "none"))


def one(df):
    return df.first().asDict(recursive=True)


def test_normalisers(spark):
    def frame(ddl, *row):
        return spark.createDataFrame([row], ddl)

    r = one(normalize.reddit(frame("id string, created_utc bigint, title string, selftext string, subreddit string, score int, num_comments int", "test1", None, "Test post", "body", "s", 1, 2), NOW))
    assert r["text"] == "Test post\nbody" and r["ts"] == dt.datetime(1970, 1, 1) and r["metadata"]["subreddit"] == "s"
    r = one(normalize.twitter(frame("id string, created_at string, text string, hashtags array<string>, lang string, author_id string, public_metrics string", "1", "2024-01-01T00:00:00Z", "hi", None, "en", "u", "{}"), NOW))
    assert r["ts"] == dt.datetime(2024, 1, 1) and r["entities"] == []
    r = one(normalize.tiktok(frame("id string, create_time string, `desc` string, bio_description string, region_code string, like_count int, share_count int", "1", "x", "", "bio", "MY", 1, 1), NOW))
    assert r["text"] == "bio" and r["ts"] == NOW
    r = one(normalize.threads(frame("id string, created_time string, timestamp string, text string, caption string, permalink_url string, permalink string, type string, media_type string", "1", None, "2024-01-01T00:00:00Z", None, "cap", "", "p", None, "IMAGE"), NOW))
    assert r["text"] == "cap" and r["metadata"] == {"conversation": None, "permalink": "p", "media_type": "IMAGE"}
    r = one(normalize.youtube(frame("id string, publishedAt string, title string, description string, channelTitle string, tags array<string>", "1", "2024-01-01T00:00:00Z", "t", None, "c", ["a"]), NOW))
    assert r["text"] == "t\n" and r["entities"][0]["value"] == "a"
    r = one(normalize.github(frame("id bigint, created_at string, title string, body string, state string, labels array<struct<name:string>>", 7, "2024-01-01T00:00:00Z", "t", "b", "open", [("bug",)]), NOW))
    assert r["source_id"] == "7" and r["entities"][0]["type"] == "label"
    r = one(normalize.stack_overflow(frame("question_id bigint, creation_date bigint, title string, tags array<string>, score int, answer_count int", 1, 0, "t", [], 1, 0), NOW))
    assert r["text"] == "t"
    r = one(normalize.google_trends(frame("date string, data map<string,string>", "2024-01-01", {"k": "5", "isPartial": "false"}), NOW))
    assert r["text"] == "k:5"
    r = one(normalize.hacker_news(frame("id bigint, time bigint, title string, text string, type string, score int", 1, 0, None, "c", "story", 1), NOW))
    assert r["text"] == "" and r["entities"][0]["value"] == "c"
    r = one(normalize.news_rss(frame("id string, link string, title string, summary string, published_parsed array<int>", None, "l", "t", "s", [2024, 1, 1, 0, 0, 0]), NOW))
    assert r["source_id"] == "l" and r["ts"] == dt.datetime(2024, 1, 1)
    r = one(normalize.edgar(frame("url string, html string", "u", "x" * 2000), NOW))
    assert len(r["text"]) == 1000
    r = one(normalize.airtable(frame("id string, fields map<string,string>", "1", {"a": "b"}), NOW))
    assert r["text"] == '{"a":"b"}'
    r = one(normalize.instagram(frame("page_data string", "{}"), NOW, "me"))
    assert r["source_id"] == "me"


def test_window_label_and_lists(spark):
    df = spark.sql("SELECT DATE '2026-04-09' AS d, ' a, ,b ' AS l, ' , ' AS e")
    row = df.select(normalize.window_label(df.d, 7).alias("w"), normalize.split_list(df.l).alias("l"), normalize.split_list(df.e).alias("e")).first()
    assert row.w == "2026.4.2 - 2026.4.9" and row.l == ["a", "b"] and row.e is None
