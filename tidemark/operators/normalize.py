"""One normaliser for each platform: raw rows to canonical records, with Column functions only."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schema


def text_of(*parts: str) -> Column:
    """Parts joined by line breaks; null parts are empty but keep their break."""
    return F.concat_ws("\n", *(F.coalesce(F.col(p), F.lit("")) for p in parts))


def epoch(column: Column) -> Column:
    """Seconds or milliseconds since 1970 (beyond 1e12: milliseconds)."""
    n = column.cast("double")
    return F.timestamp_seconds(F.when(n > 1e12, n / 1000).otherwise(n))


def entities(values: Column, kind: str) -> Column:
    one = lambda v: F.struct(F.lit(kind).alias("type"), v.cast("string").alias("value"), F.lit(None).cast("double").alias("confidence"))
    return F.coalesce(F.transform(values, one), none())


def none() -> Column:
    return F.expr(f"cast(array() as array<{schema.ENTITY}>)")


def whole(raw: DataFrame) -> Column:
    """The payload as text, for records without a text of their own."""
    return F.col("payload") if "payload" in raw.columns else F.to_json(F.struct("*"))


def record(source: str, source_id: Column, ts: Column, text: Column, now: dt.datetime, found: Column | None = None, language: Column | None = None, **metadata: Column) -> list[Column]:
    items = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    origin = {"connector": F.lit(source), "connector_version": F.lit("1"), "collection_method": F.lit("replay"), "source_url": F.lit(None).cast("string"), "license": F.lit(None).cast("string"), "ingest_ts": F.lit(now).cast("timestamp")}
    return [
        F.lit(source).alias("source"),
        source_id.cast("string").alias("source_id"),
        ts.cast("timestamp").alias("ts"),
        text.alias("text"),
        (language if language is not None else F.lit(None).cast("string")).alias("language"),
        (found if found is not None else none()).alias("entities"),
        (F.create_map(*items) if items else F.expr("cast(map() as map<string,string>)")).alias("metadata"),
        F.struct(*(c.alias(k) for k, c in origin.items())).alias("provenance"),
    ]


def reddit(raw: DataFrame, now: dt.datetime) -> DataFrame:
    c = F.col
    return raw.select(*record("reddit", c("id"), F.timestamp_seconds(F.coalesce("created_utc", F.lit(0))), text_of("title", "selftext"), now, subreddit=c("subreddit"), score=c("score"), num_comments=c("num_comments")))


def twitter(raw: DataFrame, now: dt.datetime) -> DataFrame:
    c = F.col
    return raw.select(*record("twitter", c("id"), F.try_to_timestamp("created_at"), F.coalesce("text", F.lit("")), now, entities(c("hashtags"), "hashtag"), c("lang"), author_id=c("author_id"), public_metrics=c("public_metrics")))


#: What is kept of a video or of a user.
TIKTOK = ("author_name", "region_code", "like_count", "comment_count", "share_count", "follower_count", "following_count", "video_count")


def tiktok(raw: DataFrame, now: dt.datetime) -> DataFrame:
    c = F.col
    filled = lambda n: F.nullif(c(n), F.lit(""))
    ts = F.coalesce(epoch(F.try_to_number(c("create_time").cast("string"), F.lit("9999999999999999"))), F.lit(now).cast("timestamp"))
    return raw.select(*record("tiktok", c("id"), ts, F.coalesce(filled("desc"), filled("bio_description"), whole(raw)), now, **{n: c(n) for n in TIKTOK if n in raw.columns}))


def threads(raw: DataFrame, now: dt.datetime) -> DataFrame:
    c = F.col
    filled = lambda n: F.nullif(c(n), F.lit(""))
    ts = F.coalesce(F.try_to_timestamp(filled("created_time")), F.try_to_timestamp(filled("timestamp")), F.lit(now).cast("timestamp"))
    return raw.select(*record("threads", c("id"), ts, F.coalesce(filled("text"), filled("caption"), whole(raw)), now, conversation=c("conversation") if "conversation" in raw.columns else F.lit(None), permalink=F.coalesce(filled("permalink_url"), filled("permalink")), media_type=F.coalesce(filled("type"), filled("media_type"))))


def youtube(raw: DataFrame, now: dt.datetime) -> DataFrame:
    c = F.col
    return raw.select(*record("youtube", c("id"), F.try_to_timestamp("publishedAt"), text_of("title", "description"), now, entities(c("tags"), "tag"), channel=c("channelTitle")))


def github(raw: DataFrame, now: dt.datetime) -> DataFrame:
    c = F.col
    return raw.select(*record("github", c("id"), F.try_to_timestamp("created_at"), text_of("title", "body"), now, entities(F.transform("labels", lambda x: x["name"]), "label"), state=c("state")))


def stack_overflow(raw: DataFrame, now: dt.datetime) -> DataFrame:
    c = F.col
    return raw.select(*record("stack_overflow", c("question_id"), F.timestamp_seconds("creation_date"), F.coalesce("title", F.lit("")), now, entities(c("tags"), "tag"), score=c("score"), answer_count=c("answer_count")))


def airtable(raw: DataFrame, now: dt.datetime) -> DataFrame:
    return raw.select(*record("airtable", F.col("id"), F.lit(now), F.to_json("fields"), now))


def instagram(raw: DataFrame, now: dt.datetime, username: str = "unknown") -> DataFrame:
    return raw.select(*record("instagram", F.lit(username), F.lit(now), F.col("page_data"), now))


def pairs_text(data: Column, skip: str = "isPartial") -> Column:
    """``key:value`` pairs of a map in one line, without the key ``skip``."""
    kept = F.map_filter(data, lambda k, _: k != skip)
    return F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), " | ")


def google_trends(raw: DataFrame, now: dt.datetime) -> DataFrame:
    return raw.select(*record("google_trends", F.col("date"), F.try_to_timestamp("date"), pairs_text(F.col("data")), now))


def hacker_news(raw: DataFrame, now: dt.datetime) -> DataFrame:
    c = F.col
    return raw.select(*record("hacker_news", c("id"), F.timestamp_seconds("time"), F.coalesce("title", F.lit("")), now, entities(F.array(F.coalesce("text", F.lit(""))), "comment"), type=c("type"), score=c("score")))


def news_rss(raw: DataFrame, now: dt.datetime) -> DataFrame:
    c = F.col
    p = lambda k: F.get("published_parsed", F.lit(k))
    ts = F.coalesce(F.make_timestamp(p(0), p(1), p(2), p(3), p(4), p(5)), F.lit(now).cast("timestamp"))
    return raw.select(*record("news_rss", F.coalesce("id", "link", F.lit("")), ts, text_of("title", "summary"), now, link=c("link")))


def edgar(raw: DataFrame, now: dt.datetime) -> DataFrame:
    c = F.col
    return raw.select(*record("edgar", c("url"), F.lit(now), F.left(F.col("html"), F.lit(1000)), now, url=c("url")))


NORMALIZERS: dict[str, Callable[[DataFrame, dt.datetime], DataFrame]] = {
    "reddit": reddit, "twitter": twitter, "tiktok": tiktok, "threads": threads, "youtube": youtube, "github": github, "stack_overflow": stack_overflow,
    "airtable": airtable, "instagram": instagram, "google_trends": google_trends, "hacker_news": hacker_news, "news_rss": news_rss, "edgar": edgar,
}


def example(raw: DataFrame, now: dt.datetime) -> DataFrame:
    """The synthetic source's normaliser: a post whose title and body are both there."""
    c = F.col
    return raw.select(*record("reddit", c("id"), F.timestamp_seconds(F.coalesce("created_utc", F.lit(0))), F.concat("title", F.lit("\n"), "selftext"), now, subreddit=c("subreddit")))


def bronze_rows(raw: DataFrame) -> DataFrame:
    """Raw posts to the four bronze columns; only an absent subreddit takes the default."""
    source = F.col("subreddit") if "subreddit" in raw.columns else F.lit("reddit")
    return raw.select(source.alias("source"), F.col("id").cast("string").alias("source_id"), F.col("created_utc").cast("long").alias("timestamp"), text_of("title", "selftext").alias("text"))


def window_label(day: Column, days: int) -> Column:
    """``2026.4.2 - 2026.4.9``: a window of natural days that ends on ``day``."""
    return F.concat(F.date_format(F.date_sub(day, days), "yyyy.M.d"), F.lit(" - "), F.date_format(day, "yyyy.M.d"))


def split_list(column: Column) -> Column:
    """Comma-separated values, trimmed; empty ones go, and nothing left is null."""
    found = F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(found) > 0, found)
