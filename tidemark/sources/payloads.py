"""Recorded platform payloads: JSON text to the columns that the normalisers read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.normalize import epoch
from tidemark.sources.registry import TIMES

#: The fields of each platform's payload that are read.
SCHEMAS = {
    "reddit": "id string, created_utc double, title string, selftext string, subreddit string, score bigint, num_comments bigint, url string",
    "twitter": "id string, text string, created_at string, author_id string, lang string, public_metrics string, entities struct<hashtags:array<struct<tag:string>>>",
    "tiktok": "id string, create_time string, desc string, bio_description string, author_name string, region_code string, like_count bigint, comment_count bigint, share_count bigint, follower_count bigint, following_count bigint, video_count bigint",
    "threads": "id string, text string, caption string, created_time string, timestamp string, conversation string, permalink_url string, permalink string, type string, media struct<type:string>",
    "youtube": "id string, publishedAt string, title string, description string, channelTitle string, tags array<string>",
    "github": "id bigint, title string, body string, created_at string, state string, labels array<struct<name:string>>",
    "stack_overflow": "question_id bigint, creation_date bigint, title string, tags array<string>, score bigint, answer_count bigint",
    "airtable": "id string, fields map<string,string>",
    "instagram": "page_data string",
    "google_trends": "date string, data map<string,string>",
    "hacker_news": "id bigint, time bigint, title string, text string, type string, score bigint",
    "news_rss": "id string, link string, title string, summary string, published_parsed array<int>",
    "edgar": "html string, url string",
}
#: Columns that a normaliser reads and a payload holds deeper down.
DERIVED = {
    "twitter": {"hashtags": "entities.hashtags.tag"},
    "threads": {"media_type": "media.type"},
}


def parsed(raw: DataFrame, name: str) -> DataFrame:
    """Rows of ``payload`` with the platform's fields as columns, ``payload`` among them."""
    rows = raw.select(F.from_json("payload", SCHEMAS[name]).alias("p"), "payload").select("p.*", "payload")
    return rows.withColumns({k: F.col(path) for k, path in DERIVED.get(name, {}).items()})


def payload_time(name: str) -> Column:
    """When a parsed payload was published; null for platforms without times and for broken ones."""
    column, kind = TIMES.get(name, (None, ""))
    if column is None:
        return F.lit(None).cast("timestamp")
    return epoch(F.col(column).try_cast("double")) if kind == "epoch" else F.try_to_timestamp(F.col(column))
