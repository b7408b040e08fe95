"""Scalar helpers as Column functions: times, numbers, URLs, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def compact_day(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def local_minutes(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """Shown in a zone to the minute."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), zone), "yyyy-MM-dd HH:mm")


def whole_or_fraction(x: Column) -> Column:
    """A number as text: without a fraction if it is whole."""
    return F.when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(x.cast("double").cast("string"))


def clamp(x: Column, low: int, high: int, default: int) -> Column:
    return F.least(F.greatest(F.coalesce(x, F.lit(default)), F.lit(low)), F.lit(high))


def host(url: Column) -> Column:
    return F.parse_url(url, F.lit("HOST"))


def encoded(text: Column) -> Column:
    """Percent-encoded for a query string."""
    return F.url_encode(text)


def plain_numbers(values: Column) -> Column:
    """Numbers of a map as text, recursively through nested lists of a JSON value: whole ones without a fraction."""
    return F.regexp_replace(values, r"(?<=[\[,:{ ])(-?[0-9]+)\.0+(?=[\],} ]|$)", "$1")


def tickers(text: Column) -> Column:
    """Cash-tagged tickers, in order, once each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$([A-Z]{1,6})\b"), F.lit(1)))


def hashtags(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"#([\p{L}\p{N}_]+)"), F.lit(1)))


def lexicon_score(text: Column, positive: list[str], negative: list[str]) -> Column:
    """Positive minus negative words over all words; null without words."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    count = lambda names: F.size(F.filter(words, lambda w: w.isin(*names))).cast("double")
    return F.try_divide(count(positive) - count(negative), F.size(words).cast("double"))
