"""News and community search over recorded items: keyword, kind, language, order, size, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds of news and orders of a search.
KINDS = {1: "news", 2: "notice", 3: "research"}
SORTS = {1: "popularity", 2: "publish_time", 3: "attention"}


def clamped(size: int | None, default: int, low: int, high: int) -> int:
    """A size between ``low`` and ``high``; below 1 is an error, none is the default."""
    if size is None:
        return default
    if size < 1:
        raise ValueError("size must be positive")
    return min(max(size, low), high)


def matches(keyword: str, *columns: str) -> Column:
    """The keyword is part of one of the columns, whatever the case; no wildcards."""
    if not keyword.strip():
        raise ValueError("keyword must not be empty")
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(keyword.strip().lower()), F.lit(False))
    return found


def news(items: DataFrame, keyword: str, size: int | None = None, news_type: int | None = 1, lang: str | None = None, sort_type: int = 2) -> DataFrame:
    """The first ``size`` items (10 unless given, 50 at most) by popularity, time or attention, ties by id.

    ``items``: ``news_id, news_type, title, lang, publish_time, popularity, attention, ...``
    """
    if news_type is not None and news_type not in KINDS or sort_type not in SORTS:
        raise ValueError("no such kind or order")
    found = items.where(matches(keyword, "title"))
    if news_type is not None:
        found = found.where(F.col("news_type") == news_type)
    if lang:
        found = found.where(F.col("lang") == lang)
    return found.orderBy(F.col(SORTS[sort_type]).desc_nulls_last(), "news_id").limit(clamped(size, 10, 1, 50))


def feed(posts: DataFrame, symbols: list[str], size: int | None = None) -> DataFrame:
    """The newest ``size`` posts of each symbol (30 unless given, between 1 and 50), newest first."""
    own = posts.where(F.col("symbol").isin(list(dict.fromkeys(symbols))))
    newest = W.partitionBy("symbol").orderBy(F.col("publish_time").desc_nulls_last(), "id")
    ranked = own.withColumn("position", F.row_number().over(newest).cast("long"))
    return ranked.where(F.col("position") <= clamped(size, 30, 1, 50))


def page(rows: DataFrame, order: list[Column], size: int, number: int = 0) -> DataFrame:
    """One page by offset: rows ``number * size`` and after, in a total order."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def after(rows: DataFrame, key: str, cursor: object | None, size: int) -> DataFrame:
    """One page by cursor: the rows behind the last key that was seen; no earlier row is read again."""
    rest = rows if cursor is None else rows.where(F.col(key) > F.lit(cursor))
    return rest.orderBy(key).limit(size)


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON records, nested columns included."""
    return rows.select(F.to_json(F.struct("*")).alias("record"))
