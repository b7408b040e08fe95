"""Trend serving: top-k, nested filters after the top-k, detail, timeline, dashboard.

The order matters and is kept: top-k first, then the filters, then the limit again.
Ties are broken by the entity's name.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 100


def checked_limit(limit: int) -> int:
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must lie between 1 and {MOST}")
    return limit


def top_features(features: DataFrame, limit: int = 10) -> DataFrame:
    return features.orderBy(F.coalesce("latest_score", F.lit(0.0)).desc(), "entity").limit(checked_limit(limit))


def as_trends(items: DataFrame) -> DataFrame:
    """Served rows of feature items; absent columns and nulls take their defaults."""
    has = set(items.columns)
    pick = lambda *names: [F.col(n) for n in names if n in has]
    text = lambda c: F.nullif(c.cast("string"), F.lit(""))
    times = [text(c) for c in pick("updated_at", "ts")]
    no_evidence = F.expr("cast(array() as array<struct<source:string,s3_uri:string,ts:string,note:string>>)")
    return items.select(
        F.coalesce(*pick("entity"), F.lit("unknown")).alias("entity"),
        F.coalesce(*pick("latest_score", "score"), F.lit(0)).cast("double").alias("score"),
        F.coalesce(*pick("mention_count"), F.lit(0)).cast("long").alias("mention_count"),
        F.coalesce(*pick("evidence"), no_evidence).alias("evidence"),
        (F.coalesce(*times) if times else F.lit(None).cast("string")).alias("last_seen"),
    )


def from_source(trends: DataFrame, source: str | None) -> DataFrame:
    return trends.where(F.exists("evidence", lambda e: e["source"] == source)) if source else trends


def matching(trends: DataFrame, query: str | None) -> DataFrame:
    """Entity or a source of its evidence contains the query, whatever the case; no wildcards."""
    if not query:
        return trends
    q = F.lit(query.lower())
    in_evidence = F.exists("evidence", lambda e: F.lower(F.coalesce(e["source"], F.lit(""))).contains(q))
    return trends.where(F.lower("entity").contains(q) | F.coalesce(in_evidence, F.lit(False)))


def trends(features: DataFrame, limit: int = 10, source: str | None = None, query: str | None = None, fallback: DataFrame | None = None) -> DataFrame:
    """The served trends; ``fallback`` (in its own order) answers when there are no features."""
    top = top_features(features, limit)
    if fallback is not None and features.isEmpty():
        top = fallback
    return matching(from_source(as_trends(top), source), query).limit(limit)


def detail(features: DataFrame, entity: str) -> DataFrame:
    """The entity's row if it is among the first 100."""
    return trends(features, MOST).where(F.col("entity") == entity).limit(1)


def timeline(rows: DataFrame, now: dt.datetime, days: int = 7, digits: int | None = 3) -> DataFrame:
    """``entity, idx, date, value``: a rise from 65 % to the whole score over ``days`` days."""
    span = max(days - 1, 1)
    idx = F.col("idx")
    value = F.greatest(F.lit(0.0), F.col("score") * (F.lit(0.65) + idx / F.lit(float(span)) * F.lit(0.35)))
    value = value if digits is None else F.round(value, digits)
    moment = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days - 1) - idx)
    return rows.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).select(
        "entity", idx.cast("long").alias("idx"), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), value.alias("value")
    )


def chart_series(served: DataFrame) -> DataFrame:
    """Both chart series in long form: ``entity, series, value``."""
    return served.select(
        "entity", F.explode(F.create_map(F.lit("score"), F.col("score"), F.lit("mention_count"), F.col("mention_count").cast("double"))).alias("series", "value")
    )


def dashboard(served: DataFrame, platforms: DataFrame, store: str = "unknown") -> DataFrame:
    """One row with the whole dashboard document."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("by"), "entity", "score", "mention_count", "evidence", "last_seen")))
    own = served.agg(ranked.alias("t"))
    part = lambda *names: F.transform("t", lambda x: F.struct(*(x[n].alias(n) for n in names)))
    return own.crossJoin(platforms.agg(F.count(F.lit(1)).alias("platform_count"))).select(
        part("entity", "score", "mention_count", "evidence", "last_seen").alias("top_trends"),
        F.size("t").cast("long").alias("signal_count"),
        "platform_count",
        F.lit(store).alias("feature_store"),
        part("entity", "score").alias("score_breakdown"),
        part("entity", "mention_count").alias("mention_breakdown"),
    )


def table_cells(served: DataFrame) -> DataFrame:
    """What the page shows: two decimals, number of evidence items, n/a without a time."""
    return served.select(
        "entity", F.format_string("%.2f", "score").alias("score_text"), F.coalesce(F.size("evidence"), F.lit(0)).cast("long").alias("evidence_count"), F.coalesce("last_seen", F.lit("n/a")).alias("last_seen")
    )


def label(name: Column | str) -> Column:
    return F.initcap(F.replace(F.col(name) if isinstance(name, str) else name, F.lit("_"), F.lit(" ")))


def platform_statuses(platforms: DataFrame, now: dt.datetime) -> DataFrame:
    return platforms.select(
        "name",
        label("name").alias("label"),
        F.lit("Healthy").alias("status"),
        F.coalesce("schedule", F.lit("unknown")).alias("schedule"),
        F.coalesce("execution", F.lit("unknown")).alias("execution"),
        F.lit(now.isoformat() + "Z").alias("last_run"),
        F.lit("n/a").alias("items_ingested"),
    )


def pipeline_statuses(platforms: DataFrame, now: dt.datetime) -> DataFrame:
    moment = F.lit(now.isoformat() + "Z")
    return platforms.select(F.concat(F.lit("ingest_"), "name").alias("dag_id"), F.lit("scheduled").alias("status"), moment.alias("last_run"), moment.alias("next_run"))
