"""Entity features: mention counts, the merged feature table, and change over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_filled(*columns: Column | str, default: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns), F.lit(default))


def mentions(events: DataFrame) -> DataFrame:
    """Event rows as mentions: ``id, entity, source, ts, score``."""
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity"),
        F.col("event_type").alias("source"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("score"),
    )


def mention_counts(rows: DataFrame, key: Column | str = "entity") -> DataFrame:
    """Mentions of each entity in this run, and their number as the score."""
    named = rows.withColumn("entity", F.col(key) if isinstance(key, str) else key)
    return named.groupBy("entity").agg(F.count(F.lit(1)).alias("mention_count")).withColumn("score", F.col("mention_count").cast("double"))


def latest_features(rows: DataFrame) -> DataFrame:
    """``entity, latest_score, mention_count, updated_at``: the latest score and the number of mentions."""
    return rows.groupBy("entity").agg(
        F.max_by("score", F.struct("ts", "id")).alias("latest_score"), F.count(F.lit(1)).alias("mention_count"), F.max("ts").alias("updated_at")
    )


def merge_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: the later row sets score and time, counts add up; on a tie ``new`` wins.

    ``new`` must be a delta that was not merged before.
    """
    both = old.withColumn("gen", F.lit(0)).unionByName(new.withColumn("gen", F.lit(1)))
    return both.groupBy("entity").agg(
        F.max_by("latest_score", F.struct("updated_at", "gen")).alias("latest_score"),
        F.sum("mention_count").alias("mention_count"),
        F.max("updated_at").alias("updated_at"),
    )


def evidence_item() -> Column:
    return F.struct(
        F.col("source"),
        F.concat(F.lit("lake://bronze/source="), "source").alias("s3_uri"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.concat(F.col("n").cast("string"), F.lit(" mentions")).alias("note"),
    )


def evidence(rows: DataFrame) -> DataFrame:
    """``entity, evidence``: the latest mention of each source, sources in order."""
    per_source = rows.groupBy("entity", "source").agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"))
    return per_source.groupBy("entity").agg(F.array_sort(F.collect_list(evidence_item())).alias("evidence"))


def with_evidence(rows: DataFrame) -> DataFrame:
    """Latest features and evidence together: one scan, summed by source before it is rolled up by entity."""
    at = F.struct("ts", "id")
    per_source = rows.groupBy("entity", "source").agg(F.max_by("score", at).alias("score"), F.max(at).alias("at"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"))
    return per_source.groupBy("entity").agg(
        F.max_by("score", "at").alias("latest_score"), F.sum("n").alias("mention_count"), F.max("ts").alias("updated_at"), F.array_sort(F.collect_list(evidence_item())).alias("evidence")
    )


def per_day(rows: DataFrame, by: str = "entity") -> DataFrame:
    return rows.groupBy(by, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def velocity(counts: DataFrame, by: str = "entity") -> DataFrame:
    """First and second difference of a count series and its relative change.

    The change is null where the previous count is zero or missing.
    """
    w = W.partitionBy(by).orderBy("day")
    return (
        counts.withColumn("previous", F.lag("n").over(w))
        .withColumn("velocity", F.col("n") - F.col("previous"))
        .withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(w))
        .withColumn("pct_change", F.try_divide((F.col("n") - F.col("previous")).cast("double"), F.col("previous").cast("double")))
    )


def momentum(counts: DataFrame, k: int, by: str = "entity") -> DataFrame:
    """Mean of the last ``k`` counts against that of the ``k`` before; null until both are full."""
    w = W.partitionBy(by).orderBy("day")
    now, then = w.rowsBetween(-k + 1, 0), w.rowsBetween(-2 * k + 1, -k)
    full = F.count(F.lit(1)).over(w.rowsBetween(-2 * k + 1, 0)) == 2 * k
    return counts.withColumn("momentum", F.when(full, F.try_divide(F.avg("n").over(now), F.avg("n").over(then)) - 1))


def z_scores(counts: DataFrame, back: int = 20, by: str = "entity", value: str = "n") -> DataFrame:
    """Distance of a value from the mean of the ``back`` values before it, in their standard deviations."""
    w = W.partitionBy(by).orderBy("day").rowsBetween(-back, -1)
    return counts.withColumn("z", F.try_divide(F.col(value) - F.avg(value).over(w), F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))))
