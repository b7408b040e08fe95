"""Alert rules over features; every threshold is a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import velocity, z_scores
from tidemark.operators.hygiene import top_per_group


def above_threshold(signals: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Signals whose score reaches the threshold; a missing score is 0."""
    return signals.where(F.coalesce(F.col("score").cast("double"), F.lit(0.0)) >= threshold)


def jumps(counts: DataFrame, least: float = 3.0) -> DataFrame:
    """Days on which a count rose by ``least`` times the day before (3.0: by 300 %)."""
    return velocity(counts).where(F.col("pct_change") >= least)


def outliers(counts: DataFrame, least: float = 2.5, back: int = 20) -> DataFrame:
    return z_scores(counts, back).where(F.abs("z") >= least)


def rules(features: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Subscriptions (``rule_id, entity`` or null for all, ``threshold``) joined with the features they fire on.

    Rules that name an entity are an equi-join, however many there are. Rules for all
    entities meet all of them by contract: their result has a row for each entity and rule.
    """
    f, fires = features.select("entity", "latest_score"), F.col("latest_score") >= F.col("threshold")
    named = f.join(subscriptions.where("entity IS NOT NULL"), "entity").where(fires)
    for_all = f.join(subscriptions.where("entity IS NULL").drop("entity"), fires)
    return named.unionByName(for_all).select("rule_id", "entity", "latest_score", "threshold")


def digest(fired: DataFrame, by: str = "rule_id", most: int = 5) -> DataFrame:
    """One row for each rule: how many alerts, the highest score, and the first ``most`` entities by score."""
    top = top_per_group(fired, by, [F.desc("latest_score"), F.col("entity")], most)
    named = top.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda x: x["entity"]).alias("entities"))
    return fired.groupBy(by).agg(F.count(F.lit(1)).alias("alerts"), F.max("latest_score").alias("highest")).join(named, by)
