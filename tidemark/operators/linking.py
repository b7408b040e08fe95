"""Joins: ordered lookups, aliases, misses, as-of alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lookup_in_order(ids: DataFrame, items: DataFrame, key: str, position: str = "position") -> DataFrame:
    """Items of a list of ids, in the order of the list."""
    return ids.join(items, key).orderBy(position)


def misses(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.join(known, key, "left_anti")


def labelled(rows: DataFrame, dimension: DataFrame, key: str, label: str) -> DataFrame:
    """The dimension's label, or the key itself where there is none."""
    return rows.join(dimension.select(key, label), key, "left").withColumn(label, F.coalesce(label, key))


def resolve_aliases(rows: DataFrame, aliases: DataFrame, name: str = "name") -> DataFrame:
    """Canonical code of a name, whatever its case; ``ambiguous`` where an alias has several codes."""
    known = aliases.groupBy(F.lower("alias").alias("alias_")).agg(F.min("code").alias("code"), (F.count_distinct("code") > 1).alias("ambiguous"))
    return rows.join(known, F.lower(name) == F.col("alias_"), "left").drop("alias_").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def as_of(left: DataFrame, right: DataFrame, by: str, ts: str, order: str, value: str, out: str, width: str = "day") -> DataFrame:
    """The latest ``value`` of ``right`` at or before each row of ``left``.

    Both sides are dealt by key and time bucket (``width``), so a hot key is many tasks; a
    bucket's last value is carried to the buckets after it. No rows are multiplied.
    ``order`` breaks ties among the rows of ``right``.
    """
    bucket = F.date_trunc(width, ts)
    l = left.withColumns({"side_": F.lit(1), "seen_": F.lit(None).cast(right.schema[value].dataType), "tie_": F.lit(None).cast(right.schema[order].dataType)})
    r = right.select(F.col(by), F.col(ts), F.lit(0).alias("side_"), F.col(value).alias("seen_"), F.col(order).alias("tie_"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("bucket_", bucket)
    within_ = W.partitionBy(by, "bucket_").orderBy(ts, "side_", "tie_").rowsBetween(W.unboundedPreceding, 0)
    ends = both.groupBy(by, "bucket_").agg(F.max_by("seen_", F.when(F.col("side_") == 0, F.struct(ts, "tie_"))).alias("end_"))
    before = W.partitionBy(by).orderBy("bucket_").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.withColumn("carried_", F.last("end_", ignorenulls=True).over(before)).drop("end_")
    seen = both.withColumn("in_", F.last("seen_", ignorenulls=True).over(within_)).where("side_ = 1").join(carried, [by, "bucket_"], "left")
    return seen.withColumn(out, F.coalesce("in_", "carried_")).drop("side_", "seen_", "tie_", "bucket_", "in_", "carried_")


def within(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, minutes: int) -> DataFrame:
    """Pairs of the same key at most ``minutes`` apart: an equi-join on time buckets, each left row in three of them."""
    width = minutes * 60
    bucket = lambda c: F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / width)
    l = left.withColumn("bucket_", F.explode(F.array(*(bucket(left_ts) + k for k in (-1, 0, 1)))))
    r = right.withColumn("bucket_", bucket(right_ts))
    apart: Column = F.abs(F.unix_timestamp(F.col(left_ts).cast("timestamp")) - F.unix_timestamp(F.col(right_ts).cast("timestamp")))
    return l.join(r, [by, "bucket_"]).where(apart <= width).drop("bucket_")
