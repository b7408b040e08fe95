"""Hourly counts that stay right when rows come late.

Closed hours are partitions. A row behind the watermark whose hour is closed goes to a side table as
well; a backfill recomputes just the hours of these rows, by dynamic partition overwrite. All
tables are written by batch number, so a replayed batch overwrites its own part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.session import dropped

HOURS = "event_type string, n bigint, total double, start timestamp, day date"
MARKS = "mark timestamp, batch bigint"


def _hours(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day", "start", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def _put(rows: DataFrame, path: str) -> None:
    """Overwrite the hours that ``rows`` has, and no others."""
    rows.withColumn("hour", F.hour("start")).repartition("day", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "hour").parquet(path)


def _of(spark: SparkSession, root: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).parquet(root)


def _pruned(rows: DataFrame, days: list) -> DataFrame:
    """Rows of some days, so that only their folders are read."""
    return rows.where(F.col("day").isin(days))


def mark(spark: SparkSession, root: str, before: int | None = None):
    """The watermark after the batches before ``before``, None if there was none."""
    marks = _of(spark, f"{root}/marks", MARKS)
    return marks.where(F.col("batch") < before if before is not None else F.lit(True)).agg(F.max("mark")).first()[0]


def keep_hours(events: DataFrame, root: str, checkpoint: str, delay: str = "10 minutes") -> StreamingQuery:
    """Keep ``root/rows``, ``root/hours`` (closed hours) and ``root/late``; an hour closes when the watermark passes its end."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields if f.name != "ts") + ", ts timestamp, start timestamp, day date, batch bigint"

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = mark(spark, root, number) if number else None
        rows = batch.withColumn("ts", F.col("ts").cast("timestamp")).where("ts IS NOT NULL")
        rows = rows.withColumn("start", F.date_trunc("hour", "ts")).withColumn("day", F.to_date("start")).withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{root}/rows")
        end = F.col("start") + F.expr("INTERVAL 1 HOUR")
        late = rows.where(end <= F.lit(old)) if old is not None else rows.where("false")
        late.drop("batch").write.mode("overwrite").parquet(f"{root}/late/batch={number}")
        seen = rows.agg((F.max("ts") - F.expr(f"INTERVAL {delay}")).alias("mark")).first().mark
        new = max((m for m in (old, seen) if m is not None), default=None)
        spark.createDataFrame([(new,)], "mark timestamp").coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/batch={number}")
        if new is None or new == old:
            return
        closing = (end <= F.lit(new)) & (end > F.lit(old) if old is not None else F.lit(True))
        days = (F.col("day") <= F.to_date(F.lit(new))) & (F.col("day") >= F.date_sub(F.to_date(F.lit(old)), 1) if old is not None else F.lit(True))
        _put(_hours(_of(spark, f"{root}/rows", ddl).where(days & closing)), f"{root}/hours")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hours(spark: SparkSession, root: str) -> DataFrame:
    """Closed hours: ``start, event_type, n, total, day``."""
    return _of(spark, f"{root}/hours", HOURS)


def backfill(spark: SparkSession, root: str, schema: str) -> int:
    """Recompute the closed hours that late rows belong to, from all rows of their days; how many hours.

    ``schema``: DDL of the events. Run it while no batch is written; stopped half-way it can be run again.
    """
    late = _of(spark, f"{root}/late", "ts timestamp, start timestamp, day date, batch bigint")
    touched = late.select("day", "start").distinct()
    days = [r.day for r in touched.select("day").distinct().collect()]  # partitions, not rows
    if not days:
        return 0
    folders = [r.batch for r in late.select("batch").distinct().collect()]
    rows = _pruned(_of(spark, f"{root}/rows", f"{schema}, start timestamp, day date, batch bigint"), days)
    _put(_hours(rows.join(touched, ["day", "start"], "left_semi")), f"{root}/hours")
    n = touched.count()
    for b in folders:
        dropped(spark, f"{root}/late/batch={b}")
    return n
