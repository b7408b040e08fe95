"""Runs by schedule: a streaming data source whose offset is the end of the last run.

Every micro-batch is the stretch of time since then, cut into windows of ``every``; each window is one
ingest run. The end is kept in the stream's checkpoint, so runs neither overlap nor leave gaps,
and a run that was killed is taken up again with the same windows and overwrites what it had written.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

from tidemark.session import send_package
from tidemark.sources import ingest

FORMAT = "tidemark_schedule"


class Stretch(InputPartition):
    def __init__(self, start: str, end: str) -> None:
        self.start, self.end = start, end


class ScheduleReader(DataSourceStreamReader):
    """Offsets are ``{"end": ISO time}``; options ``start``, ``until`` (default now) and ``every`` (seconds)."""

    def __init__(self, options: dict) -> None:
        self.start = dt.datetime.fromisoformat(options["start"])
        self.until = dt.datetime.fromisoformat(options["until"]) if "until" in options else dt.datetime.now(dt.UTC).replace(tzinfo=None)
        self.every = dt.timedelta(seconds=int(options.get("every", 3600)))

    def initialOffset(self) -> dict:
        return {"end": self.start.isoformat()}

    def latestOffset(self) -> dict:
        """The last whole window that is over."""
        whole = max(0, (self.until - self.start) // self.every)
        return {"end": (self.start + whole * self.every).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if dt.datetime.fromisoformat(end["end"]) < dt.datetime.fromisoformat(start["end"]):
            raise ValueError(f"the clock went back from {start['end']} to {end['end']}")
        return [Stretch(start["end"], end["end"])] if start != end else []

    def read(self, partition: Stretch) -> Iterator[tuple]:
        at, end = dt.datetime.fromisoformat(partition.start), dt.datetime.fromisoformat(partition.end)
        while at < end:
            yield at, min(at + self.every, end)
            at += self.every


class Schedule(DataSource):
    """``window_start, window_end``: windows that are over and that no earlier run had, the start not included."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "window_start timestamp_ntz, window_end timestamp_ntz"

    def streamReader(self, schema) -> ScheduleReader:
        return ScheduleReader(self.options)


def windows(spark: SparkSession, start: dt.datetime, until: dt.datetime | None = None, every: dt.timedelta = dt.timedelta(hours=1)) -> DataFrame:
    send_package(spark)
    spark.dataSource.register(Schedule)
    options = {"start": start.isoformat(), "every": str(int(every.total_seconds())), **({"until": until.isoformat()} if until else {})}
    return spark.readStream.format(FORMAT).options(**options).load()


def follow(spark: SparkSession, catalogue: DataFrame, folder: str, root: str, checkpoint: str, start: dt.datetime, until: dt.datetime | None = None, every: dt.timedelta = dt.timedelta(hours=1), **how) -> StreamingQuery:
    """Ingest every window that is over and was not ingested yet into the lake ``root``; metrics go to ``root/metrics``, by batch.

    Rows are stored by the window they came in (a folder ``run``). A record that was published exactly at a
    window's end belongs to it and not to the next.
    """

    def run(batch: DataFrame, number: int) -> None:
        done = None
        for w in batch.orderBy("window_start").collect():  # windows since the last run, not records
            label = w.window_end.strftime("%Y%m%dT%H%M%S")
            found = ingest.ingest(batch.sparkSession, catalogue, folder, root, w.window_end, w.window_start, run=label, **how).withColumn("window_end", F.lit(w.window_end))
            done = found if done is None else done.unionByName(found)
        if done is not None:
            done.write.mode("overwrite").parquet(f"{root}/metrics/batch={number}")

    return windows(spark, start, until, every).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
