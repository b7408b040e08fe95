"""A Python data source that replays recorded platform payloads.

Payloads are JSON lines files, one folder for each platform. Each file is one partition.
A time range on ``ts`` is pushed into the reader; what it cannot push stays with Spark.
Rows that do not parse are skipped, as are rows outside the range. This is the plug-in
surface for platforms without a Spark reader; recorded files on shared storage are read by
``ingest.recorded``, and order and limits of a fetch are ``ingest.newest``.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tidemark.session import send_package
from tidemark.sources.registry import TIMES


def moment(value: object, kind: str) -> dt.datetime | None:
    """Naive UTC time of an epoch (seconds or milliseconds) or ISO text; None if it is neither."""
    try:
        if kind == "epoch":
            seconds = float(value)
            return dt.datetime.fromtimestamp(seconds / 1000 if seconds > 1e12 else seconds, dt.UTC).replace(tzinfo=None)
        found = dt.datetime.fromisoformat(str(value))
        return found.astimezone(dt.UTC).replace(tzinfo=None) if found.tzinfo else found
    except (TypeError, ValueError, OverflowError, OSError):
        return None


class File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class ReplayReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.platform = options["path"], options["platform"]
        self.low = self.high = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            value = getattr(f, "value", None)
            naive = value.replace(tzinfo=None) if isinstance(value, dt.datetime) else None
            if getattr(f, "attribute", None) == ("ts",) and naive is not None and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(x for x in (self.low, naive) if x is not None)
            elif getattr(f, "attribute", None) == ("ts",) and naive is not None and isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(x for x in (self.high, naive) if x is not None)
            yield f  # a range only prunes here, so Spark applies every filter once more

    def partitions(self) -> list[InputPartition]:
        return [File(str(p)) for p in sorted(Path(self.folder).glob("*.json*"))]

    def read(self, partition: File) -> Iterator[tuple]:
        column, kind = TIMES.get(self.platform, (None, "iso"))
        with open(partition.path, encoding="utf-8") as lines:
            for line in lines:
                try:
                    payload = json.loads(line)
                except ValueError:
                    continue
                ts = moment(payload.get(column), kind) if column and isinstance(payload, dict) else None
                if ts is not None and ((self.low and ts < self.low) or (self.high and ts > self.high)):
                    continue
                yield self.platform, ts, line.strip()


class Replay(DataSource):
    """``platform, ts, payload``; options: ``path`` (a folder on storage that executors share), ``platform``."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_replay"

    def schema(self) -> str:
        return "platform string, ts timestamp_ntz, payload string"

    def reader(self, schema) -> ReplayReader:
        return ReplayReader(self.options)


def register(spark: SparkSession) -> None:
    send_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Replay)
