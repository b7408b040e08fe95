"""One ingest run: catalogue, recorded payloads, normalisers, the lake, and its metrics."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.hygiene import first_non_empty
from tidemark.operators.normalize import NORMALIZERS
from tidemark.sources import lake
from tidemark.sources.payloads import parsed, payload_time
from tidemark.sources.registry import FETCH_LIMITS, platform
from tidemark.sources.sink import deliver

#: Platforms that are asked for a time range; one that is filtered after its newest rows were taken.
RANGED, RESIDUAL = ("twitter", "tiktok", "youtube", "github", "stack_overflow"), ("reddit",)
#: Platforms of which only entries with this attribute count.
NEEDED = {"news_rss": "published_parsed"}
METRICS = "connector string, ok boolean, items bigint, latency_s double, error string"


def newest(rows: DataFrame, limit: int, skip: int = 0) -> DataFrame:
    """The ``limit`` newest rows over all files, after ``skip`` of them."""
    ordered = rows.orderBy(F.col("ts_").desc_nulls_last(), "payload")
    return (ordered.offset(skip) if skip else ordered).limit(limit)


def fetch(lines: DataFrame, name: str, start: dt.datetime, end: dt.datetime, limit: int | None = None, skip: int = 0, after: bool = False) -> DataFrame:
    """Parsed payloads of one fetch; ``lines`` has a column ``payload``, one JSON object each.

    Newest first, one limit for the whole fetch; lines that do not parse are skipped. The
    range (both ends included, with ``after`` without its start) is applied before the limit where the platform is asked for
    it, after it where the platform is not, and not at all where records have no times.
    """
    rows = parsed(lines.where(F.try_parse_json("payload").isNotNull()), name).withColumn("ts_", payload_time(name))
    inside = F.col("ts_").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    if after:
        inside = inside & (F.col("ts_") > F.lit(start).cast("timestamp"))
    if name in NEEDED:
        rows = rows.where(F.col(NEEDED[name]).isNotNull())
    if name in RANGED:
        rows = rows.where(inside)
    most = FETCH_LIMITS.get(name) if limit is None else limit
    rows = newest(rows, most, skip) if most else rows
    return (rows.where(inside) if name in RESIDUAL else rows).drop("ts_")


def recorded(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of a folder on any storage that Spark reads."""
    return spark.read.text(folder).select(F.col("value").alias("payload"))


def _ids(spark: SparkSession, path: str) -> DataFrame | None:
    """``position, id`` of a recorded list of ids, one JSON array; None if there is none."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return None
    return text.select(F.posexplode(F.from_json("value", "array<bigint>")).alias("position", "id"))


def listed(ids: DataFrame, items: DataFrame, most: int = 50, ident: str = "id") -> DataFrame:
    """The items of the first ``most`` ids of a list (``position, id``), in list order; ids without an item are left out."""
    head = ids.orderBy("position").limit(most).select(F.col("position"), F.col("id").alias("id_"))
    return items.join(F.broadcast(head), items[ident] == F.col("id_")).drop("id_").orderBy("position")  # at most ``most`` rows


#: Where else a platform's payloads are looked for, if its first endpoint has none; the list of ids of one that is asked item by item.
FALLBACKS = {"threads": ["threads_media"]}
LISTS = {"hacker_news": "hacker_news_ids"}


def endpoint(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Recorded payloads of a platform's first endpoint that has any; an error if no endpoint is there."""
    tried = []
    for at in (name, *FALLBACKS.get(name, [])):
        try:
            tried.append(recorded(spark, f"{folder}/{at}"))
        except AnalysisException:
            continue
    if not tried:
        raise FileNotFoundError(f"{folder}/{name}")
    return first_non_empty(*tried)


def examples(subreddits: DataFrame, start: dt.datetime) -> DataFrame:
    """The synthetic source for each row of ``subreddit``: one fixed record at the start of the run."""
    seconds = int(start.replace(tzinfo=dt.UTC).timestamp())
    fields = F.struct(F.lit("test1").alias("id"), F.lit(seconds).alias("created_utc"), F.lit("Test post").alias("title"), F.lit("This is a synthetic test post").alias("selftext"), "subreddit")
    return parsed(subreddits.select(F.to_json(fields).alias("payload")), "reddit")


def example(spark: SparkSession, start: dt.datetime, subreddit: str = "example") -> DataFrame:
    return examples(spark.createDataFrame([(subreddit,)], "subreddit string"), start)


def chosen(catalogue: DataFrame, names: list[str] | None = None, execution: str | None = None) -> list[dict]:
    """The catalogue's rows (a page of configuration) with one of the names, whatever the case, and that execution."""
    rows = catalogue
    if names:
        rows = rows.where(F.lower("name").isin([n.lower() for n in set(names)]))
    if execution:
        rows = rows.where(F.col("execution") == execution)
    found = [r.asDict(recursive=True) for r in rows.collect()]
    if not found:
        raise ValueError("no connector is configured for this run")
    return found


#: What takes a run's records, normalised and as they came, and says how many there were.
Store = Callable[[DataFrame, DataFrame], int]


def in_lake(root: str, run: str | None = None) -> Store:
    """Both copies in the lake; with ``run`` a repeated run overwrites its own rows."""

    def keep(records: DataFrame, payloads: DataFrame) -> int:
        seen = Observation()
        lake.write_raw_and_bronze(records.observe(seen, F.count(F.lit(1)).alias("items")), root, payloads=payloads, run=run)
        return int(seen.get["items"])

    return keep


def to_sink(kind: str, journal: Callable[[], str], target: str = "", **options) -> Store:
    """Records to the console, files or a webhook; ``journal`` makes a new folder for each connector's job."""

    def keep(records: DataFrame, payloads: DataFrame) -> int:
        return deliver(records, kind, journal(), target, **options).where("status = 'delivered'").count()

    return keep


def shown(show: Callable) -> Store:
    """Each record to a function on the driver, one at a time."""

    def keep(records: DataFrame, payloads: DataFrame) -> int:
        items = 0
        for items, r in enumerate(records.toLocalIterator(), 1):  # noqa: B007
            show(r)
        return items

    return keep


def ingest(spark: SparkSession, catalogue: DataFrame, folder: str, root: str | None, end: dt.datetime, start: dt.datetime | None = None, names: list[str] | None = None, overrides: dict | None = None, now: dt.datetime | None = None, show: Callable = print, store: Store | None = None, run: str | None = None) -> DataFrame:
    """Run the catalogue's connectors over ``[start, end]`` (default: the last hour): one row of metrics each.

    ``folder`` has one folder of recorded payloads for each connector. Records go to ``store``, else to
    the lake ``root``, else, if that is None, to ``show`` one by one. A connector that fails is reported and
    does not stop the others. Overrides win over a connector's own options. ``run`` names a window
    of a schedule: its start is not included, and run again it overwrites its own rows.
    """
    start, now, out = start or end - dt.timedelta(hours=1), now or end, []
    for row in chosen(catalogue, names):
        options, began = {**(row.get("kwargs") or {}), **(overrides or {})}, time.monotonic()
        try:
            name = platform(row["name"])
            limit = options.get("limit")
            raw = fetch(endpoint(spark, folder, name), name, start, end, None if limit is None else int(limit), after=run is not None)
            if name in LISTS and (ids := _ids(spark, f"{folder}/{LISTS[name]}")) is not None:
                raw = listed(ids, parsed(endpoint(spark, folder, name), name)).drop("position")
            keep = store or (in_lake(root, run) if root else shown(show))
            items = keep(NORMALIZERS[name](raw, now), raw.select(F.lit(name).alias("source"), payload_time(name).alias("ts"), "payload"))
            out.append((row["name"], True, items, time.monotonic() - began, None))
        except Exception as e:  # noqa: BLE001  one platform's failure is its own
            out.append((row["name"], False, 0, time.monotonic() - began, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(out, METRICS)


def run_metrics(runs: DataFrame) -> DataFrame:
    """Metrics of many runs by connector: successes, failures, error rate, items, mean and largest latency."""
    bad = F.count_if(~F.col("ok"))
    return runs.groupBy("connector").agg(
        F.count_if("ok").alias("successes"), bad.alias("failures"), (bad / F.count(F.lit(1))).alias("error_rate"), F.sum("items").alias("items"), F.avg("latency_s").alias("mean_latency_s"), F.max("latency_s").alias("max_latency_s")
    )
