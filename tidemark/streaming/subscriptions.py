"""Subscriptions on a stream: each (rule, entity) fires once and then cools down; digests go out once a period."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.alerts import digest
from tidemark.streaming.state import with_state_store

FIRED = "rule_id string, entity string, score double, threshold double, fired_at timestamp"
#: Length of a period in days, and the day of 1970 on which one starts (weeks start on Mondays).
PERIODS = {"daily": (1, 0), "weekly": (7, 4)}


class Rule(StatefulProcessor):
    """The last time a rule fired for an entity; it fires again after ``cooldown_ms``."""

    def __init__(self, cooldown_ms: int) -> None:
        self.cooldown_ms = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("fired", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = pd.concat(list(rows)).sort_values(["ts", "score"])
        times = seen["ts"].astype("datetime64[ms]").astype("int64").to_numpy()
        old = self.last.get()
        last, picked, at = None if old is None else old[0], [], 0
        while at < len(times):
            if last is not None:
                at = max(at, int(times.searchsorted(last + self.cooldown_ms)))
                if at >= len(times):
                    break
            picked.append(at)
            last, at = int(times[at]), at + 1
        if picked:
            self.last.update((last,))
            out = seen.iloc[picked]
            yield pd.DataFrame({"rule_id": key[0], "entity": key[1], "score": out["score"].to_numpy(), "threshold": out["threshold"].to_numpy(), "fired_at": out["ts"].to_numpy()})

    def close(self) -> None:
        pass


def first_only(reached: DataFrame, root: str, number: int) -> DataFrame:
    """The first score of each rule and entity of a batch that did not fire in an earlier one: the alerts are their own state."""
    spark, at = reached.sparkSession, F.struct("ts", "score", "threshold")
    first = reached.groupBy("rule_id", "entity").agg(F.min(at).alias("x"))
    if number and _exists(spark, root):
        before = alerts(spark, root).where(F.col("batch") < number).select(F.col("rule_id").alias("rule_"), F.col("entity").alias("entity_"))
        first = first.join(before, F.col("rule_id").eqNullSafe(F.col("rule_")) & (F.col("entity") == F.col("entity_")), "left_anti")
    return first.select("rule_id", "entity", "x.score", "x.threshold", F.col("x.ts").alias("fired_at"))


def fire(scores: DataFrame, subscriptions: DataFrame, root: str, checkpoint: str, cooldown: dt.timedelta | None = None) -> StreamingQuery:
    """Alerts of a stream of ``entity, score, ts`` under ``root``, by batch; a replayed batch overwrites its own alerts.

    ``subscriptions``: ``rule_id, entity`` (null: all), ``threshold``. Only scores that reach a rule's threshold go to its state.
    """
    with_state_store(scores.sparkSession, __name__)
    sound = scores.where("entity IS NOT NULL AND ts IS NOT NULL").select("entity", F.col("score").cast("double"), F.col("ts").cast("timestamp"))
    fires = F.col("score") >= F.col("threshold")
    named = sound.join(subscriptions.where("entity IS NOT NULL"), "entity").where(fires)
    for_all = sound.join(subscriptions.where("entity IS NULL").drop("entity"), fires)
    reached = named.unionByName(for_all).select("rule_id", "entity", "score", "threshold", "ts")
    fired = reached
    if cooldown is not None:
        fired = reached.groupBy("rule_id", "entity").transformWithStateInPandas(Rule(int(cooldown.total_seconds() * 1000)), FIRED, "Append", "None")

    def write(batch: DataFrame, number: int) -> None:
        new = batch if cooldown is not None else first_only(batch, root, number)
        new.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return fired.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def alerts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(f"{FIRED}, batch bigint").parquet(root)


def send_digests(spark: SparkSession, root: str, out: str, period: str, upto: dt.datetime, most: int = 5) -> DataFrame:
    """Digests of the periods that ended by ``upto`` and were not sent: ``period_start, rule_id, alerts, highest, entities``.

    Each is one folder of ``out``; a period that has a folder was sent and is left alone.
    """
    days, first = PERIODS[period]
    start = F.date_add(F.lit("1970-01-01").cast("date"), (F.floor((F.unix_date(F.to_date("fired_at")) - first) / days) * days + first).cast("int"))
    dated = alerts(spark, root).withColumn("period_start", start).where(F.date_add("period_start", days) <= F.lit(upto.date()))
    sent = _sent(spark, out)
    due = [r.period_start for r in dated.select("period_start").distinct().orderBy("period_start").collect() if r.period_start not in sent]  # periods
    rows = dated.where(F.col("period_start").isin(due)).withColumn("latest_score", F.col("score")).withColumn("group_", F.struct("period_start", "rule_id"))
    best = rows.groupBy("group_", "entity").agg(F.max("latest_score").alias("latest_score"), F.count(F.lit(1)).alias("times"))
    sums = best.groupBy("group_").agg(F.sum("times").alias("alerts"))
    made = digest(best, "group_", most).drop("alerts").join(sums, "group_").select("group_.*", "alerts", "highest", "entities")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period_start").parquet(out)
    return made if not due else _digests(spark, out).where(F.col("period_start").isin(due))


def _digests(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("rule_id string, alerts bigint, highest double, entities array<string>, period_start date").parquet(out)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _sent(spark: SparkSession, out: str) -> set:
    if not _exists(spark, out):
        return set()
    return {r.period_start for r in _digests(spark, out).select("period_start").distinct().collect()}
