"""What larger tables showed: orders of wide ids, whole runs, slopes of zero, streams by batch."""

import random

import duckdb
import pytest
from oracle import same
from pyspark.sql import functions as F

from tidemark import session
from tidemark.operators import portfolio
from tidemark.plans import runs
from tidemark.sources import ingest
from tidemark.streaming import state, subscriptions


def test_a_slope_of_zero_neither_rises_nor_falls(spark):
    r, rows = random.Random(5), []
    for g in range(300):
        days = [(float(x), float(r.randrange(1, 6)), 50.0 + r.random()) for x in r.sample(range(30), 12)]
        days = days + [(58.0 - x, n, v - 1.0) for x, n, v in days]  # the mirror image takes the slope away
        r.shuffle(days)
        rows += [(g, x, n, v, n - 2 * x) for x, n, v in days]
    frame = spark.createDataFrame(rows, "g int, x double, n double, v double, falls double").repartition(7)
    assert portfolio.trends_apart(frame, "g", "x", "n", "falls").count() == 0
    assert portfolio.trends_apart(frame.withColumn("n", F.col("n") + F.col("x") / 1000), "g", "x", "n", "falls").count() == 300
    assert portfolio.trends_apart(frame.withColumn("up", F.col("x")), "g", "x", "up", "n").count() == 0


def wide(spark, sf, tmp_path):
    """The events of ``sf`` seven times, with ids up to nine million."""
    events = spark.read.parquet(f"{sf}/events.parquet").crossJoin(spark.range(7))
    events.withColumn("event_id", F.col("event_id") + F.col("id") * 1500000).drop("id").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    return con, str(tmp_path)


@pytest.mark.parametrize("name", ["fetch_range_then_newest", "fetch_newest_then_range"])
def test_wide_ids_are_taken_in_order(spark, sf, tmp_path, name):
    con, folder = wide(spark, sf, tmp_path)
    same(con, runs.R.sql[name], runs.R.queries[name](spark, folder))


def test_a_run_takes_all_that_is_there(spark, sf, tmp_path, monkeypatch):
    """However many records there are: no fetch of the run may stop at a number of newest rows."""
    monkeypatch.setattr(ingest, "newest", lambda rows, limit, skip=0: rows.limit(10))
    want = spark.read.parquet(f"{sf}/events.parquet").where("date_trunc('second', ts) BETWEEN '2024-01-01' AND '2024-01-20'").count()
    assert [(r.connector, r["items"]) for r in runs.R.queries["ingest_run"](spark, sf).collect()] == [("Reddit", want), ("stackoverflow", want), ("youtube", 0)]


def test_states_of_many_keys_cost_no_call_to_python(spark, sf):
    """Features that never expire and rules that never cool down run in Spark's own operators, each run in one batch."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = session.scratch(spark, "stream")
    events.repartition(5).write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    rules = spark.createDataFrame([("all", None, 50.0)], "rule_id string, entity string, threshold double")
    scores = stream.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity"), F.col("value").alias("score"), "ts")
    for q in (state.keep_features(stream, session.scratch(spark, "out"), session.scratch(spark, "cp")), subscriptions.fire(scores, rules, session.scratch(spark, "out"), session.scratch(spark, "cp"))):
        q.awaitTermination(120)
        assert "InPandas" not in q._jsq.explainInternal(True) and "InArrow" not in q._jsq.explainInternal(True)
        assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == 1
