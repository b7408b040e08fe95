import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.operators.features import latest_features, mentions
from tidemark.streaming import features as st
from tidemark.streaming import state


def parts(spark, sf, tmp_path, n=3):
    """The events dealt to files, later rows first, so some come late."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartitionByRange(n, F.desc("event_id")).write.parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


COLUMNS = ["entity", "latest_score", "mention_count"]


def test_features_survive_a_failing_batch(spark, sf, tmp_path, monkeypatch):
    events, stream = parts(spark, sf, tmp_path)
    root, checkpoint, save = str(tmp_path / "out"), str(tmp_path / "cp"), state.save

    def fails(batch, folder):
        save(batch, folder)
        if folder.endswith("batch=1"):
            raise OSError("lost after writing")

    monkeypatch.setattr(state, "save", fails)
    with pytest.raises(StreamingQueryException):
        state.keep_features(stream, root, checkpoint).awaitTermination(120)
    monkeypatch.setattr(state, "save", save)
    state.keep_features(stream, root, checkpoint).awaitTermination(120)
    want = sorted(latest_features(mentions(events)).select(*COLUMNS).collect())
    assert sorted(state.feature_table(spark, root).select(*COLUMNS).collect()) == want
    touched = {r.batch: r["count"] for r in state.changes(spark, root).groupBy("batch").count().collect()}
    assert len(touched) == 3
    assert state.compact_features(spark, root) == 1 and state.compact_features(spark, root) == 0
    assert sorted(state.feature_table(spark, root).select(*COLUMNS).collect()) == want


def test_a_batch_writes_what_it_touched_and_idle_entities_expire(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    ddl = "event_id long, user_id long, event_type string, ts timestamp, value double"
    root, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for k, rows in enumerate([[(1, 1, "v", day(1), 1.0), (2, 2, "v", day(1), 2.0), (3, None, "v", None, 2.0)], [(4, 2, "v", day(20), 3.0)], [(5, 1, "v", day(21), 9.0)]]):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        state.keep_features(stream, root, checkpoint, "1 day", dt.timedelta(days=5)).awaitTermination(120)
        if k == 1:
            assert [(r.entity, r.mention_count) for r in state.feature_table(spark, root).collect()] == [("user_2", 2)]
    assert sorted((r.entity, r.latest_score, r.mention_count) for r in state.feature_table(spark, root).collect()) == [("user_1", 9.0, 1), ("user_2", 3.0, 2)]
    assert [(r.entity, r.expired) for r in state.changes(spark, root).orderBy("batch", "entity").collect() if r.entity == "user_1"] == [("user_1", False), ("user_1", True), ("user_1", False)]


def test_windows_in_stream_and_batch(spark, sf, tmp_path):
    events, stream = parts(spark, sf, tmp_path)
    q = st.run_once(st.windowed_counts(stream, delay="60 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    memory = st.windowed_counts(stream, delay="60 days").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    memory.awaitTermination(120)
    got = spark.table("counts").select("start", "event_type", "n").collect()
    want = st.windowed_counts(events).select("start", "event_type", "n").collect()
    assert sorted(got) == sorted(want)


def test_repeats_within_the_watermark(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").limit(50)
    events.union(events).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = st.without_repeats(stream, delay="60 days").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 50
