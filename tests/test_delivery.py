"""Sinks that account for what they hand over, and runs that follow a schedule."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.sources import ingest, schedule, sink


@pytest.fixture
def receiver():
    """A webhook that refuses whatever says ``bad`` and remembers the rest."""
    got = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"])).decode()
            bad = "bad" in body
            if not bad:
                got.append((self.headers["Idempotency-Key"], json.loads(body)))
            self.send_response(500 if bad else 204)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", got
    server.shutdown()


def test_webhook_failures_are_counted_and_kept(spark, tmp_path, receiver):
    url, got = receiver
    rows = spark.createDataFrame([(f"e{k}" if k % 5 else f"bad{k}", float(k), None) for k in range(50)], "entity string, score double, evidence string").repartition(3)
    journal = f"file://{tmp_path}/journal"
    found = sink.deliver(rows, "webhook", journal, url, attempts=2, chunk=7)
    assert {r.status: r["count"] for r in found.groupBy("status").count().collect()} == {"delivered": 40, "failed": 10}
    assert sorted(x["entity"] for _, x in got) == sorted(f"e{k}" for k in range(50) if k % 5) and all(x["evidence"] is None for _, x in got)
    lost = found.where("status = 'failed'").collect()
    assert all("bad" in json.loads(r.payload)["entity"] and "500" in r.error for r in lost)
    said = sink.outcome(spark, journal).first()
    assert (said.outcome, said.delivered, said.failed, said.lost_tasks) == ("committed", 40, 10, 0)


def test_a_failing_task_leaves_nothing_unreported(spark, tmp_path, receiver):
    url, got = receiver
    bad = F.when(F.col("id") == 17, F.raise_error(F.lit("broken input"))).otherwise(F.col("id"))
    rows = spark.range(40).repartition(1).sortWithinPartitions("id").select(bad.cast("long").alias("n"))
    with pytest.raises(Exception, match="broken input|Writing job|aborted"):
        sink.deliver(rows, "webhook", f"file://{tmp_path}/journal", url, chunk=4)
    found = sink.report(spark, f"file://{tmp_path}/journal")
    assert found.where("status = 'delivered'").count() == len({k for k, _ in got})
    assert sink.outcome(spark, f"file://{tmp_path}/journal").first().outcome == "aborted"
    (tmp_path / "journal" / "intents").mkdir(exist_ok=True)
    (tmp_path / "journal" / "intents" / "lost.jsonl").write_text('{"key": "abc"}\n')
    assert [r.key for r in sink.report(spark, f"file://{tmp_path}/journal").where("status = 'unknown'").collect()] == ["abc"]


def test_files_appear_when_all_tasks_are_through(spark, tmp_path):
    bad = F.when(F.col("id") == 39, F.raise_error(F.lit("broken input"))).otherwise(F.col("id"))
    with pytest.raises(Exception):  # noqa: B017
        sink.deliver(spark.range(0, 40, 1, 4).select(bad.cast("long").alias("n")), "file", f"file://{tmp_path}/j1", f"file://{tmp_path}/out")
    assert not list((tmp_path / "out").glob("*.jsonl"))
    sink.deliver(spark.range(0, 40, 1, 4).select(F.col("id").alias("n")), "file", f"file://{tmp_path}/j2", f"file://{tmp_path}/out")
    assert sorted(r.n for r in spark.read.json(f"file://{tmp_path}/out/*.jsonl").collect()) == list(range(40))
    with pytest.raises(ValueError):
        sink.deliver(spark.range(1), "pigeon", f"file://{tmp_path}/j3")


def recorded(spark, tmp_path, name="reddit"):
    (tmp_path / name).mkdir()
    lines = [json.dumps({"id": str(k), "created_utc": 1704067200 + 900 * k, "title": "t"}) for k in range(40)]  # every quarter of an hour
    (tmp_path / name / "a.jsonl").write_text("\n".join(lines))
    return spark.createDataFrame([("reddit", {"limit": "1000"})], "name string, kwargs map<string,string>")


def test_scheduled_runs_take_every_payload_once(spark, tmp_path, monkeypatch):
    catalogue, root = recorded(spark, tmp_path), str(tmp_path / "lake")
    start, hour = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    follow = lambda until: schedule.follow(spark, catalogue, str(tmp_path), root, str(tmp_path / "cp"), start, until).awaitTermination(120)
    ids = lambda: sorted(int(json.loads(r.payload)["id"]) for r in spark.read.json(f"{root}/raw").collect())
    follow(start + 2 * hour + dt.timedelta(minutes=50))  # two windows are over
    assert ids() == list(range(1, 9))
    whole = ingest.ingest

    def dies(*a, **k):
        out = whole(*a, **k)
        if k["run"] == "20240101T040000":
            raise OSError("killed")
        return out

    monkeypatch.setattr(ingest, "ingest", dies)
    with pytest.raises(StreamingQueryException):
        follow(start + 6 * hour)
    monkeypatch.setattr(ingest, "ingest", whole)
    follow(start + 6 * hour)
    follow(start + 6 * hour)
    assert ids() == list(range(1, 25))
    metrics = spark.read.parquet(f"{root}/metrics")
    assert metrics.agg(F.sum("items")).first()[0] == 24 and metrics.select("window_end").distinct().count() == 6


def test_a_run_can_have_its_own_store(spark, tmp_path):
    catalogue = recorded(spark, tmp_path)
    journals = iter(f"file://{tmp_path}/j{k}" for k in range(9))
    to = ingest.to_sink("file", lambda: next(journals), f"file://{tmp_path}/out")
    out = ingest.ingest(spark, catalogue, str(tmp_path), None, dt.datetime(2024, 1, 1, 2), dt.datetime(2024, 1, 1), store=to)
    assert [(r.ok, r["items"]) for r in out.collect()] == [(True, 9)]
    assert spark.read.json(f"file://{tmp_path}/out/*.jsonl").count() == 9
