"""One sink for the console, files and webhooks, which accounts for every record.

A task writes down what it is about to hand over, a chunk at a time, then hands it over, then
writes down what became of each record. So whatever happens to a task, the journal says what was
delivered, what failed (with the record, for a quarantine table), and what may or may not have
arrived. Files are staged and only appear when the whole job commits; a webhook gets the record's key
with it, so that a repeated one can be told.
"""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidemark.session import send_package

FORMAT = "tidemark_sink"
KINDS = ("console", "file", "webhook")
RESULT = "key string, status string, error string, payload string"


@dataclass
class Handed(WriterCommitMessage):
    delivered: int
    failed: int
    staged: list[str]


class Folder:
    """A folder of any file system that Arrow opens."""

    def __init__(self, uri: str) -> None:
        self.files, self.root = arrow_fs.FileSystem.from_uri(uri)

    def put(self, name: str, text: str) -> None:
        path = f"{self.root}/{name}"
        self.files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.files.open_output_stream(path) as out:
            out.write(text.encode())


class SinkWriter(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.kind, self.target, self.journal = options["kind"], options.get("target", ""), options["journal"]
        self.attempts, self.timeout, self.chunk = int(options.get("attempts", 3)), float(options.get("timeout", 5)), int(options.get("chunk", 100))
        if self.kind not in KINDS:
            raise ValueError(f"no such sink: {self.kind}")

    def hand(self, key: str, payload: str) -> str | None:
        """The error, or None if the record was taken."""
        if self.kind == "console":
            print(payload, flush=True)
            return None
        error = None
        for _ in range(self.attempts):
            try:
                request = urllib.request.Request(self.target, payload.encode(), {"Content-Type": "application/json", "Idempotency-Key": key})
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    if answer.status < 300:
                        return None
                    error = f"status {answer.status}"
            except Exception as e:  # noqa: BLE001  whatever an unreachable receiver raises is its record's result
                error = f"{type(e).__name__}: {e}"[:200]
        return error

    def write(self, iterator: Iterator) -> Handed:
        task, journal, done, n = TaskContext.get(), Folder(self.journal), Handed(0, 0, []), 0
        ident = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        held: list[str] = []

        def flush() -> None:
            nonlocal n
            if not held:
                return
            name, keys = f"{ident}-{n:06d}", [hashlib.sha256(p.encode()).hexdigest() for p in held]
            journal.put(f"intents/{name}.jsonl", "".join(json.dumps({"key": k}) + "\n" for k in keys))
            if self.kind == "file":
                Folder(self.target).put(f"_staged/{name}.jsonl", "".join(p + "\n" for p in held))
                done.staged.append(name)
                errors = [None] * len(held)
            else:
                errors = [self.hand(k, p) for k, p in zip(keys, held, strict=True)]
            lines = ({"key": k, "status": "failed", "error": e, "payload": p} if e else {"key": k, "status": "delivered"} for k, p, e in zip(keys, held, errors, strict=True))
            journal.put(f"results/{name}.jsonl", "".join(json.dumps(x) + "\n" for x in lines))
            done.failed += sum(e is not None for e in errors)
            done.delivered += sum(e is None for e in errors)
            n += 1
            held.clear()

        for row in iterator:
            held.append(row.payload)
            if len(held) == self.chunk:
                flush()
        flush()
        return done

    def _settle(self, messages: list[Handed | None], outcome: str) -> None:
        known = [m for m in messages if m is not None]
        if self.kind == "file":
            target = Folder(self.target)
            for name in (x for m in known for x in m.staged):
                if outcome == "committed":
                    target.files.move(f"{target.root}/_staged/{name}.jsonl", f"{target.root}/{name}.jsonl")
                else:
                    target.files.delete_file(f"{target.root}/_staged/{name}.jsonl")
        said = {"outcome": outcome, "tasks": len(messages), "lost_tasks": len(messages) - len(known), "delivered": sum(m.delivered for m in known), "failed": sum(m.failed for m in known)}
        Folder(self.journal).put(f"outcome/{outcome}.jsonl", json.dumps(said) + "\n")

    def commit(self, messages: list[Handed | None]) -> None:
        self._settle(messages, "committed")

    def abort(self, messages: list[Handed | None]) -> None:
        self._settle(messages, "aborted")


class Sink(DataSource):
    """Takes ``payload``; options ``kind``, ``target``, ``journal``, ``attempts``, ``timeout``, ``chunk``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "payload string"

    def writer(self, schema, overwrite: bool) -> SinkWriter:
        return SinkWriter(self.options)


def deliver(rows: DataFrame, kind: str, journal: str, target: str = "", **options) -> DataFrame:
    """Hand every row, as JSON, to a sink; the report of ``journal`` (a new folder for each job that executors share)."""
    spark = rows.sparkSession
    if kind not in KINDS:
        raise ValueError(f"no such sink: {kind}")
    send_package(spark)
    spark.dataSource.register(Sink)
    said = {"kind": kind, "target": target, "journal": journal, **options}
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("payload")).write.format(FORMAT).mode("append").options(**{k: str(v) for k, v in said.items()}).save()
    return report(spark, journal)


def report(spark: SparkSession, journal: str) -> DataFrame:
    """``key, status, error, payload``: one row for each key that a task was about to hand over.

    ``delivered`` if any attempt was, else ``failed`` with the record, else ``unknown``: a task was lost on the way.
    """
    read = lambda part, ddl: spark.read.schema(ddl).option("recursiveFileLookup", "true").json(f"{journal}/{part}") if _exists(spark, f"{journal}/{part}") else spark.createDataFrame([], ddl)
    found = read("results", RESULT).groupBy("key").agg(F.min(F.struct("status", "error", "payload")).alias("x"))  # delivered is before failed
    return read("intents", "key string").distinct().join(found, "key", "left").select("key", F.coalesce("x.status", F.lit("unknown")).alias("status"), "x.error", "x.payload")


def outcome(spark: SparkSession, journal: str) -> DataFrame:
    """``outcome, tasks, lost_tasks, delivered, failed`` of the job."""
    return spark.read.schema("outcome string, tasks bigint, lost_tasks bigint, delivered bigint, failed bigint").json(f"{journal}/outcome")


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
