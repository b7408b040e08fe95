"""Session factory and table loader shared by queries, tests and the bench."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that results depend on (UTC, ANSI, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Applications whose executors have the package.
_SENT: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Send this package to the executors, once in each application, for operators that run Python there."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        package = Path(__file__).resolve().parent
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='tidemark-')}/tidemark", "zip", package.parent, package.name))
        _SENT.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a local session without that setting gets a temporary one; on a cluster it is an
    error, as executors do not see the driver's own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def dropped(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark can open."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Folders that an application has written.
_WRITTEN: dict[str, list[str]] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder on the shared storage, for an intermediate; ``forget_all`` deletes it."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here,
    and a lost executor costs only a new read."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete an intermediate table whose successor is written. Not for results: they are read lazily."""
    spark, own = df.sparkSession, _WRITTEN.get(df.sparkSession.sparkContext.applicationId, [])
    names = {f.split("/")[-2] for f in df.inputFiles()}
    for path in [p for p in own if p.rsplit("/", 1)[-1] in names]:
        dropped(spark, path)
        own.remove(path)


def forget_all(spark: SparkSession) -> None:
    """Delete every intermediate table of this application, once its results are written elsewhere."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        dropped(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a dataset folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
