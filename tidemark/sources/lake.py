"""Lake readers and writers: raw JSON, bronze Parquet, feature snapshots, catalogues."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators.hygiene import latest_per_key, union_sources
from tidemark.session import dropped, written

PARTITIONS = ("source", "year", "month", "day")


def strict_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Every object must parse."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(path)


def tolerant_json(spark: SparkSession, path: str) -> DataFrame:
    """One object in each file; what does not parse is left out. ``path, payload, value``."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("payload"))
    return files.withColumn("value", F.try_parse_json("payload")).where("value IS NOT NULL")


def split_bad(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """(rows of JSON lines that parse, the other lines for a quarantine table)."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("ok", F.try_parse_json("value").isNotNull())
    good = lines.where("ok").select(F.from_json("value", ddl).alias("row")).select("row.*")
    return good, lines.where("NOT ok").select("value")


def signals(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Trends of a signals file: an object with ``trends`` or a bare list.

    A missing or broken file has no trends; with ``strict`` it is an error.
    """
    item = f"struct<entity:string,score:double,latest_score:double,mention_count:bigint,evidence:array<{schema.EVIDENCE}>,ts:string>"
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        if strict:
            raise
        return spark.createDataFrame([], f"entity string, score double, latest_score double, mention_count bigint, evidence array<{schema.EVIDENCE}>, ts string")
    if strict:
        kind = F.schema_of_variant(F.try_parse_json("value"))
        whole = F.coalesce(kind.startswith("ARRAY") | (kind.startswith("OBJECT") & F.try_variant_get(F.try_parse_json("value"), "$.trends", "array<variant>").isNotNull()), F.lit(False))
        broken = text.where(~whole).select(F.input_file_name().alias("path")).first()
        if broken is not None or text.isEmpty():
            raise ValueError(f"no signals in {broken.path if broken else path}")
    parsed = text.select(F.coalesce(F.from_json("value", f"struct<trends:array<{item}>>")["trends"], F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{item}>"))).alias("t"))
    return parsed.select(F.explode("t").alias("x")).where("x IS NOT NULL").select("x.*")


def connector_names(spark: SparkSession, path: str) -> DataFrame:
    """Names in a YAML catalogue, by its ``- name:`` lines."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(F.col("line").startswith("- name:"))
    return lines.select(F.trim(F.element_at(F.split("line", ":", 2), 2)).alias("name"))


def connectors(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a YAML catalogue; anything but a mapping with a list has none."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # a catalogue is a page long
    loaded = yaml.safe_load(text) if text else None
    rows = (loaded.get("connectors") or []) if isinstance(loaded, dict) else []
    names = ("name", "module", "class_name", "execution", "schedule")
    ddl = ", ".join(f"{n} string" for n in names) + ", kwargs map<string,string>"
    return spark.createDataFrame([(*(r.get(n) for n in names), {k: str(v) for k, v in (r.get("kwargs") or {}).items()}) for r in rows], ddl)


def _front(name: str) -> Column:
    return F.trim(F.regexp_extract(F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1), rf"(?m)^{name}:[ \t]*(.*)$", 1))


def skills(spark: SparkSession, pattern: str) -> DataFrame:
    """Front matter of skill files, in path order; a folded block is the description's indented lines."""
    files = spark.read.text(pattern, wholetext=True).withColumn("path", F.input_file_name())
    block = F.regexp_extract(F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1), r"(?s)(?:\A|\n)description:[ \t]*(?:>-|\|-)[ \t]*((?:\n[ \t]+[^\n]*)+)", 1)
    folded = F.trim(F.regexp_replace(block, r"\s*\n\s*", "\n"), F.lit("\n "))
    description = F.when(_front("description").isin(">-", "|-"), folded).otherwise(_front("description"))
    ident = F.element_at(F.split("path", "/"), -2)
    return files.select(
        ident.alias("id"), F.coalesce(F.nullif(_front("name"), F.lit("")), ident).alias("label"), description.alias("description"), F.coalesce(F.nullif(_front("category"), F.lit("")), F.lit("General")).alias("category"), "path"
    ).orderBy("path")


def write_raw_and_bronze(records: DataFrame, root: str, mode: str = "append", payloads: DataFrame | None = None, run: str | None = None) -> dict[str, str]:
    """Both copies of a run, by source and day; Spark's committer makes each all or nothing.

    ``payloads`` (``source, ts, payload``) are what was fetched; without them the raw copy
    holds the normalised records as JSON. With ``run`` rows lie in folders of that name below their day, and
    the same run written again replaces them; a lake has all its rows in such folders or none.
    """
    ts = F.col("ts")
    dated = lambda df: df.withColumns({"year": F.year(ts), "month": F.month(ts), "day": F.dayofmonth(ts)})
    paths = {"raw": f"{root}/raw", "bronze": f"{root}/bronze"}
    by = (*PARTITIONS, "run") if run else PARTITIONS

    def writer(rows: DataFrame):
        if not run:
            return dated(rows).write.mode(mode).partitionBy(*by)
        return dated(rows).withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)

    writer(records).parquet(paths["bronze"])
    writer(records if payloads is None else payloads).json(paths["raw"])
    return paths


def written_items(path: str, rows: DataFrame, mode: str = "overwrite") -> int:
    """Write Parquet and say how many rows went out, counted on the way."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    return int(seen.get["n"])


def expire(spark: SparkSession, root: str, before: dt.date) -> list[str]:
    """Drop the day partitions under ``root`` that are older than ``before``; their folders."""
    days = spark.read.parquet(root).select(*PARTITIONS).distinct()  # partition columns only: as many rows as folders
    old = days.where(F.make_date("year", "month", "day") < F.lit(before)).orderBy(*PARTITIONS).collect()
    folders = [f"{root}/source={r.source}/year={r.year}/month={r.month}/day={r.day}" for r in old]
    for f in folders:
        dropped(spark, f)
    return folders


def tier(spark: SparkSession, root: str, cold: str, before: dt.date, keys: tuple[str, ...] = ("source_id",)) -> int:
    """Move the days before ``before`` from ``root`` to ``cold``: sorted by ``keys``, few files a day; how many days.

    Rows that a cold day already has stay. The new days are written aside first, then put in place partition by partition, and
    only then the hot folders go: whatever happens in between, no row is lost, and running it again ends in the same table.
    """
    old = F.make_date("year", "month", "day") < F.lit(before)
    rows = spark.read.parquet(root).where(old)
    days = rows.select(*PARTITIONS).distinct()
    n = days.count()  # folders
    if not n:
        return 0
    if exists(spark, cold):
        known = spark.read.parquet(cold).join(F.broadcast(days), list(PARTITIONS), "left_semi")  # one row for each folder
        rows = _once(rows.unionByName(known, allowMissingColumns=True), keys)
    aside = written(rows.repartitionByRange(*PARTITIONS, *keys).sortWithinPartitions(*PARTITIONS, *keys), "cold")
    aside.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(cold)
    expire(spark, root, before)
    return n


def _once(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Equal rows once: a move that was stopped half-way leaves a day in both tiers. Told apart by a digest, as maps cannot be compared."""
    digest = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
    best = rows.withColumn("digest_", digest).groupBy(*PARTITIONS, *keys, "digest_").agg(F.first(F.struct(*(c for c in rows.columns if c not in (*PARTITIONS, *keys)))).alias("x_"))
    return best.select(*PARTITIONS, *keys, "x_.*").select(*rows.columns)


def both_tiers(spark: SparkSession, root: str, cold: str) -> DataFrame:
    """Rows of both tiers, with ``tier``."""
    parts = [spark.read.parquet(p).withColumn("tier", F.lit(name)) for name, p in (("hot", root), ("cold", cold)) if exists(spark, p)]
    return union_sources(*parts)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def bronze(spark: SparkSession, root: str, source: str | None = None, since: dt.date | None = None, until: dt.date | None = None, category: str | None = None, confidence: float | None = None, timeframe: str | None = None, now: dt.datetime | None = None) -> DataFrame:
    """Bronze rows, one for each key; source and days prune partitions.

    ``category`` and ``confidence``: rows with an entity of that type, and at least that sure; ``timeframe``
    (like ``24h``, ``7d``) the time up to ``now``.
    """
    rows = spark.read.parquet(f"{root}/bronze")
    if category or confidence is not None:
        rows = rows.where(F.exists("entities", lambda e: (F.lit(category is None) | (e["type"] == (category or ""))) & (F.lit(confidence is None) | (e["confidence"] >= (confidence or 0.0)))))
    if timeframe:
        size = re.fullmatch(r"([0-9]+)([hdw])", timeframe.strip().lower())
        if size is None or now is None:
            raise ValueError(f"no such timeframe, or no now for it: {timeframe}")
        first = now - dt.timedelta(hours=int(size[1]) * {"h": 1, "d": 24, "w": 168}[size[2]])
        since = max(d for d in (since, first.date()) if d is not None)
        rows = rows.where((F.col("ts") > F.lit(first).cast("timestamp")) & (F.col("ts") <= F.lit(now).cast("timestamp")))
    if source:
        rows = rows.where(F.col("source") == source)
    if since:
        rows = rows.where(F.make_date("year", "month", "day") >= F.lit(since))
    if until:
        rows = rows.where(F.make_date("year", "month", "day") <= F.lit(until))
    return latest_per_key(rows, ["source", "source_id"], [F.col("provenance.ingest_ts"), F.col("ts")])


def write_if_rows(rows: DataFrame, path: str) -> bool:
    """Write Parquet unless there is nothing to write."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def create_feature_table(spark: SparkSession, name: str = "features") -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema.FEATURE_DDL}) USING parquet")
