"""Which platform is read by which source, and how a run's arguments reach it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.normalize import NORMALIZERS

ALIASES = {"x": "twitter", "stackoverflow": "stack_overflow", "hn": "hacker_news"}

#: The most records that one fetch of a platform returns.
FETCH_LIMITS = {"reddit": 200, "twitter": 100, "tiktok": 50, "youtube": 50, "github": 100, "stack_overflow": 50, "airtable": 100, "hacker_news": 50, "edgar": 40}

#: The time column of each platform, where it has one, and what it holds.
TIMES = {
    "reddit": ("created_utc", "epoch"), "twitter": ("created_at", "iso"), "tiktok": ("create_time", "epoch"), "threads": ("created_time", "iso"), "youtube": ("publishedAt", "iso"),
    "github": ("created_at", "iso"), "stack_overflow": ("creation_date", "epoch"), "hacker_news": ("time", "epoch"), "google_trends": ("date", "iso"),
}


def platform(name: str) -> str:
    """The canonical name, whatever the case; an unknown one is an error."""
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in NORMALIZERS:
        raise ValueError(f"no such platform: {name}")
    return key


def parse_arguments(arguments: list[str]) -> dict[str, str]:
    """``--k v``, ``--k=v`` and bare ``--flag`` (true); dashes in names become underscores."""
    found: dict[str, str] = {}
    queue = list(arguments)
    while queue:
        word = queue.pop(0)
        if not word.startswith("--"):
            continue
        name, has_value, value = word[2:].partition("=")
        if not has_value:
            value = queue.pop(0) if queue and not queue[0].startswith("--") else "true"
        found[name.replace("-", "_")] = value
    return found


def reader(spark: SparkSession, name: str, configured: dict | None = None, overrides: dict | None = None) -> DataFrame:
    """A replay reader for a platform; overrides win over configured options."""
    from tidemark.sources.replay import register

    register(spark)
    options = {**(configured or {}), **(overrides or {}), "platform": platform(name)}
    return spark.read.format("tidemark_replay").options(**{k: str(v) for k, v in options.items()}).load()
