"""Unexpected schemas: what JSON payloads look like, by partition, against what they should."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)", "string": "^STRING", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID"}


def kind(of: Column) -> Column:
    """Number, string, boolean, array, object or null; ``mixed`` where a field has several."""
    return reduce(lambda rest, x: F.when(of.rlike(x[1]), x[0]).otherwise(rest), KINDS.items(), F.lit("mixed"))


def fields(payloads: DataFrame, by: list[str], payload: str = "payload") -> DataFrame:
    """``by, field, kind, rows, of``: top-level fields of JSON objects, what they hold, in how many of how many objects.

    Types are summed up in each task before the shuffle; payloads that are no objects count as none. A null
    leaves the kind that a field has otherwise.
    """
    parsed = payloads.select(*by, F.try_parse_json(payload).alias("v_")).where(F.schema_of_variant("v_").startswith("OBJECT"))
    all_ = parsed.groupBy(*by).agg(F.count(F.lit(1)).alias("of"))
    cells = parsed.lateralJoin(payloads.sparkSession.tvf.variant_explode(F.col("v_").outer())).select(*by, F.col("key").alias("field"), F.col("value").alias("value_"))
    held = F.when(F.schema_of_variant("value_") != "VOID", F.col("value_"))
    own = cells.groupBy(*by, "field").agg(F.schema_of_variant_agg(held).alias("type_"), F.count(F.lit(1)).alias("rows"))
    return own.join(all_, by).select(*by, "field", kind(F.col("type_")).alias("kind"), "rows", "of")


def drift(found: DataFrame, expected: DataFrame, by: list[str], source: str) -> DataFrame:
    """What differs from ``expected`` (``source, field, kind``) in each partition of ``fields``: ``by, field, change, kind, expected, rows, of``.

    ``new`` fields are not expected; ``missing`` ones lack in some or all objects; ``retyped`` ones hold something else, nulls aside.
    """
    parts = found.groupBy(*by).agg(F.max("of").alias("all_"))
    wanted = parts.join(expected.select(source, "field", F.col("kind").alias("expected")), source)
    both = found.join(wanted, [*by, "field"], "full")
    absent = F.coalesce("rows", F.lit(0)) < F.coalesce("all_", "of")
    change = F.when(F.col("expected").isNull(), "new").when(~F.col("kind").isin("null") & (F.col("kind") != F.col("expected")), "retyped").when(absent, "missing")
    out = both.withColumn("change", change).where("change IS NOT NULL")
    return out.select(*by, "field", "change", "kind", "expected", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.coalesce("all_", "of").alias("of"))
