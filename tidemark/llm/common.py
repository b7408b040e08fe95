"""Helpers shared by the training-data operators: intermediate tables and Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import _WRITTEN, forget, send_package, written  # noqa: F401  the operators take them from here
from tidemark.session import forget_all as forget_folders

#: Rows in one Arrow batch that a Python task receives. Texts may be long, so it is far below Spark's default.
ROWS_PER_BATCH = 512
#: Catalogue tables that an application has written.
_TABLES: dict[str, list[str]] = {}


def small_batches(spark: SparkSession) -> None:
    """Bound what one Python worker holds at a time, and send this package to the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    send_package(spark)


def forget_all(spark: SparkSession) -> None:
    """Delete every intermediate table of this application, once its results are written elsewhere."""
    forget_folders(spark)
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty text."""
    return [t or "" for t in column.to_pylist()]


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Non-empty batches only."""
    return (b for b in rows if b.num_rows)


def slices(text: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of stretches of rows with about ``most`` bytes of text; one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, end - start
        start = end


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def mix64_into(x: np.ndarray, spare: np.ndarray) -> None:
    """``mix64`` in place; ``spare`` has the length of ``x``."""
    for _ in range(2):
        np.right_shift(x, np.uint64(32), out=spare)
        x ^= spare
        x *= np.uint64(0xD6E8FEB86659FD93)
    np.right_shift(x, np.uint64(32), out=spare)
    x ^= spare


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


class Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def labelled_ids(labels: DataFrame, value: str, rows: int, where=None) -> DataFrame:
    """At most ``rows`` labelled ids (``doc_id, value``): those of the lowest hash.

    The bound makes it safe to broadcast. Rows without an id or a label are left out; of
    several labels for one id the lowest counts.
    """
    from pyspark.sql import functions as F

    known = labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull())
    if where is not None:
        known = known.where(where)
    one = known.groupBy("doc_id").agg(F.min(value).alias("value"))
    return one.orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(rows)
