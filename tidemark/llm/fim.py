"""Fill-in-the-middle: texts cut into prefix, middle and suffix and put in another order.

A text is cut into units (white space with the word after it, or white space alone), and
two cuts are drawn from the SHA-256 of a seed and the document's id, so reruns agree. Each
Arrow batch is registered in DuckDB and rewritten there by SQL; no row is touched in Python.
The connection is kept by the Python worker, with one thread and no files.

Edge cases: a null text is the empty one; an empty text, or one that holds one of the
sentinels, stays plain; white space alone is one unit; very long texts are rewritten
whole, in slices of some ``slice_bytes`` of text; a null id is drawn like an empty one, and
rows that repeat an id are cut at the same draws; an empty table gives an empty result. All
columns are kept, but one with the name of a new column is replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import batches, slices, small_batches, unused

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE_BYTES = 8_000_000
NEW = "n long, form string, prefix_chars long, middle_chars long, output string"


def _sql(rate: int, spm: int, seed: int, marks: tuple[str, str, str]) -> str:
    """SQL over ``batch`` (``id, text``): one row for each, in order."""
    p, s, m = ("'" + x.replace("'", "''") + "'" for x in marks)
    draw = lambda k: f"('0x' || substr(h, {8 * k - 7}, 8))::UBIGINT"
    return rf"""
WITH units AS (
  SELECT row, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('{seed}:' || id) AS h FROM batch),
drawn AS (
  SELECT row, text, u, len(u) AS n, {draw(1)} % (len(u) + 1) AS c1, {draw(2)} % (len(u) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, {p}) OR contains(text, {s}) OR contains(text, {m}) OR {draw(3)} % 100 >= {rate} THEN 'plain'
      WHEN {draw(4)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM units),
cut AS (
  SELECT row, text, n, form, array_to_string(list_slice(u, 1, least(c1, c2)::BIGINT), '') AS prefix,
    array_to_string(list_slice(u, least(c1, c2)::BIGINT + 1, greatest(c1, c2)::BIGINT), '') AS middle,
    array_to_string(list_slice(u, greatest(c1, c2)::BIGINT + 1, n), '') AS suffix FROM drawn WHERE form <> 'plain'
  UNION ALL SELECT row, text, n, form, NULL, NULL, NULL FROM drawn WHERE form = 'plain')
SELECT n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
  CASE form WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle WHEN 'spm' THEN {s} || suffix || {p} || prefix || {m} || middle ELSE text END AS output
FROM cut ORDER BY row"""


def _connection():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})


def fill_in_middle(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42, ident: str = "doc_id", text: str = "text", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """All columns of ``docs`` and ``n`` (units), ``form`` (plain, psm, spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` percent of the texts are rewritten, of these ``spm`` percent with the suffix first.
    """
    small_batches(docs.sparkSession)
    new = T._parse_datatype_string(NEW)
    kept = [f for f in docs.schema.fields if f.name.lower() not in {x.name for x in new.fields}]
    at = len(kept)  # behind the kept columns: what the SQL reads
    sent = docs.select(*(F.col(f"`{f.name}`") for f in kept), F.coalesce(F.col(ident).cast("string"), F.lit("")).alias(unused(docs, "id_")), F.coalesce(F.col(text), F.lit("")).alias(unused(docs, "text_")))
    sql = _sql(rate, spm, seed, marks)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for whole in batches(rows):
            for start, length in slices(whole.column(at + 1), slice_bytes):
                b = whole.slice(start, length)
                con.register("batch", pa.table({"row": pa.array(np.arange(length)), "id": b.column(at), "text": b.column(at + 1)}))
                found = con.execute(sql).to_arrow_table().combine_chunks()
                con.unregister("batch")
                columns = [found.column(f.name).chunk(0).cast(pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in new.fields]
                yield pa.RecordBatch.from_arrays([*b.columns[:at], *columns], [*b.schema.names[:at], *(f.name for f in new.fields)])

    return sent.mapInArrow(run, T.StructType([*kept, *new.fields]))


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text before it was rewritten. No part holds a sentinel, so cutting at sentinels gives the parts back."""
    parts = F.split(F.col(output), "|".join(re.escape(m) for m in marks), -1)
    whole = lambda *order: F.concat(*(parts[k] for k in order))
    return F.when(F.col(form) == "psm", whole(1, 3, 2)).when(F.col(form) == "spm", whole(2, 3, 1)).otherwise(F.col(output))
