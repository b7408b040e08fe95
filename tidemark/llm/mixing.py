"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: each source has a weight and shares the total number of words by weight, but
stops at ``max_repeat`` times its own size; the excess is shared again. Blocks of
``block_words`` words are then given to sources by highest quotient target / (2j + 1),
and each source's blocks to its shards the same way, by size, if there are many in two
steps. Within a shard the documents lie on a line in seeded order and every block is taken quota / blocks times,
the remainder by seeded systematic selection.

Edge cases: a null text has size 0, takes nothing and stays in the result; a null
source is a source, the last one; repeated rows are separate documents; a very long text
lies on the line like others; an empty table gives an empty result. Only doc_id, source
and text are read from the input.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import batches, small_batches, texts_of, written

WORDS = r"[^\x20\x09-\x0D]+"
#: A word with the white space behind it.
SAID = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def targets(sources: DataFrame, max_repeat: int = 3, cycle: int = 3) -> DataFrame:
    """Add ``weight`` and ``target`` to one row per source (``key, source, source_size``).

    Filled level by level: with sources ordered by cap / weight, the level that stops no
    later source is the largest of the candidate levels.
    """
    everywhere = W.orderBy(F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    total, weights = F.sum("source_size").over(whole).cast("double"), F.sum("weight").over(whole)
    done = lambda c: F.coalesce(F.sum(c).over(by_cap), F.lit(0)).cast("double")
    return (
        sources.withColumn("rank", F.row_number().over(everywhere))
        .withColumn("weight", ((F.col("rank") - 1) % cycle + 1).cast("long"))
        .withColumn("cap", (F.col("source_size") * max_repeat).cast("long"))
        .withColumn("level", (total - done("cap")) / (weights - done("weight")))
        .withColumn("level", F.max("level").over(whole))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .drop("level", "cap")
    )


def sainte_lague(rows: DataFrame, group: list[str], votes: str, seats: Column, order: str, out: str) -> DataFrame:
    """Give each group's ``seats`` to its rows by highest quotient votes / (2j + 1).

    Rounding votes / seat price is already within a few seats of the answer, so only the
    quotients around it compete; ties go to the earlier ``order``.
    """
    g = W.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(g), F.sum(votes).over(g).cast("double")
    near = (
        rows.withColumn("seats_", seats)
        .withColumn("share_", F.coalesce(F.try_divide(F.col(votes).cast("double"), total), F.lit(0.0)))
        .withColumn("first_", F.floor(F.col("share_") * F.col("seats_") + 0.5).cast("long"))
        .withColumn("off_", F.abs(F.col("seats_") - F.sum("first_").over(g)) + n)
        .withColumn("reach_", F.ceil(F.col("share_") * F.col("off_")).cast("long") + 2)
        .withColumn("base_", F.greatest(F.lit(0), F.col("first_") - F.col("reach_")))
        .withColumn("open_", F.col("seats_") - F.sum("base_").over(g))
    )
    best = W.partitionBy(*group).orderBy(F.desc("quotient_"), order, "seat_")
    won = (
        near.where(F.col(votes) > 0)
        .withColumn("seat_", F.explode(F.sequence(F.col("base_"), F.col("first_") + F.col("reach_") - 1)))
        .withColumn("quotient_", F.col(votes) / (2 * F.col("seat_") + 1))
        .withColumn("place_", F.row_number().over(best))
        .where(F.col("place_") <= F.col("open_"))
        .groupBy(*group, order)
        .agg(F.count(F.lit(1)).alias("won_"))
    )
    return (
        near.join(won, [*group, order], "left")
        .withColumn(out, F.col("base_") + F.coalesce("won_", F.lit(0)))
        .drop("seats_", "share_", "first_", "off_", "reach_", "base_", "open_", "won_")
    )


#: Shards that are apportioned together; larger sources have groups of shards first.
TOGETHER = 4_096


def mix(docs: DataFrame, seed: int = 17, block_words: int = 8, shard_words: int = 65_536, max_repeat: int = 3, text: str | None = None) -> DataFrame:
    """Per document: ``doc_id, size, source, source_size, target, taken``.

    A source has one shard for each ``shard_words`` words, so a hot source is dealt over
    many tasks and a shard's line stays small, whatever the corpus. Its blocks go to groups
    of ``TOGETHER`` shards, then to the shards of each group. With ``text`` (a column's name)
    that column is what the mix takes: once for each time that a word is taken.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    own = docs.select("doc_id", "source", key.alias("key"), words.alias("size"), *(["text"] if text else []))
    sized = written(own, "mix-sizes")
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    aimed = targets(sources, max_repeat)
    blocks = F.round(F.sum("source_size").over(W.partitionBy()) / block_words).cast("long")
    aimed = sainte_lague(aimed.withColumn("all_", F.lit(0)), ["all_"], "target", blocks, "rank", "blocks")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")
    aimed = written(aimed.select("key", "source_size", "target", "blocks", shards.alias("shards")), "mix-sources")
    lines = sized.join(aimed, "key").withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "size")).withColumn("shard", F.pmod("place", "shards"))
    shards = lines.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("source_blocks"))
    shards = written(shards.withColumn("group", F.floor(F.col("shard") / TOGETHER)), "mix-shards")
    groups = shards.groupBy("key", "group").agg(F.sum("shard_size").alias("group_size"), F.first("source_blocks").alias("source_blocks"))
    groups = sainte_lague(groups, ["key"], "group_size", F.col("source_blocks"), "group", "group_blocks").select("key", "group", "group_blocks")
    shards = sainte_lague(shards.join(groups, ["key", "group"]), ["key", "group"], "shard_size", F.col("group_blocks"), "shard", "won")
    n = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block_words)).cast("long")
    shards = shards.withColumn("n", n).select(
        "key", "shard", "n", F.least("won", F.col("n") * max_repeat).alias("quota"), F.pmod(F.xxhash64(F.lit(seed), "key", "shard"), "n").alias("phase")
    )
    line = W.partitionBy("key", "shard").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)

    def upto_block(k: Column) -> Column:
        """Blocks taken among the first ``k`` of the shard's line, repeats counted."""
        return k * F.expr("quota div n") + F.floor((k * (F.col("quota") % F.col("n")) + F.col("phase")) / F.col("n")).cast("long")

    def times(block: Column) -> Column:
        return upto_block(block + 1) - upto_block(block)

    def upto(x: Column) -> Column:
        """Words taken among the first ``x`` of the shard's line."""
        before = F.floor(x / block_words).cast("long")
        return upto_block(before) * block_words + (x - before * block_words) * times(before)

    placed = lines.join(shards, ["key", "shard"]).withColumn("end", F.sum("size").over(line))
    taken = upto(F.col("end")) - upto(F.col("end") - F.col("size"))
    shown = ["doc_id", "size", "source", "source_size", "target", "taken"]
    placed = placed.withColumn("taken", taken)
    if not text:
        return placed.select(*shown)
    parts = placed.select(*shown, (F.col("end") - F.col("size")).alias("first"), F.expr("quota div n").alias("whole"), (F.col("quota") % F.col("n")).alias("rest"), "phase", "n", F.col(text).alias("said"))

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            size, many = b.column(1).to_pylist(), b.column(5).to_pylist()
            line = zip(*(b.column(k).to_pylist() for k in range(6, 11)), strict=True)
            out = [mixed(t, n, *at, block_words) if k else "" for t, n, k, at in zip(texts_of(b.column(11)), size, many, line, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(out, pa.string())], [*b.schema.names[:6], text])

    small_batches(docs.sparkSession)
    return parts.mapInArrow(cut, T.StructType([*parts.schema.fields[:6], T.StructField(text, T.StringType())]))


def mixed(text: str, size: int, first: int, whole: int, rest: int, phase: int, n: int, block_words: int) -> str:
    """The words of a text of ``size`` words that the mix takes; the text begins at word ``first`` of its
    shard's line, and block b of the line is taken as often as ``taken`` counts it."""
    said, out = SAID.findall(text), []
    upto = lambda b: b * whole + (b * rest + phase) // n
    blocks = range(first // block_words, (first + size - 1) // block_words + 1)
    times = [upto(b + 1) - upto(b) for b in blocks]
    for k in range(max(times)):
        out.append("".join(w for b, t in zip(blocks, times, strict=True) if t > k for w in said[max(b * block_words - first, 0) : (b + 1) * block_words - first]))
    return "\n".join(x for x in out if x)
