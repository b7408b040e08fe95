"""URL rules by Bloom filter cascades.

A rule is a host, a path and a verdict. It fits its host and all subdomains, if the url's
path starts with the rule's; the longest fitting rule wins (by its characters, host and path
together, then by its host's). A url's keys are those of its host suffixes and path prefixes
that have the shape (length of host, length of path) of some rule, so a rule fits exactly
if one of the url's keys is the rule's.

For each verdict the keys of its rules are encoded in a cascade over the corpus's complete
universe of keys: level 1 is a Bloom filter of the listed keys, level 2 one of the other keys of
the corpus that pass level 1, level 3 one of the listed keys that pass level 2, and so on,
until a level would have no keys. Every key of the corpus is then told apart exactly by the
first level that it does not pass. Levels hash the key's text with their own seeds, so keys
that collide in one do not in the next. Building scans the corpus once; only keys that pass
level 1 are shuffled. Judging is one more scan, without joins.

A level is broadcast; it has at most ``LARGEST`` bits. Where one would need more, keys are
dealt by a hash into twice as many parts with cascades of their own, judged one after the other.

Edge cases: a url that is null or has no ``://`` has an empty host and path and no keys; a url
without a fitting rule gets ``default``; rules without host, path or verdict are left out; of
verdicts for one key the largest counts; rules that repeat count once; rows that repeat are
judged alike; very long urls cost no more keys than there are shapes; without rules
every verdict is ``default``; an empty table gives an empty result. Other columns of the
table are kept by ``judge`` unless they have the name of a new one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import batches, small_batches, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits for each key of a level and how many of them are set; bits of a level at most.
BITS, HASHES, LARGEST = 16, 8, 1 << 28
MASK = 0xFFFFFFFF


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?`` or ``#`` in lower case (A-Z only), and then up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The url's keys of all rules' shapes, longest first: ``array<struct<key, n>>``, n being the host's length."""
    known = F.array(*(F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in shapes)) if shapes else F.array().cast("array<struct<h:int,p:int>>")
    n, m = F.length(host), F.length(path)
    whole = lambda s: (s["h"] == n) | ((s["h"] < n) & (F.substr(host, n - s["h"], F.lit(1)) == "."))
    fits = F.filter(known, lambda s: (s["p"] <= m) & whole(s))
    return F.transform(fits, lambda s: F.struct(F.concat(F.right(host, s["h"]), F.left(path, s["p"])).alias("key"), s["h"].alias("n")))


def seeded(seed: int, key: Column) -> Column:
    return F.xxhash64(F.lit(seed), key)


def all_seeded(seed: int, found: str) -> Column:
    return F.transform(found, lambda k: seeded(seed, k["key"]))


def dealt(key: Column, part: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)) == part


def dealt_keys(found: str, part: int, parts: int) -> Column:
    return F.filter(found, lambda k: dealt(k["key"], part, parts))


class Level(NamedTuple):
    """A Bloom filter: ``words`` of 64 bits."""

    seed: int
    bits: int
    words: np.ndarray

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        low, step = h & np.uint64(MASK), (h >> np.uint64(32)) | np.uint64(1)
        out = np.ones(len(h), bool)
        for i in range(HASHES):
            at = (low + np.uint64(i) * step) % np.uint64(self.bits)
            out &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def level(listed: DataFrame, seed: int, n: int, per_key: int) -> Level:
    """The filter of ``key``; its words are put together by Spark, some bits a key reach the driver."""
    bits = max(64, per_key * n)
    h = seeded(seed, F.col("key"))
    low, step = h.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
    at = listed.select(F.explode(F.array(*((low + i * step) % F.lit(bits) for i in range(HASHES)))).alias("at"))
    word = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set"))
    got = word.toArrow()
    words = np.zeros((bits + 63) // 64, np.uint64)
    words[got.column("word").to_numpy()] = got.column("set").to_numpy().view(np.uint64)
    return Level(seed, bits, words)


def passing(rows: DataFrame, one: Level) -> DataFrame:
    """The rows whose ``key`` passes."""
    shared = rows.sparkSession.sparkContext.broadcast(one)
    names = rows.columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            yield b.filter(pa.array(shared.value.passes(b.column(len(names)).to_numpy())))

    hashed = rows.withColumn("hash_", seeded(one.seed, F.col("key")))
    return hashed.mapInArrow(run, hashed.schema).drop("hash_")


def cascade(universe: DataFrame, listed: DataFrame, first: int, per_key: int = BITS, most: int = LARGEST) -> list[Level] | None:
    """Levels that tell the keys of ``listed`` from all others of ``universe`` (both of ``key``); None if one would be too large.

    ``universe`` may repeat keys; ``listed`` may not, and may have keys that the universe lacks.
    """
    n = listed.count()
    if not n:
        return []
    if n * per_key > most:
        return None
    levels = [level(listed, first, n, per_key)]
    found = passing(universe, levels[0]).distinct()
    inside = written(found.join(listed.withColumn("in_", F.lit(True)), "key", "left").select("key", F.coalesce("in_", F.lit(False)).alias("listed")), "urls-passing")
    held, other = inside.where("listed"), inside.where("NOT listed")
    while True:
        held, other = other, held  # the next level encodes what wrongly passed, then the tables change sides
        n = held.count()
        if not n:
            return levels
        if n * per_key > most:
            return None
        levels.append(level(held, first + len(levels), n, per_key))
        other = written(passing(other, levels[-1]), "urls-passing")


def member(passed: list[np.ndarray]) -> np.ndarray:
    """Whether keys are listed, from which levels they pass: the first one that they do not pass tells."""
    out = np.full(len(passed[0]), len(passed) % 2 == 1)
    for k in range(len(passed) - 1, -1, -1):
        out = np.where(passed[k], out, k % 2 == 1)
    return out


def _judged(pages: DataFrame, lists: dict[str, list[Level]]) -> DataFrame:
    """``rule_`` and ``verdict_`` of the longest listed key in ``keys_``, if it is longer than the one found before."""
    spark = pages.sparkSession
    shared, names = spark.sparkContext.broadcast(lists), pages.columns
    order = [(v, one) for v, levels in lists.items() for one in levels]
    hashed = pages.withColumns({f"hash{j}_": all_seeded(one.seed, "keys_") for j, (_, one) in enumerate(order)})
    at = {n: k for k, n in enumerate(hashed.columns)}
    schema = T.StructType([f for f in hashed.schema.fields if f.name in names])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            many = b.column(at["keys_"])
            row = np.repeat(np.arange(b.num_rows), np.diff(many.offsets.to_numpy()))
            key = many.flatten()
            text, n = key.field(0), key.field(1).to_numpy(zero_copy_only=False)
            rule, verdict, wide, long = (b.column(at[c]).to_pylist() for c in ("rule_", "verdict_", "wide_", "long_"))
            j, hits = 0, []
            for v, levels in shared.value.items():
                passed = [one.passes(b.column(at[f"hash{j + k}_"]).flatten().to_numpy()) for k, one in enumerate(levels)]
                j += len(levels)
                hits += [(k, v) for k in np.flatnonzero(member(passed))] if passed else []
            for k, v in hits:
                r, t = row[k], text[k].as_py()
                if (len(t), int(n[k])) > (long[r], wide[r]):
                    rule[r], verdict[r], long[r], wide[r] = t, v, len(t), int(n[k])
            new = {"rule_": pa.array(rule, pa.string()), "verdict_": pa.array(verdict, pa.string()), "wide_": pa.array(wide, pa.int32()), "long_": pa.array(long, pa.int32())}
            yield pa.RecordBatch.from_arrays([new.get(c, b.column(at[c])) for c in names], names)

    return hashed.mapInArrow(run, schema)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", per_key: int = BITS, most: int = LARGEST) -> DataFrame:
    """The columns of ``pages`` and ``host, path, rule, verdict``. ``rules``: ``host, path, verdict``."""
    spark = pages.sparkSession
    small_batches(spark)
    clean = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    listed = written(clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(F.concat("host", "path").alias("key"), F.length("host").alias("h"), F.length("path").alias("p"), "verdict"), "urls-rules")
    shapes = sorted((tuple(r) for r in listed.select("h", "p").distinct().toLocalIterator()), reverse=True)  # lengths, not rules
    verdicts = sorted(r.verdict for r in listed.select("verdict").distinct().toLocalIterator())
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url))
    split = pages.select(*kept, host.alias("host"), path.alias("path"))
    keys_ = keys(F.col("host"), F.col("path"), shapes)
    split = split.withColumns({"keys_": keys_, "rule_": F.lit(None).cast("string"), "verdict_": F.lit(None).cast("string"), "wide_": F.lit(-1), "long_": F.lit(-1)})

    def over(split: DataFrame, part: int, parts: int) -> DataFrame:
        own, mine = split.withColumn("keys_", dealt_keys("keys_", part, parts)), listed.where(dealt(F.col("key"), part, parts))
        all_ = own.select(F.explode("keys_.key").alias("key"))
        lists = {}
        for k, v in enumerate(verdicts):
            lists[v] = cascade(all_, mine.where(F.col("verdict") == v).select("key"), 1000 * k + 1, per_key, most)
            if lists[v] is None:
                return over(over(split, part, 2 * parts), part + parts, 2 * parts)
        found = _judged(own, lists)
        return found if parts == 1 else written(found.withColumn("keys_", keys_), "urls-judged")

    split = over(split, 0, 1)
    return split.select(*kept, "host", "path", F.col("rule_").alias("rule"), F.coalesce("verdict_", F.lit(default)).alias("verdict"))
