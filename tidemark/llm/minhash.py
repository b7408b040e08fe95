"""Near-duplicate detection: fast similarity sketches, banding, exact verification.

A document's set is its distinct 5-word shingles (hashed to 64 bits). Its sketch has
``COORDINATES`` places. In round i every element falls into the bin its i-th hash names
and a bin keeps the smallest value of the first round that reached it; after
``COORDINATES`` such rounds, round i fills bin i - ``COORDINATES`` directly, so every
place fills. Similarity 0.85 agrees on one of 25 bands of 5 places with a probability of
1 - 4e-7.

Documents with equal sets form one class, and only classes are compared. A bucket of a few
classes (``SMALL`` at first, ``MOST`` at most, whatever the corpus) is compared in all pairs.
A larger one is compared with one of its members only, its pivot p, so its pairs stay linear.
For the others let C be what they share with p and B the rest. Two of them that are similar
share at least theta (n1 + n2) - min(|C1|, |C2|) elements of B, theta = 0.85 / 1.85. So a
member that is not similar to p meets, in the next round, only members with which it has an
element of B in common, among the first ones in hash order that this bound leaves (prefix
filtering), or those so small that the bound is not positive. Members that are similar to p
are connected already, and members of one bucket of the next round share an element that its
pivot lacks, so buckets fall apart. No link is lost, and copies never meet in all pairs.

Edge cases: a document of one to four words has one shingle, the whole sequence; null or
empty texts have none and are linked with nothing; a null doc_id is linked with nothing
and kept; rows that share a doc_id count as one document of all their texts; an empty
table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import _TABLES, _WRITTEN, batches, forget, mix64, mix64_into, small_batches, unused, written
from tidemark.session import shared_folder

WIDTH, COORDINATES, ROWS = 5, 125, 5
UNFILLED, STEP = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)

#: Hashes that numpy works on at a time, so that they stay in a core's cache.
BLOCK = 1 << 13


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` neighbours in ``h``."""
    out, spare = np.full(max(0, len(h) - width + 1), width, np.uint64), np.empty(BLOCK, np.uint64)
    for start in range(0, len(out), BLOCK):
        part = out[start : start + BLOCK]
        for j in range(width):
            part *= STEP
            part += h[start + j : start + j + len(part)]
            mix64_into(part, spare[: len(part)])
    return out


def shingle_sets(texts: list[str] | pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of a batch of texts, one text after the other, and the bounds of each.

    Arrow splits and numbers the words of the whole batch, so Python sees each different word once.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string()) if isinstance(texts, list) else pc.fill_null(texts.cast(pa.large_string()), "")))
    words = split.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)  # white space at either end leaves an empty word
    n = np.diff(np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy()])
    coded = words.filter(pa.array(real)).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    h = hashes[coded.indices.to_numpy()]

    end, size = np.cumsum(n), np.where(n < width, np.minimum(n, 1), n - width + 1)
    bounds = np.concatenate([[0], np.cumsum(size)])
    out, rest = np.empty(bounds[-1], np.uint64), np.ones(bounds[-1], bool)
    for k in range(1, width):  # texts of fewer words have one shingle, the whole sequence
        mine = np.flatnonzero(n == k)
        total = np.full(len(mine), k, np.uint64)
        for j in range(k):
            total = mix64(total * STEP + h[end[mine] - k + j])
        out[bounds[mine]], rest[bounds[mine]] = total, False
    within = np.ones(len(h), bool)
    for k in range(1, width):  # a run of words that starts with the last few of a text would reach into the next one
        within[end[n >= k] - k] = False
    out[rest] = runs(h, width)[within[: max(0, len(h) - width + 1)]]
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        out[first:last].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[bounds[:-1][size > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def sketches(elements: np.ndarray, bounds: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches of all sets of a batch, (sets, t). Sets must not be empty."""
    n = len(bounds) - 1
    out = np.empty((n, t), np.uint64)
    live, mine = np.arange(n), np.full((n, t), UNFILLED)  # sets with open places, and their places
    owner, e = np.repeat(live, np.diff(bounds)), elements
    spare = np.empty(BLOCK, np.uint64)
    for i in range(2 * t):
        salt, round_ = np.uint64((0x632BE59BD9B4E019 * (i + 1)) & 0xFFFFFFFFFFFFFFFF), np.uint64(i) << np.uint64(56)
        if i < t:
            found = mine.reshape(-1)  # values of later rounds are larger, so places that are filled stay as they are
        else:
            found = mine[:, i - t].copy()
        for start in range(0, len(e), BLOCK):
            h = e[start : start + BLOCK] ^ salt
            mix64_into(h, spare[: len(h)])
            own = owner[start : start + BLOCK]
            if i < t:
                np.floor_divide(h, np.uint64(t), out=spare[: len(h)])  # numpy divides by a number faster than it takes a remainder
                own = own * t + (h - spare[: len(h)] * np.uint64(t)).astype(np.int64)
            np.minimum.at(found, own, (h >> np.uint64(8)) | round_)
        if i >= t:
            mine[:, i - t] = found
        open_ = (mine == UNFILLED).any(axis=1)
        if not open_.all():
            out[live[~open_]] = mine[~open_]
            if not open_.any():
                break
            live, mine, keep = live[open_], mine[open_], open_[owner]
            owner, e = (np.cumsum(open_) - 1)[owner[keep]], e[keep]
    return out


def rows_of_bands(percent: int, most_missed: float = 1e-4) -> int:
    """The most rows in a band, up to ``ROWS``, by which a pair at the threshold is not missed."""
    missed = lambda rows: (1 - (percent / 100) ** rows) ** (COORDINATES // rows)
    return next((r for r in range(ROWS, 1, -1) if missed(r) <= most_missed), 1)


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band, (sets, bands); the band's number is part of it."""
    bands = sketch[:, : sketch.shape[1] // rows * rows].reshape(len(sketch), -1, rows)
    key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for j in range(rows):
            key = mix64(key * STEP + bands[:, :, j])
    return key.view(np.int64)


def described(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, print_hi, print_lo, bands`` of each document; bands are null for empty sets."""
    small_batches(docs.sparkSession)
    depth = rows_of_bands(percent)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            elements, bounds = shingle_sets(b.column(1))
            size = np.diff(bounds)
            prints = b"".join(xxhash.xxh3_128_digest(elements[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            half = np.frombuffer(prints, ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2).T
            full = size > 0
            keys = band_keys(sketches(elements, np.concatenate([[0], bounds[1:][full]])), depth) if full.any() else np.zeros((0, 0), np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(full * keys.shape[1])]), pa.int32())
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()), mask=pa.array(~full))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(half[0].copy()), pa.array(half[1].copy()), bands], ["doc_id", "n_shingles", "print_hi", "print_lo", "bands"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, print_hi long, print_lo long, bands array<long>")


#: Cells of the bitmap of ids to be compared: 256 rows of 4 KB at most, whatever the corpus.
CELLS = 1 << 23


def with_hint(docs: DataFrame, ids: DataFrame, hint: str) -> DataFrame:
    """``docs`` with a column that is true where the id may be in ``ids`` and false where it is not.

    It comes from a bitmap of hashed ids, which is bounded and hence broadcast; when ids outgrow it, more of them may be.
    """
    cell = F.pmod(F.xxhash64(F.col("doc_id").cast(ids.schema["doc_id"].dataType)), F.lit(CELLS)) + 1
    row, bit = F.bitmap_bucket_number(cell), F.bitmap_bit_position(cell)
    bitmap = ids.groupBy(row.alias("row")).agg(F.bitmap_construct_agg(bit).alias("bits")).select(F.struct("row", "bits").alias(unused(docs, "map_")))
    cells, at = F.col(bitmap.columns[0]), (bit / 8).cast("int") + 1
    byte = F.conv(F.hex(F.substring(cells["bits"], at, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0, F.lit(False))
    return docs.join(F.broadcast(bitmap), cells["row"] == row, "left").select(*(docs[c] for c in docs.columns), may.alias(hint))


def only_wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with an id in ``ids``; a bitmap keeps most other texts out of the shuffle of the exact join."""
    near = with_hint(docs, ids, hint := unused(docs, "near_")).where(hint).drop(hint)
    return near.join(ids, "doc_id")  # ids are distinct; a semi-join would be pushed below the bitmap


def bucketed(sets: DataFrame) -> DataFrame:
    """The sets as a table bucketed by id, so that no later join shuffles them."""
    spark = sets.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"sets_{uuid.uuid4().hex}"
    dealt = sets.repartition(n, "doc_id").distinct()
    dealt.write.bucketBy(n, "doc_id").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    _TABLES.setdefault(spark.sparkContext.applicationId, []).append(name)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(f"{shared_folder(spark)}/{name}")
    return spark.table(name)


def with_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, n, items``: the sets themselves, for documents that are to be compared."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            elements, bounds = shingle_sets(b.column(1))
            items = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(elements.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds), pa.int64()), items], ["doc_id", "n", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, items array<long>")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for the nodes of ``edges`` (a, b).

    Smallest labels spread along edges and jump along labels until their sum stands still.
    """
    both = written(edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    before = None
    while before != (now := labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]):
        before = now
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("there"))
        older, labels = labels, written(lower.join(jump, lower.component == jump.via).select("node", F.least("component", "there").alias("component")), "labels")
        forget(older)
    forget(both)
    return labels


#: Members of a bucket that is compared in all pairs: four times as many in each later round, up to a bound that holds for any corpus.
SMALL, MOST = 64, 1024


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, star, least) with their sizes, what they share and whether they are similar.

    For star pairs (a is the pivot) ``need`` is the least number of elements outside the
    pivot that b shares with a similar member of at least ``least`` elements, and ``rest``
    the elements of b outside the pivot among which one of those must be.
    """
    theta = percent / (100 + percent)
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    left = written(left.join(pairs.select("a").distinct(), "a", "left_semi"), "left")  # so that a hot pivot can be split
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    both = pairs.join(right, "b").join(left, "a").withColumn("both", F.size(F.array_intersect("ia", "ib")))
    smallest = F.greatest("least", F.ceil(F.col("nb") * percent / 100))
    both = both.withColumn("need", F.when(F.col("star"), F.ceil((F.col("nb") + smallest) * theta - F.col("both") - 1e-9)))
    outside = F.array_sort(F.array_except("ib", "ia"))
    both = both.withColumn("rest", F.when(F.col("star"), F.slice(outside, 1, F.greatest(F.lit(0), F.size(outside) - F.greatest("need", F.lit(1)).cast("int") + 1))))
    similar = F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent
    return both.select("a", "b", "star", "nb", "both", "need", "rest", similar.alias("similar"))


def links(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Labels (node, component) of the classes that are linked; ``buckets``: key, node, n, score, open.

    A bucket's pivot is its open member of the highest score (one that no pivot was similar
    to yet); buckets without an open member have nothing left to find.
    """
    theta = percent / (100 + percent)
    edges, pending = None, buckets
    for round_ in count():
        heads = pending.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max("open").alias("any"), F.max_by("node", F.struct("open", "score", -F.col("node"))).alias("pivot"))
        marked = written(pending.join(heads.where("members > 1 AND any").drop("any"), "key"), "buckets")
        if marked.isEmpty():
            break
        few = F.col("members") <= min(SMALL * 4**round_, MOST)
        near = lambda x, y: F.least(x["n"], y["n"]) * 100 >= F.greatest(x["n"], y["n"]) * percent
        small = marked.where(few).groupBy("key").agg(F.collect_set(F.struct("node", "n")).alias("m"))
        small = small.select("m", F.explode("m").alias("x")).select("x", F.explode(F.filter("m", lambda y: (y["node"] > F.col("x")["node"]) & near(F.col("x"), y))).alias("y"))
        small = small.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.lit(False).alias("star"), F.lit(0).cast("long").alias("least")).distinct()
        star = marked.where(~few & (F.col("node") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("node").alias("b"), "n").distinct()
        family = star.groupBy("a").agg(F.min("n").alias("least"))
        star = star.join(family, "a").select("a", "b", F.lit(True).alias("star"), "least")
        found = written(compared(written(small.union(star), "pairs"), sets, percent), "compared")
        new = found.where("similar").select("a", "b")
        edges = new if edges is None else edges.union(new)

        members = found.where("star").select("a", F.col("b").alias("node"), F.col("nb").alias("n"), F.col("both").cast("long").alias("score"), "need", "rest", (~F.col("similar")).alias("open"))
        by_element = members.withColumn("element", F.explode("rest")).select(F.xxhash64("a", "element").alias("key"), "node", "n", "score", "open")
        free = members.where("need <= 0")
        reach = free.where("open").groupBy("a").agg(F.max(F.col("score") / theta - F.col("n")).alias("reach"))
        left = free.join(reach, "a").where(F.col("open") | (F.col("n") <= F.col("reach") + 1e-9))
        pending = by_element.union(left.select(F.xxhash64("a", F.lit("rest"), F.lit(round_)).alias("key"), "node", "n", "score", "open")).distinct()
    return None if edges is None else components(edges)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_ = written(described(ids, percent), "sketches")
    known = all_.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = ["print_hi", "print_lo"]
    classes = written(known.groupBy(*same).agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    keyed = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = written(keyed.join(shared, "key"), "shared")
    central = buckets.groupBy("node").agg(F.sum("members").alias("score"))
    buckets = written(buckets.drop("members").join(central, "node").select("key", "node", "n", "score", F.lit(True).alias("open")), "scored")
    compared = buckets.select(F.col("node").alias("doc_id")).distinct()
    sets = bucketed(with_sets(only_wanted(ids, compared)))
    labels = links(buckets, sets, percent)

    # a document of several classes (rows that share its doc_id) joins them
    torn = written(known.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("lo"), F.max(F.struct(*same)).alias("hi")).where("lo != hi").select("doc_id"), "torn")
    if not torn.isEmpty():
        member = known.join(torn, "doc_id", "left_semi").join(classes.drop("bands", "n"), same).select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
        labels = components(member if labels is None else member.union(labels.select("node", "component")))
    class_of = classes.select(*same, "node")
    if labels is not None:
        class_of = class_of.join(labels, "node", "left").select(*same, F.coalesce("component", "node").alias("node"))
    placed = all_.drop("bands").join(class_of, same, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("node")).otherwise(F.col("doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicate(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The same columns; of each group of near duplicates the document with the smallest id stays.

    A document is all rows of its id; of rows that repeat both id and text one stays.
    """
    found = written(near_duplicates(docs, percent).select("doc_id", "kept"), "found")
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    hinted = with_hint(docs, gone, hint := unused(docs, "gone_"))  # texts that stay are not shuffled
    doubtful, gone = hinted.where(hint).drop(hint), gone.withColumnRenamed("doc_id", hint)
    left = hinted.where(~F.col(hint)).drop(hint).union(doubtful.join(gone, doubtful.doc_id == gone[hint], "left_anti"))
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return left
    key = [F.col("doc_id"), F.xxhash64("text")]
    copy = unused(docs, "copy_")
    one = W.partitionBy(*key).orderBy(F.octet_length("text"))
    return left.withColumn(copy, F.row_number().over(one)).where((F.col(copy) == 1) | F.col("doc_id").isNull()).drop(copy)
