"""Repeated passages: every byte of a text that lies in a ``LENGTH``-byte string which also
starts anywhere else is removed; bytes in such strings of ``PASSAGE`` bytes (about 45 words)
are reported as shared. Texts are UTF-8 bytes; matches never cross documents.

1. Winnowing deals the work: each ``PASSAGE``-byte window is named by the smallest hash of
   its 64-byte grams. Strings that are equal over ``PASSAGE`` bytes have equal names, so
   they only meet within a name. Consecutive windows of one name form a context, which
   carries the bytes up to ``LENGTH`` behind its last window. A context that occurs twice as
   a whole (equal name, length and hash, 128 bits) is repeated as a whole and represented
   once in what follows.
2. The contexts of names with several different contexts (or with a repeat inside one) are
   sorted in lots of ``LOT_BYTES`` by two-stage suffix sorting: suffixes smaller than their
   successors are sorted directly, the others are induced by scanning buckets. The longer
   of a suffix's two adjacent common prefixes says whether its window is repeated.
3. A name with more than ``CROWDED`` bytes of different contexts would not fit one lot. Its
   windows get a second name, by 192-byte grams, and are sorted in lots of that. Only a
   name that is crowded again (its contexts share 192 of 256 bytes) is counted by window
   hash, as a plain shuffle.

Edge cases: null is the empty text; texts shorter than ``PASSAGE`` bytes keep everything;
repeated rows remove each other's windows; very long texts are read in pieces of ``CHUNK``
windows; a null doc_id is a document like others; an empty table gives an empty result.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches, mix64, small_batches, texts_of, written

LENGTH, PASSAGE, CHUNK = 400, 256, 1 << 17
#: Gram lengths of the first and of the second name.
GRAM, LONG_GRAM = 64, 192
LOT_BYTES, CROWDED = 250_000, 4_000_000
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = CHUNK + LENGTH
    return _powers(BASE, n), _powers(pow(BASE, -1, 1 << 64), n), mix64(np.arange(1, 257, dtype=np.uint64))


def named_windows(a: np.ndarray, tables: tuple, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes; name, first and last window of every context) of up to CHUNK windows of bytes."""
    up, down, byte = tables
    width = PASSAGE - gram + 1
    total = np.zeros(len(a) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(byte[a] * up[: len(a)], out=total[1:])
        grams = mix64((total[gram:] - total[:-gram]) * down[: len(a) - gram + 1])
    blocks = -(-len(grams) // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(grams)] = grams
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(grams) - width + 1
    names = np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows])
    turn = np.flatnonzero(names[1:] != names[:-1]) + 1
    first = np.concatenate([[0], turn])
    return grams, names[first], first, np.concatenate([turn, [windows]]) - 1


def contexts(data: bytes, tables: tuple, gram: int = GRAM, tail: int = LENGTH, windows: int | None = None) -> Iterator[tuple[int, int, int, int, int, bool]]:
    """(name, context hash, first window, last window, end, repeats inside) of a text's windows, the first ``windows`` or all."""
    windows = max(0, len(data) - PASSAGE + 1) if windows is None else windows
    for base in range(0, windows, CHUNK):
        part = np.frombuffer(data, np.uint8)[base : min(base + CHUNK, windows) + PASSAGE - 1]
        grams, names, first, last = named_windows(part, tables, gram)
        keys = names.view(np.int64).tolist()
        for k, (s, e) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            inside = np.count_nonzero(grams[s : e + PASSAGE - gram + 1] == names[k]) > 1
            end = min(base + e + tail, len(data))
            yield keys[k], xxhash.xxh3_64_intdigest(data[base + s : end], e - s) - (1 << 63), base + s, base + e, end, bool(inside)


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1."""
    order = np.argsort(keys)
    found = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[True], found[1:] != found[:-1]]))
    return out


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last one never is."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    step[-1] = -1
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def sort_directly(t: np.ndarray, small: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that are smaller than their successors, sorted by ``depth`` characters at least.

    From one of them to the next is a piece; pieces are ranked by their (character, kind)
    pairs, and ranks of 1, 2, 4, ... pieces are put together until they reach the depth.
    """
    pos = np.flatnonzero(small)
    if not len(pos):
        return pos
    pair = (t.astype(np.int64) + 1) * 2 + small
    size = np.minimum(np.diff(np.concatenate([pos, [len(t) - 1]])) + 1, depth)
    rank = np.zeros(len(pos), np.int64)
    for base in reversed(range(0, int(size.max()), 5)):  # from the ends of the longest pieces to all beginnings
        todo = np.flatnonzero(size > base)
        key = np.zeros(len(todo), np.int64)
        for k in range(base, base + 5):
            key = key << 10
            there = size[todo] > k
            key[there] |= pair[pos[todo[there]] + k]
        rank[todo] = _ranks((_ranks(key) << 32) | rank[todo]) if rank[todo].any() else _ranks(key)
    reach = 1
    while reach < len(pos) and (pos[reach:] - pos[:-reach]).min() < depth and rank.max() < len(pos):
        later = np.zeros(len(pos), np.int64)
        later[: len(pos) - reach] = rank[reach:]
        rank = _ranks((rank << 32) | later)
        reach *= 2
    return pos[np.argsort(rank, kind="stable")]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Two-stage suffix sorting of a text of small non-negative integers, by ``depth`` characters at least."""
    n, letters = len(t), int(t.max()) + 1 if len(t) else 0
    small = smaller_than_next(t) if n else np.zeros(0, bool)
    direct = sort_directly(t, small, depth)
    sorted_small = np.split(direct, np.searchsorted(t[direct], np.arange(1, letters)))
    induced: list[list[np.ndarray]] = [[] for _ in range(letters)]
    if n:
        induced[int(t[-1])].append(np.array([n - 1]))
    out = []
    for c in range(letters):
        todo = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        bucket = [todo]
        while len(todo):  # the same character in front of an induced suffix belongs to this bucket
            todo = todo[todo > 0] - 1
            todo = todo[t[todo] == c]
            bucket.append(todo)
        bucket.append(sorted_small[c])
        found = np.concatenate(bucket)
        out.append(found)
        ahead = found[found > 0] - 1
        ahead = ahead[t[ahead] > c]
        letter = t[ahead]
        order = np.argsort(letter, kind="stable")
        ahead, letter = ahead[order], letter[order]
        cuts = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        for part in np.split(ahead, cuts):
            if len(part):
                induced[int(t[part[0]])].append(part)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def common_prefixes(data: np.ndarray, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
    """Lengths of the common prefixes of suffix pairs of bytes, up to ``most``, eight bytes at a step."""
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded[: len(padded) // 8 * 8].view(np.uint64), (len(data) + most + 8,), (1,))
    out, live = np.full(len(left), most), np.arange(len(left))
    for k in range(0, most, 8):
        differ = eights[left + k] ^ eights[right + k]
        ends = differ != 0
        if ends.any():
            found = differ[ends]
            with np.errstate(over="ignore"):
                lowest = found & (~found + np.uint64(1))
            out[live[ends]] = k + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8
            live, left, right = live[~ends], left[~ends], right[~ends]
            if not len(live):
                break
    return np.minimum(out, most)


def longest_repeats(lot: list[bytes], windows: list[int], most: int = LENGTH) -> list[np.ndarray]:
    """For each of a context's windows, the length (up to ``most``) of what also starts at another window of the lot."""
    sizes = np.array([len(x) + 1 for x in lot])
    begins = np.cumsum(sizes) - sizes
    raw = np.frombuffer(b"\0".join(lot) + b"\0", np.uint8)
    t = raw.astype(np.int16) + 1
    t[begins + sizes - 1] = 0
    at = np.arange(len(t)) - np.repeat(begins, sizes)
    own = at < np.repeat(windows, sizes)
    room = np.repeat(sizes - 1, sizes) - at
    order = suffix_array(t, most)
    order = order[own[order]]
    found = np.zeros(len(t), np.int64)
    if len(order) > 1:
        left, right = order[:-1], order[1:]
        same = np.minimum(common_prefixes(raw, left, right, most), np.minimum(room[left], room[right]))
        np.maximum.at(found, left, same)
        np.maximum.at(found, right, same)
    return [found[b : b + k] for b, k in zip(begins, windows, strict=True)]


def stretches(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Window starts as covered stretches (start, end)."""
    if not len(starts):
        return []
    turn = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], turn + 1])].tolist(), (starts[np.concatenate([turn, [len(starts) - 1]])] + length).tolist(), strict=True))


def both_stretches(repeats: np.ndarray, base: int = 0) -> list[tuple[int, int, bool]]:
    """(start, end, to be removed) of what windows with these repeat lengths cover."""
    return [(base + s, base + e, length == LENGTH) for length in (LENGTH, PASSAGE) for s, e in stretches(np.flatnonzero(repeats >= length), length)]


KEY = ["key", "print"]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows are told apart by id and text; equal rows are treated alike."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("key"),
        F.xxhash64("text").alias("print"),
        "text",
    )


def _records(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = _tables()
    for b in batches(rows):
        out: list[tuple] = []
        for key, print_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), strict=True):
            out += [(key, print_, *c) for c in contexts(text.encode(), tables)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], RECORD)


def _cut_out(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        out = []
        for key, print_, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b.column(2)), b.column(3).to_pylist(), strict=True):
            data = text.encode()
            out += [(w["name"], w["n"], w["crowded"], key, print_, w["first"], w["last"], data[w["first"] : w["end"]]) for w in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["name", "n", "crowded", *KEY, "first", "last", "data"])


def _spans(out: list[tuple]) -> Iterator[pa.RecordBatch]:
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*KEY, "start", "end", "gone"])


def _compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, n, key, print, first, last, data) come sorted by name; a lot ends between names once it is large enough."""
    lot: list[tuple] = []
    size, before = 0, None

    def done() -> Iterator[pa.RecordBatch]:
        repeats = longest_repeats([x[-1] for x in lot], [x[5] - x[4] + 1 for x in lot])
        yield from _spans([(x[2], x[3], *span) for x, found in zip(lot, repeats, strict=True) if x[1] == 1 for span in both_stretches(found, x[4])])

    for b in batches(rows):
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != before and size >= LOT_BYTES:
                yield from done()
                lot, size = [], 0
            lot.append(row)
            size += len(row[-1])
            before = row[0]
    if lot:
        yield from done()


def _renamed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts of crowded names, dealt again by long grams."""
    tables = _tables()
    for b in batches(rows):
        for name, n, key, print_, first, last, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out = []
            for second, context, s, e, end, inside in contexts(data, tables, LONG_GRAM, windows=last - first + 1):
                both = xxhash.xxh3_64_intdigest(f"{name} {second}") - (1 << 63)
                out.append((key, print_, both, context, first + s, first + e, first + end, inside, n, data[s:end]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*RECORD, "n", "data"])


def _windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each window (of either length) of contexts that are crowded under both names."""
    up, down, byte = _tables()
    for b in batches(rows):
        for name, n, key, print_, first, last, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            a = np.frombuffer(data, np.uint8)
            for length in (PASSAGE, LENGTH):
                k = min(last - first + 1, len(a) - length + 1)
                if k > 0:
                    halves = []
                    for salt in (0, 1):
                        total = np.zeros(len(a) + 1, np.uint64)
                        with np.errstate(over="ignore"):
                            np.cumsum(mix64(byte[a] + np.uint64(salt)) * up[: len(a)], out=total[1:])
                            halves.append(mix64((total[length : length + k] - total[:k]) * down[:k]).view(np.int64))
                    columns = [np.full(k, name), np.full(k, length), *halves, np.full(k, n), np.full(k, key), np.full(k, print_), np.full(k, first), np.arange(first, first + k)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [x.split()[0] for x in WINDOW.split(", ")])


def _merged(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches(rows):
        found = zip(*(c.to_pylist() for c in b.columns), strict=True)
        yield from _spans([(key, print_, s, e, length == LENGTH) for key, print_, length, starts in found for s, e in stretches(np.sort(starts), length)])


RECORD = [*KEY, "name", "context", "first", "last", "end", "inside"]
RECORDS = "key long, print long, name long, context long, first long, last long, end long, inside boolean"
PIECE = "name long, n long, key long, print long, first long, last long, data binary"
WINDOW = "name long, length long, hi long, lo long, n long, key long, print long, first long, start long"
SPAN = "key long, print long, start long, end long, gone boolean"


def _whole(copied: DataFrame) -> DataFrame:
    """The spans of contexts that are repeated as a whole."""
    shared = copied.select(*KEY, F.col("first").alias("start"), (F.col("last") + PASSAGE).alias("end"), F.lit(False).alias("gone"))
    gone = copied.where(F.col("end") - F.col("first") >= LENGTH).select(*KEY, F.col("first").alias("start"), "end", F.lit(True).alias("gone"))
    return shared.union(gone)


def _compared(pieces: DataFrame) -> DataFrame:
    return pieces.select([x.split()[0] for x in PIECE.split(", ")]).repartition("name").sortWithinPartitions("name").mapInArrow(_compare, SPAN)


def _crowded(groups: DataFrame) -> DataFrame:
    """The names whose different contexts (one row each) do not fit one lot."""
    return groups.groupBy("name").agg(F.sum(F.col("end") - F.col("first")).alias("bytes")).where(F.col("bytes") > CROWDED).select("name", F.lit(True).alias("crowded"))


def _crowded_spans(pieces: DataFrame) -> DataFrame:
    """What the pieces of crowded names repeat: sorted under their second names, or counted if these are crowded too."""
    again = written(pieces.mapInArrow(_renamed, f"{RECORDS}, n long, data binary"), "renamed")
    name = ["name", "context"]
    groups = again.groupBy(*name).agg(
        F.sum("n").alias("total"), F.max("inside").alias("inside"), F.min(F.struct(*KEY, "first", "last", "end", "data")).alias("at")
    )
    groups = written(groups.select(*name, "total", "inside", "at.*"), "regrouped")
    spans = _whole(again.where("n = 1").join(groups.where("total > 1").select(*name), name, "left_semi"))
    names = groups.groupBy("name").agg(F.count(F.lit(1)).alias("several"), F.max("inside").alias("any")).where("several > 1 OR any").select("name")
    open_ = groups.join(names, "name", "left_semi").join(_crowded(groups), "name", "left").withColumnRenamed("total", "n")
    spans = spans.union(_compared(open_.where("crowded IS NULL")))
    windows = written(open_.where("crowded").select([x.split()[0] for x in PIECE.split(", ")]).mapInArrow(_windows, WINDOW), "windows")
    window = ["name", "length", "hi", "lo"]
    more = windows.groupBy(*window).agg(F.sum("n").alias("total")).where("total > 1").select(*window)
    starts = windows.where("n = 1").join(more, window, "left_semi").groupBy(*KEY, "first", "length").agg(F.collect_list("start").alias("starts"))
    return spans.union(starts.select(*KEY, "length", "starts").mapInArrow(_merged, SPAN))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``key, print, start, end, gone``: stretches of bytes that are repeated, overlapping ones included;
    gone: covered by strings of ``LENGTH``, else of ``PASSAGE`` bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = _keyed(docs)
    records = written(keyed.select(*KEY, "text").mapInArrow(_records, RECORDS), "contexts")
    names = (
        records.groupBy("name")
        .agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"), F.max("inside").alias("inside"))
        .where("n > 1 OR inside")
        .select("name", (F.col("lo") < F.col("hi")).alias("several"))
    )
    shared = written(records.join(names, "name"), "shared")
    groups = shared.groupBy("name", "context").agg(
        F.count(F.lit(1)).alias("n"), F.max("inside").alias("inside"), F.max("several").alias("several"), F.min(F.struct(*KEY, "first", "last", "end")).alias("at")
    )
    groups = written(groups.select("name", "context", "n", "inside", "several", "at.*"), "groups")
    spans = _whole(shared.join(groups.where("n > 1").select("name", "context"), ["name", "context"], "left_semi"))

    open_ = groups.where("several OR inside")
    crowded = written(_crowded(open_), "crowded")
    open_ = open_.join(crowded, "name", "left").withColumn("crowded", F.col("crowded").isNotNull())
    wanted = open_.groupBy(*KEY).agg(F.collect_list(F.struct("name", "n", "crowded", "first", "last", "end")).alias("wanted"))
    pieces = keyed.select(*KEY, "text").join(wanted, KEY).mapInArrow(_cut_out, "name long, n long, crowded boolean, key long, print long, first long, last long, data binary")
    pieces = written(pieces, "pieces")
    spans = spans.union(_compared(pieces.where("NOT crowded")))
    if not crowded.isEmpty():
        spans = spans.union(_crowded_spans(pieces.where("crowded").drop("crowded")))
    return spans


def merged(found: list[dict]) -> list[tuple[int, int]]:
    """Spans in order, overlapping and adjoining ones put together."""
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in found):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _removed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    shown = lambda spans: [{"start": s, "end": e} for s, e in spans]
    for b in batches(rows):
        sizes, gone, shared, kept = [], [], [], []
        for text, found in zip(texts_of(b.column(1)), b.column(2).to_pylist(), strict=True):
            data = text.encode()
            cut = merged([x for x in found or () if x["gone"]])
            ends = [0, *(x for m in cut for x in m), len(data)]
            sizes.append(len(data))
            gone.append(shown(cut))
            shared.append(shown(merged(found or [])))
            kept.append(b"".join(data[s:e] for s, e in zip(ends[::2], ends[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, kind), pa.array(kept, pa.binary()), pa.array(shared, kind)], ["doc_id", "n_bytes", "spans", "kept", "shared"]
        )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans, kept, shared``: the removed stretches of every text, the bytes that stay,
    and all stretches that are repeated over ``PASSAGE`` bytes or more."""
    spans = repeated_spans(docs).groupBy(*KEY).agg(F.collect_set(F.struct("start", "end", "gone")).alias("found"))
    joined = _keyed(docs).join(spans, KEY, "left").select("doc_id", "text", "found")
    span = "array<struct<start:long,end:long>>"
    return joined.mapInArrow(_removed, f"doc_id long, n_bytes long, spans {span}, kept binary, shared {span}")
