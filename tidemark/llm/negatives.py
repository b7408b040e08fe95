"""Hard-negative mining by bit-sliced integer products.

Vectors become integers (each component floor(256 x)) and are packed in blocks as
bit-planes: plane b of a block holds bit b of every component, the top plane being the
sign. A score is the sum over planes of the plane's weight times (anchor . plane), so after
the planes from the top down to bit t it is known to lie in an interval that the lower
bits cannot leave. Planes are processed most significant first; after each one intervals are
tightened and candidates that cannot qualify any more are dropped. Only what is left at the
last plane has an exact score.

Anchors are a stated query set against all rows: blocks of anchors meet blocks of rows, and
a block of rows is read once for every part of the anchors. Nothing is collected to the
driver; of a task's rows each anchor keeps its best few, and these are merged by anchor.

An anchor's positives are the best rows of its label; its negatives are, for each positive,
the best rows of other labels whose score lies from ``low`` percent of the positive's score
up to ``high`` percent of it (a positive below 0 has none). Ties go to the smaller id.

Edge cases: rows with a null id, a null label, a null vector, or a null or non-finite
component take no part, nor do components of 32,768 or more or vectors of over 65,536
components, whose scores could leave a long. Shorter vectors count as if zeros followed; an
empty one scores 0 everywhere. Rows that repeat one another all count, but no row is another
row of an anchor with its id, and of anchors with the same id the smallest (label, vector)
counts. Anchors without rows of another label in range give no rows; an empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import batches, small_batches, written

SCALE = 256
#: Components in a block of candidates; rows in a block of anchors; anchors whose best scores a task keeps before it hands them on.
CELLS, ANCHORS, KEPT = 1 << 18, 256, 50_000
#: Bytes in an Arrow batch that pairs of blocks travel in.
BATCH_BYTES = 8_000_000
#: Share of a block's pairs below which they are followed one by one.
SPARSE = 0.05
LARGEST, LONGEST = 1 << 15, 1 << 16
BLOCK = "n int, d int, bits int, ids binary, labels binary, planes binary"
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(rows: DataFrame, ident: str, label: Column, vector: str) -> DataFrame:
    """``id, label, x``: the rows that take part, components as integers."""
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < LARGEST)) & (F.size(vector) <= LONGEST)
    took = rows.where(F.col(ident).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & sound)
    whole = F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE).cast("int"))
    return took.select(F.col(ident).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("x"))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def weight(k: int, bits: int) -> int:
    """What plane k from the top stands for; the top one is the sign."""
    return -(1 << (bits - 1)) if k == 0 else 1 << (bits - 1 - k)


def sliced(x: np.ndarray) -> tuple[int, bytes]:
    """(bits, planes): two's complement of all components, most significant plane first."""
    bits = int(np.maximum(x, ~x).max(initial=0)).bit_length() + 1
    return bits, np.packbits(np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).astype(np.uint8)).tobytes()


class Block:
    """Rows of a packed block, with their planes."""

    def __init__(self, n: int, d: int, bits: int, ids: bytes, labels: bytes, planes: bytes) -> None:
        self.d, self.bits = d, bits
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.planes = np.unpackbits(np.frombuffer(planes, np.uint8), count=bits * n * d).reshape(bits, n, d)

    def integers(self) -> np.ndarray:
        return sum(self.planes[k].astype(np.int64) * weight(k, self.bits) for k in range(self.bits))


def blocks(rows: DataFrame, size: int | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows packed, sorted by label in each block; ``extra`` columns of longs become a binary each.

    A block has ``size`` rows, or as many as have some ``CELLS`` components.
    """
    longs = ("ids", "labels", *extra)
    ddl = ", ".join([BLOCK, *(f"{c} binary" for c in extra)])

    def packed(rows: pa.Table) -> pa.RecordBatch:
        values = [rows.column(c).to_numpy().astype(np.int64) for c in ("id", "label", *extra)]
        order = np.lexsort((values[0], values[1]))
        x = matrix(rows.column("x").combine_chunks())[order]
        bits, planes = sliced(x)
        cells = {"n": len(x), "d": x.shape[1], "bits": bits, "planes": planes} | {c: v[order].tobytes() for c, v in zip(longs, values, strict=True)}
        return pa.RecordBatch.from_arrays([pa.array([cells[c.split()[0]]], pa.int32() if c.endswith(" int") else pa.binary()) for c in ddl.split(", ")], [c.split()[0] for c in ddl.split(", ")])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches(it):
            held.append(b)
            n, components = sum(h.num_rows for h in held), sum(len(h.column(h.schema.get_field_index("x")).flatten()) for h in held)
            most = size or max(16, CELLS // max(1, components // n))
            if n >= most:
                whole = pa.Table.from_batches(held)
                for start in range(0, n - n % most, most):
                    yield packed(whole.slice(start, most))
                held = whole.slice(n - n % most).to_batches()
        if held:
            yield packed(pa.Table.from_batches(held))

    return rows.mapInArrow(run, ddl)


def qualifying(a: np.ndarray, block: Block, rows: np.ndarray, fit: np.ndarray, low: np.ndarray, high: np.ndarray, best: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, exact score) of the pairs of ``fit`` (anchors, rows) whose score is in ``[low, high]`` of the anchor.

    With ``best``, pairs that cannot be among an anchor's so many best may be left out: its
    ``best``-th largest lower bound is a floor for all its pairs. Float products are exact,
    as no partial sum leaves the type's integers.
    """
    d = min(a.shape[1], block.d)
    a, low = a[:, :d], low.copy()
    reach = int(np.abs(a).sum(axis=1).max(initial=0)) << block.bits
    kind = np.float32 if reach < 1 << 24 else np.float64 if reach < 1 << 53 else np.int64
    exact = np.int64 if kind == np.int64 else np.float64
    plus, minus, left = np.maximum(a, 0).sum(axis=1), np.minimum(a, 0).sum(axis=1), a.astype(kind)
    score, alive, pairs = np.zeros((len(a), len(rows)), kind), fit, None
    for k in range(block.bits):
        bit, w, rest = block.planes[k][:, :d], kind(weight(k, block.bits)), (1 << (block.bits - 1 - k)) - 1
        # what the lower planes add to a component of the row lies between 0 and rest
        if pairs is None:
            score += w * (left @ bit[rows].T.astype(kind))
            floor, ceiling = (score.astype(exact) + (rest * m)[:, None] for m in (minus, plus))
            if best and alive.shape[1] >= best:
                sure = np.where(alive & (floor >= low[:, None]) & (ceiling <= high[:, None]), floor, exact(LEAST))
                low = np.maximum(low, np.partition(sure, -best, axis=1)[:, -best].astype(np.int64))
            alive = alive & (ceiling >= low[:, None]) & (floor <= high[:, None])
            keep = alive.any(axis=0)
            rows, score, alive = rows[keep], score[:, keep], alive[:, keep]
            if not rows.size:
                break
            if alive.mean() < SPARSE:
                pairs = np.nonzero(alive)
                score = score[pairs]
        else:
            i, c = pairs
            score = score + w * np.einsum("ij,ij->i", left[i], bit[rows[c]].astype(kind))
            known = score.astype(exact)
            keep = (known + rest * plus[i] >= low[i]) & (known + rest * minus[i] <= high[i])
            pairs, score = (i[keep], c[keep]), score[keep]
    if pairs is None:
        pairs = np.nonzero(alive)
        score = score[pairs]
    return pairs[0], rows[pairs[1]], score.astype(np.int64)


class Anchors:
    """A block of anchors in a task, and the best rows of each of their slots so far."""

    def __init__(self, block: Block, scores: list[np.ndarray] | None, k: int, low: int, high: int) -> None:
        self.x, self.ids, self.labels, self.k = block.integers(), block.ids, block.labels, k
        m = len(self.ids)
        if scores is None:  # positives: one slot for each anchor, any score
            self.low, self.high = np.full((m, 1), LEAST), np.full((m, 1), MOST)
        else:  # negatives: a slot for each positive; one below 0 has an empty range
            p = np.stack(scores, axis=1)
            self.low, self.high = np.where(p < 0, MOST, -(-low * p // 100)), np.where(p < 0, LEAST, high * p // 100)
        self.slots = self.low.shape[1]
        self.slot, self.score, self.row = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = self.low.copy()  # below it no score can enter a slot any more

    def meet(self, block: Block, same: bool) -> None:
        """Take in a block of rows: those of the anchors' labels, or those of others."""
        found = []
        if same:
            for label in np.unique(self.labels):
                mine, rows = np.flatnonzero(self.labels == label), np.arange(*np.searchsorted(block.labels, [label, label + 1]))
                if rows.size:
                    fit = self.ids[mine][:, None] != block.ids[rows]
                    i, c, s = qualifying(self.x[mine], block, rows, fit, self.floor[mine, 0], self.high[mine, 0], self.k)
                    found.append((mine[i], c, s))
        else:
            mine = np.flatnonzero((self.low <= self.high).any(axis=1))
            open_ = self.low[mine] <= self.high[mine]
            low = np.where(open_, self.floor[mine], MOST).min(axis=1, initial=MOST)
            high = np.where(open_, self.high[mine], LEAST).max(axis=1, initial=LEAST)
            i, c, s = qualifying(self.x[mine], block, np.arange(len(block.ids)), self.labels[mine][:, None] != block.labels, low, high)
            found.append((mine[i], c, s))
        for i, c, s in found:
            for slot in range(self.slots):
                into = (s >= self.floor[i, slot]) & (s <= self.high[i, slot])
                self.add(i[into] * self.slots + slot, s[into], block.ids[c[into]])

    def add(self, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        if not slot.size:
            return
        slot, score, row = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.row, row)))
        order = np.lexsort((row, -score, slot))
        slot, score, row = slot[order], score[order], row[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        self.slot, self.score, self.row = (x[place < self.k] for x in (slot, score, row))
        full = slot[place == self.k - 1]
        self.floor.reshape(-1)[full] = np.maximum(self.floor.reshape(-1)[full], score[place == self.k - 1])

    def best(self) -> pa.RecordBatch:
        found = (self.ids[self.slot // self.slots], self.slot % self.slots, self.score, self.row)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["anchor_id", "place", "score", "id"])


def best_rows(candidates: DataFrame, anchors: DataFrame, k: int, extra: tuple[str, ...] = (), low: int = 0, high: int = 0) -> DataFrame:
    """``anchor_id, place, score, id, rank``: the ``k`` best rows of every slot; blocks of rows meet blocks of anchors."""
    names = [c.split()[0] for c in BLOCK.split(", ")]
    met = candidates.crossJoin(anchors.select(*(F.col(c).alias(f"a_{c}") for c in (*names, *extra))))  # blocks, not rows

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Anchors] = {}
        block, last = None, None
        for b in batches(it):
            for row in b.to_pylist():
                if row["ids"] != last:
                    block, last = Block(*(row[c] for c in names)), row["ids"]
                if row["a_ids"] not in held:
                    if len(held) * ANCHORS > KEPT:
                        yield from (a.best() for a in held.values())
                        held.clear()
                    scores = [np.frombuffer(row[f"a_{c}"], np.int64) for c in extra]
                    held[row["a_ids"]] = Anchors(Block(*(row[f"a_{c}"] for c in names)), scores or None, k, low, high)
                held[row["a_ids"]].meet(block, not extra)
        yield from (a.best() for a in held.values())

    found = met.mapInArrow(run, "anchor_id long, place long, score long, id long")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor: Column, label: Column | None = None, ident: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says which rows are anchors, in columns of ``rows``; ``label`` is the label column unless another is given.
    """
    spark = rows.sparkSession
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    label = F.col("label") if label is None else label
    all_ = written(blocks(quantised(rows, ident, label, vector)), "negatives-rows")
    one = quantised(rows.where(anchor), ident, label, vector).groupBy("id").agg(F.min(F.struct("label", "x")).alias("v"))
    asking = written(one.select("id", "v.label", "v.x"), "negatives-anchors")
    parts = max(1, asking.count() // (16 * ANCHORS))  # full blocks, however the anchors were dealt
    first = best_rows(all_, written(blocks(asking.coalesce(parts), ANCHORS), "negatives-asking"), positives)
    near = written(first.select("anchor_id", (F.col("rank") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    scores = [F.coalesce(F.max(F.when(F.col("place") == j, F.col("positive_score"))), F.lit(-1).cast("long")).alias(f"p{j}") for j in range(positives)]
    with_scores = asking.join(near.groupBy("anchor_id").agg(*scores), asking.id == F.col("anchor_id")).drop("anchor_id")
    names = tuple(f"p{j}" for j in range(positives))
    second = best_rows(all_, written(blocks(with_scores.coalesce(parts), ANCHORS, names), "negatives-scored"), negatives, names, low, high)
    return second.join(near, ["anchor_id", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
