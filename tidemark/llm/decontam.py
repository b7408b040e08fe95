"""Benchmark decontamination with a generalised suffix automaton of the test items.

Test items and documents are normalised to words (A-Z lower-cased). The automaton holds
every run of words of every item; each document streams through it once, keeping the
length of the longest match that ends at the current word. Where that length reaches
``window`` words (or a whole item that is shorter) those words are hit.

The items travel to the tasks in blocks of about ``block_bytes``, one automaton at a time,
so a large benchmark costs passes, not memory; hits of all blocks are united.

Edge cases: null or empty texts have no words and no hits; an item without words matches
nothing; a null item_id reads ``null``; repeated rows are treated alike; very long texts
stream through whole; an empty
benchmark hits nothing; an empty document table gives an empty result. Other columns of
the documents pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import batches, small_batches, texts_of, unused, written

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z to a-z, what is between words to a blank, anything else to itself.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Automaton:
    """All runs of words of a set of items."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window, self.numbers = window, {}
        self.moves, self.link, self.size = [{}], [-1], [0]
        split = [(name, [self.numbers.setdefault(w, len(self.numbers)) for w in words(text)]) for name, text in items]
        for _, ids in split:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        self.anchor = [0] * len(self.moves)
        self.items: dict[int, set[str]] = {}
        whole: dict[int, list[tuple[int, str]]] = {}
        for s in sorted(range(1, len(self.moves)), key=self.size.__getitem__):
            up = self.link[s]
            self.anchor[s] = self.anchor[up] if self.size[up] >= window else s
        for name, ids in split:
            s = 0
            for i, c in enumerate(ids):
                s = self.moves[s][c]
                if i + 1 >= window:
                    self.items.setdefault(self.anchor[s], set()).add(name)
            if 0 < len(ids) < window:
                while self.size[self.link[s]] >= len(ids):
                    s = self.link[s]
                whole.setdefault(s, []).append((len(ids), name))
        #: short items that end where a state's strings end, longest first
        self.short: list[tuple] = [()] * len(self.moves)
        if whole:
            for s in sorted(range(1, len(self.moves)), key=self.size.__getitem__):
                self.short[s] = (*sorted(whole.get(s, ()), reverse=True), *self.short[self.link[s]])

    def _extend(self, last: int, c: int) -> int:
        moves, link, size = self.moves, self.link, self.size
        there = moves[last].get(c)
        if there is not None:
            return there if size[there] == size[last] + 1 else self._copy(last, c, there)
        cur = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            link[cur] = q if size[q] == size[p] + 1 else self._copy(p, c, q)
        return cur

    def _copy(self, p: int, c: int, q: int) -> int:
        moves, link, size = self.moves, self.link, self.size
        copy = len(moves)
        moves.append(dict(moves[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and moves[p].get(c) == q:
            moves[p][c] = copy
            p = link[p]
        return copy

    def stream(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit stretches of words (start, end), merged, and the items that they come from."""
        moves, link, size, anchor, short, window = self.moves, self.link, self.size, self.anchor, self.short, self.window
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        names: set[str] = set()
        s = length = 0
        get = self.numbers.get
        for i, c in enumerate(map(get, text_words)):
            if c is None:
                s = length = 0
                continue
            t = moves[s].get(c)
            if t is None:
                while s > 0 and t is None:
                    s = link[s]
                    t = moves[s].get(c)
                length = size[s]
            s, length = t or 0, length + 1
            reach = 0
            if length >= window:
                found.add(anchor[s])
                reach = window
            if short[s]:
                for n, name in short[s]:
                    if n <= length:
                        names.add(name)
                        reach = max(reach, n)
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        for a in found:
            names |= self.items[a]
        return spans, names


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


#: The automaton of the block that this worker process streamed last.
_BUILT: dict[tuple, Automaton] = {}


def built(block: list[tuple[str, str]], window: int) -> Automaton:
    """A block's automaton, built once in each worker process that tasks share."""
    key = (window, len(block), xxhash.xxh3_128_hexdigest("\0".join(f"{i}\0{t}" for i, t in block).encode()))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Automaton(block, window)
    return _BUILT[key]


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple[str, str]], bool]]:
    """The items in blocks of about ``block_bytes`` of text, one block on the driver at a time, and whether it is the last."""
    known = items.where(F.length("text") > 0).select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    total = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        yield [(r.item, r.text) for r in known.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).collect()], k == blocks - 1


def find_hits(docs: DataFrame, items: DataFrame, window: int = 10, block_bytes: int = 8_000_000, out: str = "hits_", then: Callable[[pa.RecordBatch], pa.RecordBatch] | None = None) -> DataFrame:
    """All rows and columns of ``docs`` and the struct ``out`` (n_words, starts, ends, items): the stretches of hit words.

    ``then`` turns a batch of that into one with the columns of ``docs``, in the same Python
    worker: a second pass over Arrow would hold a second worker for each task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    at, schema = docs.columns.index("text"), T.StructType([*docs.schema.fields, T.StructField(out, HITS)])
    kind = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])

    def one_pass(df: DataFrame, block: list[tuple[str, str]], first: bool, then: Callable | None) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = None
            for b in batches(rows):
                automaton = automaton or built(shared.value, window)
                before = [None] * b.num_rows if first else b.column(b.num_columns - 1).to_pylist()
                found = []
                for text, old in zip(texts_of(b.column(at)), before, strict=True):
                    split = words(text)
                    spans, names = automaton.stream(split)
                    if old:
                        spans, names = merged([*spans, *zip(old["starts"], old["ends"], strict=True)]), names | set(old["items"])
                    found.append({"n_words": len(split), "starts": [s for s, _ in spans], "ends": [e for _, e in spans], "items": sorted(names)})
                kept = b.columns if first else b.columns[:-1]
                hit = pa.RecordBatch.from_arrays([*kept, pa.array(found, kind)], [*(f.name for f in schema.fields)])
                yield then(hit) if then else hit

        return df.mapInArrow(run, docs.schema if then else schema)

    found, blocks = docs, 0
    for block, last in item_blocks(items, block_bytes):
        found = one_pass(found if blocks < 2 else written(found, "decontaminate"), block, blocks == 0, then if last else None)
        blocks += 1
    return found


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document: words, hit words, items found and their digest."""
    hits = find_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items, window)
    n_hit = F.aggregate(F.arrays_zip("hits_.starts", "hits_.ends"), F.lit(0).cast("long"), lambda n, s: n + s["ends"] - s["starts"])
    return hits.select(
        "doc_id",
        F.col("hits_.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("hits_.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits_.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def cut_text(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the given stretches of words; a line break stands for each."""
    data = text.encode()
    places = [m.span() for m in WORD.finditer(data.translate(FOLD))]
    out, done = [], 0
    for s, e in zip(starts, ends, strict=True):
        out += [data[done : places[s][0]], b"\n"]
        done = places[e - 1][1]
    return b"".join([*out, data[done:]]).decode()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.8, block_bytes: int = 8_000_000) -> DataFrame:
    """The same columns; hit stretches are cut out of the texts and a document goes if more
    than ``max_coverage`` of its words are hit."""
    at, columns = docs.columns.index("text"), docs.columns

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        hits = b.column(b.num_columns - 1).to_pylist()
        share = np.array([sum(h["ends"]) - sum(h["starts"]) for h in hits]) / np.array([max(h["n_words"], 1) for h in hits])
        texts = [t if not h["starts"] else cut_text(t, h["starts"], h["ends"]) for t, h in zip(b.column(at).to_pylist(), hits, strict=True)]
        kept = [*b.columns[:at], pa.array(texts, pa.string()), *b.columns[at + 1 : -1]]
        return pa.RecordBatch.from_arrays(kept, columns).filter(pa.array(share <= max_coverage))

    return find_hits(docs, items, window, block_bytes, unused(docs, "hits_"), cut)
