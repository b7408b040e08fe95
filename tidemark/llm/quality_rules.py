"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the corpus.

Unigrams and bigrams of lower-cased words are hashed into ``buckets`` cells. They are
counted over every document (the raw multinomial) and over every trusted one; a last
pass scores each document by the sum of log p(target) - log p(raw) over its
n-grams, divided by their number plus ``shrink``. Everything at or above ``threshold``
is kept unless a base rule fails.

Edge cases: a null or empty text has no words, fails the base rule and is not kept;
repeated rows are scored alike; an empty table gives an empty result; without trusted
documents both multinomials are the same prior and no document fails on its score.
Only doc_id and text are read; columns with clashing names do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Numbers, batches, mix64, small_batches, texts_of
from tidemark.llm.minhash import only_wanted

BUCKETS = 1 << 16
#: Words kept in a worker's cache before it starts anew; also mostly keeps a word number below 21 bits.
CACHE = 1 << 20
WORD_SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Weight of the raw distribution in the target, in n-grams for each n-gram of the target.
PRIOR = 0.125


class Vocabulary:
    """Word numbers and hashes, kept over the batches of a worker."""

    def __init__(self) -> None:
        self.numbers, self.hashes = Numbers(), np.zeros(1 << 12, np.uint64)

    def ids(self, words: list[bytes]) -> np.ndarray:
        if len(self.numbers) > CACHE:
            self.numbers = Numbers()
        known = len(self.numbers)
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        while len(self.numbers) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        fresh = [w.lower() for w in islice(reversed(self.numbers), len(self.numbers) - known)]
        self.hashes[known : len(self.numbers)] = [zlib.crc32(w) | zlib.crc32(b"+" + w) << 32 for w in reversed(fresh)]
        return ids

    def cells(self, ids: np.ndarray, buckets: int) -> np.ndarray:
        """The cell of every unigram and bigram."""
        h = self.hashes[ids]
        with np.errstate(over="ignore"):
            pairs = mix64(h[:-1] * np.uint64(3) + h[1:])
        return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def cell_sums(docs: DataFrame, buckets: int) -> DataFrame:
    """``cell, n``: the n-grams of all texts. A task adds up its own counts before the shuffle."""

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Vocabulary(), np.zeros(buckets, np.int64)
        for b in batches(rows):
            for text in texts_of(b.column(0)):
                cells = words.cells(words.ids(text.encode().split()), buckets)
                if len(cells) > buckets // 8:
                    counts += np.bincount(cells, minlength=buckets)
                else:
                    np.add.at(counts, cells, 1)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["cell", "n"])

    return docs.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The distinct ids labelled quality 1; of several labels for one id the lowest counts."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("value")).where("value = 1").select("doc_id")


def count_cells(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``cell, raw, target``: n-gram counts over all documents and over the trusted ones.

    ``trusted`` (distinct doc_id) may grow with the corpus: it is joined by sorting at any
    size, never broadcast, and only texts that its bitmap lets through are shuffled.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw, target = cell_sums(rows, buckets), cell_sums(only_wanted(rows, trusted.hint("merge")), buckets)
    none = F.lit(0).cast("long")
    both = raw.select("cell", F.col("n").alias("raw"), none.alias("target")).union(target.select("cell", none, "n"))
    return both.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> np.ndarray:
    """One log ratio for each cell. ``counts`` has at most ``buckets`` rows, whatever the corpus.

    The target is smoothed towards the raw distribution with ``prior`` times its own number of
    n-grams, so the ratios depend on shares only, not on the size of the tables. Cells that no
    document has are 0.
    """
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for cell, r, t in counts.collect():
        raw[cell], target[cell] = r, t
    out, seen = np.zeros(buckets), raw > 0
    if target.sum():
        p_raw = raw[seen] / raw.sum()
        out[seen] = np.log((target[seen] / target.sum() + prior * p_raw) / (1 + prior)) - np.log(p_raw)
    return out


def repeated_windows(ids: np.ndarray, width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more."""
    if len(ids) < width + 1:
        return 0
    if ids.max() >> 21:  # too many words for one key: number the pairs first
        pairs = np.unique((ids[:-1] << np.int64(32)) | ids[1:], return_inverse=True)[1]
        key = (pairs[:-1] << np.int64(32)) | ids[2:]
    else:
        key = (ids[:-2] << np.int64(42)) | (ids[1:-1] << np.int64(21)) | ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def apply_rules(docs: DataFrame, ratios: np.ndarray, threshold: float = -0.1, shrink: float = 32.0) -> DataFrame:
    small_batches(docs.sparkSession)
    buckets, model = len(ratios), docs.sparkSession.sparkContext.broadcast(ratios)

    def score(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, table = Vocabulary(), model.value
        for b in batches(rows):
            out: list[tuple] = []
            for text in texts_of(b.column(1)):
                ids = vocabulary.ids(text.encode().split())
                n, cells = len(ids), vocabulary.cells(ids, buckets)
                lines = [x for x in text.split("\n") if x.strip(WORD_SPACE)]
                repeats = repeated_windows(ids)
                failed = n < 50 or 100 * repeats > 50 * n
                value = float(table[cells].sum() / (len(cells) + shrink))
                out.append((n, len(text) - sum(map(text.count, WORD_SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed, not failed and value >= threshold, value))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, zip(*out, strict=True))], [x.split()[0] for x in SCORED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, SCORED)


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit both multinomials, then score every document.

    The trusted target is every document labelled quality 1; the raw side covers the whole
    corpus.
    """
    return apply_rules(docs, log_ratios(count_cells(docs, trusted_ids(labels))))
