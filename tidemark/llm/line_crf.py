"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is described by shares of byte classes and word repetitions, together with the
same numbers for the lines before and after it. The field has two states, bad and good.
The length-weighted mean of its forward-backward marginals is the document's quality.

Training labels come from documents: every line carries its document's label. At most
``max_docs`` labelled documents (those of the lowest hash) are learned from, of each its
first ``max_lines`` lines; of rows that repeat a labelled id the smallest text counts; only
their numbers, no texts, reach the driver. Scoring always reads whole texts.

Edge cases: a null or empty text is one empty line and gets that line's marginal; without
labelled documents every score is 0.5; very long texts are labelled whole; repeated rows score
alike; an empty table gives an empty result. Only doc_id and text are read for scoring.

A task holds the numbers of about ``SLICE_BYTES`` of text (or of one longer text) at a time
and keeps no words, so its memory grows neither with the vocabulary nor with the texts of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches, labelled_ids, slices, small_batches, texts_of

MAX_DOCS, MAX_LINES = 3_000, 512
FEATURES = 14
#: Bytes of text that are described at a time.
SLICE_BYTES = 1 << 21


def _classes() -> np.ndarray:
    """For each byte, counters packed 32 bits apart: [upper | lower], [mark | digit], [high | bang-like], [bar | end]."""
    t = np.zeros((4, 256), np.int64)
    for c in range(256):
        ch = chr(c)
        t[0, c] = ("A" <= ch <= "Z") | ("a" <= ch <= "z") << 32
        t[1, c] = (ch in "#*$%&<>=~^@\\{}[]_+/") | ("0" <= ch <= "9") << 32
        t[2, c] = (c >= 0xC0) | (ch in "!?") << 32
        t[3, c] = (ch == "|") | (ch in ".,;:") << 32
    return t


CLASSES = _classes()
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, line lengths in bytes, first line of each text and the end)."""
    data = [t.encode() for t in texts]
    blob = b"\n".join(data) + b"\n"
    a = np.frombuffer(blob, np.uint8)
    ends = np.flatnonzero(a == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = (ends - starts).astype(np.float64)
    counts = []
    for t in CLASSES:
        packed = np.add.reduceat(t[a], starts)
        counts += [packed & 0xFFFFFFFF, packed >> 32]
    upper, lower, mark, digit, high, bang, bar, stop = (c.astype(np.float64) for c in counts)
    space = SPACE[a]
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    line = np.searchsorted(ends, first)
    words = blob.split()
    same = np.fromiter(map(eq, words, words[1:]), bool, max(len(words) - 1, 0))
    n = np.bincount(line, minlength=len(ends)).astype(np.float64)
    runs = np.bincount(line[1:][same & (line[1:] == line[:-1])], minlength=len(ends))
    begins = np.where(size > 0, a[np.minimum(starts, len(a) - 1)], 0)
    closes = np.where(size > 0, a[np.maximum(ends - 1, 0)], 0)
    per, some = np.maximum(size, 1), np.maximum(n, 1)
    x = np.stack(
        [
            np.log1p(size) / 8, n == 0, upper / np.maximum(upper + lower, 1), mark / per * 4, digit / per, high / per, bang / some, bar / some,
            stop / some, runs / some, (size - n) / some / 16, n < 3, (begins >= 65) & (begins <= 90), np.isin(closes, list(b".!?")),
        ],
        axis=1,
    ).astype(np.float64)
    breaks = np.cumsum([0] + [d.count(b"\n") + 1 for d in data])
    return x, size, breaks


def with_neighbours(x: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """[line, line before, line after, 1]; zeros beyond a text's ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[breaks[:-1]] = 0
    after[breaks[1:] - 1] = 0
    return np.concatenate([x, before, after, np.ones((len(x), 1))], axis=1)


def forward_backward(unary: np.ndarray, trans: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each line (n, 2) and summed pair marginals (2, 2), all texts in step."""
    length = np.diff(breaks)
    order = np.argsort(-length, kind="stable")
    start, length = breaks[:-1][order], length[order]
    e, steps = np.exp(trans), int(length.max()) if len(length) else 0
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]  # texts with more than t lines
    u = np.exp(unary - unary.max(axis=1, keepdims=True))
    alpha, beta = np.empty_like(u), np.ones_like(u)
    for t in range(steps):
        at = start[: live[t]] + t
        a = u[at] if t == 0 else (alpha[at - 1] @ e) * u[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = start[: live[t + 1]] + t
        right = u[at + 1] * beta[at + 1]
        b = right @ e.T
        both = alpha[at][:, :, None] * e[None] * right[:, None, :]
        pairs += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[at] = b / b.sum(axis=1, keepdims=True)
    m = alpha * beta
    return m / m.sum(axis=1, keepdims=True), pairs


def train(x: np.ndarray, breaks: np.ndarray, y: np.ndarray, steps: int = 120, rate: float = 0.15, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum conditional likelihood by Adam. ``y``: the label of each text."""
    length = np.diff(breaks)
    label = np.repeat(y, length)
    z = with_neighbours(x, breaks)
    pairs_seen = np.zeros((2, 2))
    for k in (0, 1):
        pairs_seen[k, k] = (length[y == k] - 1).sum()
    theta = np.zeros(2 * z.shape[1] + 4)
    m, v, lines = np.zeros_like(theta), np.zeros_like(theta), max(len(label), 1)
    seen = np.stack([z[label == k].sum(axis=0) for k in (0, 1)], axis=1)
    for i in range(1, steps + 1):
        w, trans = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        p, pairs = forward_backward(z @ w, trans, breaks)
        grad = np.concatenate([(z.T @ p - seen).ravel(), (pairs - pairs_seen).ravel()]) / lines + decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)


def score_texts(texts: list[str], model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    x, size, breaks = line_features(texts)
    p, _ = forward_backward(with_neighbours(x, breaks) @ model[0], model[1], breaks)
    weight = size + 1
    return np.add.reduceat(p[:, 1] * weight, breaks[:-1]) / np.add.reduceat(weight, breaks[:-1])


def fit(docs: DataFrame, labels: DataFrame, where=None, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> tuple[np.ndarray, np.ndarray]:
    """Train on a bounded sample of labelled documents; ``where`` selects the rows that may be learned from."""
    small_batches(docs.sparkSession)
    sample = labelled_ids(labels, "quality", max_docs, where)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "value").agg(F.min("text").alias("text"))
    rows = rows.select("text", F.col("value").cast("int").alias("y"))

    def describe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches(it):
            for start, length in slices(whole.column(0), SLICE_BYTES):
                b = whole.slice(start, length)
                x, _, breaks = line_features(texts_of(b.column(0)))
                found = [x[s : min(e, s + max_lines)].astype(np.float32).tobytes() for s, e in zip(breaks[:-1], breaks[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column(1)], ["x", "y"])

    got = sorted((bytes(r.x), r.y) for r in rows.mapInArrow(describe, "x binary, y int").collect())
    if not got:
        return np.zeros((3 * FEATURES + 1, 2)), np.zeros((2, 2))
    xs = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for x, _ in got]
    breaks = np.cumsum([0] + [len(x) for x in xs])
    return train(np.concatenate(xs).astype(np.float64), breaks, np.array([min(max(y, 0), 1) for _, y in got]))


def add_score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and the quality, a double from 0 to 1, in column ``out``."""
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            parts = [score_texts(texts_of(b.column(at).slice(start, length)), shared.value) for start, length in slices(b.column(at), SLICE_BYTES)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(parts))], [*b.schema.names, out])

    return docs.mapInArrow(score, schema)
