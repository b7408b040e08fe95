"""Language identification by cross-parsing.

For each language a suffix automaton is built from labelled text. A text is parsed from
left to right into the longest phrases that occur in that language's automaton; the
language that needs the fewest phrases per letter wins, ties going to the smaller code.

Texts are lower-cased and every run of non-letters is one blank. The symbols of a batch
are cut into segments of ``SEGMENT`` symbols that are parsed side by side, all languages
at once: whole texts take part, and a cut adds at most one phrase for each language.

Every letter of the samples is a symbol of its own, whatever its script. The automata
share one double array: a state is an offset, and its move by symbol c lies at cell
state + c, marked with the state, so the table grows with the moves and not with the
number of letters.

An automaton learns about ``CHARS`` symbols from at most ``SLOTS`` labelled documents of
its language, of each at most ``LONGEST`` characters from its first letter on (bounds of
the fit, not of the prediction); no language is left out.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; without
labelled rows everything is ``und``; a single language scores 1; repeated rows are
predicted alike; an empty table gives an empty result. lang, source and doc_id are never
inputs of a prediction.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batches, small_batches, texts_of

CHARS, SLOTS, LONGEST, SEGMENT = 16_000, 64, 8_000, 256
#: Symbol 0 is the blank, 1 a letter outside the alphabet.
BLANK, STRANGE = 0, 1


class Model(NamedTuple):
    languages: list[str]
    alphabet: str  # the letters of symbols 2, 3, ...
    owner: np.ndarray  # cell state + symbol: the state whose move it holds, or -1
    target: np.ndarray  # the next state
    roots: np.ndarray


def normalise(text: str) -> str:
    return "".join(c if c.isalpha() else " " for c in text.lower())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The moves of the minimal automaton of all substrings; state 0 is the root."""
    moves, link, size, last = [{}], [-1], [0], 0
    for c in symbols:
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
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    return moves


def double_array(automata: list[list[dict[int, int]]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, target, roots) of all automata. States with many moves are placed first, at random offsets."""
    moves = [(a, s, out) for a, states in enumerate(automata) for s, out in enumerate(states)]
    span = 3 * sum(1 + len(out) for _, _, out in moves) + 1
    dice, offset, taken, cells = random.Random(7), {}, set(), set()
    for a, s, out in sorted(moves, key=lambda x: -len(x[2])):
        at = dice.randrange(span)
        while at in taken or any(at + c in cells for c in out):
            at = dice.randrange(span)
        offset[a, s] = at
        taken.add(at)
        cells.update(at + c for c in out)
    owner, target = np.full(span + width, -1, np.int32), np.zeros(span + width, np.int32)
    for a, s, out in moves:
        at = offset[a, s]
        for c, t in out.items():
            owner[at + c], target[at + c] = at, offset[a, t]
    return owner, target, np.array([offset[a, 0] for a in range(len(automata))], np.int64)


def fit(docs: DataFrame, where: Column | None = None) -> Model:
    """Learn from rows with text and lang (and ``where``): a few rows for each language."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows if where is None else rows.where(where)
    key = F.xxhash64(F.lit(11), "doc_id", F.length("text"))
    # the slot's row of the lowest hash; the text rides along in the partial aggregates
    piece = F.substring(F.regexp_replace("text", r"^\P{L}++", ""), 1, LONGEST)
    rows = rows.select("lang", key.alias("h"), piece.alias("piece")).where("piece != ''")
    chosen = rows.groupBy("lang", F.pmod("h", F.lit(SLOTS)).alias("slot")).agg(F.min(F.struct("h", "piece")).alias("row"))
    texts: dict[str, list[str]] = {}
    for lang, _, (_, text) in sorted(chosen.collect()):
        texts.setdefault(lang, []).append(text)
    samples: dict[str, str] = {}
    for lang, found in texts.items():
        sample = ""
        for t in found:
            if len(sample) < CHARS and len(sample) + len(t) < 2 * CHARS:
                sample += " " + " ".join(normalise(t).split())
        if sample.strip():
            samples[lang] = sample
    alphabet = "".join(sorted({c for s in samples.values() for c in s if c != " "}))
    symbol = {c: i + 2 for i, c in enumerate(alphabet)} | {" ": BLANK}
    automata = [suffix_automaton([symbol[c] for c in samples[lang]]) for lang in sorted(samples)]
    return Model(sorted(samples), alphabet, *double_array(automata, len(alphabet) + 2))


@lru_cache(maxsize=1)
def symbol_table(alphabet: str) -> np.ndarray:
    """The symbol of every code point; kept by the worker process."""
    out = np.fromiter((STRANGE if chr(c).isalpha() else BLANK for c in range(0x110000)), np.int32, 0x110000)
    for i, c in enumerate(alphabet):
        out[ord(c)] = i + 2
    return out


def count_phrases(symbols: np.ndarray, bounds: np.ndarray, model: Model, segment: int = SEGMENT) -> np.ndarray:
    """Phrases of each text in each language, (languages, texts). ``bounds``: where texts begin and end."""
    length = np.diff(bounds)
    pieces = -(-length // segment)
    owner = np.repeat(np.arange(len(length)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = bounds[:-1][owner] + nth * segment
    size = np.minimum(segment, bounds[1:][owner] - start)
    order = np.argsort(-size, kind="stable")
    start, size, owner = start[order], size[order], owner[order]
    langs, owners, targets, root = len(model.languages), model.owner, model.target, model.roots[:, None]
    first = root + np.arange(len(model.alphabet) + 2)
    first = np.where(owners[first] == root, targets[first], root)  # the moves of the roots; none leads back to a root
    state = np.repeat(root, len(start), axis=1)
    phrases = np.zeros((langs, len(start)), np.int32)
    live = np.searchsorted(-size, -np.arange(segment), side="left")
    for t in range(int(size[0]) if len(size) else 0):
        k = live[t]
        c = symbols[start[:k] + t].astype(np.int64)
        s = state[:, :k]
        cell = s + c
        stuck = owners[cell] != s
        phrases[:, :k] += stuck | (s == root)
        state[:, :k] = np.where(stuck, first[:, c], targets[cell])
    return np.stack([np.bincount(owner, p, len(length)) for p in phrases])


def predict_texts(texts: list[str], model: Model, table: np.ndarray, sharpness: float = 30.0) -> tuple[list[str], np.ndarray]:
    codes = np.frombuffer("\n".join(t.lower() for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = table[codes]
    ends = np.cumsum([len(t.lower()) + 1 for t in texts])
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != BLANK) | (symbols[:-1] != BLANK)
    kept = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(symbols != BLANK)])
    starts = np.concatenate([[0], ends[:-1]])
    has = letters[np.minimum(ends, len(symbols))] > letters[np.minimum(starts, len(symbols))]
    bounds = kept[np.concatenate([starts, [len(symbols)]])]
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    rate = count_phrases(symbols[keep], bounds, model) / np.maximum(np.diff(bounds), 1)
    best = rate.argmin(axis=0)
    weight = np.exp(-sharpness * (rate - rate.min(axis=0)))
    score = np.where(has, 1 / weight.sum(axis=0), 0.0)
    return [model.languages[b] if h else "und" for b, h in zip(best, has, strict=True)], score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = symbol_table(shared.value.alphabet)
        for b in batches(rows):
            langs, score = predict_texts(texts_of(b.column(1)), shared.value, table)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
