"""What a Python task holds does not grow with the vocabulary, the texts of a batch or the steps of an operator."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import tables

from tidemark.llm import decontam, line_crf


def batch(first, texts, words):
    """``texts`` texts of ``words`` words each that no other batch has."""
    said = (" ".join(f"w{i}" for i in range(s, s + words)) for s in range(first, first + texts * words, words))
    return pa.RecordBatch.from_arrays([pa.array(range(texts), pa.int64()), pa.array(said)], ["doc_id", "text"])


@pytest.mark.parametrize(("n", "texts", "words", "most"), [(60, 1, 5_000, 8e6), (1, 200, 10_000, 100e6)], ids=["vocabulary", "long_texts"])
def test_scoring_holds_a_slice_and_no_words(spark, monkeypatch, n, texts, words, most):
    docs = tables.docs(spark).select("doc_id", "text")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, task, schema: task)
    score = line_crf.add_score(docs, (np.ones((3 * line_crf.FEATURES + 1, 2)), np.zeros((2, 2))))
    rows = (batch(k * texts * words, texts, words) for k in range(n))
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in score(rows)) == n * texts
        assert tracemalloc.get_traced_memory()[1] < most
    finally:
        tracemalloc.stop()


def test_scores_do_not_depend_on_the_slices(spark, monkeypatch):
    docs, labels = tables.docs(spark), tables.labels(spark)

    def scores():
        return sorted((str(r.doc_id), str(r.text), round(r.score, 12)) for r in line_crf.add_score(docs, line_crf.fit(docs, labels)).collect())

    whole = scores()
    monkeypatch.setattr(line_crf, "SLICE_BYTES", 100)
    assert scores() == whole


def test_repeated_words_of_a_line():
    x, _, breaks = line_crf.line_features(["", "a a a b\na a", " \n\na  a\tb b"])
    assert list(np.round(x[:, 9] * np.maximum([0, 4, 2, 0, 0, 4], 1))) == [0, 2, 1, 0, 0, 2] and list(breaks) == [0, 1, 3, 6]


def test_cutting_needs_one_python_worker_a_task(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontam.decontaminate(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_blocks_of_items_cut_the_same_words(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (sorted(map(str, decontam.decontaminate(docs, items, block_bytes=b).collect())) for b in (10**9, 2_000))
    assert one == many and one != sorted(map(str, docs.collect()))
