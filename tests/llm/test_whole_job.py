"""The whole job: no bound on what an operator learns from or looks at."""

import random

import numpy as np
import tables
from pyspark.sql import functions as F

from tidemark.llm import langid, pii, quality_rules


def test_all_good_documents_are_the_target(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("w"), F.col("id")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    scores = quality_rules.rate(docs, labels).agg(F.max(F.abs("score"))).first()[0]
    assert scores < 1e-9  # the target is the corpus


def test_scores_do_not_depend_on_the_table_size(spark):
    docs, labels = tables.docs(spark).where("doc_id IS NOT NULL").distinct(), tables.labels(spark)
    times = spark.range(4).withColumnRenamed("id", "copy_")
    more = lambda df: df.crossJoin(times).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("copy_")).drop("copy_")
    one = {r.doc_id: (r.score, r.kept) for r in quality_rules.rate(docs, labels).collect()}
    for r in quality_rules.rate(more(docs), more(labels.where("doc_id < 900"))).collect():
        score, kept = one[r.doc_id % 1000]
        assert abs(r.score - score) < 1e-9 and r.kept == kept


def test_repeats_among_millions_of_words():
    assert quality_rules.repeated_windows(np.array([0, 1 << 21, 7, 1, 0, 7])) == 0
    assert quality_rules.repeated_windows(np.array([5, 1 << 21, 7, 9, 5, 1 << 21, 7])) == 6


def said(seed, first, letters, n):
    r = random.Random(seed)
    return "".join(chr(first + r.randrange(letters)) if r.random() < 0.8 else " " for _ in range(n))


def test_languages_of_rare_letters_and_long_texts_are_learned(spark):
    kinds = {"aa": (0x61, 26), "el": (0x3B1, 24), "ja": (0x3041, 80), "ka": (0x10D0, 33), "th": (0xE01, 40), "zh": (0x4E00, 900)}
    rows = [(100 * k + i, said(100 * k + i, *kinds[lang], 300), lang) for k, lang in enumerate(kinds) for i in range(30)]
    rows += [(9000 + i, "1 " * 9000 + said(9000 + i, 0x561, 38, 9000), "hy") for i in range(5)]  # all longer than a sample's piece
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, where=F.col("doc_id") % 5 != 2)
    assert model.languages == sorted([*kinds, "hy"])
    want = {i: lang for i, _, lang in rows}
    assert all(r.lang_pred == want[r.doc_id] for r in langid.predict(docs, model).collect())


def test_phrases_are_those_of_plain_search():
    samples = {"a": "abcabca bca", "b": "bcd dcb 漢字漢"}
    letters = "".join(sorted(set("".join(samples.values())) - {" "}))
    symbol = {c: i + 2 for i, c in enumerate(letters)} | {" ": 0}
    model = langid.Model(list(samples), letters, *langid.double_array([langid.suffix_automaton([symbol[c] for c in s]) for s in samples.values()], len(letters) + 2))
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice("abcd 漢字é") for _ in range(r.randrange(1, 20)))
        got = langid.count_phrases(np.array([symbol.get(c, 1) for c in text]), np.array([0, len(text)]), model)
        for k, s in enumerate(samples.values()):
            n = at = 0
            while at < len(text):
                end = at + 1
                while end <= len(text) and text[at:end] in s:
                    end += 1
                n, at = n + 1, max(end - 1, at + 1)
            assert got[k][0] == n


def test_ibans_before_words_in_capitals():
    assert pii.redact_text("pay DE89370400440532013000 BIC COBADEFF now") == "pay <IBAN> BIC COBADEFF now"
    assert pii.redact_text("DE89 3704 0044 0532 0130 00 OR GB82 WEST 1234 5698 7654 32.") == "<IBAN> OR <IBAN>."
    assert pii.redact_text("XX12 ABCD EF DE89370400440532013000 A") == "XX12 ABCD EF <IBAN> A"
    assert pii.redact_text("DE89370400440532013000x DE8937040044053201300 0A") == "DE89370400440532013000x DE8937040044053201300 0A"


def test_ip_parts_of_many_zeros():
    t = "0" * 5000 + "1.2.3.4"
    assert pii.listed(pii.find(t)) == f"ip:0:{len(t)}"
