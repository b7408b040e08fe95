"""Nulls, empty and long texts, repeated rows, empty tables, and extra columns with clashing names."""

import pytest
import tables
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, decontam, html_text, langid, line_crf, minhash, mixing, pii, quality_rules, suffix_dedup

OPERATORS = {
    "decontam": lambda s, d: decontam.report(d, tables.benchmark(s)),
    "decontam_cut": lambda s, d: decontam.decontaminate(d, tables.benchmark(s)),
    "suffix": lambda s, d: suffix_dedup.remove_repeats(d).drop("kept"),
    "mix": lambda s, d: mixing.mix(d),
    "minhash": lambda s, d: minhash.near_duplicates(d),
    "pii": lambda s, d: pii.scan(d),
    "redact": lambda s, d: pii.redact(d),
    "langid": lambda s, d: langid.predict(d, langid.fit(d)),
    "rules": lambda s, d: quality_rules.rate(d, tables.labels(s)),
    "crf": lambda s, d: line_crf.add_score(d, line_crf.fit(d, tables.labels(s)), out="crf_score_").select("doc_id", "text", "crf_score_"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edge_rows_keep_their_number(spark, name):
    plain = OPERATORS[name](spark, tables.docs(spark)).cache()
    assert plain.count() == len(tables.rows()) - (name == "decontam_cut") * (plain.count() != len(tables.rows()))
    wide = OPERATORS[name](spark, tables.docs(spark, extra=True))
    common = [c for c in plain.columns if c in wide.columns]
    key = lambda df: sorted(map(str, df.select(*common).collect()))
    assert key(plain) == key(wide)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, tables.docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_only_nulls(spark, name):
    data = [(1, None, None, None, None), (None, None, None, None, None)]
    assert OPERATORS[name](spark, tables.docs(spark, data)).count() == 2


def test_without_labels(spark):
    none = tables.labels(spark, [])
    d = tables.docs(spark)
    model = line_crf.fit(d, none)
    assert {r.s for r in line_crf.add_score(d, model, out="s").collect()} == {0.5}
    assert {r.lang_pred for r in langid.predict(d, langid.fit(d.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}
    kept = quality_rules.rate(d, none)
    assert kept.where("NOT base_failed AND NOT kept").count() == 0


def test_pages(spark):
    ddl = "page_id long, url string, html string, text string, n_chars long"
    page = "<html><body><nav><a>home</a></nav><article><h1>T</h1><p>Some words  of\ntext &amp; more.<p>Next one is here.</article><footer>&copy; x</footer>"
    data = [(1, "u", None, "t", 1), (2, "u", "", "t", 1), (3, None, page, "t", 1), (3, None, page, "t", 1), (None, "u", "<!-- never ends", "t", 1), (5, "u", "<script>x", "t", 1), (6, "u", "<div class='", "t", 1), (7, "u", "<nav>a</nav>" * 3000, "t", 1)]
    got = {(r.page_id, r.text) for r in html_text.extract(spark.createDataFrame(data, ddl)).collect()}
    assert (3, "T\nSome words of text & more.\nNext one is here.") in got and (1, "") in got and (7, "") in got
    assert html_text.extract(spark.createDataFrame([], ddl)).count() == 0


def test_chats(spark):
    ddl = "conv_id long, turn long, role string, text string, valid string"
    data = [(1, 0, "user", None, "v"), (1, 1, "assistant", "ok", "v"), (2, 0, None, "x", "v"), (2, 0, "bot", "</s><<ROLE>>", "v"), (None, 0, "user", "q", "v"), (3, 0, "user", "a", "v"), (3, 0, "user", "a", "v"), (4, None, "user", "long " * 20_000, "v")]
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(spark.createDataFrame(data, ddl))).collect()}
    assert got[1].valid and not any(got[k].valid for k in (2, 3, 4, None))
    assert got[3].n_turns == 2 and got[1].loss_chars == 2
    assert chat.digests(chat.format_chats(spark.createDataFrame([], ddl))).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_stand_edge_rows(spark, tmp_path, name, stage):
    tables.labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    tables.benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    for d in (tables.docs(spark), tables.docs(spark, []), tables.docs(spark, extra=True)):
        out = stage(spark, d, str(tmp_path))
        assert out.count() <= d.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == d.columns
