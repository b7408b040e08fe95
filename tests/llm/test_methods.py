"""The methods themselves against plain versions, and bounds that must not bite."""

import itertools
import math
import random
import re

import numpy as np
import pytest
import tables
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, decontam, html_text, line_crf, minhash, mixing, pii, quality_rules

SAID = "Bafor lanis e noti mera. Conis dan ferila goti bane."


@pytest.mark.parametrize("levels", [0, 1, 2, 3, 5, 10, 14, 30])
@pytest.mark.parametrize("kind", ["article", "div", "main", "div class='content'", "section"])
def test_wrappers_change_nothing(levels, kind):
    """Titles and paragraphs under any number of plain wrappers."""
    tag = kind.split()[0]
    for n in (2, 8):
        parts = ["The title here", *(f"{SAID} Number {k} of more sentences." for k in range(n))]
        inner = f"<h1>{parts[0]}</h1>" + "".join(f"<p>{p}</p>" for p in parts[1:])
        page = f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>About</a></li></ul></nav>{'<div>' * levels}<{kind}>{inner}</{tag}>{'</div>' * levels}<footer>&copy; 2024 us</footer></body>"
        assert html_text.extract_pages([page], html_text.trained(), html_text.WordCells()) == ["\n".join(parts)]


def test_formulas_stay_and_notices_go():
    page = f"<div class='cookie-banner'><p>We use cookies. Accept?</p></div><article><h1>A title</h1><p>{SAID} As <math><mi>x</mi><mo>=</mo><mn>2</mn></math> shows.</p><svg/><p>{SAID}</p></article><section class='comments'><p>Nice one.</p></section>"
    got = html_text.extract_pages([page], html_text.trained(), html_text.WordCells())[0]
    assert got == f"A title\n{SAID} As x=2 shows.\n{SAID}"


def test_lstm_is_the_plain_recurrence():
    rnd = np.random.default_rng(4)
    breaks, h = np.array([0, 3, 4, 9]), html_text.HIDDEN
    z, w = rnd.normal(size=(9, 4 * h)), rnd.normal(size=(h, 4 * h))
    s = lambda x: 1 / (1 + np.exp(-x))
    ahead, back, live = html_text.steps(breaks)
    for order, backwards in ((ahead, False), (back, True)):
        got = html_text.lstm(z, w, order, live)[0]
        for a, b in itertools.pairwise(breaks):
            state, cell = np.zeros(h), np.zeros(h)
            for k in reversed(range(a, b)) if backwards else range(a, b):
                i, f, o, u = np.split(z[k] + state @ w, 4)
                cell = s(f) * cell + s(i) * np.tanh(u)
                state = s(o) * np.tanh(cell)
                assert np.allclose(got[k], state)


def test_forward_backward_is_the_sum_over_all_labelings():
    rnd = np.random.default_rng(5)
    breaks = np.array([0, 1, 4, 12])
    unary, trans = rnd.normal(size=(12, 2)), rnd.normal(size=(2, 2))
    got, pairs = line_crf.forward_backward(unary, trans, breaks)
    want, want_pairs = np.zeros((12, 2)), np.zeros((2, 2))
    for a, b in itertools.pairwise(breaks):
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            weights[y] = math.exp(sum(unary[a + k, v] for k, v in enumerate(y)) + sum(trans[u, v] for u, v in itertools.pairwise(y)))
        total = sum(weights.values())
        for y, p in weights.items():
            for k, v in enumerate(y):
                want[a + k, v] += p / total
            for u, v in itertools.pairwise(y):
                want_pairs[u, v] += p / total
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_ratio_is_that_of_the_counted_multinomials(spark):
    """With so many cells that no two n-grams of the fixture share one, up to hashing."""
    docs = spark.createDataFrame([(1, "a b a c"), (2, "a c c"), (3, "b b d"), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (3, 1), (2, 0)], "doc_id long, quality int")
    texts = {1: "a b a c".split(), 2: "a c c".split(), 3: "b b d".split()}
    grams = lambda ws: [*ws, *zip(ws, ws[1:], strict=False)]
    raw = [g for ws in texts.values() for g in grams(ws)]
    target = [g for i in (1, 3) for g in grams(texts[i])]
    prior = quality_rules.PRIOR

    def ratio(g):
        p = raw.count(g) / len(raw)
        return math.log((target.count(g) / len(target) + prior * p) / (1 + prior)) - math.log(p)

    for r in quality_rules.rate(docs, labels).where("doc_id < 4").collect():
        own = grams(texts[r.doc_id])
        assert math.isclose(r.score, sum(map(ratio, own)) / (len(own) + 32), abs_tol=1e-9)


def test_many_dissimilar_members_of_a_bucket_meet_in_linear_pairs(spark):
    """5,000 sets that share a passage and nothing else: no link, and about as many pairs as members."""
    n = 5_000
    passage = [7 * k for k in range(40)]
    sets = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(60).cast("long").alias("n"), F.concat(F.array(*map(F.lit, passage)).cast("array<long>"), F.transform(F.sequence(F.lit(0), F.lit(19)), lambda k: F.xxhash64("id", k))).alias("items"))
    buckets = sets.select(F.lit(1).cast("long").alias("key"), F.col("doc_id").alias("node"), "n", F.lit(1).cast("long").alias("score"), F.lit(True).alias("open"))
    made, plain = [], minhash.compared
    minhash.compared = lambda pairs, *a: (made.append(pairs.count()), plain(pairs, *a))[1]
    try:
        labels = minhash.links(buckets, sets, 85)
    finally:
        minhash.compared = plain
    assert labels.count() == 0 and sum(made) <= 2 * n


def test_bands_follow_the_threshold():
    for percent in (95, 85, 80, 70, 50, 30):
        rows = minhash.rows_of_bands(percent)
        assert (1 - (percent / 100) ** rows) ** (minhash.COORDINATES // rows) <= 1e-4
    assert minhash.rows_of_bands(85) == 5 > minhash.rows_of_bands(50)


def test_rows_that_share_an_id_are_one_document(spark):
    said = "one two three four five six seven eight nine ten"
    rows = [(1, said), (2, said), (3, "a b c d e f"), (3, "g h i j k l"), (3, "g h i j k l"), (None, said), (None, said)]
    got = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([rows[0], *rows[2:4], *rows[5:]], "doc_id long, text string").collect()))


def test_context_words_are_whole_words():
    number = "123-45-6789"
    assert [s.kind for s in pii.find(f"her SSN is {number}")] == ["ssn"]
    assert pii.find(f"antisocial {number} classroom") == []
    scores = [pii.find(f"{w} 10.0.0.1")[0].score for w in ("the ship", "the ip")]
    assert scores[0] < scores[1]


def test_groups_of_shards_take_what_one_group_takes(spark, monkeypatch):
    docs = tables.docs(spark)
    sums = lambda df: {r.source: r.s for r in df.groupBy("source").agg(F.sum("taken").alias("s")).collect()}
    one = sums(mixing.mix(docs, shard_words=200))
    monkeypatch.setattr(mixing, "TOGETHER", 3)
    many = mixing.mix(docs, shard_words=200)
    assert all(abs(one[k] - v) <= 64 for k, v in sums(many).items())
    assert many.where("taken > 3 * size").count() == 0


def test_mixed_texts_hold_the_words_taken(spark):
    docs = tables.docs(spark)
    for block in (8, 32):
        out = mixing.mix(docs, block_words=block, text="text")
        assert out.where(F.regexp_count("text", F.lit(mixing.WORDS)) != F.col("taken")).count() == 0
        assert out.where("taken > size").count() > 0


def test_empty_benchmark(spark):
    docs = tables.docs(spark)
    none = tables.benchmark(spark, [])
    assert decontam.report(docs, none).where("contaminated OR n_items > 0").count() == 0
    assert decontam.decontaminate(docs, none).count() == docs.count()


def test_repeated_labelled_rows_are_learned_once(spark):
    docs, labels = tables.docs(spark), tables.labels(spark)
    many = docs.where("doc_id = 2").crossJoin(spark.range(200)).drop("id").unionByName(docs)
    one, two = line_crf.fit(docs.dropDuplicates(["doc_id"]), labels), line_crf.fit(many, labels)
    assert all(np.allclose(a, b) for a, b in zip(one, two, strict=True))


def test_intermediate_tables_can_be_deleted(spark):
    docs = tables.docs(spark)
    minhash.near_duplicates(docs).collect()
    before = spark.sql("SHOW TABLES").where("tableName LIKE 'sets_%'").count()
    common.forget_all(spark)
    assert before > 0 and spark.sql("SHOW TABLES").where("tableName LIKE 'sets_%'").count() == 0
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.checkpoint.dir"))
    left = [f.getPath().getName() for f in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    assert not [n for n in left if not re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", n)]  # Spark's own folder


def test_pipeline_is_its_stages_one_after_the_other(spark):
    """``run`` against the stages' plain meaning: who is kept, what is cut, and what the mix takes."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    good = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, sf).collect()}

    def shingles(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in good.items()}
    near = {i: {j for j in sets if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} | {i} for i in sets}
    stays = set()
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        if min(seen) == i:
            stays.add(i)
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    tokens = lambda t: word.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    items = [tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + min(10, len(w))]) for w in items if w for k in range(len(w) - min(10, len(w)) + 1)}
    want = {}
    for i in stays:
        ws = tokens(good[i])
        hit = {p + q for n in {len(w) for w in windows} for p in range(len(ws) - n + 1) if tuple(ws[p : p + n]) in windows for q in range(n)}
        if len(hit) <= 0.8 * max(len(ws), 1):
            runs = [list(g) for _, g in itertools.groupby(sorted(hit), key=lambda k, c=itertools.count(): k - next(c))]
            text = decontam.cut_text(good[i], [r[0] for r in runs], [r[-1] + 1 for r in runs]) if runs else good[i]
            want[i] = len(re.findall(r"[^\x20\x09-\x0D]+", pii.redact_text(text)))
    assert {i: r.size for i, r in got.items()} == want
    assert all(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) == r.taken <= 3 * r.size for r in got.values())


def test_long_labelled_texts_are_learned_from(spark):
    good = "\n".join(f"The {k}th sentence of a calm and ordered report ends here." for k in range(600))
    junk = "\n".join("$$ ||| WIN >>> NOW !!! ### 99%" for _ in range(600))
    docs = spark.createDataFrame([(i, good if i < 10 else junk) for i in range(20)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id < 10) as quality")
    scores = {r.doc_id: r.score for r in line_crf.add_score(docs, line_crf.fit(docs, labels)).collect()}
    assert min(scores[i] for i in range(10)) > 0.9 and max(scores[i] for i in range(10, 20)) < 0.1


def test_shingles_of_a_batch_are_those_of_each_text_and_a_word_is_hashed_once(monkeypatch):
    r, hashed, plain = random.Random(7), [], xxhash.xxh3_64_intdigest
    texts = ["", " \n", " one", "one two ", "a B c d", "A b C d E", "漢字 é\x1cx a\x0bb É\x85 c d\x00 e　f"] + [" ".join(r.choices("ab cd EF gh \n \t".split(" "), k=r.randint(0, 40))) for _ in range(300)]

    def shingles(text):
        h = [plain(w) for w in text.encode().lower().split()]
        out, k = set(), min(5, len(h))
        for at in range(len(h) - k + 1 if h else 0):
            total = np.full(1, k, np.uint64)
            for x in h[at : at + k]:
                with np.errstate(over="ignore"):
                    total = common.mix64(total * np.uint64(0x9E3779B97F4A7C15) + np.uint64(x))
            out.add(int(total[0]))
        return sorted(out)

    monkeypatch.setattr(minhash.xxhash, "xxh3_64_intdigest", lambda w: (hashed.append(w), plain(w))[1])
    elements, bounds = minhash.shingle_sets(texts)
    assert [elements[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == [shingles(t) for t in texts]
    assert sorted(hashed) == sorted({w for t in texts for w in t.encode().lower().split()})


def shuffled(spark):
    """Bytes that the session has shuffled so far."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_that_stay_are_not_shuffled(spark):
    r = random.Random(6)
    texts = [" ".join(f"{r.getrandbits(64):x}" for _ in range(300)) for _ in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (400, texts[7])], "doc_id int, text string")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        kept = sorted(minhash.deduplicate(docs).collect())
        assert kept == [*enumerate(texts)] and shuffled(spark) - before < sum(map(len, texts)) / 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_a_full_bitmap_takes_no_document_away(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CELLS", 3)
    texts = [" ".join(f"w{k // 2 * 50 + i}" for i in range(40)) for k in range(60)]  # every text twice
    rows = [*enumerate(texts), (None, texts[0]), (2, texts[2]), (8, "another text of this document")]
    kept = minhash.deduplicate(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(kept, key=str) == sorted([(k, t) for k, t in rows if k is None or k % 2 == 0][:-2] + [rows[-1]], key=str)
