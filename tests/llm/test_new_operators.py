"""URL filters, hard negatives and fill-in-the-middle against plain versions, and their edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import tables
from pyspark.sql import functions as F

from tidemark.llm import fim, negatives, queries, urls

RULES = "host string, path string, verdict string"


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def judged(url, rules):
    host, path = host_path(url)
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


@pytest.mark.parametrize("per_key,most", [(16, 1 << 28), (1, 1 << 28), (16, 200)])
def test_urls_are_judged_like_the_plain_rules(spark, per_key, most):
    r = random.Random(4)
    names = ["a", "b", "www", "x-1", "é", "A"]
    host = lambda: ".".join(r.choice(names) for _ in range(r.randint(1, 4)))
    rules = sorted({(host().lower(), r.choice(["", "/", "/a", "/a/", "/a/b", "/é/"])): r.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    rows = [f"http{r.choice(['', 's'])}://{host()}{r.choice(['', '/', '/a', '/a/b/c', '/é/x', '/b'])}{r.choice(['', '?q=://z/a', '#f', '?'])}" for _ in range(1500)]
    rows += [None, "", "no scheme", "://", "x://", "http:///a/b", "http://..a/a", "http://a./a", "a://b://a/a", "http://b" + ".b" * 20_000 + "/a"]
    pages = spark.createDataFrame([(k, u, "h", 1) for k, u in enumerate(rows)], "page_id long, url string, host string, wide_ int")
    got = urls.judge(pages, spark.createDataFrame([*rules, rules[0], (None, "/", "block"), ("a", None, "block")], RULES), per_key=per_key, most=most)
    assert got.columns == ["page_id", "url", "wide_", "host", "path", "rule", "verdict"]
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {k: judged(u, rules) for k, u in enumerate(rows)}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.where(F.substring("key", -1, 1) == "3").union(spark.createDataFrame([("elsewhere",)], "key string"))
    levels = urls.cascade(universe, listed, 1, per_key=4)
    assert len(levels) > 3
    hashes = [universe.select("key", urls.seeded(one.seed, F.col("key"))).toPandas() for one in levels]
    assert all((h["key"] == hashes[0]["key"]).all() for h in hashes)
    got = urls.member([one.passes(h.iloc[:, 1].to_numpy()) for one, h in zip(levels, hashes, strict=True)])
    assert (got == hashes[0]["key"].str.endswith("3")).all()


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = spark.createDataFrame([], RULES)
    assert [(r.rule, r.verdict) for r in urls.judge(pages, none).collect()] == [(None, "allow")]
    assert urls.judge(pages.where("false"), spark.createDataFrame([("com", "/", "block")], RULES)).count() == 0


def mined(rows, k=5):
    sound = [(i, y, x) for i, y, x in rows if i is not None and y is not None and x is not None and all(c is not None and math.isfinite(c) and abs(c) < 1 << 15 for c in x)]
    whole = [(i, y, [math.floor(256 * c) for c in x]) for i, y, x in sound]
    score = lambda a, b: sum(p * q for p, q in zip(a, b))  # noqa: B905, E731
    out = []
    for i, y, x in [min(((y, x, i) for i, y, x in whole if i == a)) [::-1] for a in sorted({i for i, _, _ in whole if i % 100 == 0})]:
        x, y = y, x
        pos = sorted((-score(x, v), j) for j, z, v in whole if z == y and j != i)[:k]
        others = sorted((-score(x, v), j) for j, z, v in whole if z != y)
        for ps, p in pos:
            fit = [(-s, j) for s, j in others if 80 * -ps <= 100 * -s <= 100 * -ps][:k]
            out += [(i, p, n + 1, j, -ps, s) for n, (s, j) in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<float>, x int, place long"


@pytest.mark.parametrize("spread,d", [(0.3, 16), (2.0, 3), (20000.0, 5), (0.01, 40)])
def test_hard_negatives_are_those_of_all_scores(spark, monkeypatch, spread, d):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(0, spread, (6, d))
    vectors = np.clip(centres[rnd.integers(0, 6, 900)] + rnd.normal(0, spread / 2, (900, d)), -32000, 32000).astype(np.float32)
    rows = [(int(i), int(rnd.integers(0, 4)), [float(c) for c in v]) for i, v in enumerate(vectors)]
    rows += [(i, y, x) for i, (_, y, x) in zip(range(900, 960), [rows[7]] * 60, strict=True)]  # ties
    rows += [rows[5], rows[5], rows[100], (None, 1, [0.5] * d), (970, None, [0.5] * d), (971, 1, None), (972, 1, [None] * d), (973, 1, [float("nan")] * d), (974, 1, [float("inf")] * d), (975, 1, []), (976, 1, [spread]), (977, 1, [1e30] * d), (200, 3, [0.0] * d), (1000, 9, [spread] * d)]
    monkeypatch.setattr(negatives, "CELLS", 64 * d)
    monkeypatch.setattr(negatives, "KEPT", 2)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    table = spark.createDataFrame([(*r, 1, 1) for r in rows], VECTORS).repartition(3)
    got = negatives.hard_negatives(table, F.col("vec_id") % 100 == 0)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows)


def test_pairs_drop_out_before_the_last_plane():
    rnd = np.random.default_rng(1)
    x = np.floor(256 * rnd.normal(0, 0.12, (500, 64))).astype(np.int64)
    bits, planes = negatives.sliced(x)
    block = negatives.Block(500, 64, bits, np.arange(500).tobytes(), np.zeros(500, np.int64).tobytes(), planes)
    assert (block.integers() == x).all()
    i, c, s = negatives.qualifying(x[:20], block, np.arange(500), np.ones((20, 500), bool), np.full(20, negatives.LEAST), np.full(20, negatives.MOST), 5)
    exact = x[:20] @ x.T
    assert (s == exact[i, c]).all() and len(s) < 1000
    for a in range(20):
        assert set(np.sort(exact[a])[-5:]) <= set(s[i == a])


def test_no_vectors(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, 1, [0.5], 1, 1), (1, 1, [0.4], 1, 1)], VECTORS)
    assert negatives.hard_negatives(alone, F.col("vec_id") % 100 == 0).count() == 0


def rewritten(ident, text, rate=50, spm=80):
    t = text or ""
    u = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    h = [int(hashlib.sha256(f"42:{'' if ident is None else ident}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(u) + 1) for x in h[:2])
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, t
    return (len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["<P>", "a <M> b", "<", "<<P", "P> <P", "\n\n", " a", "a ", "\x0b\x0c\r", "a\x00b \x00", "e\u0301 \U0001f600 \u00a0x", "<S", "x <P y>", "\x1c\x85", "'quote\" \\ {}"]


@pytest.mark.parametrize("slice_bytes,rate", [(8_000_000, 50), (10, 100)])
def test_fill_in_the_middle(spark, slice_bytes, rate):
    r = random.Random(6)
    odd = [(2000 + k, "".join(r.choice(TEXTS) for _ in range(r.randint(1, 4)))) for k in range(300)]
    rows = [(i, t) for i, t, *_ in tables.rows()] + odd + [(-7, "negative id here"), (5000, "w " * 300_000)]
    docs = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, n long, Form string").repartition(2)
    made = fim.fill_in_middle(docs, rate=rate, slice_bytes=slice_bytes).withColumn("back", fim.restored())
    assert made.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "back"]
    key = lambda x: sorted(map(repr, x))
    got = made.collect()
    assert key((g.doc_id, g.text, g.n, g.form, g.prefix_chars, g.middle_chars, g.output) for g in got) == key((i, t, *rewritten(i, t, rate)) for i, t in rows)
    assert all(g.back == (g.text or "") for g in got) and {g.form for g in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.where("false")).count() == 0


@pytest.mark.parametrize("name", ["op11_url_filter", "op12_hard_negatives", "op13_fill_in_middle"])
def test_columns_of_the_contracts(spark, sf, name):
    want = {
        "op11_url_filter": "page_id:bigint host:string path:string rule:string verdict:string",
        "op12_hard_negatives": "anchor_id:bigint positive_id:bigint rank:int negative_id:bigint positive_score:bigint negative_score:bigint",
        "op13_fill_in_middle": "doc_id:bigint n:bigint form:string prefix_chars:bigint middle_chars:bigint output_sha256:string restored_sha256:string",
    }
    assert " ".join(f"{c}:{t}" for c, t in queries.QUERIES[name](spark, sf).dtypes) == want[name]
