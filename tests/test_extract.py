"""Dictionary names, schema drift and tiers against plain versions."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import extract, schemas
from tidemark.sources import lake


def greedy(words, names):
    """Leftmost, longest, without overlaps."""
    out, at = [], 0
    while at < len(words):
        fit = [n for n in names if tuple(words[at : at + len(n)]) == n]
        if fit:
            best = max(fit, key=len)
            out.append((at, at + len(best), names[best]))
            at += len(best)
        else:
            at += 1
    return out


def test_names_are_leftmost_and_longest(spark):
    r = random.Random(1)
    alphabet = ["a", "b", "c", "d"]
    names = {tuple(r.choice(alphabet) for _ in range(r.randint(1, 4))): str(k) for k in range(12)}
    texts = [(k, " ".join(r.choice(alphabet) for _ in range(r.randint(0, 30)))) for k in range(200)] + [(900, None), (901, "  ?! ")]
    rows = [(" ".join(n).upper() + "!", c) for n, c in names.items()] + [("", "x"), (None, "y"), ("a b", None), (" ".join(next(iter(names))), "zz")]
    known = extract.dictionary(spark.createDataFrame(rows, "name string, code string"))
    frame = spark.createDataFrame(texts, "id long, text string")
    got = {x.id: [(e.start, e.end, e.code) for e in x.entities] for x in extract.entities(frame, known, "id", "text").collect()}
    want = {i: greedy((t or "").split(), names) for i, t in texts if t != "  ?! "}
    assert got == {i: w for i, w in want.items() if w}
    assert extract.entities(frame, known.where("false"), "id", "text").count() == 0


def test_a_large_dictionary(spark):
    names = spark.range(100_000).select(F.concat(F.lit("n"), F.col("id"), F.lit(" x")).alias("name"), F.col("id").cast("string").alias("code"))
    texts = spark.createDataFrame([(1, "see n17 x and n99999 x, n5 y")], "id long, text string")
    assert [e.code for e in extract.entities(texts, extract.dictionary(names), "id", "text").first().entities] == ["17", "99999"]


def test_novelty_is_the_distance_from_everything_before(spark):
    r = random.Random(2)
    words = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(r.sample(words, r.randint(1, 5)))) for k in range(120)] + [(500, None)]
    got = {x.id: x.novelty for x in extract.novelty(spark.createDataFrame(rows, "id long, title string"), "id", "title", 0.3).collect()}
    for i, t in rows[:-1]:
        own = set(t.split())
        near = max((len(own & set(u.split())) / len(own | set(u.split())) for j, u in rows if j < i), default=0.0)
        assert got[i] == pytest.approx(1 - near if near >= 0.3 else 1.0)
    assert 500 not in got


def test_drift(spark):
    day = dt.date(2024, 1, 1)
    said = [{"id": 1, "n": 2.5, "tags": ["a"]}, {"id": 2, "n": None, "more": {"x": 1}}, {"id": 3, "n": 7, "tags": "none"}]
    rows = [("s", day, json.dumps(x)) for x in said] + [("s", day, "not json"), ("s", day, "[1]"), ("s", day, None), ("t", day, "{}"), ("t", day, '{"id": "5"}')]
    frame = spark.createDataFrame(rows, "source string, day date, payload string")
    expected = spark.createDataFrame([(s, f, k) for s in "st" for f, k in (("id", "number"), ("n", "number"), ("gone", "string"))], "source string, field string, kind string")
    got = {(d.source, d.field): (d.change, d.kind, d.expected, d.rows, d.of) for d in schemas.drift(schemas.fields(frame, ["source", "day"]), expected, ["source", "day"], "source").collect()}
    assert got == {
        ("s", "tags"): ("new", "mixed", None, 2, 3), ("s", "more"): ("new", "object", None, 1, 3), ("s", "gone"): ("missing", None, "string", 0, 3),
        ("t", "id"): ("retyped", "string", "number", 1, 2), ("t", "n"): ("missing", None, "number", 0, 2), ("t", "gone"): ("missing", None, "string", 0, 2),
    }


def test_tiers_keep_every_row(spark, tmp_path, monkeypatch):
    hot, cold = str(tmp_path / "bronze"), str(tmp_path / "cold")
    made = lambda a, b: spark.range(a, b).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 10 as int))").alias("ts"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("metadata"))
    lake.write_raw_and_bronze(made(0, 100).repartition(5), str(tmp_path))
    ids = lambda: sorted(int(r.source_id) for r in lake.both_tiers(spark, hot, cold).collect())
    whole = lake.expire
    monkeypatch.setattr(lake, "expire", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        lake.tier(spark, hot, cold, dt.date(2024, 1, 5))
    assert set(ids()) == set(range(100))
    monkeypatch.setattr(lake, "expire", whole)
    assert lake.tier(spark, hot, cold, dt.date(2024, 1, 5)) == 4 and ids() == list(range(100))
    lake.write_raw_and_bronze(made(100, 120), str(tmp_path))  # late rows of days that are cold
    assert lake.tier(spark, hot, cold, dt.date(2024, 1, 5)) == 4 and ids() == list(range(120))
    assert lake.tier(spark, hot, cold, dt.date(2024, 1, 5)) == 0
    assert all(len(list(p.glob("*.parquet"))) <= 2 for p in (tmp_path / "cold").glob("source=s/year=2024/month=1/day=*"))
    assert {r.tier: r["count"] for r in lake.both_tiers(spark, hot, cold).groupBy("tier").count().collect()} == {"cold": 48, "hot": 72}
