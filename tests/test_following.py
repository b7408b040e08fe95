"""Similar headlines, late rows and subscriptions against plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import hygiene, similar
from tidemark.sources import ingest, lake
from tidemark.streaming import late, subscriptions


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets_are_all_pairs_over_the_threshold(spark, least):
    r = random.Random(7)
    words = [f"w{k}" for k in range(25)]
    rows = [(k, " ".join(["Every", *r.sample(words, r.randint(0, 6))])) for k in range(250)] + [(900, None), (901, "!!"), (902, "every"), (903, "w1, every!")]
    frame = spark.createDataFrame(rows, "id int, title string")
    sets = {}
    for i, t in rows:
        s = frozenset("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
        if s:
            sets[s] = min(i, sets.get(s, i))
    ids = sorted((i, s) for s, i in sets.items())
    want = {(a, b): len(x & y) / len(x | y) for k, (a, x) in enumerate(ids) for b, y in ids[k + 1 :] if len(x & y) >= least * len(x | y)}
    found = similar.similar(similar.word_sets(frame, "id", "title"), least).collect()
    assert {(p.a, p.b): p.similarity for p in found} == pytest.approx(want) and len(found) == len(want)
    assert {m.id: m.class_id for m in similar.members(frame, "id", "title").collect()} == {i: sets[frozenset("".join(c if c.isalnum() else " " for c in t.lower()).split())] for i, t in rows if t and t != "!!"}


def test_a_word_in_every_headline_stays_linear(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("daily news a"), F.col("id"), F.lit(" b"), F.col("id"), F.lit(" c"), F.col("id")).alias("title"))
    sets = similar.word_sets(rows, "id", "title")
    assert similar.similar(sets, 0.8).count() == 0
    with pytest.raises(ValueError):
        similar.similar(sets, 0.0)


EVENTS = "event_id long, event_type string, value double, ts timestamp"


def test_late_rows_are_counted_after_the_backfill_only(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    root, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for rows in ([(1, "a", 1.0, at(1)), (2, "a", 2.0, at(3, 30))], [(3, "a", 5.0, at(1, 5)), (4, "b", 1.0, at(2, 59)), (5, "a", 1.0, at(5)), (6, "a", 1.0, None)]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        late.keep_hours(stream, root, checkpoint, "10 minutes").awaitTermination(120)
    shown = lambda: sorted((r.start.hour, r.event_type, r.n, r.total) for r in late.hours(spark, root).collect())
    assert shown() == [(1, "a", 1, 1.0), (3, "a", 1, 2.0)]  # hour 5 is still open
    untouched = [p for p in (tmp_path / "out" / "hours").rglob("hour=3/*.parquet")]
    assert late.backfill(spark, root, EVENTS.replace(", ts timestamp", ", ts timestamp")) == 2
    assert shown() == [(1, "a", 2, 6.0), (2, "b", 1, 1.0), (3, "a", 1, 2.0)]
    assert [p for p in (tmp_path / "out" / "hours").rglob("hour=3/*.parquet")] == untouched
    assert late.mark(spark, root).hour == 4


@pytest.mark.parametrize("hours", [None, 6])
def test_rules_fire_and_cool_down(spark, tmp_path, hours):
    r = random.Random(3)
    start, cooldown = dt.datetime(2024, 1, 1), None if hours is None else dt.timedelta(hours=hours)
    scores = [(f"e{r.randrange(3)}", float(r.randrange(10)), start + dt.timedelta(minutes=10 * k)) for k in range(400)]
    rules = [("all", None, 8.0), ("own", "e1", 5.0), ("none", "zz", 0.0)]
    subs = spark.createDataFrame(rules, "rule_id string, entity string, threshold double")
    root, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for part in (scores[:150], scores[150:], scores[:300]):  # at last the first ones once more
        spark.createDataFrame(part, "entity string, score double, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("entity string, score double, ts timestamp").parquet(str(tmp_path / "in"))
        subscriptions.fire(stream, subs, root, checkpoint, cooldown).awaitTermination(120)
    want, last = [], {}
    for e, s, t in scores:
        for rule, own, threshold in rules:
            if own in (None, e) and s >= threshold and ((rule, e) not in last or cooldown is not None and t >= last[rule, e] + cooldown):
                last[rule, e] = t
                want.append((rule, e, t))
    got = sorted((a.rule_id, a.entity, a.fired_at) for a in subscriptions.alerts(spark, root).collect())
    assert got == sorted(want)
    out = str(tmp_path / "digests")
    first = subscriptions.send_digests(spark, root, out, "daily", dt.datetime(2024, 1, 2)).collect()
    assert {d.period_start for d in first} == {dt.date(2024, 1, 1)}
    assert {d.rule_id: d.alerts for d in first} == {rule: sum(w[0] == rule and w[2].day == 1 for w in want) for rule in ("all", "own")}
    assert {d.period_start.day for d in subscriptions.send_digests(spark, root, out, "daily", dt.datetime(2024, 1, 4)).collect()} <= {2, 3}
    assert subscriptions.send_digests(spark, root, out, "daily", dt.datetime(2024, 1, 4)).count() == 0


def test_strict_signals(spark, tmp_path):
    for name, text, rows in [("a", '{"trends": [{"entity": "p1", "score": 0.95}]}', 1), ("b", '[{"entity": "p1"}, null]', 1), ("c", '{"trends": [', None), ("d", "3", None), ("e", "", None), ("f", '{"other": []}', None), ("g", '{"trends": []}', 0)]:
        (tmp_path / name).write_text(text)
        if rows is None:
            with pytest.raises(ValueError):
                lake.signals(spark, str(tmp_path / name), strict=True)
            assert lake.signals(spark, str(tmp_path / name)).count() == 0
        else:
            assert lake.signals(spark, str(tmp_path / name), strict=True).count() == rows
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        lake.signals(spark, str(tmp_path / "missing"), strict=True)


def test_lists_and_second_endpoints(spark, tmp_path):
    items = spark.createDataFrame([(k, f"t{k}") for k in range(100)], "id long, title string")
    ids = spark.createDataFrame([(p, (p * 37) % 130) for p in range(120)], "position int, id long")
    assert [r.id for r in ingest.listed(ids, items, 50).collect()] == [(p * 37) % 130 for p in range(50) if (p * 37) % 130 < 100]
    (tmp_path / "threads_media").mkdir()
    (tmp_path / "threads_media" / "a.jsonl").write_text('{"id": "1"}\n')
    assert ingest.endpoint(spark, str(tmp_path), "threads").count() == 1
    with pytest.raises(FileNotFoundError):
        ingest.endpoint(spark, str(tmp_path), "reddit")


def test_spam_and_templates(spark):
    rows = [(k, f"Win {k * 10}.5 coins at https://x{k}.io with @user{k}!") for k in range(4)] + [(10, "a calm and quite ordinary post"), (11, None), (12, "join my group on Telegram"), (13, "!!! $$$ %%% !!!"), (14, "see https://a https://b https://c"), (15, "two of a kind 1"), (16, "two of a kind 2")]
    posts = spark.createDataFrame(rows, "id int, text string")
    assert sorted(r.id for r in hygiene.without_templates(posts).collect()) == list(range(10, 17))
    assert sorted(r.id for r in posts.where(hygiene.spam("text")).collect()) == [12, 13, 14]
    assert hygiene.without_templates(posts.where("false")).count() == 0


def test_lake_filters(spark, tmp_path):
    now = dt.datetime(2024, 1, 10, 12)
    entity = F.array(F.struct(F.lit("tag").alias("type"), F.lit("x").alias("value"), (F.col("id") / 10).alias("confidence")))
    rows = spark.range(10).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("source_id"), F.expr("timestamp'2024-01-10 12:00:00' - make_interval(0, 0, 0, 0, cast(id * 12 as int))").alias("ts"), F.when(F.col("id") != 9, entity).alias("entities"), F.struct(F.current_timestamp().alias("ingest_ts")).alias("provenance"))
    lake.write_raw_and_bronze(rows, str(tmp_path))
    ids = lambda **k: sorted(int(r.source_id) for r in lake.bronze(spark, str(tmp_path), **k).collect())
    assert ids(category="tag") == list(range(9)) and ids(category="brand") == [] and ids(confidence=0.5) == [5, 6, 7, 8]
    assert ids(timeframe="24h", now=now) == [0, 1] and ids(timeframe="2d", now=now, since=dt.date(2024, 1, 9)) == [0, 1, 2, 3]
    for bad in ({"timeframe": "soon", "now": now}, {"timeframe": "1d"}):
        with pytest.raises(ValueError):
            ids(**bad)
