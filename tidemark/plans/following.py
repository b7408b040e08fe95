"""Queries of what follows a stream or a schedule: runs, late rows, subscriptions, deliveries; similar headlines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import alerts, extract, features, hygiene, schemas, similar
from tidemark.plans.registry import Registry
from tidemark.plans.runs import CATALOGUE, EPOCH, IN_RANGE, ISO, REDDIT, payloads, recorded_run, streamed
from tidemark.session import scratch, table
from tidemark.sources import ingest, lake, schedule, sink
from tidemark.streaming import late, subscriptions

R = Registry()


@R.add("SELECT event_id::VARCHAR AS source_id, count(*) AS copies FROM events WHERE date_trunc('second', ts) > TIMESTAMP '2024-01-03' AND date_trunc('second', ts) <= TIMESTAMP '2024-01-27' GROUP BY event_id")
def scheduled_runs(spark, sf):
    """Runs of eight days each, the first two in one go and the last later: every payload of the time is stored once."""
    folder, root, checkpoint = scratch(spark, "recorded"), scratch(spark, "lake"), scratch(spark, "checkpoint")
    payloads(table(spark, sf, "events"), *REDDIT).write.text(f"{folder}/reddit")
    catalogue = spark.createDataFrame([("reddit", {"limit": "0"})], "name string, kwargs map<string,string>")
    for until in (dt.datetime(2024, 1, 19), dt.datetime(2024, 1, 30)):
        schedule.follow(spark, catalogue, folder, root, checkpoint, dt.datetime(2024, 1, 3), until, dt.timedelta(days=8)).awaitTermination()
    return spark.read.parquet(f"{root}/bronze").groupBy("source_id").agg(F.count(F.lit(1)).alias("copies"))


@R.add("SELECT 'user_' || user_id AS entity, sum(value) >= 2000 AS high, 'delivered' AS status FROM events GROUP BY user_id HAVING sum(value) >= 1000")
def alerts_delivered(spark, sf):
    """Alerts handed to the file sink: what arrived, and what the journal says of it."""
    target, journal = scratch(spark, "alerts"), scratch(spark, "journal")
    sums = table(spark, sf, "events").groupBy(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity")).agg(F.sum("value").alias("score"))
    said = alerts.above_threshold(sums, 1000.0).select("entity", (F.col("score") >= 2000).alias("high"))
    found = sink.deliver(said, "file", journal, target)
    arrived = spark.read.schema("entity string, high boolean").json(f"{target}/*.jsonl")
    key = F.sha2(F.to_json(F.struct("entity", "high")), 256)
    return arrived.join(found.select("key", "status"), key == F.col("key")).select("entity", "high", "status")


CLOSED = "HAVING time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@R.add(f"SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY time_bucket(INTERVAL '1 hour', ts), event_type {CLOSED}")
def late_rows_backfilled(spark, sf):
    """Files come newest first, so most rows are late; after the backfill of their hours the closed hours equal the batch."""
    root = scratch(spark, "hours")
    late.keep_hours(streamed(spark, sf), root, scratch(spark, "checkpoint")).awaitTermination()
    late.backfill(spark, root, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    return late.hours(spark, root).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def fired(spark, sf):
    """Alerts of all rules over the events, which come twice: (root of the alerts)."""
    events, folder, root, checkpoint = table(spark, sf, "events"), scratch(spark, "stream"), scratch(spark, "alerts"), scratch(spark, "checkpoint")
    named = table(spark, sf, "nation").select(F.col("n_name").alias("rule_id"), F.concat(F.lit("user_"), F.col("n_nationkey").cast("string")).alias("entity"), (F.col("n_regionkey") * 10.0 + 20).alias("threshold"))
    for_all = table(spark, sf, "region").select(F.col("r_name").alias("rule_id"), F.lit(None).cast("string").alias("entity"), (F.col("r_regionkey") * 20.0 + 60).alias("threshold"))
    for _ in range(2):
        events.write.mode("append").parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)  # one batch a run, however many files
        scores = stream.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity"), F.col("value").alias("score"), "ts")
        subscriptions.fire(scores, named.unionByName(for_all), root, checkpoint).awaitTermination()
    return root


RULES = """r AS (SELECT n_name AS rule_id, 'user_' || n_nationkey AS entity, n_regionkey * 10.0 + 20 AS threshold FROM nation UNION ALL SELECT r_name, NULL, r_regionkey * 20.0 + 60 FROM region),
f AS (SELECT rule_id, 'user_' || user_id AS entity, min(ts) AS ts, arg_min(value, (ts, value)) AS score FROM events JOIN r ON value >= threshold AND (r.entity IS NULL OR r.entity = 'user_' || user_id) GROUP BY 1, 2)"""


@R.add(f"WITH {RULES} SELECT rule_id, entity, score, strftime(ts, '%Y-%m-%d %H:%M:%S') AS fired_at FROM f")
def alerts_fire_once(spark, sf):
    """Each rule fires for an entity at the first score that reaches it, and not again when the input comes again."""
    rows = subscriptions.alerts(spark, fired(spark, sf))
    return rows.select("rule_id", "entity", "score", F.date_format("fired_at", "yyyy-MM-dd HH:mm:ss").alias("fired_at"))


def digests(spark, sf, period):
    root, out = fired(spark, sf), scratch(spark, "digests")
    for upto in (dt.datetime(2024, 1, 9), dt.datetime(2024, 1, 20), dt.datetime(2024, 1, 20)):
        subscriptions.send_digests(spark, root, out, period, upto)
    rows = spark.read.schema("rule_id string, alerts bigint, highest double, entities array<string>, period_start date").parquet(out)
    return rows.select("period_start", "rule_id", "alerts", "highest", F.array_join("entities", ",").alias("entities"))


def digest_sql(start: str, days: int) -> str:
    return f"""WITH {RULES}, p AS (SELECT *, {start} AS period_start FROM f)
SELECT period_start, rule_id, count(*) AS alerts, max(score) AS highest, array_to_string(list(entity ORDER BY score DESC, entity)[:5], ',') AS entities FROM p WHERE period_start + {days} <= DATE '2024-01-20' GROUP BY 1, 2"""


@R.add(digest_sql("ts::DATE", 1))
def alert_digests_daily(spark, sf):
    """A digest for each rule and day that is over; each day is sent once, however often it is asked for."""
    return digests(spark, sf, "daily")


@R.add(digest_sql("date_trunc('week', ts)::DATE", 7))
def alert_digests_weekly(spark, sf):
    """A digest for each rule and week, from Monday."""
    return digests(spark, sf, "weekly")


TITLE = r"regexp_extract(html, '<title>(.*?)</title>', 1)"


@R.add(
    f"""WITH w AS (SELECT page_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower({TITLE}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> ''))) AS ws FROM pages),
c AS (SELECT ws, min(page_id) AS id FROM w WHERE len(ws) > 0 GROUP BY ws),
p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.ws, y.ws)) AS k, len(x.ws) + len(y.ws) AS n FROM c x JOIN c y ON x.id < y.id)
SELECT a, b, round(k / (n - k), 6) AS similarity FROM p WHERE k / (n - k) >= 0.3""".replace("\\\\", "\\")
)
def similar_headlines(spark, sf):
    """Pairs of page titles that share much of their words."""
    titles = table(spark, sf, "pages").select("page_id", F.expr(TITLE).alias("title"))
    return similar.similar(similar.word_sets(titles, "page_id", "title"), 0.3).withColumn("similarity", F.round("similarity", 6))


@R.add("SELECT 'good' AS file, count(*) AS entities, false AS failed FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT 'broken', 0, true UNION ALL SELECT 'object', 0, true")
def signals_strict(spark, sf):
    """Strict loading takes a whole file and fails on one that is cut off or has no trends."""
    sums = table(spark, sf, "events").groupBy(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity")).agg(F.sum("value").alias("score"))
    whole = sums.agg(F.to_json(F.struct(F.collect_list(F.struct("entity", "score")).alias("trends"))).alias("value"))  # the file is one object
    files = {"good": F.col("value"), "broken": F.expr("substr(value, 1, length(value) - 1)"), "object": F.replace(F.col("value"), F.lit("trends"), F.lit("other"))}
    out = []
    for name, value in files.items():
        path = scratch(spark, "signals")
        whole.select(value.alias("value")).coalesce(1).write.text(path)
        try:
            out.append((name, lake.signals(spark, path, strict=True).count(), False))
        except ValueError:
            out.append((name, 0, True))
    return spark.createDataFrame(out, "file string, entities bigint, failed boolean")


HN = ("event_id as id", f"{EPOCH} as time", "event_type as title", "props as text", "'story' as type", "user_id as score")


@R.add("SELECT event_id::VARCHAR AS source_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 50) WHERE event_id % 4 <> 0")
def hacker_news_list(spark, sf):
    """The first 50 ids of a list (here: by value) and their items; some items are gone."""
    folder, root, events = scratch(spark, "recorded"), scratch(spark, "lake"), table(spark, sf, "events")
    payloads(events.where("event_id % 4 <> 0"), *HN).write.text(f"{folder}/hacker_news")
    first = events.orderBy(F.desc("value"), "event_id").limit(80).agg(F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), "event_id"))).alias("x"))  # a list has a page of ids
    first.select(F.to_json(F.transform("x", lambda e: e["event_id"]))).coalesce(1).write.text(f"{folder}/hacker_news_ids")
    ingest.ingest(spark, spark.createDataFrame([("hacker_news", None)], CATALOGUE.replace("execution string, schedule string, ", "")), folder, root, dt.datetime(2024, 2, 1))
    return spark.read.parquet(f"{root}/bronze").select("source_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@R.add("SELECT event_id::VARCHAR AS source_id, 'cap ' || event_type AS text FROM events")
def threads_fallback(spark, sf):
    """The second endpoint is read when the first has nothing."""
    folder, root = scratch(spark, "recorded"), scratch(spark, "lake")
    spark.createDataFrame([], "value string").write.text(f"{folder}/threads")
    payloads(table(spark, sf, "events"), "cast(event_id as string) as id", "concat('cap ', event_type) as caption", f"{ISO} as timestamp").write.text(f"{folder}/threads_media")
    ingest.ingest(spark, spark.createDataFrame([("threads", None)], "name string, kwargs map<string,string>"), folder, root, dt.datetime(2024, 2, 1))
    return spark.read.parquet(f"{root}/bronze").select("source_id", "text")


@R.add(f"SELECT CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 'cold' ELSE 'hot' END AS tier, ts::DATE AS day, count(*) AS n FROM events WHERE {IN_RANGE} GROUP BY 1, 2")
def lake_tiers(spark, sf):
    """Old days are moved to the cold tier, twice, and stay readable with the hot ones."""
    root = scratch(spark, "lake")
    recorded_run(spark, sf, root)
    for before in (dt.date(2024, 1, 6), dt.date(2024, 1, 11)):
        lake.tier(spark, f"{root}/bronze", f"{root}/cold", before)
    rows = lake.both_tiers(spark, f"{root}/bronze", f"{root}/cold").where("source = 'reddit'")
    return rows.groupBy("tier", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@R.add(
    """WITH e AS (SELECT event_type AS source, ts::DATE AS day, event_id AS id FROM events), d AS (SELECT source, day, count(*) AS of FROM e GROUP BY ALL),
f AS (SELECT source, day, 'extra' AS field, 'new' AS change, 'boolean' AS kind, NULL AS expected, count(*) FILTER (WHERE id % 50 = 0) AS rows FROM e GROUP BY ALL
UNION ALL SELECT source, day, 'size', 'retyped', CASE WHEN count(*) FILTER (WHERE id % 20 <> 0) = 0 THEN 'string' ELSE 'mixed' END, 'number', count(*) FROM e GROUP BY ALL HAVING count(*) FILTER (WHERE id % 20 = 0) > 0
UNION ALL SELECT source, day, 'text', 'missing', CASE WHEN count(*) FILTER (WHERE id % 30 <> 0) > 0 THEN 'string' END, 'string', count(*) FILTER (WHERE id % 30 <> 0) FROM e GROUP BY ALL HAVING count(*) FILTER (WHERE id % 30 = 0) > 0
UNION ALL SELECT source, day, 'gone', 'missing', NULL, 'string', 0 FROM e GROUP BY ALL)
SELECT source, day, field, change, kind, expected, rows, of FROM f JOIN d USING (source, day) WHERE rows > 0 OR change <> 'new'"""
)
def schema_drift(spark, sf):
    """Fields of the payloads of each source and day that are new, missing or hold something else than expected."""
    events = table(spark, sf, "events")
    odd = F.when(F.col("event_id") % 20 == 0, F.format_string('{"id": %d, "size": "large", "note": null}', "event_id")).otherwise(F.format_string('{"id": %d, "size": %s, "note": "n"}', "event_id", F.col("value").cast("string")))
    more = F.concat(F.expr("substr({0}, 1, length({0}) - 1)".format("p")), F.when(F.col("event_id") % 50 == 0, F.lit(', "extra": true')).otherwise(""), F.when(F.col("event_id") % 30 != 0, F.lit(', "text": "t"')).otherwise(""), F.lit("}"))
    rows = events.select(F.col("event_type").alias("source"), F.to_date("ts").alias("day"), "event_id", odd.alias("p")).select("source", "day", more.alias("payload"))
    expected = events.select(F.col("event_type").alias("source")).distinct().select("source", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind")) for f, k in (("id", "number"), ("size", "number"), ("note", "string"), ("text", "string"), ("gone", "string"))))).alias("x")).select("source", "x.*")
    return schemas.drift(schemas.fields(rows, ["source", "day"]), expected, ["source", "day"], "source")


NORMAL = r"trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'))".replace("\\\\", "\\")


@R.add(
    f"""WITH t AS (SELECT doc_id, list_filter(string_split({NORMAL}, ' '), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split({NORMAL}, ' '), lambda w: w <> '') AS ws FROM benchmark),
n AS (SELECT words, min(code) AS code FROM (SELECT ws[:k] AS words, item_id::VARCHAR || '/' || len(ws[:k]) AS code FROM b, (VALUES (2), (3), (5)) v(k) WHERE len(ws) > 0) GROUP BY words),
m AS (SELECT doc_id, p - 1 AS s, p - 1 + len(words) AS e, code FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM t), n WHERE ws[p] = words[1] AND ws[p:p + len(words) - 1] = words),
g AS (SELECT doc_id, list({{'s': s, 'e': e, 'k': [code || '@' || s]}} ORDER BY s, e DESC) AS l FROM m GROUP BY doc_id)
SELECT doc_id, array_to_string(list_reduce(l, lambda a, x: CASE WHEN x.s >= a.e THEN {{'s': x.s, 'e': x.e, 'k': list_concat(a.k, x.k)}} ELSE a END).k, ',') AS entities FROM g"""
)
def dictionary_entities(spark, sf):
    """Names (the first two, three and five words of benchmark items) in all documents: leftmost, longest, without overlaps."""
    ws = F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    items = table(spark, sf, "benchmark").select("item_id", ws.alias("ws")).select("item_id", F.explode(F.transform(F.array(F.lit(2), F.lit(3), F.lit(5)), lambda k: F.slice("ws", F.lit(1), k))).alias("w"))
    names = items.select(F.array_join("w", " ").alias("name"), F.concat_ws("/", F.col("item_id").cast("string"), F.size("w").cast("string")).alias("code"))
    found = extract.entities(table(spark, sf, "documents"), extract.dictionary(names), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), F.array_join(F.transform("entities", lambda e: F.concat(e["code"], F.lit("@"), e["start"].cast("string"))), ",").alias("entities"))


@R.add(
    f"""WITH w AS (SELECT page_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower({TITLE}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> ''))) AS ws FROM pages),
c AS (SELECT ws, min(page_id) AS id FROM w WHERE len(ws) > 0 GROUP BY ws),
p AS (SELECT y.id AS b, max(len(list_intersect(x.ws, y.ws)) / (len(x.ws) + len(y.ws) - len(list_intersect(x.ws, y.ws)))) AS near FROM c x JOIN c y ON x.id < y.id GROUP BY y.id)
SELECT page_id, round(CASE WHEN page_id <> id THEN 0 WHEN near >= 0.3 THEN 1 - near ELSE 1 END, 6) AS novelty FROM w JOIN c USING (ws) LEFT JOIN p ON b = id""".replace("\\\\", "\\")
)
def headline_novelty(spark, sf):
    """How far each page's title is from all titles before it."""
    titles = table(spark, sf, "pages").select("page_id", F.expr(TITLE).alias("title"))
    return extract.novelty(titles, "page_id", "title", 0.3).select(F.col("id").alias("page_id"), F.round("novelty", 6).alias("novelty"))


@R.add(f"SELECT event_id::VARCHAR AS source_id FROM events WHERE {IN_RANGE} AND date_trunc('second', ts) > TIMESTAMP '2024-01-13'")
def lake_bronze_filters(spark, sf):
    """Rows with a tag, of the week up to the 20th."""
    root = scratch(spark, "lake")
    recorded_run(spark, sf, root)
    return lake.bronze(spark, root, category="tag", timeframe="7d", now=dt.datetime(2024, 1, 20)).select("source_id")


@R.add(
    r"""WITH t AS (SELECT conv_id, turn, text, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'https?://\S+', ' u ', 'g'), '[@#$][\p{L}\p{N}_]+', ' n ', 'g'), '[0-9]+([.,][0-9]+)*', ' 0 ', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS p FROM conversations),
n AS (SELECT *, count(*) OVER (PARTITION BY p) AS c FROM t)
SELECT conv_id, turn FROM n WHERE c < 3 AND NOT (regexp_matches(coalesce(text, ''), '(?i)(whats\s?app|telegram|t\.me/|join (my|our) (group|channel)|dm me|guaranteed (profit|return))')
  OR len(regexp_extract_all(coalesce(text, ''), 'https?://')) > 2 OR coalesce(length(regexp_replace(coalesce(text, ''), '[^!?$*#%🚀💰]', '', 'g'))::DOUBLE / nullif(length(coalesce(text, '')), 0), 0) > 0.3)"""
)
def posts_without_spam(spark, sf):
    """Posts that are no spam and whose template fewer than three posts have."""
    rows = hygiene.without_templates(table(spark, sf, "conversations").select("conv_id", "turn", "text"))
    return rows.where(~hygiene.spam("text")).select("conv_id", "turn")


@R.add("SELECT event_id, event_type, user_id FROM events")
def lake_strict_json(spark, sf):
    """Every line of the files parses to the given columns."""
    path = scratch(spark, "strict")
    table(spark, sf, "events").select("event_id", "event_type", "user_id").write.json(path)
    return lake.strict_json(spark, path, "event_id bigint, event_type string, user_id bigint")


@R.add("SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey % 5 <> 0")
def lake_tolerant_json(spark, sf):
    """One object in each file; every fifth is broken and left out."""
    path = scratch(spark, "tolerant")
    said = F.when(F.col("n_nationkey") % 5 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("n_name", "n_regionkey")))
    table(spark, sf, "nation").select("n_nationkey", said.alias("value")).repartition(25, "n_nationkey").select("n_nationkey", "value").write.partitionBy("n_nationkey").text(path)
    found = lake.tolerant_json(spark, f"{path}/*/*.txt")
    return found.select(F.try_variant_get("value", "$.n_name", "string").alias("name"), F.try_variant_get("value", "$.n_regionkey", "bigint").alias("region"))


@R.add("SELECT 'user_' || user_id AS entity, arg_max(value, (ts, event_id)) AS latest_score, count(*) AS mention_count, true AS written, false AS empty_written FROM events GROUP BY user_id")
def feature_table_created(spark, sf):
    """The feature table as DDL makes it, filled and read back; nothing is written where there is nothing to write."""
    name, path = f"features_{scratch(spark, 'ddl').rsplit('-', 1)[-1]}", scratch(spark, "features")
    new = features.latest_features(features.mentions(table(spark, sf, "events")))
    lake.create_feature_table(spark, name)
    new.select("entity", "latest_score", "mention_count", F.col("updated_at").cast("timestamp").alias("updated_at")).write.insertInto(name)
    done, nothing = lake.write_if_rows(spark.table(name), path), lake.write_if_rows(new.where("false"), f"{path}-none")
    spark.sql(f"DROP TABLE {name}")
    rows = spark.read.parquet(path)
    return rows.select("entity", "latest_score", "mention_count", F.lit(done).alias("written"), F.lit(nothing).alias("empty_written"))


@R.add("SELECT n_name AS connector, n_regionkey::VARCHAR AS \"limit\", 'true' AS dry_run, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS sub_reddit FROM nation")
def run_arguments(spark, sf):
    """Arguments of a run for every nation, as the command line gives them."""
    from tidemark.sources.registry import parse_arguments

    out = []
    for r in table(spark, sf, "nation").orderBy("n_nationkey").collect():  # 25 rows
        line = ["--connector", r.n_name, f"--limit={r.n_regionkey}", "--dry-run", *(["--sub-reddit", r.n_name] if r.n_nationkey % 2 == 0 else [])]
        got = parse_arguments(line)
        out.append((got["connector"], got["limit"], got["dry_run"], got.get("sub_reddit")))
    return spark.createDataFrame(out, "connector string, limit string, dry_run string, sub_reddit string")
