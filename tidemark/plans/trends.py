"""Queries of the feature store, of trend serving and of alerts, over ``events`` as mentions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import alerts, features, serving
from tidemark.plans.registry import Registry
from tidemark.session import table

R = Registry()
NOW = dt.datetime(2024, 2, 1)

M = """m AS (SELECT event_id AS id, 'user_' || user_id AS entity, event_type AS source, ts, value AS score FROM events)"""
FEATURES = f"""{M},
f AS (SELECT entity, arg_max(score, id) AS latest_score, count(*) AS mention_count, max(ts) AS updated_at FROM m GROUP BY entity),
s AS (SELECT entity, source, max(ts) AS ts FROM m GROUP BY entity, source),
e AS (SELECT entity, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS n FROM s GROUP BY entity)"""
TOP = """top AS (SELECT entity, latest_score AS score, mention_count, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS last_seen
  FROM f ORDER BY latest_score DESC, entity LIMIT {k})"""
SERVED = "SELECT entity, score, mention_count::BIGINT AS mention_count, last_seen, sources, n AS n_evidence FROM top JOIN e USING (entity)"
DAYS = f"""{M}, d AS (SELECT entity, ts::DATE AS day, count(*) AS n FROM m GROUP BY 1, 2)"""


def mentions(spark, sf):
    return features.mentions(table(spark, sf, "events"))


def store(spark, sf):
    """The feature table with its evidence."""
    items = features.with_evidence(mentions(spark, sf))
    return items.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


def served(trends):
    return trends.select("entity", "score", "mention_count", "last_seen", F.array_join(F.transform("evidence", lambda e: e["source"]), ",").alias("sources"), F.size("evidence").cast("long").alias("n_evidence"))


@R.add(f"WITH {FEATURES}, {TOP.format(k=10)} {SERVED}")
def trends_topk(spark, sf):
    """Top trends by latest score: the flagship query."""
    return served(serving.trends(store(spark, sf), 10))


@R.add(f"WITH {FEATURES}, {TOP.format(k=20)} {SERVED} WHERE entity IN (SELECT entity FROM m WHERE source = 'purchase')")
def trends_filter_source(spark, sf):
    """The source filter runs after the top-k."""
    return served(serving.trends(store(spark, sf), 20, source="purchase"))


@R.add(f"WITH {FEATURES}, {TOP.format(k=50)} {SERVED} WHERE contains(lower(entity), 'r_1') OR entity IN (SELECT entity FROM m WHERE contains(source, 'r_1')) ORDER BY score DESC, entity LIMIT 50")
def trends_filter_query(spark, sf):
    return served(serving.trends(store(spark, sf), 50, query="R_1"))


@R.add(f"WITH {FEATURES}, {TOP.format(k=100)} {SERVED} WHERE entity = 'user_7'")
def trend_detail(spark, sf):
    return served(serving.detail(store(spark, sf), "user_7"))


@R.add(
    f"""WITH {FEATURES}, {TOP.format(k=5)}
SELECT entity, i::BIGINT AS idx, strftime(TIMESTAMP '2024-02-01' - to_days((6 - i)::INTEGER), '%Y-%m-%dT%H:%M:%SZ') AS date,
  round(greatest(0.0::DOUBLE, score * (0.65::DOUBLE + i / 6.0::DOUBLE * 0.35::DOUBLE)), 6) AS value
FROM top, range(7) r(i)"""
)
def trend_timeline(spark, sf):
    top = serving.trends(store(spark, sf), 5)
    return serving.timeline(top, NOW, 7, digits=None).withColumn("value", F.round("value", 6))


@R.add(f"WITH {FEATURES}, {TOP.format(k=5)} SELECT entity, 'score' AS series, score AS value FROM top UNION ALL SELECT entity, 'mention_count', mention_count::DOUBLE FROM top")
def dashboard_charts(spark, sf):
    return serving.chart_series(serving.trends(store(spark, sf), 5))


@R.add(
    f"""WITH {FEATURES}, {TOP.format(k=5)}
SELECT count(*) AS signal_count, 5::BIGINT AS platform_count, string_agg(entity, ',' ORDER BY score DESC, entity) AS entities,
  sum(mention_count)::BIGINT AS mentions, 'features' AS feature_store FROM top"""
)
def dashboard_summary(spark, sf):
    platforms = table(spark, sf, "events").select(F.col("event_type").alias("name")).distinct()
    board = serving.dashboard(serving.trends(store(spark, sf), 5), platforms, "features")
    return board.select(
        "signal_count", "platform_count", F.array_join(F.transform("top_trends", lambda t: t["entity"]), ",").alias("entities"),
        F.aggregate("mention_breakdown", F.lit(0).cast("long"), lambda a, t: a + t["mention_count"]).alias("mentions"), "feature_store",
    )


@R.add(f"WITH {FEATURES}, {TOP.format(k=20)} SELECT entity, printf('%.2f', score) AS score_text, n AS evidence_count, last_seen FROM top JOIN e USING (entity)")
def trend_table_cells(spark, sf):
    return serving.table_cells(serving.trends(store(spark, sf), 20))


@R.add("SELECT DISTINCT event_type AS name, upper(event_type[1]) || event_type[2:] AS label, 'Healthy' AS status, 'hourly' AS schedule, 'unknown' AS execution, '2024-02-01T00:00:00Z' AS last_run, 'n/a' AS items_ingested FROM events")
def platform_statuses(spark, sf):
    names = table(spark, sf, "events").select(F.col("event_type").alias("name")).distinct()
    return serving.platform_statuses(names.withColumns({"schedule": F.lit("hourly"), "execution": F.lit(None).cast("string")}), NOW)


@R.add("SELECT DISTINCT 'ingest_' || event_type AS dag_id, 'scheduled' AS status, '2024-02-01T00:00:00Z' AS last_run, '2024-02-01T00:00:00Z' AS next_run FROM events")
def pipeline_statuses(spark, sf):
    return serving.pipeline_statuses(table(spark, sf, "events").select(F.col("event_type").alias("name")).distinct(), NOW)


@R.add(f"WITH {M} SELECT entity, count(*) AS mention_count, count(*)::DOUBLE AS score FROM m GROUP BY entity")
def mention_counts(spark, sf):
    return features.mention_counts(mentions(spark, sf))


@R.add("SELECT coalesce(nullif(json_extract_string(props, '$.k'), ''), nullif(event_type, ''), 'unknown') AS entity, count(*) AS mention_count, count(*)::DOUBLE AS score FROM events GROUP BY 1")
def json_entity_counts(spark, sf):
    """The key is the first non-empty of a nested attribute, a column and ``unknown``."""
    rows = table(spark, sf, "events")
    return features.mention_counts(rows, features.first_filled(F.get_json_object("props", "$.k"), "event_type", default="unknown"))


@R.add(f"WITH {FEATURES} SELECT entity, latest_score, mention_count::BIGINT AS mention_count, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM f")
def feature_merge(spark, sf):
    """Two disjoint deltas merged give the features of the whole."""
    rows = mentions(spark, sf)
    half = F.to_date("ts") < F.lit("2024-01-16").cast("date")
    merged = features.merge_features(features.latest_features(rows.where(half)), features.latest_features(rows.where(~half)))
    return merged.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


@R.add(f"WITH {FEATURES} SELECT entity, latest_score AS score FROM f WHERE latest_score >= 150")
def alert_threshold(spark, sf):
    signals = features.latest_features(mentions(spark, sf)).select("entity", F.col("latest_score").alias("score"))
    return alerts.above_threshold(signals, 150.0)


@R.add(
    f"""WITH {FEATURES}, r AS (SELECT * FROM (VALUES ('all-high', NULL, 480.0::DOUBLE), ('watch-7', 'user_7', 1.0::DOUBLE)) t(rule_id, entity, threshold))
SELECT rule_id, f.entity, latest_score, threshold FROM f JOIN r ON (r.entity IS NULL OR r.entity = f.entity) AND latest_score >= threshold"""
)
def alert_subscriptions(spark, sf):
    rules = spark.createDataFrame([("all-high", None, 480.0), ("watch-7", "user_7", 1.0)], "rule_id string, entity string, threshold double")
    return alerts.rules(features.latest_features(mentions(spark, sf)), rules)


STEPS = f"""{DAYS}, v AS (SELECT *, lag(n) OVER w AS previous, n - lag(n) OVER w AS velocity FROM d WINDOW w AS (PARTITION BY entity ORDER BY day))"""


@R.add(f"WITH {STEPS} SELECT entity, day, n, previous, velocity, velocity - lag(velocity) OVER (PARTITION BY entity ORDER BY day) AS acceleration, round((n - previous)::DOUBLE / nullif(previous, 0), 6) AS pct_change FROM v")
def velocity_daily(spark, sf):
    return features.velocity(features.per_day(mentions(spark, sf))).withColumn("pct_change", F.round("pct_change", 6))


@R.add(f"WITH {STEPS} SELECT entity, day, n, previous, velocity, round((n - previous)::DOUBLE / nullif(previous, 0), 6) AS pct_change FROM v WHERE (n - previous)::DOUBLE / nullif(previous, 0) >= 2")
def alert_pct_change(spark, sf):
    found = alerts.jumps(features.per_day(mentions(spark, sf)), 2.0)
    return found.select("entity", "day", "n", "previous", "velocity", F.round("pct_change", 6).alias("pct_change"))


@R.add(
    """WITH d AS (SELECT event_type AS source, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2),
z AS (SELECT *, (n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0) AS z FROM d WINDOW w AS (PARTITION BY source ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT source, day, n, round(z, 5) AS z FROM z WHERE abs(z) >= 1.5"""
)
def alert_outliers(spark, sf):
    counts = features.per_day(mentions(spark, sf), "source")
    return features.z_scores(counts, 20, "source").where(F.abs("z") >= 1.5).select("source", "day", "n", F.round("z", 5).alias("z"))


@R.add(
    """WITH d AS (SELECT event_type AS source, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2),
q AS (SELECT *, avg(n) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a, avg(n) OVER (w ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) AS b,
  count(*) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS c FROM d WINDOW w AS (PARTITION BY source ORDER BY day))
SELECT source, day, n, round(CASE WHEN c = 6 THEN a / b - 1 END, 6) AS momentum FROM q"""
)
def momentum(spark, sf):
    return features.momentum(features.per_day(mentions(spark, sf), "source"), 3, "source").withColumn("momentum", F.round("momentum", 6))


@R.add(
    """WITH a AS (SELECT event_type AS source, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2),
v AS (SELECT *, n - lag(n) OVER w AS v FROM a WINDOW w AS (PARTITION BY source ORDER BY day)),
x AS (SELECT *, v - lag(v) OVER (PARTITION BY source ORDER BY day) AS acc FROM v)
SELECT source, day, CASE WHEN acc > 0 THEN 'accelerating' WHEN acc < 0 THEN 'decelerating' ELSE 'stable' END AS posture FROM x"""
)
def growth_posture(spark, sf):
    from tidemark.operators.equity import posture

    moved = features.velocity(features.per_day(mentions(spark, sf), "source"), "source")
    return moved.select("source", "day", posture(F.col("acceleration")).alias("posture"))


@R.add("SELECT 'user_' || user_id AS entity, event_type AS source, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY user_id, event_type")
def source_breakdown(spark, sf):
    from pyspark.sql import Window as W

    counts = mentions(spark, sf).groupBy("entity", "source").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("entity")), 6))


@R.add("""PIVOT (SELECT 'user_' || user_id AS entity, event_type FROM events WHERE user_id IN (7, 8)) ON event_type IN ('click', 'error', 'purchase', 'signup', 'view') USING count(*) GROUP BY entity""")
def compare_entities(spark, sf):
    """Two entities across every source."""
    two = mentions(spark, sf).where(F.col("entity").isin("user_7", "user_8"))
    wide = two.groupBy("entity").pivot("source", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1)))
    return wide.na.fill(0)


@R.add(
    """WITH w AS (SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS h FROM events), x AS (SELECT event_type, unnest(range(24)) AS k, h FROM w)
SELECT event_type, strftime(h - to_hours(k::INTEGER), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM x GROUP BY 1, 2"""
)
def hourly_window_24h(spark, sf):
    """Sliding windows of 24 hours; hourly sums come first, so a row is not multiplied by 24."""
    hours = table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h")).agg(F.count(F.lit(1)).alias("c"))
    slid = hours.groupBy("event_type", F.window("h", "24 hours", "1 hour").alias("w")).agg(F.sum("c").alias("n"))
    return slid.select("event_type", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@R.add("SELECT event_type, count(*) FILTER (WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS last_24h, count(*) AS n FROM events GROUP BY 1")
def feed_counts(spark, sf):
    rows = table(spark, sf, "events")
    newest = rows.agg(F.max("ts").alias("newest"))
    return rows.crossJoin(F.broadcast(newest)).groupBy("event_type").agg(F.count_if(F.col("ts") > F.col("newest") - F.expr("INTERVAL 24 HOUR")).alias("last_24h"), F.count(F.lit(1)).alias("n"))


@R.add(
    """WITH p AS (SELECT event_type AS source, user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-16') AS now_n, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-16') AS then_n FROM events GROUP BY 1, 2)
SELECT source, 'user_' || user_id AS entity, now_n, then_n, round(now_n::DOUBLE / nullif(then_n, 0) - 1, 6) AS rise FROM p
QUALIFY row_number() OVER (PARTITION BY source ORDER BY coalesce(round(now_n::DOUBLE / nullif(then_n, 0) - 1, 6), -2) DESC, 'user_' || user_id) <= 3"""
)
def rising_entities(spark, sf):
    """Highest rise between two periods within each source."""
    from tidemark.operators.hygiene import top_per_group

    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    periods = mentions(spark, sf).groupBy("source", "entity").agg(F.count_if(late).alias("now_n"), F.count_if(~late).alias("then_n"))
    rise = periods.withColumn("rise", F.round(F.try_divide(F.col("now_n").cast("double"), F.col("then_n").cast("double")) - 1, 6))
    return top_per_group(rise, "source", [F.coalesce("rise", F.lit(-2.0)).desc(), F.col("entity")], 3).drop("rank")


@R.add(
    """WITH d AS (SELECT event_type AS source, ts::DATE AS day, count(*) AS n, avg(value) AS price, (ts::DATE - DATE '2024-01-01')::DOUBLE AS x FROM events GROUP BY ALL)
SELECT source, round(regr_slope(n, x), 6) AS interest_slope, round(regr_slope(price, x), 6) AS price_slope FROM d GROUP BY source HAVING regr_slope(n, x) IS NOT NULL"""
)
def interest_against_price(spark, sf):
    """Slopes of search interest and price, to be compared."""
    d = mentions(spark, sf).groupBy("source", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("price"))
    d = d.withColumn("x", F.date_diff("day", F.lit("2024-01-01").cast("date")).cast("double"))
    return d.groupBy("source").agg(F.round(F.regr_slope("n", "x"), 6).alias("interest_slope"), F.round(F.regr_slope("price", "x"), 6).alias("price_slope"))


@R.add("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_hourly_counts(spark, sf):
    """The batch form of the streaming query; tests hold both against each other."""
    from tidemark.streaming.features import windowed_counts

    counts = windowed_counts(table(spark, sf, "events"))
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@R.add(
    """WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n FROM s GROUP BY user_id, k"""
)
def user_sessions(spark, sf):
    from tidemark.streaming.features import sessions

    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return sessions(table(spark, sf, "events")).select("user_id", shown("start"), shown("end"), "n")
