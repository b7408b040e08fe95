"""Queries of normalisation, record hygiene and community sentiment, over documents, pages, events and conversations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import hygiene, linking, normalize, sentiment
from tidemark.plans.registry import Registry
from tidemark.session import table

R = Registry()
NOW = dt.datetime(2024, 2, 1)


@R.add(
    """SELECT 'reddit' AS source, doc_id::VARCHAR AS source_id, strftime(to_timestamp(1704067200 + doc_id * 60)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS ts, md5(lang || chr(10) || text) AS text_md5, source AS subreddit, 0::BIGINT AS n_entities FROM documents"""
)
def norm_reddit_like(spark, sf):
    raw = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), (F.lit(1704067200) + F.col("doc_id") * 60).alias("created_utc"), F.col("lang").alias("title"), F.col("text").alias("selftext"), F.col("source").alias("subreddit"), F.lit(1).alias("score"), F.lit(0).alias("num_comments")
    )
    return normalize.reddit(raw, NOW).select(
        "source", "source_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.md5("text").alias("text_md5"), F.col("metadata")["subreddit"].alias("subreddit"), F.size("entities").cast("long").alias("n_entities")
    )


@R.add("SELECT event_id, 'k:' || json_extract_string(props, '$.k') || ' | type:' || event_type AS text FROM events")
def norm_pairs_text(spark, sf):
    rows = table(spark, sf, "events")
    pairs = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"), F.lit("isPartial"), F.lit("true"))
    return rows.select("event_id", normalize.pairs_text(pairs).alias("text"))


@R.add("SELECT source, doc_id::VARCHAR AS source_id, 1704067200 + doc_id AS timestamp, length(text) + 1 AS text_chars FROM documents")
def bronze_projection(spark, sf):
    raw = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("subreddit"), (F.lit(1704067200) + F.col("doc_id")).alias("created_utc"), F.col("text").alias("title"), F.lit(None).cast("string").alias("selftext"))
    return normalize.bronze_rows(raw).select("source", "source_id", "timestamp", F.length("text").cast("long").alias("text_chars"))


@R.add(
    """WITH u AS (SELECT source, doc_id, n_chars, 1 AS gen FROM documents UNION ALL SELECT source, doc_id, n_chars + 1, 2 FROM documents WHERE doc_id % 3 = 0)
SELECT source, doc_id, arg_max(n_chars, gen) AS n_chars, max(gen) AS gen FROM u GROUP BY source, doc_id"""
)
def bronze_union_dedup(spark, sf):
    """Overlapping batches in one lake, the later row of a key wins."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    late = docs.where("doc_id % 3 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    both = hygiene.union_sources(docs.withColumn("gen", F.lit(1)), late.withColumn("gen", F.lit(2)))
    return hygiene.latest_per_key(both, ["source", "doc_id"], [F.col("gen")])


@R.add(
    """WITH q AS (SELECT source, count(*) AS n_rows, count(DISTINCT text) AS n_distinct, sum((text IS NULL OR text = '')::INT + (lang IS NULL OR lang = '')::INT)::BIGINT AS n_missing FROM documents GROUP BY source)
SELECT *, round(1 - n_distinct / n_rows, 6) AS duplicate_rate, round(n_missing / (n_rows * 2), 6) AS missing_rate, round((n_distinct / n_rows) * (1 - n_missing / (n_rows * 2)), 6) AS dq_score FROM q"""
)
def dq_metrics(spark, sf):
    return hygiene.quality_metrics(table(spark, sf, "documents"), "source", "text", ["text", "lang"])


@R.add(
    r"""SELECT md5(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'))) AS text_md5, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"""
)
def near_dup_normalised(spark, sf):
    return hygiene.same_text(table(spark, sf, "documents"))


@R.add(
    r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS text_md5 FROM pages"""
)
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(hygiene.plain("html")).alias("text_md5"))


@R.add("SELECT md5(left(html, 1000)) AS text_md5, url AS source_id FROM pages")
def html_prefix_1000(spark, sf):
    return normalize.edgar(table(spark, sf, "pages"), NOW).select("source_id", F.md5("text").alias("text_md5"))


@R.add(r"""SELECT page_id, regexp_extract(html, '<script>(.*?)</script>', 1) AS script, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages""")
def html_script_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<script>(.*?)</script>", 1).alias("script"), F.parse_url("url", F.lit("HOST")).alias("host"))


@R.add(
    r"""SELECT page_id, regexp_extract(url, '^(\w+)://', 1) AS scheme, regexp_extract(url, '^\w+://([^/]+)', 1) AS host, regexp_extract(url, '^\w+://[^/]+([^?#]*)', 1) AS path, nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query, nullif(regexp_extract(url, '#(.*)$', 1), '') AS ref FROM pages"""
)
def url_parts(spark, sf):
    part = lambda p: F.parse_url("url", F.lit(p))
    return table(spark, sf, "pages").select("page_id", part("PROTOCOL").alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"), part("REF").alias("ref"))


@R.add(
    """WITH r AS (SELECT text FROM conversations), w AS (SELECT text, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM r)
SELECT count(*) AS posts, count(*) FILTER (WHERE NOT (len(ws) < 4 OR coalesce(1 - len(list_distinct(ws))::DOUBLE / nullif(len(ws), 0), 1) > 0.5 OR regexp_matches(text, '^[^\\p{L}\\p{N}]*$') OR regexp_matches(text, '^\\s*(RT|via) @') OR regexp_matches(text, '^[\\s$A-Z.]*$'))) AS kept FROM w""".replace("\\\\", "\\")
)
def post_quality_filter(spark, sf):
    posts = table(spark, sf, "conversations").select("text")
    return posts.agg(F.count(F.lit(1)).alias("posts"), F.count_if(~F.coalesce(hygiene.weak_post("text"), F.lit(True))).alias("kept"))


@R.add("SELECT source, min(doc_id) AS position FROM documents GROUP BY source")
def symbol_dedup_order(spark, sf):
    return hygiene.ordered_distinct(table(spark, sf, "documents"), "source", "doc_id")


@R.add("SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 3")
def top3_per_symbol(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return hygiene.top_per_group(rows, "source", [F.desc("n_chars"), F.col("doc_id")], 3)


POSTS = "p AS (SELECT source AS symbol, CASE WHEN toxic = 1 THEN 'bearish' WHEN quality = 1 THEN 'bullish' ELSE 'neutral' END AS stance FROM documents JOIN labels USING (doc_id))"
SHARES = "count(*) AS post_count, " + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (WHERE stance = '{s}') / count(*), 6) AS {n}" for s, n in (("bullish", "bull_pct"), ("bearish", "bear_pct"), ("neutral", "neutral_pct")))


def posts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("symbol"))
    return docs.join(table(spark, sf, "labels"), "doc_id").select("doc_id", "symbol", sentiment.stance("quality", "toxic").alias("stance"))


@R.add(f"WITH {POSTS} SELECT symbol, {SHARES} FROM p GROUP BY symbol")
def sentiment_symbol(spark, sf):
    return sentiment.by_symbol(posts(spark, sf))


@R.add(f"WITH {POSTS} SELECT CASE WHEN grouping(symbol) = 1 THEN '(group)' ELSE symbol END AS symbol, {SHARES} FROM p GROUP BY ROLLUP (symbol)")
def sentiment_group_rollup(spark, sf):
    return sentiment.with_group(posts(spark, sf))


@R.add(
    f"""WITH {POSTS}, s AS (SELECT symbol, {SHARES} FROM p GROUP BY symbol)
SELECT *, CASE WHEN abs(bull_pct - bear_pct) < 60 AND bull_pct >= 10 AND bear_pct >= 10 THEN 'mixed' WHEN greatest(bull_pct, bear_pct) >= 10 AND bull_pct > bear_pct THEN 'bullish'
  WHEN greatest(bull_pct, bear_pct) >= 10 AND bear_pct > bull_pct THEN 'bearish' ELSE 'neutral' END AS label FROM s"""
)
def sentiment_label(spark, sf):
    return sentiment.label(sentiment.by_symbol(posts(spark, sf)), near=60.0, both=10.0)


@R.add(
    f"""WITH {POSTS}, c AS (SELECT symbol, count(*) FILTER (WHERE stance = 'bullish') AS bull, count(*) FILTER (WHERE stance = 'bearish') AS bear FROM p GROUP BY symbol)
SELECT symbol, bull, bear, round(100.0::DOUBLE * bull / nullif(sum(bull) OVER (), 0)::DOUBLE, 6) AS bull_share, round(100.0::DOUBLE * bear / nullif(sum(bear) OVER (), 0)::DOUBLE, 6) AS bear_share FROM c"""
)
def sentiment_drivers(spark, sf):
    return sentiment.drivers(posts(spark, sf))


@R.add("SELECT event_type AS symbol, strftime(min(ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS time_range_earliest, strftime(max(ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M') AS time_range_latest FROM events GROUP BY 1")
def post_data_window(spark, sf):
    return sentiment.data_window(table(spark, sf, "events").withColumnRenamed("event_type", "symbol"))


@R.add("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON d.doc_id = b.item_id * 3")
def lookup_join(spark, sf):
    """Items of a list of ids."""
    ids = table(spark, sf, "benchmark").select((F.col("item_id") * 3).alias("doc_id"), F.col("item_id").alias("position"))
    return linking.lookup_in_order(ids, table(spark, sf, "documents").select("doc_id"), "doc_id").select(F.col("position").alias("item_id"), "doc_id")


@R.add("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def lookup_missing_anti(spark, sf):
    return linking.misses(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@R.add("SELECT event_id, event_type FROM events WHERE event_type IN ('view', 'click')")
def config_semi_join(spark, sf):
    wanted = spark.createDataFrame([("VIEW",), ("Click",)], "name string").select(F.lower("name").alias("event_type")).distinct()
    return table(spark, sf, "events").select("event_id", "event_type").join(F.broadcast(wanted), "event_type", "left_semi").select("event_id", "event_type")


@R.add("SELECT n_nationkey, lower(n_name) AS name, r_name AS code, false AS ambiguous FROM nation JOIN region ON n_regionkey = r_regionkey")
def alias_resolve(spark, sf):
    nations = table(spark, sf, "nation")
    aliases = nations.join(table(spark, sf, "region"), nations.n_regionkey == F.col("r_regionkey")).select(F.col("n_name").alias("alias"), F.col("r_name").alias("code"))
    return linking.resolve_aliases(nations.select("n_nationkey", F.lower("n_name").alias("name")), aliases)


@R.add("SELECT conv_id, turn, coalesce(label, role) AS label FROM conversations LEFT JOIN (VALUES ('user', 'User'), ('assistant', 'Assistant')) t(role, label) USING (role)")
def label_or_key(spark, sf):
    labels = spark.createDataFrame([("user", "User"), ("assistant", "Assistant")], "role string, label string")
    return linking.labelled(table(spark, sf, "conversations").select("conv_id", "turn", "role"), F.broadcast(labels), "role", "label").select("conv_id", "turn", "label")
