"""The registered queries of the training-data operators, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, fim, html_text, langid, line_crf, minhash, mixing, negatives, pii, quality_rules, suffix_dedup, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return removed.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.aggregate("shared", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_shared"),
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs, where=_remainder(4) != 2)
    return langid.predict(docs, model).withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = line_crf.fit(docs, _table(spark, sf_dir, "labels"), where=_remainder(3) != 1)
    return line_crf.add_score(docs, model).select(
        "doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


PROBE = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return chat.digests(chat.format_chats(rows.unionByName(probe)))


#: The rules of the query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_repeated_passages": op2_repeated_passages,
    "op3_mix_sources": op3_mix_sources,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_pii": op5_pii,
    "op6_main_text": op6_main_text,
    "op7_language": op7_language,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat_format": op9_chat_format,
    "op10_line_crf": op10_line_crf,
    "op11_url_filter": op11_url_filter,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_fill_in_middle": op13_fill_in_middle,
}


def _repeats(length: int, out: str) -> str:
    """SQL of the maximal runs (r, a, b) covered by windows of ``length`` bytes that start twice, from hex pieces of 4,096 windows."""
    return f"""{out}_w AS (SELECT r, c * 4096 + s AS s, hash(substr(piece, 2 * s + 1, {2 * length})) AS m
  FROM (SELECT r, c, n, piece, unnest(range(0, least(4096, n - {length} + 1 - c * 4096))) AS s
    FROM (SELECT r, c, n, substr(h, c * 8192 + 1, 8192 + {2 * length}) AS piece
      FROM (SELECT r, h, n, unnest(range(0, (n - {length}) // 4096 + 1)) AS c FROM d WHERE n >= {length})))),
{out}_g AS (SELECT r, s, CASE WHEN s - lag(s) OVER (PARTITION BY r ORDER BY s) <= {length} THEN 0 ELSE 1 END AS fresh
  FROM {out}_w WHERE m IN (SELECT m FROM {out}_w GROUP BY m HAVING count(*) > 1)),
{out}_i AS (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM {out}_g),
{out} AS (SELECT r, k, min(s) AS a, max(s) + {length} AS b FROM {out}_i GROUP BY r, k)"""


ORACLE_SQL = {
    "op11_url_filter": r"""
WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS name, rest FROM rest),
u AS (SELECT page_id, translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(name) + 1), '^[^?#]*') AS path, row_number() OVER () AS row FROM split),
fits AS (SELECT row, arg_max(r.host || r.path, (length(r.host || r.path), length(r.host))) AS rule, arg_max(r.verdict, (length(r.host || r.path), length(r.host))) AS verdict
  FROM u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN fits USING (row)
""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 100 * score BETWEEN 80 * positive_score AND 100 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
""",
    "op13_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
c AS (SELECT *, array_to_string(u[:least(h1 % (n + 1), h2 % (n + 1))], '') AS p, array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s FROM k),
m AS (SELECT *, text[length(p) + 1:length(text) - length(s)] AS m,
  CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM m
""",
    "op2_repeated_passages": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
{_repeats(400, "gone")},
{_repeats(256, "shared")},
ends AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM gone UNION ALL
  SELECT d.r, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN gone USING (r) GROUP BY d.r),
kept AS (SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a, b) AS h FROM ends JOIN d USING (r) GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce((SELECT sum(b - a) FROM gone WHERE gone.r = d.r), 0)::BIGINT AS n_removed,
  (SELECT count(*) FROM gone WHERE gone.r = d.r)::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256,
  coalesce((SELECT sum(b - a) FROM shared WHERE shared.r = d.r), 0)::BIGINT AS n_shared
FROM d JOIN kept USING (r)
""",
    "op4_near_duplicates": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda p: array_to_string(ws[p:p + 4], ' ')))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM w),
x AS (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS e FROM g),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.e = b.e AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS node, doc_id AS root FROM g UNION SELECT b, root FROM reach JOIN pairs ON node = a),
c AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM g JOIN c ON doc_id = node
""",
    "op1_decontaminate": r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM t),
i AS (SELECT id, ws, least(10, len(ws)) AS n FROM w WHERE kind = 'i' AND len(ws) > 0),
iw AS (SELECT DISTINCT n, id, array_to_string(ws[p:p + n - 1], ' ') AS g
  FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM i)),
dw AS (SELECT id, n, p, array_to_string(ws[p:p + n - 1], ' ') AS g
  FROM (SELECT w.id, w.ws, l.n, unnest(range(1, len(w.ws) - l.n + 2)) AS p
    FROM w, (SELECT DISTINCT n FROM i) l WHERE w.kind = 'd')),
h AS (SELECT dw.id, dw.p, dw.n, iw.id AS item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
hw AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(p, p + n)) AS k FROM h) GROUP BY id),
hi AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM h) GROUP BY id)
SELECT w.id AS doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (id) LEFT JOIN hi USING (id) WHERE w.kind = 'd'
""",
    "op9_chat_format": r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 25 + length(role) END AS mark,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS next,
    regexp_replace(regexp_replace(text,
      '<(\\*)(<SYS>>|</SYS>>|s>|/s>|<ROLE>>|</ROLE>>|</END>>)', '<\\\1\2', 'g'),
      '\[(\\*)(INST\]|/INST\])', '[\\\1\2', 'g') AS shown
  FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(mark + length(shown))::BIGINT AS formatted_chars,
  bool_and(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev = 'system' THEN role = 'user'
    WHEN prev = 'user' THEN role = 'assistant' WHEN prev = 'assistant' THEN role = 'user' ELSE false END)
    AND bool_and(next IS NOT NULL OR role = 'assistant') AND count(DISTINCT turn) = count(*) AS valid
FROM m GROUP BY conv_id
""",
}
