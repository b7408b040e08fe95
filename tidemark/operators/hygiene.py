"""Record hygiene: unions, duplicates, data-quality metrics, markup, weak posts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def union_sources(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_non_empty(*frames: DataFrame) -> DataFrame:
    """The first frame that has rows, else the last."""
    return next((f for f in frames[:-1] if not f.isEmpty()), frames[-1])


def latest_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the latest by ``order``; a skewed key is reduced before the shuffle."""
    others = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("kept_"))
    return best.select(*key, *(F.col("kept_")[c].alias(c) for c in others)).select(*rows.columns)


def normal_text(text: Column | str) -> Column:
    """Lower case, letters and digits only, single blanks."""
    c = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def same_text(rows: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """Groups of rows with the same normalised text: how many, and the smallest id."""
    return rows.groupBy(F.md5(normal_text(text)).alias("text_md5")).agg(F.count(F.lit(1)).alias("copies"), F.min(ident).alias("first_id")).where("copies > 1")


def ordered_distinct(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct keys in the order in which they first appear."""
    return rows.groupBy(key).agg(F.min(position).alias("position")).orderBy("position")


def quality_metrics(rows: DataFrame, by: str, ident: str, required: list[str], ts: str | None = None, bad: Column | None = None) -> DataFrame:
    """Per partition: rows, duplicate rate, share of missing required values, freshness (newest ``ts``),
    share of ``bad`` rows, and a score of 0 to 1. Texts are told apart by 128-bit digests."""
    known = F.unhex(F.md5(ident)) if dict(rows.dtypes)[ident] == "string" else F.col(ident)
    missing = reduce(lambda a, b: a + b, (F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), 1).otherwise(0) for c in required))
    out = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(known).alias("n_distinct"),
        F.sum(missing).cast("long").alias("n_missing"),
        *([F.max(ts).alias("freshest")] if ts else []),
        *([F.round(F.count_if(bad) / F.count(F.lit(1)), 6).alias("error_rate")] if bad is not None else []),
    )
    share = F.col("n_missing") / (F.col("n_rows") * len(required))
    duplicate = 1 - F.col("n_distinct") / F.col("n_rows")
    return out.withColumns({"duplicate_rate": F.round(duplicate, 6), "missing_rate": F.round(share, 6), "dq_score": F.round((1 - duplicate) * (1 - share), 6)})


def plain(html: Column | str) -> Column:
    """Markup away (scripts and styles with their content), white space single."""
    c = F.col(html) if isinstance(html, str) else html
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def shared_data(html: Column | str) -> Column:
    """The script text that assigns the page's shared data, right of the first ``=``, without the closing ``;``."""
    c = F.col(html) if isinstance(html, str) else html
    found = F.regexp_extract(c, r"(?s)<script type=\"text/javascript\">\s*window\._sharedData\s*=(.*?);*\s*</script>", 1)
    return F.nullif(F.trim(found), F.lit(""))


def weak_post(text: Column | str, least_words: int = 4, most_repeated: float = 0.5) -> Column:
    """Near-empty posts, bare tickers, repost marks, and posts that mostly repeat themselves."""
    c = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    repeated = 1 - F.try_divide(F.size(F.array_distinct(words)).cast("double"), F.size(words).cast("double"))
    bare = c.rlike(r"^[^\p{L}\p{N}]*$")  # signs and emoji only
    return (F.size(words) < least_words) | bare | (F.coalesce(repeated, F.lit(1.0)) > most_repeated) | c.rlike(r"^\s*(RT|via) @") | c.rlike(r"^[\s$A-Z.]*$")


def template(text: Column | str) -> Column:
    """What a post has in common with others made from the same template: addresses, names, tickers and numbers masked."""
    c = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    for pattern, mask in ((r"https?://\S+", " u "), (r"[@#$][\p{L}\p{N}_]+", " n "), (r"[0-9]+([.,][0-9]+)*", " 0 ")):
        c = F.regexp_replace(c, pattern, mask)
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def without_templates(posts: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """Without posts whose template ``least`` posts or more have. Templates are counted before they meet the posts, so one that most posts have is one row."""
    marked = posts.withColumn("template_", F.md5(template(text)))
    often = marked.groupBy("template_").count().where(F.col("count") >= least).select("template_")
    return marked.join(often, "template_", "left_anti").drop("template_")


def spam(text: Column | str, most_links: int = 2, most_marks: float = 0.3) -> Column:
    """Many links, a number to write to, or mostly signs and capitals."""
    c = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    links = F.regexp_count(c, F.lit(r"https?://"))
    marks = F.try_divide(F.length(F.regexp_replace(c, r"[^!?$*#%🚀💰]", "")).cast("double"), F.length(c).cast("double"))
    invites = c.rlike(r"(?i)(whats\s?app|telegram|t\.me/|join (my|our) (group|channel)|dm me|guaranteed (profit|return))")
    return (links > most_links) | invites | (F.coalesce(marks, F.lit(0.0)) > most_marks)


def keep_valuable(posts: DataFrame, text: str = "text", likes: str | None = None, least_likes: int = 1) -> DataFrame:
    """Without weak posts; interaction counts only where they exist."""
    kept = posts.where(~F.coalesce(weak_post(text), F.lit(True)))
    if likes and likes in posts.columns:
        kept = kept.where(F.col(likes).isNull() | (F.col(likes) >= least_likes))
    return kept


def top_per_group(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= k)
