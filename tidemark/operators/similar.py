"""Similar headlines: a set-similarity self-join on words with prefix, length and position filters.

Headlines with the same set of words are one class, known by its smallest id; classes are joined. In a
global order of words (rare ones first) two sets of Jaccard similarity ``t`` or more share a
word among the first ``n - ceil(t n) + 1`` of both, so only these are joined on. Words in many headlines
come last and are hardly ever among them, so a word that all headlines have stays linear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.hygiene import normal_text

#: Words in more than this share of the classes are frequent: there are at most 1 / share times the mean size of a set of them.
FREQUENT = 0.01


def word_sets(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """``class_id, words, members``: distinct sets of normalised words; texts without words are in none."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(normal_text(text), " "), lambda w: w != "")))
    sets = rows.select(F.col(ident).alias("id_"), words.alias("words")).where(F.size("words") > 0)
    return sets.groupBy("words").agg(F.min("id_").alias("class_id"), F.count(F.lit(1)).alias("members"))


def members(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """``id, class_id`` of every row that has words; one shuffle, and of equal headlines only ids meet."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(normal_text(text), " "), lambda w: w != "")))
    own = rows.select(F.col(ident).alias("id"), words.alias("words")).where(F.size("words") > 0)
    return own.join(word_sets(rows, ident, text).select("words", "class_id"), "words").select("id", "class_id")


def similar(sets: DataFrame, least: float = 0.8) -> DataFrame:
    """``a, b, similarity`` (a below b) of all classes of ``word_sets`` with a similarity of ``least`` or more."""
    if not 0 < least <= 1:
        raise ValueError("the least similarity must lie above 0 and not above 1")
    n = sets.count()
    counts = sets.select(F.explode("words").alias("w")).groupBy("w").count().where(F.col("count") > max(1.0, FREQUENT * n))
    frequent = {r.w: r["count"] for r in counts.collect()}  # bounded, see FREQUENT
    rank = F.create_map(*(F.lit(x) for pair in frequent.items() for x in pair)) if frequent else F.create_map().cast("map<string,bigint>")
    order = lambda w: F.struct(F.coalesce(F.element_at(rank, w), F.lit(0).cast("long")).alias("often"), F.xxhash64(w).alias("h"), w.alias("w"))
    sorted_ = sets.select("class_id", F.transform(F.array_sort(F.transform("words", order)), lambda x: x["w"]).alias("words")).withColumn("n", F.size("words"))
    slack = 1e-9
    prefix = (F.col("n") - F.ceil(F.col("n") * least - slack) + 1).cast("int")
    heads = sorted_.select("class_id", "words", "n", F.posexplode(F.slice("words", 1, prefix)).alias("at", "w"))
    l, r = (heads.select(*(F.col(c).alias(f"{side}_{c}") for c in ("class_id", "words", "n", "at")), "w") for side in ("l", "r"))
    smaller = (F.col("l_n") < F.col("r_n")) | ((F.col("l_n") == F.col("r_n")) & (F.col("l_class_id") < F.col("r_class_id")))
    both = F.ceil((F.col("l_n") + F.col("r_n")) * (least / (1 + least)) - slack)  # words that must be common
    reach = 1 + F.least(F.col("l_n") - F.col("l_at") - 1, F.col("r_n") - F.col("r_at") - 1)  # that can be, if this is the first
    met = l.join(r, "w").where(smaller & (F.col("l_n") >= F.col("r_n") * least - slack) & (reach >= both))
    common = F.size(F.array_intersect("l_words", "r_words"))
    scored = met.select(F.least("l_class_id", "r_class_id").alias("a"), F.greatest("l_class_id", "r_class_id").alias("b"), (common / (F.col("l_n") + F.col("r_n") - common)).alias("similarity"))
    return scored.where(F.col("similarity") >= least - slack).distinct()
