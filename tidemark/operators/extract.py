"""Names of a dictionary in texts, and how new a text is.

Names are sequences of normalised words. A place in a text is looked at only if a name begins with its
word, by a join on that word; the names that begin there are then compared with the words that follow. Of
the matches of a text the leftmost counts, of those at one place the longest, and the next one starts behind it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.hygiene import normal_text
from tidemark.operators.similar import members, similar, word_sets


def _words(text: str):
    return F.filter(F.split(normal_text(text), " "), lambda w: w != "")


def dictionary(names: DataFrame, name: str = "name", code: str = "code") -> DataFrame:
    """``words, code``: each sequence of words once; of several codes for it the smallest counts, names without words are none."""
    rows = names.select(_words(name).alias("words"), F.col(code).cast("string").alias("code")).where((F.size("words") > 0) & F.col("code").isNotNull())
    return rows.groupBy("words").agg(F.min("code").alias("code"))


def matches(texts: DataFrame, names: DataFrame, ident: str, text: str) -> DataFrame:
    """``id, start, end, code`` of every place of a text where a name of ``dictionary`` stands (word numbers, end exclusive), overlaps included."""
    longest = names.agg(F.max(F.size("words"))).first()[0] or 0
    if not longest:
        return texts.select(F.col(ident).alias("id"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("code")).where("false")
    places = texts.select(F.col(ident).alias("id"), _words(text).alias("all_")).select("id", "all_", F.posexplode("all_").alias("start", "first_"))
    places = places.select("id", "start", "first_", F.slice("all_", F.col("start") + 1, F.lit(longest)).alias("ahead_"))
    known = names.select("words", "code", F.col("words")[0].alias("first_"), F.size("words").alias("n_"))
    hit = places.join(known, "first_").where(F.slice("ahead_", F.lit(1), F.col("n_")) == F.col("words"))
    return hit.select("id", "start", (F.col("start") + F.col("n_")).alias("end"), "code")


def entities(texts: DataFrame, names: DataFrame, ident: str, text: str) -> DataFrame:
    """``id, entities`` (array of ``start, end, code``) of every text with a match: leftmost, longest, without overlaps."""
    kind = "struct<start:int,end:int,code:string>"
    found = matches(texts, names, ident, text).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "code"))).alias("m"))
    one = lambda x: F.struct(x["start"].cast("int").alias("start"), (-x["back"]).cast("int").alias("end"), x["code"].alias("code"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("kept"))
    step = lambda a, x: F.when(x["start"] >= a["at"], F.struct((-x["back"]).cast("int").alias("at"), F.concat(a["kept"], F.array(one(x))).alias("kept"))).otherwise(a)
    return found.select("id", F.aggregate("m", empty, step)["kept"].alias("entities"))


def novelty(rows: DataFrame, ident: str, text: str, least: float = 0.3) -> DataFrame:
    """``id, novelty``: one minus the greatest similarity of the text's words to those of any row with a smaller id.

    Similarities below ``least`` count as none; a repeated set of words is not new at all; texts without words are left out.
    """
    sets = word_sets(rows, ident, text)
    pairs = similar(sets.select("words", "class_id", "members"), least).groupBy(F.col("b").alias("class_id")).agg(F.max("similarity").alias("near"))  # a is below b
    known = members(rows, ident, text).join(pairs, "class_id", "left")
    return known.select("id", F.when(F.col("id") == F.col("class_id"), 1 - F.coalesce("near", F.lit(0.0))).otherwise(0.0).alias("novelty"))
