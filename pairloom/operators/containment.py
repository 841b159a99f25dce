"""Pairs of word sets of which one holds the other, without meeting on common words.

If a set lies within another, its rarest word lies in the other too. So each set is filed under its rarest word alone, and looked up
by every word of the sets of the other side: a pair meets once for each direction, on that word, and a word that stands in every set
is nobody's key unless there is nothing rarer. Which word is rarest is a count over both sides, ties by the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.hybrid import skill_words
from pairloom.operators.staging import maybe_broadcast, staged


def _filed(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """Each set with its rarest word."""
    words = sets.withColumn("w", F.explode("words")).join(counts, "w")
    return words.groupBy("id", "words").agg(F.min(F.struct("n", "w")).alias("r")).select("id", "words", F.col("r.w").alias("w"))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b, wa, wb of the pairs that meet: one set's rarest word is in the other. A pair may meet from both sides. left, right: id (distinct)
    and words (array of distinct, not null)."""
    counts = left.unionByName(right).select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    counts = maybe_broadcast(staged(counts), 64)
    probe = lambda s: s.select(F.col("id").alias("other"), F.col("words").alias("others"), F.explode("words").alias("w"))
    inside = _filed(left, counts).join(probe(right), "w").select(F.col("id").alias("a"), F.col("other").alias("b"), F.col("words").alias("wa"), F.col("others").alias("wb"), F.lit(True).alias("first"))
    around = _filed(right, counts).join(probe(left), "w").select(F.col("other").alias("a"), F.col("id").alias("b"), F.col("others").alias("wa"), F.col("words").alias("wb"), F.lit(False).alias("first"))
    return inside.unionByName(around)


def containment_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: ids of which the words of one are all among the other's; empty sets meet nobody. Equal sets meet from both sides and count once."""
    within: Column = F.size(F.array_except("wa", "wb")) == 0
    around: Column = F.size(F.array_except("wb", "wa")) == 0
    return candidates(left, right).filter((F.col("first") & within) | (~F.col("first") & around & ~within)).select("a", "b")


def matching_skills(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b of normalised names (name, distinct) that match as ``skill_match`` has it: equal names have equal words, so every match is a
    set of words within the other. Null and empty names match nothing."""
    sets = lambda df: df.filter("name <> ''").select(F.col("name").alias("id"), F.array_distinct(skill_words(F.col("name"))).alias("words"))
    return containment_join(sets(left), sets(right))
