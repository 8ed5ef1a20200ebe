"""The prefix tree as a table: one row per distinct prefix, built by one shuffle on it.

``index.WordIndex`` builds the same nodes from sorted words, numbers them and keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(words: DataFrame) -> DataFrame:
    """prefix, depth, ch, parent, is_word of every node; the root is the empty prefix."""
    steps = words.where("word is not null").select("word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("depth"))
    grouped = steps.select(F.expr("left(word, depth)").alias("prefix"), (F.col("depth") == F.length("word")).alias("whole")).groupBy("prefix").agg(F.max("whole").alias("is_word"))
    depth = F.length("prefix")
    return grouped.select("prefix", depth.alias("depth"), F.expr("right(prefix, 1)").alias("ch"), F.when(depth > 0, F.expr("left(prefix, length(prefix) - 1)")).alias("parent"), "is_word")


def words_in(words: DataFrame) -> DataFrame:
    """All words, read back from the nodes."""
    return nodes(words).where("is_word").select(F.col("prefix").alias("word"))


def members(words: DataFrame, probes: DataFrame) -> DataFrame:
    """word, found: whether each probe is a whole word of the tree."""
    known = words_in(words).withColumn("__hit", F.lit(True))
    return probes.join(known, "word", "left").select("word", F.coalesce("__hit", F.lit(False)).alias("found"))
