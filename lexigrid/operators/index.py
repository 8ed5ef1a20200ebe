"""A dictionary's index, built once and stored: sorted words and the numbered nodes of their prefix tree.

The words are dealt by ranges and sorted, so a word's new prefixes are those longer than what it
has in common with the word before it, and every node comes out of one task.  Only the first word of a
range may repeat prefixes of the range before; their number follows from the two words.  A node's
breadth-first number is the count of shorter prefixes, of its depth in earlier ranges and before it in its own;
the table of counts that this needs has one row per range and depth.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.costs import CostModel, preset
from ..functions.distance import distances
from ..sources.storage import shared_path
from .metrics import Metrics
from .search import fuzzy_search, search_counts

#: Words of the sample that bounds a search's n-th distance from above.
SAMPLE = 20_000
_NODES = "part int, depth int, ch string, prefix string, is_word boolean, lead boolean, at long, parent_at long"


def _new_prefixes(words: list[str], before: str) -> tuple[np.ndarray, np.ndarray]:
    """Per sorted word its length and how much it shares with the word before it."""
    length = np.array([len(w) for w in words], np.int64)
    common = np.array([len(os.path.commonprefix((a, b))) for a, b in zip([before, *words[:-1]], words)], np.int64)
    return length, common


def _emit(batches):
    """Nodes of one range of sorted words, in lexicographic order."""
    from pyspark import TaskContext

    part, before, counts, first = TaskContext.get().partitionId(), "", np.zeros(1, np.int64), True
    for pdf in batches:
        words = pdf["word"].tolist()
        if not words:
            continue
        length, common = _new_prefixes(words, before)
        new = length - common
        word = np.repeat(np.arange(len(words)), new)
        depth = np.arange(len(word)) - np.repeat(np.cumsum(new) - new, new) + common[word] + 1
        if length.max() >= len(counts) - 1:
            counts = np.concatenate([counts, np.zeros(int(length.max()) + 2 - len(counts), np.int64)])
        # place among the range's nodes of a depth, and how many there were of the depth above
        at, above = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        for d in np.unique(depth).tolist():
            own = np.flatnonzero(depth == d)
            at[own] = counts[d] + np.arange(len(own))
            above[own] = counts[d - 1] + np.searchsorted(np.flatnonzero(depth == d - 1), own) - 1
        counts[: int(length.max()) + 1] += np.bincount(depth, minlength=int(length.max()) + 1)
        out = pd.DataFrame({"part": np.int32(part), "depth": depth.astype(np.int32)})
        out["prefix"] = [words[w][:d] for w, d in zip(word.tolist(), depth.tolist())]
        out["ch"] = out["prefix"].str[-1:]
        out["is_word"] = depth == length[word]
        out["lead"] = (word == 0) & first
        out["at"], out["parent_at"] = at, np.where(depth == 1, 0, above)
        first, before = False, words[-1]
        yield out[["part", "depth", "ch", "prefix", "is_word", "lead", "at", "parent_at"]]


class WordIndex:
    """Answers searches and tree questions from what ``build`` stored."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.words = spark.read.schema("word string").parquet(f"{path}/words")
        self._counts = self._sample = None

    @classmethod
    def build(cls, words: DataFrame, path: str | None = None, metrics: Metrics | None = None) -> WordIndex:
        """Sort and store the words (null ones are skipped, repeated ones count once)."""
        spark, metrics = words.sparkSession, metrics or Metrics()
        path = path or shared_path(spark, "index")
        with metrics.measure("build"):
            with metrics.measure("copy"):
                words.select("word").where("word is not null").write.parquet(f"{path}/copy")
            with metrics.measure("sort"):
                parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
                copied = spark.read.schema("word string").parquet(f"{path}/copy")
                copied.where("word <> ''").repartitionByRange(parts, "word").sortWithinPartitions("word").mapInPandas(_emit, _NODES).write.parquet(f"{path}/nodes")
            with metrics.measure("words"):
                known = spark.read.schema(_NODES).parquet(f"{path}/nodes").where("is_word").select(F.col("prefix").alias("word"))
                known.unionByName(copied.where("word = ''").limit(1)).write.parquet(f"{path}/words")
        return cls(spark, path)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(_NODES).parquet(f"{self.path}/nodes")

    def _ranges(self) -> list[tuple[int, int, int, int]]:
        """(range, depth, what turns a place into a node's number, prefixes repeated from the range before)."""
        if self._counts is None:
            word = F.when(F.col("is_word"), F.col("prefix"))
            rows = self._stored().groupBy("part", "depth").agg(F.count("*").alias("n"), F.min(word).alias("low"), F.max(word).alias("high")).collect()
            parts: dict[int, dict] = {}
            for r in rows:
                own = parts.setdefault(r.part, {"n": {}, "low": [], "high": []})
                own["n"][r.depth] = r.n
                own["low"] += [r.low] if r.low is not None else []
                own["high"] += [r.high] if r.high is not None else []
            last, repeated, totals, starts = "", {}, {}, {}
            for p in sorted(parts, key=lambda p: min(parts[p]["low"])):
                repeated[p] = len(os.path.commonprefix((last, min(parts[p]["low"]))))
                last = max(parts[p]["high"])
                for d, n in parts[p]["n"].items():
                    starts[p, d] = totals.get(d, 0) - (d <= repeated[p])
                    totals[d] = totals.get(d, 0) + n - (d <= repeated[p])
            base, run = {}, 1
            for d in sorted(totals):
                base[d], run = run, run + totals[d]
            self._counts = [(p, d, base[d] + s, repeated[p]) for (p, d), s in starts.items()]
        return self._counts

    def nodes(self) -> DataFrame:
        """node_id, parent_id, prefix, depth, ch, parent, is_word of every node; the root is the empty prefix."""
        ranges = self.spark.createDataFrame(self._ranges(), "part int, depth int, shift long, repeated int")
        above = ranges.select("part", (F.col("depth") + 1).alias("depth"), F.col("shift").alias("shift_above"))
        stored = self._stored().join(F.broadcast(ranges), ["part", "depth"]).join(F.broadcast(above), ["part", "depth"], "left").where(~F.col("lead") | (F.col("depth") > F.col("repeated")))
        below = stored.select((F.col("at") + F.col("shift")).alias("node_id"), F.when(F.col("depth") == 1, F.lit(0)).otherwise(F.col("parent_at") + F.col("shift_above")).alias("parent_id"), "prefix", "depth", "ch", F.expr("left(prefix, depth - 1)").alias("parent"), "is_word")
        if self.words.isEmpty():
            return below
        root = self.words.where("word = ''").agg((F.count("*") > 0).alias("is_word"))
        return below.unionByName(root.select(F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("").alias("prefix"), F.lit(0).alias("depth"), F.lit("").alias("ch"), F.lit(None).cast("string").alias("parent"), "is_word"))

    def child_ranges(self) -> DataFrame:
        """node_id, child_begin, child_end: children are neighbours in breadth-first order."""
        return self.nodes().where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.min("node_id").alias("child_begin"), (F.max("node_id") + 1).alias("child_end"))

    def descendants(self) -> DataFrame:
        """prefix, n_descendants: nodes below each node."""
        up = self.nodes().select(F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("d"), "prefix", "depth").select(F.expr("left(prefix, d)").alias("prefix"), (F.col("d") < F.col("depth")).cast("long").alias("below"))
        return up.groupBy("prefix").agg(F.sum("below").alias("n_descendants"))

    def sample(self) -> list[str]:
        if self._sample is None:
            self._sample = [r.word for r in self.words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]
        return self._sample

    def bounds(self, queries: list[tuple[int, str, int]], model: CostModel) -> dict[int, float]:
        """For each query the n-th distance within the sample: no word of its result is farther."""
        known = self.sample()
        return {q: float(np.partition(distances(known, query, model), n - 1)[n - 1]) for q, query, n in queries if 0 < n <= len(known)}

    def search(self, queries: list[tuple[int, str, int]], model: str | CostModel = "english", plan: str = "trie", prune: bool = True) -> DataFrame:
        """query_id, rank, distance, word; all tasks share the sample's bound."""
        costs = preset(model) if isinstance(model, str) else model
        return fuzzy_search(self.words, queries, costs, plan, prune, self.bounds(queries, costs) if prune and plan == "trie" else None)

    def search_counts(self, queries: list[tuple[int, str, int]], model: str | CostModel = "english", prune: bool = True) -> DataFrame:
        """query_id, num_nodes, visited_nodes, skipped_nodes of the prefixes whose rows a search computes."""
        costs = preset(model) if isinstance(model, str) else model
        return search_counts(self.words, queries, costs, self.bounds(queries, costs) if prune else {})


_known: dict[tuple, WordIndex] = {}


def index_of(words: DataFrame, source: str) -> WordIndex:
    """The index of a source's words, built at its first use in an application and again when its files change."""
    key = (words.sparkSession.sparkContext.applicationId, source, tuple(sorted(words.inputFiles())))
    if key not in _known:
        _known[key] = WordIndex.build(words)
    return _known[key]
