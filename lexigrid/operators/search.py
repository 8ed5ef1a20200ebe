"""The n nearest words of every query, by brute force or over shared prefixes.

Words stay where they are; the queries (a bounded list) go to every task.  Each task keeps
the n best per query, so what is shuffled is n rows per query and task.  Equal distances
(rounded to six decimals) are ordered by word.  The prefix plan computes the distance row
of each common prefix once and leaves out prefixes whose row exceeds the n-th best distance
known so far: rows never fall below their smallest value, as all costs are non-negative.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.costs import CostModel, preset
from ..functions.distance import codes_of, distances, next_rows

#: Words that a task holds at a time.
BLOCK = 20_000


def _blocks(batches: Iterable[pd.DataFrame]):
    for pdf in batches:
        words = [w for w in pdf["word"] if w is not None]
        for a in range(0, len(words), BLOCK):
            yield words[a : a + BLOCK]


def _best(words: np.ndarray, distance: np.ndarray, n: int) -> pd.DataFrame:
    rounded = np.round(distance, 6)
    if len(words) > 4 * n:
        keep = rounded <= np.partition(rounded, n - 1)[n - 1]
        words, rounded = words[keep], rounded[keep]
    order = np.lexsort((words, rounded))[:n]
    return pd.DataFrame({"distance": rounded[order], "word": words[order]})


def prefix_distances(words: list[str], query: str, model: CostModel, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(word indices, distances, prefixes visited, prefixes in all) with rows shared by prefix."""
    words = np.array(sorted(words), dtype=object)
    codes, length = codes_of(words.tolist())
    modify, run = model.for_query(query)
    rows = run[None, :].copy()
    node = np.zeros(len(words), np.int64)  # row of each word's current prefix
    alive = np.arange(len(words))
    found, far, visited, total = [], [], 0, 0
    empty = alive[length == 0]
    found.append(empty)
    far.append(np.full(len(empty), run[-1]))
    fresh = np.zeros(len(words), bool)
    fresh[:1] = True
    for depth in range(codes.shape[1]):
        fresh[1:] |= (codes[1:, depth] != codes[:-1, depth]) | (words_beyond(words, depth)[1:] if (codes[:, depth] == 127).any() else False)
        total += int((fresh & (length > depth)).sum())
        keep = length[alive] > depth
        alive, node = alive[keep], node[keep]
        if not len(alive):
            continue
        lead = fresh[alive]
        lead[0] = True
        lead[1:] |= node[1:] != node[:-1]
        heads = np.flatnonzero(lead)
        rows = next_rows(rows[node[heads]], codes[alive[heads], depth], model, modify, run)
        visited += len(heads)
        node = np.cumsum(lead) - 1
        done = length[alive] == depth + 1
        found.append(alive[done])
        far.append(rows[node[done], -1])
        open_ = rows.min(axis=1) <= bound + 1e-6
        alive, node = alive[open_[node]], node[open_[node]]
    index = np.concatenate(found)
    return words[index], np.concatenate(far), visited, total


def words_beyond(words: np.ndarray, depth: int) -> np.ndarray:
    """Whether a word's character at depth differs from that of the word before it, for characters that share a code."""
    at = [w[depth : depth + 1] for w in words]
    return np.array([False, *(a != b for a, b in zip(at[1:], at[:-1]))])


def fuzzy_search(words: DataFrame, queries: list[tuple[int, str, int]], model: str | CostModel = "english", plan: str = "trie", prune: bool = True, bounds: dict[int, float] | None = None) -> DataFrame:
    """query_id, rank, distance, word for a bounded list of (query_id, query, n).

    ``plan`` is ``brute`` or ``trie``; ``bounds`` are distances that no word of a query's result exceeds.
    n below 1 gives no rows, n beyond the dictionary all of it; null words are skipped.
    """
    costs = preset(model) if isinstance(model, str) else model
    wanted = [q for q in queries if q[2] > 0]
    spark = words.sparkSession
    if not wanted:
        return spark.createDataFrame([], "query_id long, rank int, distance double, word string")
    bounds = bounds or {}

    def nearest(batches):
        best = {}
        for block in _blocks(batches):
            for query_id, query, n in wanted:
                known = best.get(query_id)
                bound = bounds.get(query_id, np.inf)
                if prune and known is not None and len(known) == n:
                    bound = min(bound, known["distance"].iloc[-1])
                if plan == "trie":
                    found, far, _, _ = prefix_distances(block, query, costs, bound)
                else:
                    found, far = np.array(block, dtype=object), distances(block, query, costs)
                part = _best(found, far, n)
                best[query_id] = part if known is None else _best(*(pd.concat([known, part])[c].to_numpy() for c in ("word", "distance")), n)
        limits = {q: n for q, _, n in wanted}
        for query_id, part in best.items():
            yield part.assign(query_id=query_id, n=limits[query_id])[["query_id", "n", "distance", "word"]]

    partial = words.select("word").mapInPandas(nearest, "query_id long, n long, distance double, word string")
    ranked = partial.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "word")).cast("int"))
    return ranked.where("rank <= n").select("query_id", "rank", F.round("distance", 6).alias("distance"), "word")


def fuzzy_join(words: DataFrame, queries: DataFrame, model: str | CostModel = "english", plan: str = "trie", most: int = 1000) -> DataFrame:
    """query_id, rank, distance, word for a table of (query_id, query, n): a stated set of queries against all
    words, in blocks of about ``most`` queries; rows with a null are skipped."""
    wanted = queries.select(F.col("query_id").cast("long"), "query", F.col("n").cast("int")).dropna().distinct()
    blocks = wanted.count() // most + 1
    out = fuzzy_search(words, [], model, plan)
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks)) == b).collect()
        out = out.unionByName(fuzzy_search(words, [tuple(r) for r in rows], model, plan)) if rows else out
    return out


def compare_ranked(left: DataFrame, right: DataFrame) -> DataFrame:
    """query_id, rank, same_word, same_distance of two results, by place; a place that one lacks differs."""
    a = left.select("query_id", "rank", F.col("word").alias("wa"), F.col("distance").alias("da"))
    b = right.select("query_id", "rank", F.col("word").alias("wb"), F.col("distance").alias("db"))
    same = lambda x, y: F.coalesce(F.col(x) == F.col(y), F.lit(False))
    return a.join(b, ["query_id", "rank"], "full").select("query_id", "rank", same("wa", "wb").alias("same_word"), same("da", "db").alias("same_distance"))


def search_counts(words: DataFrame, queries: list[tuple[int, str, int]], model: CostModel, bounds: dict[int, float]) -> DataFrame:
    """query_id, num_nodes, visited_nodes, skipped_nodes, summed over the blocks of words (a prefix counts in each that has it)."""

    def count(batches):
        for block in _blocks(batches):
            rows = [(q, *prefix_distances(block, query, model, bounds.get(q, np.inf))[2:]) for q, query, _ in queries]
            yield pd.DataFrame(rows, columns=["query_id", "visited_nodes", "num_nodes"])

    seen = words.select("word").mapInPandas(count, "query_id long, visited_nodes long, num_nodes long")
    return seen.groupBy("query_id").agg(F.sum("num_nodes").alias("num_nodes"), F.sum("visited_nodes").alias("visited_nodes"), F.sum(F.col("num_nodes") - F.col("visited_nodes")).alias("skipped_nodes"))


def word_costs(words: DataFrame, model: str | CostModel = "english") -> DataFrame:
    """word, insert_cost, remove_cost: what it costs to invent or to discard the whole word."""
    costs = preset(model) if isinstance(model, str) else model

    def total(batches):
        for pdf in batches:
            codes, length = codes_of(pdf["word"].tolist())
            inside = np.arange(codes.shape[1]) < length[:, None]
            yield pd.DataFrame({"word": pdf["word"], "insert_cost": np.round((costs.insert[codes] * inside).sum(axis=1), 6), "remove_cost": np.round((costs.remove[codes] * inside).sum(axis=1), 6)})

    return words.select("word").mapInPandas(total, "word string, insert_cost double, remove_cost double")
