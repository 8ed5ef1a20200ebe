"""Packing documents into fixed windows by minimum bin slack.

Each document is cut into full windows and one remainder.  Only the histogram of remainder
lengths (at most ``capacity - 1`` numbers) goes to the driver, where a bitset subset-sum
chooses, window after window, the multiset of remaining lengths that fills it closest to
capacity; a chosen multiset is used as often as the counts allow, so the plan's size is
bounded by the number of lengths and not by the documents.  Where no multiset fills a window,
the front of the longest remaining length is cut off to close the gap, and what is left of it
stays among the remaining lengths: only the last window is padded.  Every remainder then finds
its window, or its windows, from its rank among the remainders of its length.

Defined results: a null text counts as empty and still holds the end id; repeated rows are
packed as separate documents; a null id keeps its rows; an empty table gives no rows; other
columns of the input are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .textkit import chunks, map_batches, materialize
from .tokens import default_path, encoder

CAPACITY = 1024
END_ID = 0


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Multiset (length -> copies) with the largest sum up to capacity, by bitset subset-sum and backtracking."""
    mask = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], capacity // length)
        copies = 1
        while left > 0:
            take = min(copies, left)
            more = (reach | (reach << (length * take))) & mask
            if more != reach:
                steps.append((reach, length, take))
                reach = more
            left -= take
            copies *= 2
        if reach >> capacity:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


@dataclass(frozen=True)
class Step:
    """``times`` windows of the same make: whole remainders and, in ``gap`` places, the front of one of length ``donor``."""

    chosen: dict[int, int]
    times: int
    gap: int = 0
    donor: int = 0


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Steps that use up the histogram; the longest remaining length opens each window and closes its gap."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    out = []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        rest = {k: v for k, v in rest.items() if v and k <= capacity - longest}
        chosen = fill(rest, capacity - longest) if rest else {}
        chosen[longest] = chosen.get(longest, 0) + 1
        gap = capacity - sum(k * n for k, n in chosen.items())
        donor = max((k for k, v in counts.items() if v > chosen.get(k, 0)), default=0) if gap else 0
        need = {**chosen, donor: chosen.get(donor, 0) + 1} if donor else chosen
        times = min(counts[k] // n for k, n in need.items())
        for k, n in need.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        if donor:  # a length that fits the gap would have been chosen, so something is left of the donor
            counts[donor - gap] = counts.get(donor - gap, 0) + times
        out.append(Step(chosen, times, gap if donor else 0, donor))
    return out


class Places:
    """Where the remainders of each length go, by rank; what is left of a cut one has a rank of its shorter length."""

    def __init__(self, histogram: dict[int, int], plan: list[Step], sequence: int):
        rows: dict[int, list[tuple[int, int, int, int, int, int]]] = {}
        used: dict[int, int] = {}
        made = dict(histogram)

        def take(length, each, times, offset, cut=0, base=0):
            rows.setdefault(length, []).append((used.get(length, 0), each, sequence, offset, cut, base))
            used[length] = used.get(length, 0) + each * times

        for step in plan:
            offset = 0
            for length in sorted(step.chosen, reverse=True):
                take(length, step.chosen[length], step.times, offset)
                offset += length * step.chosen[length]
            if step.donor:
                left = step.donor - step.gap
                take(step.donor, 1, step.times, offset, step.gap, made.get(left, 0))
                made[left] = made.get(left, 0) + step.times
            sequence += step.times
        self.table = {k: np.array(v, np.int64) for k, v in rows.items()}

    def pieces(self, rest: np.ndarray, rank: np.ndarray):
        """(index, start in the remainder, length, sequence, offset) arrays of all pieces of the remainders given."""
        index, rest, rank = np.arange(len(rest)), rest.astype(np.int64), rank.astype(np.int64)
        start, out = np.zeros(len(rest), np.int64), []
        while len(index):
            cut, base = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
            where, offset = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
            for size in np.unique(rest).tolist():
                own = np.flatnonzero(rest == size)
                t = self.table[size]
                j = np.searchsorted(t[:, 0], rank[own], side="right") - 1
                inside = rank[own] - t[j, 0]
                where[own] = t[j, 2] + inside // t[j, 1]
                offset[own] = t[j, 3] + size * (inside % t[j, 1])
                cut[own] = t[j, 4]
                base[own] = t[j, 5] + inside
            out.append((index, start, np.where(cut > 0, cut, rest), where, offset))
            more = cut > 0
            index, start, rest, rank = index[more], (start + cut)[more], (rest - cut)[more], base[more]
        return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    tokenizer = tokenizer or default_path()

    def cut(batches):
        from pyspark import TaskContext

        part, full_before, ranks = TaskContext.get().partitionId(), 0, {}
        for rows, data, offsets in chunks(batches):
            raw = data.tobytes()
            at = offsets.tolist()
            ids, ends = encoder(tokenizer)([raw[a:b].decode("utf-8") for a, b in zip(at, at[1:])])
            n = np.diff(ends) + 1
            ids = np.insert(ids, ends[1:], end_id).astype("<u4")
            stream = memoryview(ids).cast("B")
            first = (np.cumsum(n) - n).tolist()
            out = {k: [] for k in ("doc_tokens", "crcs", "rest", "rest_rank", "full_before", "tail")}
            for begin, tokens in zip(first, n.tolist()):
                rest = tokens % capacity
                out["doc_tokens"].append(tokens)
                out["crcs"].append([zlib.crc32(stream[4 * a : 4 * (a + capacity)]) for a in range(begin, begin + tokens - rest, capacity)])
                out["tail"].append(bytes(stream[4 * (begin + tokens - rest) : 4 * (begin + tokens)]))
                out["rest"].append(rest)
                out["rest_rank"].append(ranks.get(rest, 0))
                out["full_before"].append(full_before)
                ranks[rest] = ranks.get(rest, 0) + 1
                full_before += tokens // capacity
            kinds = {"doc_tokens": pa.int64(), "crcs": pa.list_(pa.int64()), "rest": pa.int32(), "rest_rank": pa.int64(), "full_before": pa.int64(), "tail": pa.binary()}
            yield pa.RecordBatch.from_arrays([rows.column(0).cast(pa.int64()), pa.array([part] * len(n), pa.int32()), *(pa.array(out[k], kind) for k, kind in kinds.items())], ["doc_id", "part", *kinds])

    pieces = materialize(map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), cut, "doc_id long, part int, doc_tokens long, crcs array<long>, rest int, rest_rank long, full_before long, tail binary"), "packing-pieces", "zstd")
    # one row per part and length: ranks before this part; one row per part: full windows before it
    by_length = pieces.groupBy("part", "rest").agg(F.count("*").alias("n"))
    by_length = by_length.withColumn("rank_before", F.sum("n").over(W.partitionBy("rest").orderBy("part")) - F.col("n"))
    by_part = pieces.groupBy("part").agg(F.sum((F.col("doc_tokens") / capacity).cast("long")).alias("n_full"))
    by_part = by_part.withColumn("full_base", F.sum("n_full").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_full"))
    histogram = {r.rest: r.n for r in pieces.where("rest > 0").groupBy("rest").agg(F.count("*").alias("n")).collect()}
    total_full = pieces.agg(F.coalesce(F.sum((F.col("doc_tokens") / capacity).cast("long")), F.lit(0)).alias("n")).first().n
    places = Places(histogram, plan_windows(histogram, capacity), total_full)

    def place(batches):
        for batch in batches:
            doc, tokens, crcs, rest, rank, full, tail = (batch.column(i) for i in range(7))
            tokens, rest, rank, full = (x.to_numpy(zero_copy_only=False) for x in (tokens, rest, rank, full))
            n = tokens // capacity
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            ends = np.flatnonzero(rest)
            index, start, length, where, offset = places.pieces(rest[ends], rank[ends])
            index = ends[index]
            tails = [memoryview(x) for x in tail.to_pylist()]
            own = [zlib.crc32(tails[i][4 * a : 4 * (a + m)]) for i, a, m in zip(index.tolist(), start.tolist(), length.tolist())]
            whole = np.full(len(row), capacity), full[row] + k, np.zeros(len(row), np.int64), crcs.flatten().to_numpy()
            row, start = np.r_[row, index], np.r_[k * capacity, n[index] * capacity + start]
            length, where, offset, crc = (np.r_[a, b] for a, b in zip(whole, (length, where, offset, np.array(own, np.int64))))
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(row)), *map(pa.array, (start, length, crc, tokens[row], where, offset))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = pieces.join(by_length.select("part", "rest", "rank_before"), ["part", "rest"]).join(by_part.select("part", "full_base"), "part")
    ready = ranked.select("doc_id", "doc_tokens", "crcs", "rest", (F.col("rest_rank") + F.col("rank_before")).alias("rank"), (F.col("full_before") + F.col("full_base")).alias("full"), "tail")
    return map_batches(ready, place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
