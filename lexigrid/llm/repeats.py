"""Repeated passages: every byte covered by a 200-byte string that also starts elsewhere.

The suffixes at all byte positions are ordered only through their first ``DEPTH`` bytes, by
passes over digits, the most significant first; a suffix that is alone in its group leaves,
and groups that remain after the last digit are exactly the repeated strings.

* First digit: the smallest hash of the ``GRAM``-byte strings inside the window.  Equal
  windows have equal digits, and neighbouring windows mostly have it from one place, so a
  text is a sequence of short runs of windows and one row stands for a run.  Runs whose digit occurs
  once in the corpus leave here (most of the text).
* Second digit: the hash of all bytes that a run's windows cover.  Runs that agree in it
  (copies, the inside of a shared passage) are repeated as a whole.
* Remaining digits, for one run of each kind in groups where kinds differ: the windows'
  real bytes, eight at a time, as a most-significant-digit radix sort inside a task.  A group of more
  than ``HOT`` kinds is not gathered: its windows go, by a 128-bit cryptographic digest of their
  200 bytes as the last digit, through a distributed count.

Defined results: a null text counts as empty; a text shorter than the depth loses nothing;
repeated rows repeat each other's strings; rows that share an id are kept apart by their
text; a null id keeps its row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import RollingHash, chunks, discard, map_batches, materialize, probable_members, ragged

DEPTH, GRAM = 200, 48
#: Kinds of runs up to which a group is sorted in one task.
HOT = 10_000
#: Bytes of runs that a task sorts at a time (whole groups), and of texts whose runs it looks for at a time.
SORT_BYTES, RUN_BYTES = 2 << 20, 1 << 17

_bytes = RollingHash(41)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window, from running minima of blocks to both sides."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    blocks = -(-len(values) // width)
    grid = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    grid[: len(values)] = values
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH, gram: int = GRAM):
    """Runs of windows with one first digit: text, start in it, windows, first digit, second digit."""
    if len(data) < depth:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    sums = _bytes.sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = _bytes.of(sums, at, at + gram)
    low = sliding_min(grams, depth - gram + 1)
    windows = np.diff(offsets) - depth + 1
    first = offsets[:-1][windows > 0]
    stop = first + windows[windows > 0]
    step = np.zeros(len(low) + 1, np.int8)
    np.add.at(step, first, 1)
    np.add.at(step, stop, -1)
    valid = np.cumsum(step[:-1]) > 0
    new = np.ones(len(low), bool)
    # the place of a window's digit is its first one, so a run ends when it leaves the window
    new[1:] = (low[1:] != low[:-1]) | (grams[: len(low) - 1] == low[:-1]) | (valid[1:] != valid[:-1])
    new[first] = True
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, len(low)))
    start, length = start[valid[start]], length[valid[start]]
    text = np.searchsorted(offsets, start, side="right") - 1
    return text, start - offsets[text], length, low[start], _bytes.of(sums, start, start + length + depth - 1)


def radix_groups(data: np.ndarray, at: np.ndarray, group: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Which of the suffixes at ``at`` share their first depth bytes with another of their group."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.zeros(len(data) + 1, np.uint64)
    for j in range(8):
        words |= padded[j : j + len(words)].astype(np.uint64) << np.uint64(56 - 8 * j)
    live = np.arange(len(at))
    for digit in range(0, depth, 8):
        value = words[at[live] + digit]
        if depth - digit < 8:
            value >>= np.uint64(8 * (8 - depth + digit))
        order = np.lexsort((value, group))
        live, group, value = live[order], group[order], value[order]
        new = np.ones(len(live), bool)
        new[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
        number = np.cumsum(new) - 1
        shared = np.bincount(number)[number] > 1 if len(number) else new
        live, group = live[shared], number[shared]
    out = np.zeros(len(at), bool)
    out[live] = True
    return out


def _run_rows(docs: DataFrame) -> DataFrame:
    def run(batches):
        for rows, data, offsets in chunks(batches, limit=RUN_BYTES):
            text, start, length, first, second = runs(data, offsets)
            take = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(take), rows.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(first.astype(np.int64)), pa.array(second.astype(np.int64))],
                ["doc_id", "h", "start", "n", "first", "second"],
            )

    return map_batches(docs, run, "doc_id long, h long, start int, n int, first long, second long")


def _with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """docs (doc_id, h, text) left-joined with a row of lists per id and text; null ids meet null ids."""
    lists = lists.withColumnRenamed("doc_id", "__id").withColumnRenamed("h", "__h")
    return docs.join(lists, docs["doc_id"].eqNullSafe(lists["__id"]) & (docs["h"] == lists["__h"]), "left").drop("__id", "__h")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, h, start, end: byte spans of docs (doc_id, h, text) that repeated strings cover; spans may overlap.

    h is a hash of the text, which keeps rows apart that share an id.
    """
    spark = docs.sparkSession
    every = materialize(_run_rows(docs), "repeat-runs")
    again = materialize(every.groupBy("first").count().where("count > 1").select("first"), "repeat-firsts")
    live = materialize(probable_members(every, "first", again).join(again, "first", "left_semi"), "repeat-live")
    discard(every, again)
    kinds = materialize(live.groupBy("first", "second").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "h", "start", "n")).alias("at")), "repeat-kinds")
    groups = kinds.groupBy("first").agg(F.count("*").alias("kinds")).where("kinds > 1")
    whole = live.join(kinds.where("copies > 1").select("first", "second"), ["first", "second"], "left_semi").select("doc_id", "h", "start", (F.col("start") + F.col("n") + (DEPTH - 1)).alias("end"))
    mixed = kinds.join(groups, "first").select("at.*", "first", (F.col("copies") == 1).alias("alone"), (F.col("kinds") > HOT).alias("hot"))
    mixed = materialize(mixed, "repeat-mixed")
    lists = mixed.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n", "first", "alone", "hot")).alias("runs"))
    texts = _with_lists(probable_members(docs, "h", mixed.select("h")).dropDuplicates(["doc_id", "h"]), lists).where("runs is not null")

    def cut(batches):
        for rows, data, offsets in chunks(batches):
            out = {k: [] for k in ("doc_id", "h", "start", "n", "first", "alone", "hot", "data")}
            raw = data.tobytes()
            for doc, h, entries, at in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(rows.schema.get_field_index("runs")).to_pylist(), offsets.tolist()):
                for e in entries:
                    for k in ("start", "n", "first", "alone", "hot"):
                        out[k].append(e[k])
                    out["doc_id"].append(doc)
                    out["h"].append(h)
                    out["data"].append(raw[at + e["start"] : at + e["start"] + e["n"] + DEPTH - 1])
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()))], list(out))

    cuts = materialize(map_batches(texts, cut, "doc_id long, h long, start int, n int, first long, alone boolean, hot boolean, data binary"), "repeat-cuts")
    size = cuts.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("n")).first().n
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (4 * SORT_BYTES) + 1)
    dealt = cuts.where("not hot").select("first", "doc_id", "h", "start", "n", "alone", "data").repartition(parts, "first").sortWithinPartitions("first")
    sorted_ = map_batches(dealt, _sort_runs, "doc_id long, h long, start int, end int")
    hot = map_batches(cuts.where("hot"), _window_digests, "doc_id long, h long, start int, alone boolean, digest binary")
    hot = materialize(hot, "repeat-hot")
    common = hot.groupBy("digest").count().where("count > 1").select("digest")
    hot = hot.where("alone").join(common, "digest", "left_semi").select("doc_id", "h", "start", (F.col("start") + DEPTH).alias("end"))
    spans = materialize(whole.unionByName(sorted_).unionByName(hot), "repeat-spans")
    discard(live, kinds, mixed, cuts)
    return spans


def _sort_runs(batches):
    """Radix sort of whole groups, as many at a time as SORT_BYTES holds; rows come ordered by first digit."""
    kept, size = [], 0

    def flush(tables):
        table = pa.Table.from_batches(tables).combine_chunks()
        columns = {name: table.column(name).combine_chunks() for name in table.column_names}
        first = columns["first"].to_numpy()
        n = columns["n"].to_numpy().astype(np.int64)
        blob = columns["data"].cast(pa.large_binary())
        offsets = np.frombuffer(blob.buffers()[1], np.int64)[blob.offset : blob.offset + len(blob) + 1]
        data = np.frombuffer(blob.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        row = np.repeat(np.arange(len(n)), n)
        inside = ragged(n)
        group = np.unique(first, return_inverse=True)[1].ravel()
        hit = radix_groups(data, offsets[row] - offsets[0] + inside, group[row]) & columns["alone"].to_numpy(zero_copy_only=False)[row]
        row, inside = row[hit], inside[hit]
        if not len(row):
            return None
        lead = np.ones(len(row), bool)
        lead[1:] = (row[1:] != row[:-1]) | (inside[1:] != inside[:-1] + 1)
        a = np.flatnonzero(lead)
        b = np.append(a[1:], len(row)) - 1
        base = columns["start"].to_numpy()[row[a]]
        return pa.RecordBatch.from_arrays([columns["doc_id"].take(pa.array(row[a])), columns["h"].take(pa.array(row[a])), pa.array((base + inside[a]).astype(np.int32)), pa.array((base + inside[b] + DEPTH).astype(np.int32))], ["doc_id", "h", "start", "end"])

    for batch in batches:
        at = 0
        first = batch.column(0).to_numpy()
        edges = np.append(np.flatnonzero(first[1:] != first[:-1]) + 1, len(first)).tolist() if len(first) else []
        for stop in edges:
            if kept and size >= SORT_BYTES and kept[-1].column(0)[-1].as_py() != int(first[at]):
                if (out := flush(kept)) is not None:
                    yield out
                kept, size = [], 0
            piece = batch.slice(at, stop - at)
            kept.append(piece)
            size += int(np.asarray(piece.column(4)).sum()) + DEPTH * len(piece)
            at = stop
    if kept and (out := flush(kept)) is not None:
        yield out


def _window_digests(batches):
    """Every window of hot groups with the digest of its bytes."""
    for batch in batches:
        out = {k: [] for k in ("doc_id", "h", "start", "alone", "digest")}
        for doc, h, start, n, alone, data in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in ("doc_id", "h", "start", "n", "alone", "data"))):
            out["doc_id"] += [doc] * n
            out["h"] += [h] * n
            out["start"] += range(start, start + n)
            out["alone"] += [alone] * n
            out["digest"] += [hashlib.blake2b(data[i : i + DEPTH], digest_size=16).digest() for i in range(n)]
            if len(out["start"]) > 100_000:
                yield _digest_rows(out)
                out = {k: [] for k in out}
        yield _digest_rows(out)


def _digest_rows(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], list(out))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with keep_text the remaining bytes too."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs)
    # copies that share an id have equal spans
    lists = spans.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    touched = _with_lists(probable_members(docs, "h", spans.select("h")), lists)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def run(batches):
        for rows, data, offsets in chunks(batches):
            n = len(offsets) - 1
            at = rows.schema.get_field_index("spans")
            listed = rows.column(at).to_pylist() if at >= 0 else [None] * n
            removed, count, digest, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
            raw = data.tobytes()
            for i in range(n):
                text = raw[offsets[i] : offsets[i + 1]]
                pieces, last = [], 0
                for s, e in sorted((x["start"], x["end"]) for x in listed[i] or ()):
                    if s > last or not count[i]:
                        pieces.append(text[last:s])
                        count[i] += 1
                    removed[i] += max(0, e - max(s, last))
                    last = max(last, e)
                pieces.append(text[last:])
                digest.append(hashlib.sha256(b"".join(pieces)).hexdigest())
                if keep_text:
                    kept.append(b"".join(pieces))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(removed), pa.array(count), pa.array(digest, pa.string()), *([pa.array(kept, pa.binary())] if keep_text else [])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] * keep_text)])

    clean = probable_members(docs, "h", spans.select("h"), absent=True)
    return map_batches(touched, run, schema).unionByName(map_batches(clean, run, schema))
