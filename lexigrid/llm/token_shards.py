"""Token-id output: Re-Pair compressed shards with random access.

Texts are dealt by ranges of their id, encoded, and cut into shards of about ``SHARD_IDS``
ids.  Each shard is compressed by itself: rounds replace the most frequent neighbouring
pairs (never across two documents) by new symbols.  A shard stores its rules, every rule's
expansion length, the compressed sequence and a document index, so any range of any
document decodes without the rest of the shard.

Defined results: a null text counts as empty and gives only the end id; equal ids are
ordered by text; a null id sorts first and keeps its row; an empty table gives no rows;
other columns of the input are not read.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import chunks, map_batches, ragged, shared_dir
from .tokens import crc32, default_path, encoder

END_ID = 2
#: Ids of a shard before compression; a longer document makes a longer shard.
SHARD_IDS = 1 << 20
ROUNDS = 4
PAIRS_PER_ROUND = 2500
#: A pair must occur this often in its shard to become a rule.
LEAST_COUNT = 24
#: Bits of the hash by which a round counts pairs.
BUCKETS = 19
_HEAD = struct.Struct("<4sIIIQQ")
SHARDS = "part int, seq int, ids_before long, n_ids long, n_docs int, payload binary"


def frequent_pairs(key: np.ndarray, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent values of key, and per position the index of its value among them or -1.

    Values are counted by a hash; of each hash one value is followed, whose exact count
    decides, so a value that shares its hash with another waits for a later round.
    """
    width, odd = (32, 0x9E3779B1) if key.dtype == np.uint32 else (64, 0x9E3779B97F4A7C15)
    bucket = ((key * key.dtype.type(odd)) >> key.dtype.type(width - BUCKETS)).view(f"i{width // 8}")
    followed = np.zeros(1 << BUCKETS, key.dtype)
    followed[bucket] = key
    same = followed[bucket] == key
    counts = np.bincount(bucket[same], minlength=1 << BUCKETS)
    heavy = np.flatnonzero(counts >= least)
    if len(heavy) > most:
        heavy = np.sort(heavy[np.lexsort((heavy, -counts[heavy]))[:most]])
    index = np.full(1 << BUCKETS, -1, np.int32)
    index[heavy] = np.arange(len(heavy), dtype=np.int32)
    return followed[heavy], np.where(same, index[bucket], -1)


def repair(ids: np.ndarray, doc_starts: np.ndarray, first_symbol: int, rounds: int = ROUNDS, most: int = PAIRS_PER_ROUND, least: int = LEAST_COUNT):
    """(symbols, symbol offsets of documents, rules): each round replaces frequent pairs, leftmost first."""
    seq = ids.astype(np.uint32)
    starts = np.asarray(doc_starts, np.int64)
    rules = np.zeros((0, 2), np.uint32)
    # symbols of 16 bits make pairs of 32
    half, wide = (np.uint32(16), np.uint32) if first_symbol <= 1 << 16 else (np.uint64(32), np.uint64)
    for _ in range(rounds):
        if len(seq) < 2:
            break
        key = (seq[:-1].astype(wide) << half) | seq[1:]
        inner = starts[1:-1]
        across = np.unique(inner[(inner > 0) & (inner < len(seq))]) - 1
        room = min(most, (1 << 16) - first_symbol - len(rules)) if first_symbol <= 1 << 16 else most
        if room <= 0:
            break
        free = np.delete(key, across)
        pairs, which = frequent_pairs(free, room, least)
        if not len(pairs):
            break
        at = np.flatnonzero(which >= 0)
        which = which[at]
        at += np.searchsorted(across - np.arange(len(across)), at, side="right")
        # in a run of neighbouring hits every other one is replaced
        lead = np.ones(len(at), bool)
        lead[1:] = at[1:] != at[:-1] + 1
        run = np.flatnonzero(lead)
        offset = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        lead = offset % 2 == 0
        at, which = at[lead], which[lead]
        seq = seq.copy()
        seq[at] = first_symbol + len(rules) + which
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        gone = np.concatenate([[0], np.cumsum(~keep)])
        starts = starts - gone[starts]
        seq = seq[keep]
        rules = np.concatenate([rules, np.stack([pairs >> half, pairs & wide((1 << int(half)) - 1)], 1).astype(np.uint32)])
    return seq, starts, rules


def expansion_lengths(rules: np.ndarray, first_symbol: int) -> np.ndarray:
    out = np.ones(len(rules), np.uint32)
    for k, (a, b) in enumerate(rules.tolist()):
        out[k] = (out[a - first_symbol] if a >= first_symbol else 1) + (out[b - first_symbol] if b >= first_symbol else 1)
    return out


def pack_shard(ids: np.ndarray, doc_starts: np.ndarray, doc_ids: list, first_symbol: int) -> bytes:
    """The shard's bytes: head, rules, expansion lengths, document ids and offsets, symbols."""
    seq, starts, rules = repair(ids, doc_starts, first_symbol)
    width = 2 if first_symbol + len(rules) <= 1 << 16 else 4
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [
        _HEAD.pack(b"RPS1", first_symbol, len(rules), width, len(doc_ids), len(seq)),
        rules.astype("<u4").tobytes(),
        expansion_lengths(rules, first_symbol).astype("<u4").tobytes(),
        known.tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        starts.astype("<i8").tobytes(),
        np.asarray(doc_starts, "<i8").tobytes(),
        seq.astype(f"<u{width}").tobytes(),
    ]
    return b"".join(parts)


class Shard:
    """Reads a shard; ``ids(doc, start, length)`` touches only that range's symbols."""

    def __init__(self, payload: bytes):
        magic, self.first, n_rules, width, n_docs, n_symbols = _HEAD.unpack_from(payload)
        if magic != b"RPS1":
            raise ValueError("not a token shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules).astype(np.int64)
        known = take("u1", n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(take("<i8", n_docs).tolist(), known.tolist())]
        self.symbol_starts = take("<i8", n_docs + 1)
        self.id_starts = take("<i8", n_docs + 1)
        self.symbols = take(f"<u{width}", n_symbols)
        self._table = None

    def _expansions(self):
        """Start and ids of each rule's expansion, by levels: a rule's parts come before it."""
        if self._table is None:
            starts = np.cumsum(self.lengths) - self.lengths
            flat = np.zeros(int(self.lengths.sum()), np.uint32)
            for k, (a, b) in enumerate(self.rules.tolist()):
                at = starts[k]
                for part in (a, b):
                    if part < self.first:
                        flat[at] = part
                        at += 1
                    else:
                        n = self.lengths[part - self.first]
                        s = starts[part - self.first]
                        flat[at : at + n] = flat[s : s + n]
                        at += n
            self._table = starts, flat
        return self._table

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        if not len(self.rules):
            return symbols.astype(np.uint32)
        starts, flat = self._expansions()
        # plain ids follow the expansions in one table, addressed through their own value
        table = np.concatenate([flat, np.arange(self.first, dtype=np.uint32)])
        rule = symbols >= self.first
        index = np.where(rule, symbols - self.first, 0)
        lengths = np.where(rule, self.lengths[index], 1)
        begin = np.where(rule, starts[index], len(flat) + symbols)
        return table[np.repeat(begin, lengths) + ragged(lengths)]

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        if not len(self.rules):
            return np.ones(len(symbols), np.int64)
        rule = symbols >= self.first
        return np.where(rule, self.lengths[np.where(rule, symbols - self.first, 0)], 1)

    def ids(self, doc: int, start: int = 0, length: int | None = None) -> np.ndarray:
        part = self.symbols[self.symbol_starts[doc] : self.symbol_starts[doc + 1]]
        ends = np.cumsum(self.sizes(part))
        total = int(ends[-1]) if len(ends) else 0
        stop = total if length is None else min(total, start + length)
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(ends, start, side="right"))
        b = int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(part[a:b])[start - before : stop - before]

    def all_ids(self) -> np.ndarray:
        return self.expand(self.symbols)


def write_token_shards(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, first_symbol: int = 50257) -> None:
    """Encode df's texts and write the shards in ascending id order."""
    tokenizer = tokenizer or default_path()
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def build(batches):
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        ids, docs, lengths, size = [], [], [], 0

        def shard():
            nonlocal seq, before, ids, docs, lengths, size
            every = np.concatenate(ids)
            payload = pack_shard(every, np.concatenate([[0], np.cumsum(lengths)]), docs, first_symbol)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "ids_before": pa.array([before], pa.int64()), "n_ids": pa.array([len(every)], pa.int64()), "n_docs": pa.array([len(docs)], pa.int32()), "payload": pa.array([payload], pa.binary())})
            seq, before = seq + 1, before + len(every)
            ids, docs, lengths, size = [], [], [], 0
            return out

        for rows, data, offsets in chunks(batches):
            raw = data.tobytes()
            cut = offsets.tolist()
            found, at = encoder(tokenizer)([raw[a:b].decode("utf-8") for a, b in zip(cut, cut[1:])])
            where = at[1:]
            full = np.insert(found, where, end_id)
            ids.append(full)
            lengths += (np.diff(at) + 1).tolist()
            docs += rows.column(0).to_pylist()
            size += len(full)
            if size >= SHARD_IDS:
                yield shard()
        if docs:
            yield shard()

    map_batches(ordered, build, SHARDS).write.option("compression", "zstd").parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, decoded from the shards: doc_id, start, n_tokens, ids_crc32, part, shard, row.

    Documents' starts need the number of ids in the parts before; that table has one row per
    part (the writer's shuffle partitions), whatever the number of documents.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    totals = {r.part: r.n_ids for r in parts.collect()}
    base, run = {}, 0
    for part in sorted(totals):
        base[part] = run
        run += totals[part]

    def decode(batches):
        for batch in batches:
            for part, seq, before, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
                shard = Shard(payload)
                ids = shard.all_ids()
                cut = shard.id_starts.tolist()
                n = len(shard.doc_ids)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(shard.doc_ids, pa.int64()),
                        "start": pa.array(shard.id_starts[:-1] + (base[part] + before), pa.int64()),
                        "n_tokens": pa.array(np.diff(shard.id_starts), pa.int64()),
                        "ids_crc32": pa.array([crc32(ids[a:b]) for a, b in zip(cut, cut[1:])], pa.int64()),
                        "part": pa.array([part] * n, pa.int32()),
                        "shard": pa.array([seq] * n, pa.int32()),
                        "row": pa.array(range(n), pa.int32()),
                    }
                )

    return map_batches(shards.select("part", "seq", "ids_before", "payload"), decode, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, shard int, row int")


def token_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to the shared folder and describe every document from what was read back."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/token-shards-{uuid.uuid4().hex}"
    write_token_shards(df, path, id_col, text_col)
    return read_token_shards(df.sparkSession, path)
