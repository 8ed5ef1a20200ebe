"""Vectorised text helpers shared by the corpus operators.

Everything here works on a *chunk*: the UTF-8 bytes of a few rows laid end to end with
their offsets.  A chunk holds whole texts, about ``CHUNK_BYTES`` in total (one longer text
makes a chunk of its own), so the memory of a task is set by that size and not by the
number of rows in an Arrow batch.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees; a session on one machine that names none gets one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own_dir()
    return found.rstrip("/")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="lexigrid-")


#: Rows of a batch that goes to Python, where the session does not set them.
BATCH_ROWS = 2000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` in batches of few rows, as texts may be long; a session's own number of rows stays."""
    spark = df.sparkSession
    if spark.conf.get(_ROWS_KEY) == "10000":  # Spark's default
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def _trim() -> None:
    """Give memory that is free back to the system: workers are kept, and beside them runs the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def chunks(batches, text: str = "text", limit: int = CHUNK_BYTES):
    """Yield (rows, data, offsets) for slices of Arrow batches; null texts count as empty."""
    for batch in batches:
        column = pc.fill_null(batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()), "")
        if len(column) == 0:
            continue
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
        at = 0
        while at < len(column):
            end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), len(column))
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end
    _trim()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class RollingHash:
    """Polynomial hashes modulo 2**64 of any slices, from one running sum over random byte values."""

    def __init__(self, seed: int, symbols: int = 256):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 8 + 5
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) > n:
            return
        n = max(n + 1, 1 << 16)
        for name, base in (("powers", self.base), ("inverse", pow(self.base, -1, 1 << 64))):
            steps = np.full(n, base % (1 << 64), np.uint64)
            steps[0] = 1
            setattr(self, name, np.multiply.accumulate(steps))

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        self._reach(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(self.values[symbols] * self.powers[: len(symbols)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hash of each slice [start, end); its length takes part."""
        raw = (sums[end] - sums[start]) * self.inverse[start]
        return mix(raw ^ ((end - start).astype(np.uint64) * _GOLDEN))


#: Fixed: lower-cases A-Z, and the bytes that separate words (space, tab to carriage return).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

_words = RollingHash(11)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of a chunk, and per text the index of its first word (one more at the end)."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~SPACE[data]
    first = solid[1:] & ~solid[:-1]
    last = solid[:-1] & ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    inner = cuts[solid[cuts + 1] & solid[cuts]]
    first[inner] = True
    last[inner] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased."""
    return _words.of(_words.sums(LOWER[data]), starts, ends)


def shingles(hashes: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text of a chunk, sorted within a text, and their text's index.

    A text with fewer than ``width`` words but at least one gives its whole sequence as one shingle.
    """
    n = len(hashes)
    odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)][:width]
    counts = np.diff(bounds)
    full = np.maximum(counts - width + 1, 0)
    at = np.repeat(bounds[:-1], full) + ragged(full)
    text = np.repeat(np.arange(len(counts)), full)
    value = np.zeros(len(at), np.uint64)
    for k, m in enumerate(odd):
        value += mix(hashes[at + k] + np.uint64(k)) * m
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        more = np.zeros(len(short), np.uint64)
        for k, m in enumerate(odd[:-1]):
            inside = counts[short] > k
            more += np.where(inside, mix(hashes[np.minimum(bounds[short] + k, n - 1)] + np.uint64(k)) * m, np.uint64(0))
        value, text = np.concatenate([value, more ^ np.uint64(1)]), np.concatenate([text, short])
    value = mix(value)
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        value, text = value[new], text[new]
    return value, text


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c of counts, laid end to end."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def whole_groups(batches, key: str, rows: int):
    """Tables of whole groups (rows with one key, which lie together), of at least so many rows but for the last."""
    kept, size, last = [], 0, None
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(key)).to_numpy()
        at = 0
        while at < len(values):
            if size >= rows:
                # the open group goes on in front of the first other key
                other = np.flatnonzero(values[at:] != last)
                end = at + int(other[0]) if len(other) else len(values)
                if end > at:
                    kept.append(batch.slice(at, end - at))
                if end < len(values):
                    yield pa.Table.from_batches(kept).combine_chunks()
                    kept, size = [], 0
                at = end
            else:
                end = min(len(values), at + rows - size)
                kept.append(batch.slice(at, end - at))
                size, at, last = size + end - at, end, values[end - 1]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


#: Bits of the filter below: a broadcast of at most 1 MB, whatever the number of rows.
FILTER_BITS = 23


def probable_members(df: DataFrame, column: str, wanted: DataFrame, absent: bool = False) -> DataFrame:
    """Rows of df whose column may be in ``wanted`` (one column), without a shuffle of df; or those that surely aren't.

    A bitmap of ``2 ** FILTER_BITS`` hashed values is gathered and broadcast; its size is fixed, and
    false positives only mean that a later exact join drops more rows.  Nulls count as a value.
    """
    from pyspark.sql import functions as F

    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << FILTER_BITS))
    wanted = wanted.select(spot(F.col(wanted.columns[0])).alias("spot"))
    maps = wanted.groupBy((F.col("spot") / 32768).cast("long").alias("__block")).agg(F.bitmap_construct_agg(F.pmod("spot", F.lit(32768))).alias("__map"))
    df = df.withColumn("__spot", spot(F.col(column)))
    joined = df.join(F.broadcast(maps), (F.col("__spot") / 32768).cast("long") == F.col("__block"), "left")
    within = F.pmod("__spot", F.lit(32768))
    byte = F.conv(F.hex(F.substring("__map", (within / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(within, F.lit(8)).cast("int")) == 1, F.lit(False))
    return joined.where(~hit if absent else hit).drop("__spot", "__block", "__map")
