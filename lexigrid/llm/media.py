"""Media columns: lossless FLAC streams, coded and decoded in lanes.

A payload's bytes are 8-bit mono samples (byte minus 128).  The coder gives each block the
best of the fixed predictors of order 0 to 2 and a short linear predictor, with Rice-coded
residuals; the decoder reads constant, verbatim, fixed (0 to 4) and linear (1 to 32)
subframes with 4- or 5-bit Rice parameters, partitions and escapes, checks every header's
CRC-8, every frame's CRC-16 and the stream's MD5, and gives PCM blocks with their sample
offsets.  All frames of a chunk advance together, one sample per step, so the work per step
is a handful of array operations.

Defined results: a null text counts as empty, and an empty payload is 64 zero bytes;
repeated rows give equal rows; a null id keeps its row; an empty table gives no rows; other
columns are not read; a damaged stream raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import chunks, map_batches

BLOCK = 512
#: A seek point stands before every so many frames.
SEEK_EVERY = 4
RATE = 8000
UNIT = 64
#: Fixed by the format: coefficients of the fixed predictors.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: The coder's linear predictor: mean of the last four samples (coefficients, shift, precision).
MEAN4 = ((1, 1, 1, 1), 2, 5)
#: Fixed by the format: block sizes by code.
SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
CODES = {v: k for k, v in SIZES.items()}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


@lru_cache(maxsize=4)
def _crc_table(bits: int, poly: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out[b] = c
    return out


def crc8(data: bytes) -> int:
    table, c = _crc_table(8, 0x07), 0
    for b in data:
        c = int(table[c ^ b])
    return c


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of many slices at once; slices are aligned at their ends, as leading zeros change nothing."""
    table = _crc_table(16, 0x8005)
    out = np.zeros(len(starts), np.uint32)
    if not len(starts):
        return out
    longest = int((ends - starts).max())
    padded = np.concatenate([np.zeros(longest, np.uint8), data])
    for back in range(longest, 0, -1):
        at = ends - back
        byte = np.where(at >= starts, padded[at + longest], 0)
        out = ((out << np.uint32(8)) & np.uint32(0xFFFF)) ^ table[(out >> np.uint32(8)) ^ byte]
    return out


def _number(n: int) -> bytes:
    """The frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = next(s for s in range(2, 8) if n < 1 << (5 * s + 1))
    out = [0x80 | (n >> (6 * i) & 0x3F) for i in range(size - 1)]
    lead = (0xFF << (8 - size)) & 0xFF
    return bytes([lead | n >> (6 * (size - 1)), *reversed(out)])


@lru_cache(maxsize=65536)
def _header(number: int, size: int) -> bytes:
    code = CODES.get(size, 7)
    head = bytes([0xFF, 0xF8, code << 4 | 4, 0x02]) + _number(number) + (struct.pack(">H", size - 1) if code == 7 else b"")
    return head + bytes([crc8(head)])


def _residual(samples: np.ndarray, kind: int) -> tuple[np.ndarray, int]:
    """Residual (frames x samples) of predictor ``kind``: 0 to 2 fixed, 3 the linear one; and its order."""
    if kind < 3:
        return np.diff(samples, kind, axis=1) if kind else samples, kind
    total = samples[:, 3:-1] + samples[:, 2:-2] + samples[:, 1:-3] + samples[:, :-4]
    return samples[:, 4:] - (total >> MEAN4[1]), 4


def _encode_blocks(samples: np.ndarray, numbers: list[int]) -> list[bytes]:
    """Frames of equally long blocks (frames x samples, int32)."""
    n, size = samples.shape
    best = np.argmin([np.abs(_residual(samples, kind)[0]).sum(axis=1) * (1 + 0.002 * kind) for kind in range(4)], axis=0)
    constant = (samples == samples[:, :1]).all(axis=1)
    best[constant] = 9
    out: list[bytes] = [b""] * n
    heads = [_header(k, size) for k in numbers]
    for i in np.flatnonzero(constant).tolist():
        body = heads[i] + bytes([0, int(samples[i, 0]) & 0xFF])
        out[i] = body
    for kind in range(4):
        own = np.flatnonzero(best == kind)
        if not len(own):
            continue
        residual, order = _residual(samples[own], kind)
        zig = (residual << 1) ^ (residual >> 31)
        mean = zig.mean(axis=1)
        guess = np.clip(np.floor(np.log2(np.maximum(mean, 1) * 0.7 + 1)).astype(np.int64), 0, 13)
        trial = np.stack([(zig >> (guess + d)[:, None]).sum(axis=1) + (guess + d + 1) * zig.shape[1] for d in (0, 1)])
        k = guess + np.argmin(trial, axis=0)
        quotient = zig >> k[:, None]
        lengths = quotient + (k + 1)[:, None]
        lead = []
        for i, row in enumerate(own.tolist()):
            warm = bytes((samples[row, :order] & 0xFF).astype(np.uint8))
            if kind < 3:
                first = bytes([(8 | kind) << 1])
                lead.append((heads[row] + first + warm, 0, 0))
            else:
                coefficients, shift, precision = MEAN4
                value, bits = precision - 1, 4
                for x, w in [(shift, 5), *((c & ((1 << precision) - 1), precision) for c in coefficients)]:
                    value, bits = value << w | x, bits + w
                lead.append((heads[row] + bytes([(32 | 3) << 1]) + warm, value, bits))
        lead_bits = np.array([8 * len(b) + w for b, _, w in lead])
        starts_in = np.cumsum(lengths, axis=1) - lengths
        total = lead_bits + 10 + lengths.sum(axis=1)
        n_bytes = -(-total // 8)
        base = 8 * (np.cumsum(n_bytes) - n_bytes)
        bits = np.zeros(int(n_bytes.sum()) * 8, np.uint8)
        first = base + lead_bits + 10
        at = (first[:, None] + starts_in + quotient).ravel()
        bits[at] = 1
        wide = np.repeat(k, zig.shape[1])
        flat = zig.ravel()
        for b in range(int(k.max())):
            inside = wide > b
            here, value, w = (at, flat, wide) if inside.all() else (at[inside], flat[inside], wide[inside])
            bits[here + 1 + b] = (value >> (w - 1 - b)) & 1
        packed = np.packbits(bits)
        offsets = (base // 8).tolist()
        for i, (row, (head, value, w)) in enumerate(zip(own.tolist(), lead)):
            # what follows the warm-up samples: the predictor's bits, method 00, one partition, its parameter
            value, w = value << 10 | int(k[i]), w + 10
            body = bytearray(packed[offsets[i] : offsets[i] + int(n_bytes[i])].tobytes())
            body[: len(head)] = head
            spare = -w % 8
            extra = (value << spare).to_bytes((w + spare) // 8, "big")
            for j, x in enumerate(extra, len(head)):
                body[j] |= x
            out[row] = bytes(body)
    stops = np.cumsum([len(b) for b in out])
    data = np.frombuffer(b"".join(out), np.uint8)
    checks = crc16(data, stops - [len(b) for b in out], stops)
    return [b + struct.pack(">H", c) for b, c in zip(out, checks.tolist())]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream per payload (each of 64 bytes or more, a multiple of 64)."""
    groups: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for at in range(0, len(p), BLOCK):
            groups.setdefault(min(BLOCK, len(p) - at), []).append((i, at))
    frames: list[list[bytes]] = [[b""] * (-(-len(p) // BLOCK)) for p in payloads]
    for size, places in groups.items():
        raw = b"".join([payloads[i][a : a + size] for i, a in places])
        samples = np.frombuffer(raw, np.uint8).reshape(-1, size).astype(np.int32) - 128
        for (i, a), frame in zip(places, _encode_blocks(samples, [a // BLOCK for _, a in places])):
            frames[i][a // BLOCK] = frame
    out = []
    for p, own in zip(payloads, frames):
        sizes = [len(f) for f in own]
        pcm = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
        points, at = [], 0
        for k, size in enumerate(sizes):
            if k % SEEK_EVERY == 0:
                points.append(struct.pack(">QQH", k * BLOCK, at, min(BLOCK, len(p) - k * BLOCK)))
            at += size
        table = b"".join(points)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + b"".join(own))
    return out


class _Bits:
    """Big-endian bit reader over one array, for the few header fields."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        if not n:
            return 0
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("stream ends early")
        value = int.from_bytes(self.data[a:b], "big") >> (8 * b - self.at - n) & ((1 << n) - 1)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> (n - 1) else value


def read_metadata(stream: bytes) -> tuple[dict, list[tuple[int, int, int]], int]:
    """(stream info, seek points, where the frames begin)."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, info, seek = 4, {}, []
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        at += 4 + size
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18], "big")
            info = {"block": struct.unpack(">H", body[:2])[0], "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind & 0x7F == 3:
            seek = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, size, 18)]
        if kind & 0x80:
            return info, seek, at


def _read_header(stream: bytes, at: int) -> tuple[int, int, int]:
    """(frame number, block size, where the subframe begins) after checking sync and CRC-8."""
    if stream[at] != 0xFF or stream[at + 1] & 0xFE != 0xF8:
        raise ValueError("frame sync not found")
    code, rate = stream[at + 2] >> 4, stream[at + 2] & 15
    p = at + 4
    lead = stream[p]
    more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
    number = lead if lead < 0x80 else lead & (0x7F >> (more + 1))
    for b in stream[p + 1 : p + 1 + more]:
        number = number << 6 | b & 0x3F
    p += 1 + more
    if code == 6:
        size, p = stream[p] + 1, p + 1
    elif code == 7:
        size, p = struct.unpack_from(">H", stream, p)[0] + 1, p + 2
    else:
        size = SIZES.get(code) or 0
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if not size or crc8(stream[at:p]) != stream[p]:
        raise ValueError("frame header is damaged")
    return number, size, p + 1


class _Lane:
    """One frame under way."""

    __slots__ = ("bits", "coefficients", "done", "end", "frame", "kind", "order", "partition_bits", "partitions", "shift", "size", "start", "stream", "wide", "warm", "width")


def _open_frame(stream: bytes, at: int, width: int, which: int) -> _Lane:
    lane = _Lane()
    lane.stream, lane.start = which, at
    lane.frame, lane.size, p = _read_header(stream, at)
    bits = lane.bits = _Bits(stream, 8 * p)
    if bits.take(1):
        raise ValueError("subframe header is damaged")
    kind = bits.take(6)
    waste = 0
    if bits.take(1):
        waste = 1
        while not bits.take(1):
            waste += 1
    lane.width = width - waste
    lane.shift, lane.coefficients, lane.kind, lane.wide = 0, (), "rice", waste
    if kind == 0:
        lane.kind, lane.order, lane.warm = "constant", 0, [bits.signed(lane.width)]
        return lane
    if kind == 1:
        lane.kind, lane.order = "verbatim", 0
        lane.warm = [bits.signed(lane.width) for _ in range(lane.size)]
        return lane
    lane.order = kind - 8 if 8 <= kind <= 12 else kind - 31 if kind >= 32 else -1
    if lane.order < 0:
        raise ValueError("reserved subframe type")
    lane.warm = [bits.signed(lane.width) for _ in range(lane.order)]
    if kind >= 32:
        precision = bits.take(4) + 1
        lane.shift = bits.signed(5)
        lane.coefficients = tuple(bits.signed(precision) for _ in range(lane.order))
    else:
        lane.coefficients = FIXED[lane.order]
    lane.partition_bits = 4 + bits.take(2)
    if lane.partition_bits > 5:
        raise ValueError("reserved residual coding")
    lane.partitions = 1 << bits.take(4)
    return lane


def _rice(words: np.ndarray, at: np.ndarray, counts: np.ndarray, k: np.ndarray, out: np.ndarray, rows: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Read counts[i] codes with parameter k[i] from bit at[i] into out[rows[i], column[i]:]; returns the bits' ends."""
    order = np.argsort(-counts, kind="stable")
    at, counts, k, rows, column = at[order].copy(), counts[order], k[order], rows[order], column[order]
    kk, up = k.astype(np.uint64), (np.uint64(64) - k.astype(np.uint64))
    eight = np.arange(8)
    for step in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -step, side="left"))
        p = at[:live]
        word = words[(p >> 3)[:, None] + eight].view(">u8").ravel().astype(np.uint64) << (p & 7).astype(np.uint64)
        high = (word >> np.uint64(40)).astype(np.float32)
        quotient = np.int64(150) - (high.view(np.uint32) >> np.uint32(23)).astype(np.int64)
        long = np.flatnonzero(quotient + k[:live] > 48)
        if len(long):  # a long run of zeros: count it word by word
            for i in long.tolist():
                q, j = 0, int(p[i])
                while not words[j >> 3] >> (7 - (j & 7)) & 1:
                    q, j = q + 1, j + 1
                    if j >> 3 >= len(words) - 8:
                        raise ValueError("residual runs past the stream")
                quotient[i] = q
                rest = int.from_bytes(words[(j + 1) >> 3 : ((j + 1) >> 3) + 8].tobytes(), "big") << ((j + 1) & 7)
                word[i] = np.uint64((rest & ((1 << 64) - 1)))
        shift = (quotient + 1).astype(np.uint64)
        if len(long):
            shift[long] = 0
        rest = np.where(k[:live] > 0, (word << shift) >> np.minimum(up[:live], np.uint64(63)), np.uint64(0))
        value = (quotient.astype(np.uint64) << kk[:live]) | rest
        out[rows[:live], column[:live] + step] = (value >> np.uint64(1)).astype(np.int64) ^ -(value & np.uint64(1)).astype(np.int64)
        at[:live] = p + quotient + 1 + k[:live]
    back = np.empty_like(at)
    back[order] = at
    return back


def decode_streams(streams: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Samples of each stream and its PCM blocks (sample offset, samples); every checksum is verified.

    Frames lie one behind the other and a frame's end is known once it is decoded, so the
    streams' seek points open as many places at once as there are.
    """
    lanes_at: list[tuple[int, int, int]] = []  # stream, byte, sample
    metas = []
    for i, s in enumerate(streams):
        info, seek, begin = read_metadata(s)
        if info.get("channels") != 1 or info["bits"] not in SAMPLE_BITS.values():
            raise ValueError("one channel of 8 to 24 bits is expected")
        metas.append(info)
        points = seek or [(0, 0, 0)]
        lanes_at += [(i, begin + off, sample) for sample, off, _ in points if sample < info["samples"]]
    base = np.cumsum([0] + [len(s) for s in streams])
    words = np.frombuffer(b"".join(streams) + b"\0" * 16, np.uint8)
    samples = [np.zeros(m["samples"], np.int64) for m in metas]
    blocks: list[list[tuple[int, int]]] = [[] for _ in streams]
    stops = {}
    for (i, _, sample), nxt in zip(lanes_at, [*lanes_at[1:], (-1, 0, 0)]):
        stops[i, sample] = nxt[2] if nxt[0] == i else metas[i]["samples"]
    active = [(i, byte, sample, stops[i, sample]) for i, byte, sample in lanes_at]
    while active:
        lanes = [_open_frame(streams[i], byte, metas[i]["bits"], i) for i, byte, _, _ in active]
        width = max(l.size for l in lanes)
        values = np.zeros((len(lanes), width), np.int64)
        rice = [j for j, l in enumerate(lanes) if l.kind == "rice"]
        ends = np.array([l.bits.at for l in lanes], np.int64) + 8 * base[[l.stream for l in lanes]]
        for j, l in enumerate(lanes):
            if l.kind == "constant":
                values[j, : l.size] = l.warm[0]
            elif l.kind == "verbatim":
                values[j, : l.size] = l.warm
        for part in range(max((lanes[j].partitions for j in rice), default=0)):
            rows, k, counts, column = [], [], [], []
            for j in rice:
                l = lanes[j]
                if part >= l.partitions:
                    continue
                each = l.size // l.partitions
                n, first = each - (l.order if part == 0 else 0), max(part * each, l.order)
                reader = _Bits(streams[l.stream], int(ends[j] - 8 * base[l.stream]))
                parameter = reader.take(l.partition_bits)
                if parameter == (1 << l.partition_bits) - 1:
                    raw = reader.take(5)
                    values[j, first : first + n] = [reader.signed(raw) for _ in range(n)]
                    ends[j] = reader.at + 8 * base[l.stream]
                    continue
                ends[j] = reader.at + 8 * base[l.stream]
                rows.append(j)
                k.append(parameter)
                counts.append(n)
                column.append(first)
            if rows:
                rows = np.array(rows)
                ends[rows] = _rice(words, ends[rows], np.array(counts), np.array(k, np.int64), values, rows, np.array(column))
        _predict(lanes, rice, values)
        byte_ends = -(-ends // 8)
        starts = np.array([l.start for l in lanes]) + base[[l.stream for l in lanes]]
        if (byte_ends + 2 > base[np.array([l.stream for l in lanes]) + 1]).any():
            raise ValueError("frame runs past the stream")
        stored = words[byte_ends].astype(np.uint32) << np.uint32(8) | words[byte_ends + 1]
        if (crc16(words, starts, byte_ends) != stored).any():
            raise ValueError("frame checksum differs")
        following = []
        for j, (l, (i, _, sample, stop)) in enumerate(zip(lanes, active)):
            samples[i][sample : sample + l.size] = values[j, : l.size] << l.wide
            blocks[i].append((sample, l.size))
            if sample + l.size < stop:
                following.append((i, int(byte_ends[j] + 2 - base[i]), sample + l.size, stop))
        active = following
    out = []
    for s, m, b in zip(samples, metas, blocks):
        size = -(-m["bits"] // 8)
        pcm = s.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :size].tobytes()
        if any(m["md5"]) and hashlib.md5(pcm).digest() != m["md5"]:
            raise ValueError("stream checksum differs")
        out.append((s, sorted(b)))
    return out


def _predict(lanes: list[_Lane], rice: list[int], values: np.ndarray) -> None:
    """Undo the predictors in place; lanes with the same one go through their samples together."""
    groups: dict[tuple, list[int]] = {}
    for j in rice:
        if lanes[j].order:
            groups.setdefault((lanes[j].coefficients, lanes[j].shift), []).append(j)
    for (coefficients, shift), rows in groups.items():
        order = len(coefficients)
        work = np.ascontiguousarray(values[rows].T)
        work[:order] = np.array([lanes[j].warm for j in rows]).T
        for t in range(order, work.shape[0]):
            guess = work[t - 1] * coefficients[0]
            for back, c in enumerate(coefficients[1:], 2):
                guess += work[t - back] * c if c != 1 else work[t - back]
            work[t] += guess >> shift if shift >= 0 else guess << -shift
        values[rows] = work.T


def payload(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT if text else UNIT)


def encode_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's payload as a FLAC stream."""

    def run(batches):
        for rows, data, offsets in chunks(batches):
            raw, at = data.tobytes(), offsets.tolist()
            media = encode_payloads([payload(raw[a:b]) for a, b in zip(at, at[1:])])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_bytes long, media binary")


def _decoded(batches, limit: int = 1 << 21):
    """Slices of batches with their streams, decoded; the samples of a slice are bounded unless one stream has more."""
    for batch in batches:
        media = batch.column(batch.schema.get_field_index("media"))
        # the first metadata block ends its line of rate, channels and depth with 36 bits of the number of samples
        sizes = [int.from_bytes(head or b"", "big") & (1 << 36) - 1 for head in pc.binary_slice(media, 18, 26).to_pylist()]
        at = 0
        while at < len(sizes):
            end, total = at, 0
            while end < len(sizes) and (end == at or total + sizes[end] <= limit):
                total, end = total + sizes[end], end + 1
            streams = [m.as_py() for m in media[at:end]]
            yield batch.slice(at, end - at), streams, decode_streams(streams)
            at = end


def pcm_blocks(media: DataFrame) -> DataFrame:
    """doc_id, sample_offset, pcm: decoded blocks, each findable by the offset of its first sample."""

    def run(batches):
        for rows, _, decoded in _decoded(batches):
            ids, first, pcm = [], [], []
            for doc, (samples, blocks) in zip(rows.column(0).to_pylist(), decoded):
                for at, n in blocks:
                    ids.append(doc)
                    first.append(at)
                    pcm.append(samples[at : at + n].astype(np.int8).tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "sample_offset": pa.array(first, pa.int64()), "pcm": pa.array(pcm, pa.binary())})

    return map_batches(media.select("doc_id", "media"), run, "doc_id long, sample_offset long, pcm binary")


def media_digest(media: DataFrame) -> DataFrame:
    """Decode stored streams of 8-bit samples and describe payload, stored form and sound."""

    def run(batches):
        for rows, streams, decoded in _decoded(batches):
            out = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for stream, (samples, blocks) in zip(streams, decoded):
                data = (samples + 128).astype(np.uint8).tobytes()
                out["payload_bytes"].append(len(data))
                out["payload_sha256"].append(hashlib.sha256(data).hexdigest())
                out["tail_crc32"].append(zlib.crc32(data[-UNIT:]))
                out["media_bytes"].append(len(stream))
                out["media_sha256"].append(hashlib.sha256(stream).hexdigest())
                steps = np.abs(np.diff(samples)).sum()
                out["feature"].append(f"blocks={len(blocks)};sum={int(samples.sum())};energy={int((samples * samples).sum())};steps={int(steps)}")
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *(pa.array(v) for v in out.values())], ["doc_id", "n_bytes", *out])

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
