"""Benchmark decontamination: random-walk embedding, bit sampling, exact edit distance.

Texts are sequences of words (runs of letters and digits, A-Z lower-cased; a character of a
script without spaces is a word).  An item of L words is found in a document where some stretch
lies within ``floor(share * L)`` word edits; items of fewer than ``min_words`` words are
looked for without edits, by a hash of their whole sequence.

* Windows of each item length start at every word.  An edit destroys at most two word
  pairs, so a window with fewer than ``L - 1 - 2 * edits`` pairs from the items cannot match
  and leaves; this bound loses nothing.
* A text within the allowed edits of an item's length is one window by itself, also where it
  is the shorter one.  It meets every item of which it has enough pairs, without sampling.
* The rest are embedded by random walks (at step j the walk writes its symbol and moves on or
  stays by a random bit of (j, symbol)), which turn a few edits into a few differing steps.
  Repeated sampling of steps gives hash keys; a window meets the items with an equal key.
* The edit distance of each meeting is computed exactly around the window.

The benchmark is a stated query set: it is sent to all tasks in blocks of about ``BLOCK_BYTES``
of text, so what is broadcast is bounded whatever the benchmark's size.

Defined results: null and empty texts contain nothing; items without words identify no
passage and are not looked for; repeated documents and repeated items give repeated rows;
null ids keep their rows; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, RollingHash, chunks, map_batches, mix, ragged

SHARE = 0.2
MIN_WORDS = 8
BLOCK_BYTES = 2 << 20
#: Random walks, samples of each walk, and steps of a sample.
WALKS, SAMPLES, STEPS = 4, 12, 5
_MAP_BITS = 20

#: Letters and digits; every byte of a character beyond ASCII counts as a letter.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_hash = RollingHash(53)


def words(data: np.ndarray, offsets: np.ndarray):
    """Hashes, starts, ends of all words and the index of each text's first word."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = _SOLID[data]
    first, last = solid[1:] & ~solid[:-1], solid[:-1] & ~solid[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    inner = cuts[solid[cuts + 1] & solid[cuts]]
    first[inner] = last[inner] = True
    if (data >= 0xE0).any():
        at, size = unspaced(data)
        first[at] = last[at + size] = True
        last[at[solid[at]]] = True
        first[(at + size)[solid[at + size + 1]]] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return _hash.of(_hash.sums(LOWER[data]), starts, ends), starts, ends, np.searchsorted(starts, offsets)


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and sizes of the characters of scripts without spaces: Thai to Khmer, kana and Han."""
    at = np.flatnonzero(data >= 0xE0)
    at = at[at + 3 <= len(data)]
    lead, second = data[at], data[at + 1]
    long = (lead == 0xF0) & (second >= 0xA0)
    own = long | ((lead >= 0xE4) & (lead <= 0xE9)) | ((lead == 0xE3) & (second >= 0x81)) | ((lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB))
    own |= (lead == 0xE1) & (((second >= 0x80) & (second <= 0x82)) | ((second >= 0x9E) & (second <= 0x9F)))
    return at[own], np.where(long[own], 4, 3)


def pair_hashes(symbols: np.ndarray) -> np.ndarray:
    return mix(symbols[:-1] * np.uint64(0x9E3779B97F4A7C15) + symbols[1:])


def sequence_hashes(symbols: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` symbols from every place on (fewer at the end)."""
    out = np.zeros(len(symbols), np.uint64)
    for k in range(length):
        out[: len(out) - k] = mix(out[: len(out) - k] ^ symbols[k:]) + np.uint64(k + 1)
    return out


def walk(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Random-walk embeddings (windows x 3 * longest) of windows of a symbol sequence."""
    steps = 3 * int(length.max())
    out = np.zeros((len(start), steps), np.uint64)
    place, end = start.copy(), start + length
    salts = mix(np.arange(1, steps + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1_000_003))
    for j in range(steps):
        inside = place < end
        symbol = np.where(inside, symbols[np.minimum(place, len(symbols) - 1)], np.uint64(0))
        out[:, j] = symbol
        place += inside & (mix(symbol ^ salts[j]) & np.uint64(1)).astype(bool)
    return out


def sample_keys(embedded: np.ndarray, length: int, seed: int) -> np.ndarray:
    """One key per sample (windows x SAMPLES) of windows of one length."""
    rng = np.random.default_rng(seed * 100_003 + length)
    picked = rng.integers(0, 3 * length, (SAMPLES, STEPS))
    key = np.broadcast_to(mix(np.arange(SAMPLES, dtype=np.uint64) + np.uint64(seed * 4096 + 17)), (len(embedded), SAMPLES)).copy()
    for k in range(STEPS):
        key = mix(key ^ embedded[:, picked[:, k]]) + np.uint64(k)
    return key


def best_match(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of part nearest to item by word edits; leftmost end among equals."""
    m = len(part)
    row = np.zeros(m + 1, np.int64)
    begin = np.arange(m + 1)
    ramp = np.arange(m + 1)
    for i, symbol in enumerate(item.tolist(), 1):
        keep = np.empty(m + 1, np.int64)
        origin = np.empty(m + 1, np.int64)
        keep[0], origin[0] = i, 0
        change = row[:-1] + (part != np.uint64(symbol))
        drop = row[1:] + 1
        keep[1:] = np.minimum(change, drop)
        origin[1:] = np.where(change <= drop, begin[:-1], begin[1:])
        # insertions run along the row: the smallest of keep - position so far
        low = np.minimum.accumulate(keep - ramp)
        source = np.maximum.accumulate(np.where(keep - ramp == low, ramp, 0))
        row, begin = low + ramp, origin[source]
    end = int(np.argmin(row))
    return int(row[end]), int(begin[end]), end


class Items:
    """A block of the benchmark, ready for search; one copy per task."""

    def __init__(self, ids: list, texts: list[str], share: float, min_words: int):
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        symbols, _, _, bounds = words(data, offsets)
        length = np.diff(bounds)
        self._short(ids, symbols, bounds, np.flatnonzero((length > 0) & (length < max(2, min_words))))
        use = np.flatnonzero(length >= max(2, min_words))
        self.ids = [ids[i] for i in use.tolist()]
        self.length = length[use]
        self.edits = np.floor(self.length * share).astype(np.int64)
        self.words = [symbols[bounds[i] : bounds[i + 1]] for i in use.tolist()]
        pairs = [pair_hashes(w) for w in self.words]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64)
        self.map = np.zeros(1 << _MAP_BITS, bool)
        self.map[(self.pairs >> np.uint64(64 - _MAP_BITS)).astype(np.int64)] = True
        # pairs of one word with itself, as in repeated words, count only as often as an item has any
        self.doubles = max((int((w[1:] == w[:-1]).sum()) for w in self.words), default=0)
        self.needs = {int(l): int(l - 1 - 2 * e) for l, e in zip(self.length, self.edits)}
        # the items that have each pair
        rows = [np.unique(np.searchsorted(self.pairs, p)) for p in pairs]
        row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        order = np.argsort(row, kind="stable")
        self.owners = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[order]
        self.owner_starts = np.searchsorted(row[order], np.arange(len(self.pairs) + 1))
        # the lengths of the items that have each pair
        kinds = np.unique(np.stack([row, np.repeat(self.length, [len(r) for r in rows])]), axis=1) if rows else np.zeros((2, 0), np.int64)
        self.kinds, self.kind_starts = kinds[1], np.searchsorted(kinds[0], np.arange(len(self.pairs) + 1))
        self.keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        if len(use):
            flat = np.concatenate(self.words)
            start = np.cumsum(self.length) - self.length
            for seed in range(WALKS):
                embedded = walk(flat, start, self.length, seed)
                for l in self.needs:
                    own = np.flatnonzero(self.length == l)
                    key = sample_keys(embedded[own], l, seed)
                    order = np.argsort(key.ravel(), kind="stable")
                    self.keys[seed, l] = key.ravel()[order], np.repeat(own, SAMPLES)[order]

    def _short(self, ids: list, symbols: np.ndarray, bounds: np.ndarray, use: np.ndarray) -> None:
        """Per length the sequence hashes of the short items and their ids."""
        self.short: dict[int, tuple[np.ndarray, list]] = {}
        for l in np.unique(np.diff(bounds)[use]).tolist():
            own = use[np.diff(bounds)[use] == l]
            key = sequence_hashes(symbols, l)[bounds[own]]
            order = np.argsort(key, kind="stable")
            self.short[l] = key[order], [ids[i] for i in own[order].tolist()]

    def short_hits(self, symbols: np.ndarray, bounds: np.ndarray) -> list[tuple[int, object, int, int]]:
        """(text, id, first word, word after) of the first place of each short item in each text."""
        out = []
        for l, (known, ids) in self.short.items():
            key = sequence_hashes(symbols, l)
            low, high = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
            seen = set()
            for p in np.flatnonzero(high > low).tolist():
                text = int(np.searchsorted(bounds, p, side="right")) - 1
                if p + l <= bounds[text + 1]:
                    for i in range(low[p], high[p]):
                        if (text, i) not in seen:
                            seen.add((text, i))
                            out.append((text, ids[i], p, p + l))
        return out

    def hits(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where the texts have a pair of the items, and which pair."""
        pair = pair_hashes(symbols)
        hit = self.map[(pair >> np.uint64(64 - _MAP_BITS)).astype(np.int64)]
        at = np.flatnonzero(hit)
        which = np.minimum(np.searchsorted(self.pairs, pair[at]), len(self.pairs) - 1)
        real = (self.pairs[which] == pair[at]) & ~np.isin(at, bounds[1:-1] - 1)
        return at[real], which[real]

    def windows(self, symbols: np.ndarray, at: np.ndarray, which: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the windows that the pair count leaves."""
        double = symbols[at] == symbols[at + 1]
        size = np.diff(self.kind_starts)[which]
        hit = np.repeat(np.arange(len(at)), size)
        kind = self.kinds[np.repeat(self.kind_starts[which], size) + ragged(size)]
        order = np.argsort(kind, kind="stable")
        hit, kind = hit[order], kind[order]
        starts, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        first = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(kind) else kind
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(kind)]):
            l, own = int(kind[a]), hit[a:b]
            if l > len(symbols) or b - a < self.needs[l]:
                continue
            n = len(symbols) + 1
            single, twice = (np.cumsum(np.bincount(at[own[double[own] == d]] + 1, minlength=n)) for d in (False, True))
            count = single[l - 1 :] - single[: n - l + 1] + np.minimum(twice[l - 1 :] - twice[: n - l + 1], self.doubles)
            found = np.flatnonzero(count[: n - l] >= self.needs[l])
            found = found[found + l <= bounds[np.searchsorted(bounds, found, side="right")]]
            starts.append(found)
            lengths.append(np.full(len(found), l))
        return np.concatenate(starts), np.concatenate(lengths)

    def whole(self, at: np.ndarray, which: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(text start, item) of the texts about as long as an item that have enough of its pairs."""
        size, cut = np.diff(bounds), np.searchsorted(at, bounds)
        fits = np.zeros(len(size), bool)
        for l, e in {int(l): int(e) for l, e in zip(self.length, self.edits)}.items():
            fits |= (np.abs(size - l) <= e) & (np.diff(cut) >= self.needs[l])
        needs = self.length - 1 - 2 * self.edits
        out: set[tuple[int, int]] = set()
        for t in np.flatnonzero(fits).tolist():
            pair = which[cut[t] : cut[t + 1]]
            first, n = self.owner_starts[pair], np.diff(self.owner_starts)[pair]
            count = np.bincount(self.owners[np.repeat(first, n) + ragged(n)], minlength=len(self.ids))
            item = np.flatnonzero((count >= needs) & (np.abs(size[t] - self.length) <= self.edits))
            out.update((int(bounds[t]), i) for i in item.tolist())
        return out

    def candidates(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray) -> set[tuple[int, int]]:
        """(window start, item) pairs that share a key."""
        out: set[tuple[int, int]] = set()
        for seed in range(WALKS):
            embedded = walk(symbols, start, length, seed)
            for l in np.unique(length).tolist():
                own = np.flatnonzero(length == l)
                key = sample_keys(embedded[own], l, seed)
                known, item = self.keys[seed, l]
                low, high = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
                for r, c in zip(*np.nonzero(high > low)):
                    out.update((int(start[own[r]]), int(i)) for i in item[low[r, c] : high[r, c]].tolist())
        return out

    def search(self, symbols: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, word after) of the best stretch of each item in each text."""
        if not self.needs or not len(symbols):
            return []
        at, which = self.hits(symbols, bounds)
        start, length = self.windows(symbols, at, which, bounds)
        met = self.whole(at, which, bounds)
        if len(start):
            met |= self.candidates(symbols, start, length)
        places: dict[tuple[int, int], list[int]] = {}
        for p, item in met:
            places.setdefault((int(np.searchsorted(bounds, p, side="right")) - 1, item), []).append(p)
        out = []
        for (text, item), found in sorted(places.items()):
            l, e = int(self.length[item]), int(self.edits[item])
            best, found = None, sorted(found)
            while found:
                last = found[0]
                k = 1
                while k < len(found) and found[k] <= last + l:
                    last, k = found[k], k + 1
                a, b = max(int(bounds[text]), found[0] - e), min(int(bounds[text + 1]), last + l + e)
                d, s, t = best_match(self.words[item], symbols[a:b])
                if d <= e and (best is None or d < best[0]):
                    best = d, a + s, a + t
                found = found[k:]
            if best:
                out.append((text, item, *best))
        return out


def find_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, item_id, distance, item_words, start, end: the best stretch (code points) of each item in each document that has it."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    schema = "doc_id long, item_id long, distance long, item_words long, start long, end long"
    blocks = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n // BLOCK_BYTES + 1
    out = docs.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        block = Items([r.item_id for r in rows], [r.text for r in rows], share, min_words)

        def run(batches, block=block):
            for rows, data, offsets in chunks(batches):
                symbols, starts, ends, bounds = words(data, offsets)
                found = [(t, block.ids[i], d, int(block.length[i]), a, e) for t, i, d, a, e in block.search(symbols, bounds)]
                found += [(t, i, 0, e - a, a, e) for t, i, a, e in block.short_hits(symbols, bounds)]
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = [int(lead[offsets[t]]) for t, *_ in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array([t for t, *_ in found], pa.int64())),
                        *(pa.array([f[k] for f in found], pa.int64()) for k in (1, 2, 3)),
                        pa.array([int(lead[starts[f[4]]]) - z for f, z in zip(found, base)], pa.int64()),
                        pa.array([int(lead[ends[f[5] - 1]]) - z for f, z in zip(found, base)], pa.int64()),
                    ],
                    ["doc_id", "item_id", "distance", "item_words", "start", "end"],
                )

        if block.ids or block.short:
            out = out.unionByName(map_batches(docs, run, schema))
    return out


def drop_leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, min_words: int = MIN_WORDS) -> DataFrame:
    """df without the rows whose id has a leak; rows with a null id are kept."""
    found = find_leaks(df, benchmark, id_col, text_col, share=share, min_words=min_words).select(F.col("doc_id").alias(id_col)).distinct()
    return df.join(found, id_col, "left_anti")
