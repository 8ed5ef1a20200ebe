"""Byte-level BPE ids through the ``tokenizers`` library, at the speed of distinct pieces.

Byte-level BPE encodes each pre-token ("piece") by itself.  The chunk's pieces are found
with vectorised character classes, told apart by 64-bit hashes, and only pieces that this
worker has not met yet go through the library's model; a bounded cache keeps their ids.
The ids equal ``Tokenizer.encode(text, add_special_tokens=False)`` with ``encode_special_tokens``
set, so a special token spelled out in a text is plain text; tests compare them.
"""

from __future__ import annotations

import sys
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd

from .textkit import RollingHash, ragged

#: Pieces kept by a worker before the cache starts anew.
CACHE_PIECES = 400_000
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Fixed: what the pre-tokeniser cuts off after an apostrophe at a piece's start.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, from Unicode's general categories."""
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    table[0x2000:0x200B] = SPACE
    return table


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else 256 and on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(more))
            more += 1
    return out


def piece_starts(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sorted positions where a piece begins; ``bounds`` are the texts' starts (and the total length)."""
    n = len(codes)
    kind = classes()[codes]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    prev = np.empty(n, np.uint8)
    prev[1:] = kind[:-1]
    prev[:1] = 0
    prev[edge[:n]] = 0
    space = kind == SPACE
    new = (kind != prev) & ~space
    # a single blank before another piece belongs to it
    blank = np.flatnonzero(new & (prev == SPACE))
    blank = blank[codes[blank - 1] == 32]
    new[blank] = False
    # runs of white space: all but the last character, and the last one, which may lead the next piece
    new |= space & (prev != SPACE)
    ends = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:n]) if n else np.zeros(0, int)
    new[ends] = True
    # contractions
    quote = np.flatnonzero(codes == 39)
    quote = quote[new[quote]] if len(quote) else quote
    if len(quote):
        after = np.flatnonzero(edge)
        stop = after[np.searchsorted(after, quote, side="right")]
        for q, s in zip(quote.tolist(), stop.tolist()):
            tail = "".join(map(chr, codes[q + 1 : min(q + 3, s)].tolist()))
            for c in CONTRACTIONS:
                if tail.startswith(c):
                    new[q + 1 : q + 1 + len(c)] = False
                    if q + 1 + len(c) < s:
                        nxt = q + 1 + len(c)
                        new[nxt] |= kind[nxt] != SPACE
                    break
    return np.flatnonzero(new)


class PieceEncoder:
    """Encodes chunks of texts; one per worker process."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        self.model = tokenizer.model
        self.letters = byte_letters()
        self.hash = RollingHash(29, 1 << 16)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, pieces: list[str]) -> None:
        letters, tokenize, counts, ids = self.letters, self.model.tokenize, [], []
        for piece in pieces:
            found = [t.id for t in tokenize("".join([letters[b] for b in piece.encode("utf-8")]))]
            counts.append(len(found))
            ids += found
        counts = np.array(counts, np.int64)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.ids = np.concatenate([self.ids, np.array(ids, np.uint32)])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and each text's offset among them."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        starts = piece_starts(codes, bounds)
        ends = np.append(starts[1:], len(codes))
        high = codes >> np.uint32(16)
        folded = (codes ^ (high * np.uint32(0x9E37))) & np.uint32(0xFFFF)
        key = self.hash.of(self.hash.sums(folded), starts, ends)
        if high.any():  # planes beyond the first are told apart by a second term
            key ^= self.hash.of(self.hash.sums(high), starts, ends)
        which, distinct = pd.factorize(key)
        if len(self.known) > CACHE_PIECES:
            self._forget()
        known = self.known
        wanted = distinct.tolist()
        slots = list(map(known.get, wanted))
        missing = [j for j, slot in enumerate(slots) if slot is None]
        if missing:
            first = np.empty(len(distinct), np.int64)
            first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
            joined = "".join(texts)
            at = first[missing]
            for k, j in enumerate(missing, len(self.starts)):
                known[wanted[j]] = slots[j] = k
            self._learn([joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        slot = np.array(slots, np.int64)[which]
        lengths = self.counts[slot]
        out = self.ids[np.repeat(self.starts[slot], lengths) + ragged(lengths)]
        ahead = np.concatenate([[0], np.cumsum(lengths)])
        return out, ahead[np.searchsorted(starts, bounds)]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
