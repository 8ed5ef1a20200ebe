"""Edit costs from letter frequencies and distances on the keyboard.

A cost model is asymmetric: ``insert`` is paid for a character of the word that the query
lacks, ``remove`` for one of the query that the word lacks, ``modify`` for a differing pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Letter frequencies a..z (German without its 27th value, which belongs to sharp s).
ENGLISH = (0.082, 0.015, 0.028, 0.043, 0.13, 0.022, 0.02, 0.061, 0.07, 0.0015, 0.0077, 0.04, 0.025, 0.067, 0.075, 0.019, 0.00095, 0.06, 0.063, 0.091, 0.028, 0.0098, 0.024, 0.0015, 0.02, 0.00074)
GERMAN = (0.0651, 0.0189, 0.0306, 0.0508, 0.1740, 0.0166, 0.0301, 0.0476, 0.0755, 0.0027, 0.0121, 0.0344, 0.0253, 0.0978, 0.0251, 0.0079, 0.0002, 0.0700, 0.0727, 0.0615, 0.0435, 0.0067, 0.0189, 0.0003, 0.0004, 0.0113)
GERMAN_SHARP_S = 0.0031
#: The rows of a QWERTZ keyboard; each key touches the keys half a step aside above and below.
KEY_ROWS = ("qwertzuiop", "asdfghjkl", "yxcvbnm")


def key_edges() -> list[tuple[str, str]]:
    """Neighbouring keys, both directions."""
    out = []
    for r, row in enumerate(KEY_ROWS):
        for c, key in enumerate(row):
            out += [(key, row[c + 1]), (row[c + 1], key)] if c + 1 < len(row) else []
            if r + 1 < len(KEY_ROWS):
                below = KEY_ROWS[r + 1]
                for d in (c - 1, c):
                    if 0 <= d < len(below):
                        out += [(key, below[d]), (below[d], key)]
    return sorted(out)


def key_distances() -> np.ndarray:
    """Shortest paths between all keys, a..z by a..z, by repeated relaxation."""
    far = np.full((26, 26), 99)
    np.fill_diagonal(far, 0)
    for a, b in key_edges():
        far[ord(a) - 97, ord(b) - 97] = 1
    for k in range(26):
        far = np.minimum(far, far[:, k : k + 1] + far[k : k + 1, :])
    return far


@dataclass(frozen=True)
class CostModel:
    """Costs of the byte values below 128; other characters count as non-letters."""

    insert: np.ndarray
    remove: np.ndarray
    modify: np.ndarray

    def for_query(self, query: str) -> tuple[np.ndarray, np.ndarray]:
        """(modify by word character and query position, running removal cost of the query's prefixes)."""
        codes = np.minimum([ord(c) for c in query], 127).astype(np.int64) if query else np.zeros(0, np.int64)
        modify = self.modify[:, codes].copy()
        for j, c in enumerate(query):
            if ord(c) > 126:
                modify[:, j] = 1.0 if self.insert[1] == 1.0 else modify[0, j]
        return modify, np.concatenate([[0.0], np.cumsum(self.remove[codes])])


def _is_letter(code: np.ndarray) -> np.ndarray:
    return (code | 32 >= 97) & (code | 32 <= 122)


def keyboard_model(frequencies: tuple[float, ...], normaliser: float = 9.0) -> CostModel:
    code = np.arange(128)
    letter = _is_letter(code)
    place = np.where(letter, (code | 32) - 97, 0)
    p = np.array(frequencies)[place]
    far = key_distances() / normaliser
    modify = np.where(letter[:, None] & letter[None, :], 0.05 + far[place[:, None], place[None, :]], 1.0)
    modify = np.where((code[:, None] | 32) == (code[None, :] | 32), 0.02, modify)
    np.fill_diagonal(modify, 0.0)
    return CostModel(np.where(letter, 0.7 - np.minimum(5 * p, 0.65), 1.0), np.where(letter, 1 + 5 * p, 2.0), modify)


def simple_model() -> CostModel:
    """Flat penalties: 0.25 per insertion, 1 per removal, 0.1 for the other case, 1 for another character."""
    code = np.arange(128)
    modify = np.where((code[:, None] ^ code[None, :]) == 32, 0.1, 1.0)
    np.fill_diagonal(modify, 0.0)
    return CostModel(np.full(128, 0.25), np.full(128, 1.0), modify)


def preset(name: str) -> CostModel:
    """``english``, ``german``, ``german_compat`` (shifted frequencies and a normaliser of 113) or ``simple``."""
    models = {
        "english": lambda: keyboard_model(ENGLISH),
        "german": lambda: keyboard_model(GERMAN),
        "german_compat": lambda: keyboard_model((*GERMAN[:19], GERMAN_SHARP_S, *GERMAN[19:25]), 113.0),
        "simple": simple_model,
    }
    if name not in models:
        raise ValueError(f"unknown cost model: {name}")
    return models[name]()
