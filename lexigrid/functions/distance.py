"""The weighted edit distance, for many words at once."""

from __future__ import annotations

import numpy as np

from .costs import CostModel


def codes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes (words x longest; 127 stands for any character beyond ASCII) and lengths."""
    length = np.array([len(w) for w in words], np.int64)
    width = int(length.max()) if len(words) else 0
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32)
    return np.minimum(flat, 127).astype(np.int64).reshape(len(words), width), length


def next_rows(rows: np.ndarray, char: np.ndarray, model: CostModel, modify: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Rows of the distance table after one more character of each word."""
    best = rows + model.insert[char][:, None]
    if modify.shape[1]:
        np.minimum(best[:, 1:], rows[:, :-1] + modify[char], out=best[:, 1:])
    # removals run along the row: the smallest of best - run so far, plus run
    return np.minimum.accumulate(best - run, axis=1) + run


def distances(words: list[str], query: str, model: CostModel) -> np.ndarray:
    """Distance of every word to the query."""
    codes, length = codes_of(words)
    modify, run = model.for_query(query)
    rows = np.broadcast_to(run, (len(words), len(run))).copy()
    out = rows[:, -1].copy()
    order = np.argsort(-length, kind="stable")
    rows, codes, length = rows, codes[order], length[order]
    for i in range(codes.shape[1]):
        live = int(np.searchsorted(-length, -i, side="left"))
        rows[:live] = next_rows(rows[:live], codes[:live, i], model, modify, run)
    out[order] = rows[:, -1]
    return out
