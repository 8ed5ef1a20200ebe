"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of its hash and the mean embedding of its character
trigrams.  Overlapping windows of ``WINDOW`` words run through a forward and a backward
gated unit; attention pools the states of a window into one logit, and a text's logit is
that of its worst window.  Training sees labelled texts only: first every window takes
its text's label, then the worst window of each text stands for it.

Defined results: null, empty and wordless texts score as an empty window; repeated rows
score alike; a null id keeps its row and is not held out; without labels of both classes
the score is constant; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import words
from .labelled import calibrate, held_out, sample, sigmoid
from .textkit import CHUNK_BYTES, LOWER, chunks, map_batches, ragged

WINDOW, STRIDE = 32, 24
WORDS, TRIGRAMS, EMBED, HIDDEN = 1 << 15, 1 << 13, 8, 8
#: Labelled documents of each class that are read at most, and bytes of their whole texts together.
PER_CLASS = 1200
MAX_BYTES = 4 << 20
#: Steps on any windows, then steps on texts' worst windows, which are chosen anew after every so many.
STEPS, WORST_STEPS, CHOOSE = 200, 250, 50
BATCH = 256
RATE = 0.01
DECAY = 0.002
THRESHOLD = 0.7
FOLDS, FOLD = 3, 1


def inputs(data: np.ndarray, offsets: np.ndarray):
    """Word buckets and their trigrams: word index of each position, distinct words' buckets, trigram ids and their ends, text bounds."""
    parts, at = [], 0
    while at < len(offsets) - 1:  # whole texts, so that the arrays beside the bytes stay small
        end = min(max(int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1, at + 1), len(offsets) - 1)
        hashes, starts, ends, bounds = words(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        parts.append((hashes, starts + offsets[at], ends + offsets[at], np.diff(bounds)))
        at = end
    hashes, starts, ends, counts = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(4))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    which, distinct = pd.factorize(hashes)
    first = np.empty(len(distinct), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    sizes = (ends - starts)[first]
    inside = ragged(sizes)
    at = np.repeat(starts[first], sizes) + inside
    low = LOWER[data[at]].astype(np.int64)
    before = np.where(inside > 0, np.roll(low, 1), 256)
    after = np.where(inside < np.repeat(sizes, sizes) - 1, np.roll(low, -1), 257)
    grams = ((before * 65_599 + low * 31 + after) * 2_654_435_761 >> 9) & (TRIGRAMS - 1)
    return which, (distinct.astype(np.uint64) & np.uint64(WORDS - 1)).astype(np.int64), grams, sizes, bounds


def window_starts(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of all windows; the last window ends with its text."""
    n = np.diff(bounds)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    at = np.minimum(ragged(count) * STRIDE, np.maximum(n[text] - WINDOW, 0))
    return text, bounds[text] + at, np.minimum(n[text], WINDOW)


class Network:
    """Parameters and the two passes; arrays are (step, window, unit)."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        e, h = 2 * EMBED, HIDDEN
        self.p = {"word": draw(WORDS, EMBED, scale=0.05), "gram": draw(TRIGRAMS, EMBED, scale=0.1), "att_w": draw(2 * h, h, scale=0.3), "att_v": draw(h, scale=0.3), "out": draw(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": draw(e, 3 * h, scale=0.3), f"u{side}": draw(h, 3 * h, scale=0.3), f"c{side}": np.zeros(3 * h, np.float32)}
        self.slope, self.offset = 0.0, 0.0

    def embed(self, buckets: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Embeddings of distinct words; a row of zeros follows for padding."""
        out = np.zeros((len(buckets) + 1, 2 * EMBED), np.float32)
        if len(buckets):
            out[:-1, :EMBED] = self.p["word"][buckets]
            out[:-1, EMBED:] = np.add.reduceat(self.p["gram"][grams], np.cumsum(sizes) - sizes) / sizes[:, None]
        return out

    def _side(self, side: str, projected: np.ndarray, which: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction: (states, memory for the backward pass)."""
        h = np.zeros((which.shape[1], HIDDEN), np.float32)
        u, n = self.p[f"u{side}"], HIDDEN
        states, memory = np.empty((*which.shape, n), np.float32), []
        steps = range(len(which)) if side == "f" else range(len(which) - 1, -1, -1)
        for t in steps:
            x = projected[which[t]]
            g = h @ u
            gate = 0.5 * np.tanh(0.5 * (x[:, : 2 * n] + g[:, : 2 * n])) + 0.5
            z, r = gate[:, :n], gate[:, n:]
            c = np.tanh(x[:, 2 * n :] + r * g[:, 2 * n :])
            new = c + z * (h - c)
            if not mask[t].all():
                new = np.where(mask[t][:, None], new, h)
            if keep:
                memory.append((t, h, z, r, c, g[:, 2 * n :]))
            h = new
            states[t] = h
        return states, memory

    def logits(self, vectors: np.ndarray, which: np.ndarray, mask: np.ndarray, keep: bool = False):
        sides = {s: self._side(s, vectors @ self.p[f"x{s}"] + self.p[f"c{s}"], which, mask, keep) for s in "fb"}
        states = np.concatenate([sides["f"][0], sides["b"][0]], axis=2)
        hidden = np.tanh(states @ self.p["att_w"])
        weight = np.where(mask, hidden @ self.p["att_v"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight *= mask
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weight, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return logit, (sides, states, hidden, weight, pooled) if keep else None

    def gradients(self, vectors: np.ndarray, which: np.ndarray, mask: np.ndarray, cache, error: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters behind the embeddings, and of the embeddings of distinct words."""
        sides, states, hidden, weight, pooled = cache
        n, p = HIDDEN, self.p
        grad = {"out": pooled.T @ error, "bias": np.array([error.sum()], np.float32)}
        d_pooled = error[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = np.einsum("tbh,bh->tb", states, d_pooled)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_hidden = d_score[:, :, None] * p["att_v"] * (1 - hidden * hidden)
        grad["att_v"] = np.einsum("tbk,tb->k", hidden, d_score)
        grad["att_w"] = np.einsum("tbh,tbk->hk", states, d_hidden)
        d_states = d_states + d_hidden @ p["att_w"].T
        d_vectors = np.zeros_like(vectors)
        for k, s in enumerate("fb"):
            own = d_states[:, :, k * n : (k + 1) * n]
            u = p[f"u{s}"]
            d_projected = np.zeros((len(vectors), 3 * n), np.float32)
            d_u = np.zeros_like(u)
            carry = np.zeros((which.shape[1], n), np.float32)
            for t, h, z, r, c, gc in reversed(sides[s][1]):
                d = carry + own[t]
                live = mask[t][:, None]
                passed = np.where(live, 0, d)
                d = np.where(live, d, 0)
                dc = d * (1 - z) * (1 - c * c)
                dz = d * (h - c) * z * (1 - z)
                dr = dc * gc * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], axis=1)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                d_u += h.T @ dg
                np.add.at(d_projected, which[t], dx)
                carry = passed + d * z + dg @ u.T
            grad[f"u{s}"] = d_u
            grad[f"x{s}"] = vectors.T @ d_projected
            grad[f"c{s}"] = d_projected.sum(axis=0)
            d_vectors += d_projected @ p[f"x{s}"].T
        return grad, d_vectors[:-1]

    def window_logits(self, which, buckets, grams, sizes, start, length) -> np.ndarray:
        vectors = self.embed(buckets, grams, sizes)
        out = np.zeros(len(start), np.float32)
        for a in range(0, len(start), 4096):
            index, mask = self.frame(which, len(buckets), start[a : a + 4096], length[a : a + 4096])
            out[a : a + 4096] = self.logits(vectors, index, mask)[0]
        return out

    @staticmethod
    def frame(which, pad, start, length):
        step = np.arange(WINDOW)[:, None]
        mask = step < length[None, :]
        at = np.minimum(start[None, :] + step, max(len(which) - 1, 0))
        return np.where(mask, which[at], pad), mask

    def text_logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The worst window's logit of every text of a chunk."""
        which, buckets, grams, sizes, bounds = inputs(data, offsets)
        text, start, length = window_starts(bounds)
        out = np.full(len(offsets) - 1, -np.inf, np.float64)
        if len(text):
            np.maximum.at(out, text, self.window_logits(which, buckets, grams, sizes, start, length).astype(np.float64))
        return np.where(np.isinf(out), float(self.p["bias"][0]), out)


class _Adam:
    def __init__(self, params: dict):
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}
        self.t = 0

    def step(self, params: dict, grads: dict, rate: float) -> None:
        self.t += 1
        scale = rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            params[k] -= (scale * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)


def fit(rows: list[tuple[str, int]], seed: int = 7) -> Network:
    """Train on three quarters of the rows and calibrate on the others."""
    net = Network(seed)
    raw = [(t.encode(), y) for t, y in rows]
    part = {k: [r for i, r in enumerate(raw) if (i % 4 == 0) == k] for k in (False, True)}

    def chunk(some):
        return np.frombuffer(b"".join(t for t, _ in some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t, _ in some])]).astype(np.int64), np.array([y for _, y in some], np.int64)

    data, offsets, y = chunk(part[False])
    which, buckets, grams, sizes, bounds = inputs(data, offsets)
    text, start, length = window_starts(bounds)
    pools = [np.flatnonzero(y[text] == k) for k in (0, 1)]
    if all(len(p) for p in pools):
        rng, adam = np.random.default_rng(seed), _Adam(net.p)
        owner = np.repeat(np.arange(len(buckets)), sizes)
        truth = np.repeat([0, 1], BATCH // 2)
        for step in range(STEPS + WORST_STEPS):
            late = step - STEPS
            if late >= 0 and late % CHOOSE == 0:  # the worst window of each text, and as many others of clean texts
                by = np.lexsort((-net.window_logits(which, buckets, grams, sizes, start, length), text))
                worst = by[np.append(True, text[by][1:] != text[by][:-1])]
                bad = y[text[worst]] == 1
                clean = np.flatnonzero(y[text] == 0)
                pools = [np.concatenate([worst[~bad], rng.choice(clean, (~bad).sum())]), worst[bad]]
            own = np.concatenate([rng.choice(p, BATCH // 2) for p in pools])
            index, mask = net.frame(which, len(buckets), start[own], length[own])
            near, local = np.unique(index, return_inverse=True)
            real = near[near < len(buckets)]
            inside = np.flatnonzero(np.isin(owner, real))
            vectors = net.embed(buckets[real], grams[inside], sizes[real])
            local = local.reshape(index.shape)
            logit, cache = net.logits(vectors, local, mask, keep=True)
            error = ((sigmoid(logit) - truth) / BATCH).astype(np.float32)
            grad, d_vectors = net.gradients(vectors, local, mask, cache, error)
            grad["word"] = np.zeros_like(net.p["word"])
            np.add.at(grad["word"], buckets[real], d_vectors[:, :EMBED])
            grad["gram"] = np.zeros_like(net.p["gram"])
            np.add.at(grad["gram"], grams[inside], np.repeat(d_vectors[:, EMBED:] / sizes[real][:, None], sizes[real], axis=0))
            for k in ("word", "gram"):  # what single words alone could learn by heart fades
                net.p[k] *= 1 - DECAY
            adam.step(net.p, grad, RATE * (0.3 if late >= WORST_STEPS - 2 * CHOOSE else 1))
    data, offsets, y = chunk(part[True])
    if len(y):
        net.slope, net.offset = calibrate(net.text_logits(data, offsets), y)
    return net


def score_toxicity(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def run(batches):
        for rows, data, offsets in chunks(batches):
            score = sigmoid(net.slope * net.text_logits(data, offsets) + net.offset)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double, predicted int")


def drop_toxic(df: DataFrame, net: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df that are not predicted toxic."""
    schema = df.schema

    def run(batches):
        for rows, data, offsets in chunks(batches, text_col):
            keep = sigmoid(net.slope * net.text_logits(data, offsets) + net.offset) < threshold
            yield rows.filter(pa.array(keep))

    return map_batches(df, run, schema)


def trained(documents: DataFrame, labels: DataFrame) -> Network:
    return fit(sample(documents, labels, "toxic", FOLDS, FOLD, PER_CLASS, MAX_BYTES))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels outside the held-out fold and score every document."""
    scored = score_toxicity(documents, trained(documents, labels))
    return scored.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", "predicted")
