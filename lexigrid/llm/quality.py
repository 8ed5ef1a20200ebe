"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text.  Every block of
a text is compressed with either; the difference of the sizes over their sum is the feature, and a
logistic fit on labelled texts that the dictionaries have not seen turns it into a score.

Defined results: null and empty texts score what a feature of 0 scores; repeated rows score
alike; a null id keeps its row and is not held out; without labels of both classes the score
is constant; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import calibrate, held_out, sample, sigmoid
from .textkit import chunks, map_batches

#: Labelled documents of each class that are read at most, and bytes of their whole texts together.
PER_CLASS = 1500
MAX_BYTES = 8 << 20
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
#: Texts are compressed in blocks, so that long ones depend on the dictionaries as short ones do.
BLOCK = 2048
THRESHOLD = 0.3
FOLDS, FOLD = 5, 0


class Model:
    def __init__(self, good: bytes, bad: bytes, slope: float = 0.0, offset: float = 0.0):
        self.good, self.bad, self.slope, self.offset = good, bad, slope, offset
        self._coders = None

    def __getstate__(self):
        return self.good, self.bad, self.slope, self.offset

    def __setstate__(self, state):
        self.__init__(*state)

    def feature(self, text: bytes) -> float:
        if self._coders is None:
            self._coders = []
            for raw in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(raw)
                known.precompute_compress(level=LEVEL)
                self._coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False))
        if not text:
            return 0.0
        blocks = [text[a : a + BLOCK] for a in range(0, len(text), BLOCK)]
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self._coders)
        return (bad - good) / (bad + good)

    def score(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * features + self.offset)


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, blocks of the texts in the order of a
    checksum, as many as a dictionary holds."""
    pieces = [t[a : a + BLOCK] for t in texts for a in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        size, kept = 0, []
        for piece in sorted(pieces, key=zlib.crc32):
            size += len(piece)
            if size > DICTIONARY_BYTES:
                break
            kept.append(piece)
        return b"".join(kept) or b"\n" * 8


def fit(rows: list[tuple[str, int]]) -> Model:
    """Dictionaries from two thirds of the rows, calibration from the others."""
    raw = [(t.encode(), y) for t, y in rows if t]
    build = [r for i, r in enumerate(raw) if i % 3]
    rest = [r for i, r in enumerate(raw) if not i % 3]
    model = Model(*(dictionary([t for t, y in build if y == label]) for label in (1, 0)))
    if rest:
        x = np.array([model.feature(t) for t, _ in rest])
        model.slope, model.offset = calibrate(x, np.array([y for _, y in rest]))
    return model


def score_quality(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted of every row."""

    def run(batches):
        for rows, data, offsets in chunks(batches):
            raw, at = data.tobytes(), offsets.tolist()
            score = model.score(np.array([model.feature(raw[a:b]) for a, b in zip(at, at[1:])]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double, predicted int")


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labels outside the held-out fold and score every document."""
    model = fit(sample(documents, labels, "quality", FOLDS, FOLD, PER_CLASS, MAX_BYTES))
    scored = score_quality(documents, model)
    return scored.select("doc_id", held_out("doc_id", FOLDS, FOLD).alias("held_out"), "score", "predicted")
