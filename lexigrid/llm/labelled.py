"""Bounded samples of labelled documents for fitting, and one-dimensional calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id's text falls on the held-out fold (a null id does not)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, per_class: int, max_bytes: int) -> list[tuple[str, int]]:
    """(text, label) of at most per_class documents of each class outside the held-out fold, whole texts.

    The documents are those of the smallest hashes of their ids, so the choice depends on
    neither order nor partitions.  Of each class they are taken in that order as long as
    their texts together have no more than max_bytes, which bounds what comes to the driver;
    a text for which there is no room is left out and not cut.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out("doc_id", folds, fold)).distinct()
    order = F.xxhash64("doc_id", F.lit(label))
    picked = known.where("y = 0").orderBy(order, "doc_id").limit(per_class).unionByName(known.where("y = 1").orderBy(order, "doc_id").limit(per_class))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(picked), "doc_id").withColumn("size", F.octet_length("text")).where(F.col("size") <= max_bytes).dropDuplicates(["doc_id", "y", "text"])
    # a window over the few picked documents of a class
    room = W.partitionBy("y").orderBy(order, "doc_id", "text").rowsBetween(W.unboundedPreceding, 0)
    rows = texts.withColumn("sum", F.sum("size").over(room)).where(F.col("sum") <= max_bytes).select("doc_id", "text", "y").collect()
    rows = sorted({(r.doc_id, r.text, r.y) for r in rows}, key=lambda r: (hash_of(r[0]), r))
    return [(text, y) for _, text, y in rows]


def hash_of(n: int) -> int:
    n = (n ^ (n >> 33)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
    return n ^ (n >> 29)


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, offset) of a logistic fit with equally weighted classes, by Newton steps; x is scaled inside."""
    scale = float(x.std()) or 1.0
    design = np.stack([x / scale, np.ones(len(x))], 1)
    n = np.bincount(y, minlength=2)
    if not n.all():
        return 0.0, float(6 * (n[1] > 0) - 3)
    weight = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - y)) + ridge * beta * [1, 0]
        hessian = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return float(beta[0] / scale), float(beta[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
