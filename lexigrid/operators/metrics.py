"""Nested timers and statistics of a run, as measurement rows."""

from __future__ import annotations

import time
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


class Metrics:
    """``with m.measure("build"): ...`` nests; times and statistics become rows."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        self.path: list[str] = []
        self.times: list[tuple[str, float]] = []
        self.stats: list[tuple[str, float]] = []

    @contextmanager
    def measure(self, name: str):
        self.path.append(name)
        key, began = "/".join(self.path), time.perf_counter()
        try:
            yield
        finally:
            self.times.append((key, (time.perf_counter() - began) * 1000))
            self.path.pop()

    def add(self, key: str, value: float) -> None:
        self.stats.append((key, float(value)))

    def rows(self, spark: SparkSession) -> DataFrame:
        """type, key, value: times in ms sorted by key, then statistics."""
        rows = [("time", *t) for t in sorted(self.times)] + [("statistic", *s) for s in self.stats]
        return spark.createDataFrame(rows, "type string, key string, value double")


def lowess(df: DataFrame, group: str, x: str, y: str, share: float = 2 / 3) -> DataFrame:
    """group, x, smooth: local linear regression with tri-cube weights on each group's mean per x (a bounded curve)."""
    from pyspark.sql import functions as F

    points = df.groupBy(group, F.col(x).cast("double").alias("x")).agg(F.avg(y).alias("y"))

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("x")
        xs, ys = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        k = max(2, min(len(xs), int(np.ceil(share * len(xs)))))
        out = []
        for x0 in xs:
            d = np.abs(xs - x0)
            w = np.clip(1 - (d / max(np.sort(d)[k - 1], 1e-12)) ** 3, 0, None) ** 3 + 1e-12
            mx, my = np.average(xs, weights=w), np.average(ys, weights=w)
            slope = np.average((xs - mx) * (ys - my), weights=w) / max(np.average((xs - mx) ** 2, weights=w), 1e-12)
            out.append(my + slope * (x0 - mx))
        return pd.DataFrame({group: pdf[group], "x": xs, "smooth": out})

    return points.groupBy(group).applyInPandas(smooth, f"{group} string, x double, smooth double")
