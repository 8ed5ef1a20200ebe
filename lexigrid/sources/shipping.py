"""Make this package importable in Python workers that do not share the driver's search path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand the package to the executors once per application, unless PYTHONPATH already has it."""
    if ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    path = os.path.join(tempfile.mkdtemp(), "lexigrid.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(os.path.join(ROOT, "lexigrid")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
