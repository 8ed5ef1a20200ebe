"""Where tables that are kept between jobs go."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="lexigrid-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; on one machine, where none is named, in an own one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own_dir()
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
