"""All reports of a measurement log, written below a folder named after the time of the run."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import SparkSession

from .analytics import REPORTS, report_sql


def write_reports(spark: SparkSession, sf_dir: str, out_dir: str, names: list[str] | None = None) -> tuple[str, list[str]]:
    """(folder, failures): each report as Parquet with its SQL beside it; one that fails is named and the others go on."""
    path = f"{out_dir.rstrip('/')}/{datetime.now().strftime('%Y_%m_%d_%H_%M_%S_%f')}"
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("events")
    failed, texts = [], {}
    for name in names or list(REPORTS):
        try:
            texts[name] = report_sql(name)
            spark.sql(texts[name]).write.parquet(f"{path}/{name}")
        except Exception as error:  # noqa: BLE001  the other reports are still wanted
            failed.append(f"{name}: {str(error).splitlines()[0]}")
    spark.createDataFrame([(json.dumps(texts),)], "value string").write.text(f"{path}/sql")
    return path, failed
