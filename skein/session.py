"""Session factory and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "skein", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; ``conf`` keys use ``__`` for dots."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": os.environ.get("SKEIN_SHUFFLE", "8"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("SKEIN_MEMORY", "8g"),
    } | {k.replace("__", "."): v for k, v in conf.items()}
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Smaller Arrow batches, so that a batch of long texts stays small in a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
