"""Arrow batches of few rows, for stages whose rows hold whole texts or sets: what a worker holds at once is then bounded by few rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Inside, actions pass at most ``rows`` rows to a Python worker at a time; the session's setting is restored."""
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(ROWS, before)
