"""Intermediate tables, and bounds of what goes to Python workers."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..shared import fresh_path, shared_dir, written

__all__ = ["fresh_path", "limit_arrow_batches", "shared_dir", "written"]


def limit_arrow_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts don't pile up in a Python worker.

    The limits are the same for all operators, so it doesn't matter which one's plan was built last.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
