"""Written intermediate tables in the application's part of the folder that all executors share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from corpuslens.operators.staging import fresh_path, staged

__all__ = ["bounded_batches", "fresh_path", "stage"]

#: Bytes of an Arrow batch, beyond which it takes no more rows.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on Arrow batches end after ``BATCH_BYTES``, whatever their rows hold.

    Spark's own 64 MB stand in the executor and in its Python worker, for each core at once.
    The setting is read when a plan is run, so it stays; a lower one is left as it is.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(name).strip().lower()).groups()
    if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: lineage is cut, a lost
    executor costs no recomputation, and every later reader sees the same rows."""
    return staged(df, name)
