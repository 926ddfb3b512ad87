"""Session settings that suit these jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "corpuslens", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and skew handling on, times in UTC.

    On a cluster leave ``master`` to spark-submit. With adaptive execution on,
    ``shuffle_partitions`` is the number before coalescing: choose it so that
    one partition of the largest shuffle stays near 200 MB.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    options = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        options["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
