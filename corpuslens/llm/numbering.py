"""Gapless numbers within few large groups, without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.staging import stage


def number_within(df: DataFrame, group: str, order: list[str], number: str, buckets: int | None = None) -> DataFrame:
    """Add ``number``: 0, 1, 2, ... over the rows of each ``group`` value.

    Every group is dealt over ``buckets`` buckets (shuffle partitions by default), rows
    are ranked inside a bucket, and a running sum over the bucket counts gives each
    bucket its first number. A group with a third of all rows, or one row repeated that
    often, is thus spread over all tasks. The bucket of a row is fixed when the narrow
    frame is written, so that counting and ranking see the same rows even if executors
    are lost in between. Null groups are a group of their own; ties in ``order`` get
    different numbers.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    rows = stage(df.withColumn("_bucket", dealt).withColumn("_group", F.coalesce(F.col(group).cast("string"), F.lit(""))), "numbered")
    counts = rows.groupBy("_group", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_group").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_group", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_group", "_bucket").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return (
        rows.withColumn("_rank", F.row_number().over(inside).cast("long") - 1)
        .join(first, ["_group", "_bucket"])
        .withColumn(number, F.col("_first") + F.col("_rank"))
        .drop("_group", "_bucket", "_rank", "_first")
    )
