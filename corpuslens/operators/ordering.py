"""Thread order: newest first, ties in the order of the dump."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators.staging import staged


def thread_order() -> list[Column]:
    return [F.col("createdAt_ts").desc(), F.col("ord_raw").asc()]


def order_key(*more: Column) -> Column:
    """Thread order as one struct that sorts ascending; ``more`` orders rows
    within a thread."""
    return F.struct(
        (-F.col("createdAt_ts")).alias("newest"), F.col("ord_raw").alias("ord_raw"),
        *[c.alias(f"in_thread_{i}") for i, c in enumerate(more)],
    )


def nth_in_group(keys: DataFrame, group: str, order: str, number: str) -> DataFrame:
    """Number the rows of each ``group`` from 1 by ``order``, which differs in every row.

    For narrow frames. Rows are dealt by ranges of the order, ranked in their range, and
    running counts of the ranges before are added, so a group that holds most rows is no
    single task's work. Ranges are fixed by writing them, for counts and ranks to agree.
    """
    ranged = staged(
        keys.select(group, order).repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranged"
    )
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ranged.groupBy(group, "_range").agg(F.count("*").alias("_n")).select(
        F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_earlier")
    )
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of"))
    return (
        ranged.withColumn("_nth", inside).join(earlier, same)
        .select(group, order, (F.col("_earlier") + F.col("_nth")).alias(number))
    )
