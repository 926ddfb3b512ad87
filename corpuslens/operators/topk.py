"""First rows per key, without gathering a key's rows in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    rank: str = "rank",
    spread: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of each key in the given order, numbered from 1.

    Spark cuts every map partition to ``n`` rows per key before the shuffle
    (``WindowGroupLimit``), so a hot key sends little. With few, very hot keys
    and many partitions even that adds up in one task: ``spread`` first cuts
    within that many slices of each key, then across them. The slice is the map
    partition's, so the cut before the shuffle stays as sharp. The result does
    not depend on it.
    """
    if spread:
        sliced = df.withColumn("_slice", F.pmod(F.spark_partition_id(), F.lit(spread)))
        within = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (
            sliced.withColumn("_n", F.row_number().over(within))
            .where(F.col("_n") <= n)
            .drop("_n", "_slice")
        )
    across = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(across)).where(F.col(rank) <= n)


def number_rows(df: DataFrame, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of the whole frame, numbered from 1.

    The limit runs first, so the single-partition window sees ``n`` rows.
    """
    return df.orderBy(*order).limit(n).withColumn(
        rank, F.row_number().over(Window.orderBy(*order))
    )
