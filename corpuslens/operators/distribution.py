"""Order statistics and histograms of an integer column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """``(value, n)``: how often each value occurs."""
    return df.groupBy(F.col(value).cast("long").alias("value")).agg(F.count("*").alias("n"))


def descending_order_stats(df: DataFrame, value: str, stats: dict[str, float]) -> DataFrame:
    """One row: for each name the element at ``int(count * share)`` of the list of
    values sorted from high to low. No interpolation; null when there are no rows.

    Values are counted first. The running sum over them is kept per bucket of
    similar size, plus the total of the buckets above, so no task sees all
    distinct values; 64-bit values have about a thousand buckets.
    """
    counts = value_counts(df.where(F.col(value).isNotNull()), value)
    magnitude = F.floor(F.log2(F.abs("value") + 1.0) * 8)
    counts = counts.withColumn("bucket", (F.signum("value") * magnitude).cast("int"))
    high_first = Window.orderBy(F.col("bucket").desc())
    buckets = (
        counts.groupBy("bucket")
        .agg(F.sum("n").alias("in_bucket"))
        .withColumn("through", F.sum("in_bucket").over(high_first))
        .withColumn("total", F.sum("in_bucket").over(Window.partitionBy()))
        .select("bucket", (F.col("through") - F.col("in_bucket")).alias("above"), "total")
    )
    within = Window.partitionBy("bucket").orderBy(F.col("value").desc())
    placed = counts.join(F.broadcast(buckets), "bucket").withColumn(
        "through", F.col("above") + F.sum("n").over(within)
    )
    return placed.agg(
        *[
            F.max(
                F.when(F.col("through") > F.floor(F.col("total") * F.lit(share)), F.col("value"))
            ).alias(name)
            for name, share in stats.items()
        ]
    )


def equal_width_histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """``(bin, bin_low, bin_high, n)`` for equal-width bins over [min, max], empty
    bins included, the last one closed. One distinct value gets a range of width 1
    around it. No rows when there are no values."""
    counts = value_counts(df.where(F.col(value).isNotNull()), value)
    bounds = counts.agg(
        F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high")
    ).where("low is not null")
    half = F.when(F.col("low") == F.col("high"), F.lit(0.5)).otherwise(F.lit(0.0))
    bounds = bounds.select((F.col("low") - half).alias("low"), (F.col("high") + half).alias("high"))
    low = bounds.select("low").scalar()
    high = bounds.select("high").scalar()

    ranged = counts.withColumn("low", low).withColumn("high", high)
    ranged = ranged.withColumn("step", (F.col("high") - F.col("low")) / bins)
    guess = F.least(F.floor((F.col("value") - F.col("low")) / F.col("step")), F.lit(bins - 1))
    # The quotient can round across an edge; the edge itself decides.
    at = F.col("guess")
    low_edge = F.col("low") + at * F.col("step")
    high_edge = F.col("low") + (at + 1) * F.col("step")
    placed = ranged.withColumn("guess", guess).withColumn(
        "bin",
        F.when(F.col("value") < low_edge, at - 1)
        .when((F.col("value") >= high_edge) & (at < bins - 1), at + 1)
        .otherwise(at),
    )
    filled = placed.groupBy((F.col("bin") + 1).cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    edges = bounds.select(
        "low", ((F.col("high") - F.col("low")) / bins).alias("step"),
        F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"),
    )
    return edges.join(filled, "bin", "left").select(
        "bin",
        (F.col("low") + (F.col("bin") - 1) * F.col("step")).alias("bin_low"),
        (F.col("low") + F.col("bin") * F.col("step")).alias("bin_high"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
    )
