"""Corpus totals: the report's numbers and the summary of a pack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.operators.distribution import descending_order_stats
from corpuslens.plans.features import with_engagement


def side_by_side(frames: list[DataFrame]) -> DataFrame:
    """One-row frames with different columns as one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _mean(total: Column, rows: Column) -> Column:
    return F.when(rows > 0, total / rows).otherwise(F.lit(0.0))


def thread_totals(threads: DataFrame) -> DataFrame:
    """One row: counts, dates, totals and means over the threads. Needs ``metrics``
    and ``comments_n``; means and totals of an empty corpus are 0, its dates null."""
    rows = F.count("*")
    reactions = F.coalesce(F.sum("metrics.reactionCount"), F.lit(0))
    comments = F.coalesce(F.sum("metrics.commentCount"), F.lit(0))
    return threads.agg(
        rows.alias("threads"),
        F.coalesce(F.sum("comments_n"), F.lit(0)).alias("comments_in_data"),
        tx.day_key(F.min("createdAt_iso")).alias("date_min"),
        tx.day_key(F.max("createdAt_iso")).alias("date_max"),
        reactions.alias("total_reactions"),
        comments.alias("total_comments"),
        _mean(reactions, rows).alias("avg_reactions"),
        _mean(comments, rows).alias("avg_comments"),
    )


def counts(**tables: DataFrame | int) -> DataFrame:
    """One row with how many rows each table has. A number is taken as it is: what a write
    has observed need not be read again."""
    known = {name: n for name, n in tables.items() if isinstance(n, int)}
    frames = {name: t for name, t in tables.items() if name not in known}
    spark = next((t.sparkSession for t in frames.values()), None) or SparkSession.active()
    first = spark.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in known.items()])
    counted = [t.agg(F.count("*").alias(name)) for name, t in frames.items()]
    return side_by_side(([first] if known else []) + counted).select(*tables)


def corpus_report(threads: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row with every number of the report; its top months and top domains are
    ``engagement.top_months`` and ``links.domains_by_unique_url``. ``sizes`` is one row:
    ``money_mentions``, ``unique_urls``, ``unique_entities``, ``marketing_candidates``."""
    stats = descending_order_stats(
        with_engagement(threads), "engagement", {"p90": 0.1, "p50": 0.5}
    )
    counted = stats.select(F.coalesce("p90", F.lit(0)).alias("p90"), F.coalesce("p50", F.lit(0)).alias("p50"))
    return side_by_side([thread_totals(threads), counted, sizes])


def pack_counts(threads: DataFrame | int, sizes: DataFrame, topics: int) -> DataFrame:
    """One row of counts to check a finished pack by. ``sizes`` as in :func:`corpus_report`."""
    return side_by_side([counts(threads=threads), sizes]).withColumn("topics", F.lit(topics).cast("long"))
