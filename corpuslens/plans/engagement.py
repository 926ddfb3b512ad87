"""Engagement ranking and activity over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.operators.distribution import descending_order_stats, equal_width_histogram
from corpuslens.operators.ordering import thread_order
from corpuslens.operators.topk import number_rows
from corpuslens.plans.features import with_engagement


def engagement_top(threads: DataFrame, n: int = 300, texts: DataFrame | None = None) -> DataFrame:
    """The ``n`` threads with the most engagement, ranked.

    ``texts`` are the threads with their texts where ``threads`` holds keys and metrics
    alone: then only keys are ranked, and the ``n`` texts are fetched by key.
    """
    ranked = with_engagement(threads)
    shown = [c for c in ("snippet_200", "text_clean", "text_raw") if c in ranked.columns]
    keys = ranked.select(
        "ord_raw", "createdAt_ts", "thread_id", "createdAt_iso", "url", "metrics.*", "engagement", *shown
    )
    top = number_rows(keys, [F.col("engagement").desc(), *thread_order()], n)
    if texts is not None:
        # At most n rows.
        top = texts.select("ord_raw", "text_clean", "text_raw").join(F.broadcast(top), "ord_raw")
    snippet = F.col("snippet_200") if "snippet_200" in top.columns else tx.snippet(tx.post_text(), 200)
    return top.select(
        "rank", "thread_id", "createdAt_iso", "url", "reactionCount", "commentCount",
        "shareCount", snippet.alias("text_snippet"),
    )


def engagement_order_stats(threads: DataFrame) -> DataFrame:
    """``p90`` and ``p50`` of engagement: elements of the descending list."""
    return descending_order_stats(with_engagement(threads), "engagement", {"p90": 0.1, "p50": 0.5})


def reaction_histogram(threads: DataFrame, bins: int = 50) -> DataFrame:
    reactions = threads.select(
        F.coalesce("metrics.reactionCount", F.lit(0)).alias("reactions")
    )
    return equal_width_histogram(reactions, "reactions", bins)


def threads_per_month(threads: DataFrame) -> DataFrame:
    """``(month, n)`` in calendar order; threads without a readable date are left out."""
    return (
        threads.select(tx.month_key(F.col("createdAt_iso")).alias("month"))
        .where("month is not null")
        .groupBy("month")
        .agg(F.count("*").alias("n"))
        .orderBy("month")
    )


def top_months(threads: DataFrame, n: int = 5) -> DataFrame:
    """The busiest months; ties go to the newer month, which is seen first."""
    return threads_per_month(threads).orderBy(F.col("n").desc(), F.col("month").desc()).limit(n)
