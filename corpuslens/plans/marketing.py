"""Threads worth mining for marketing copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.ordering import thread_order
from corpuslens.plans.features import with_engagement


def is_candidate(min_patterns: int = 2, min_engagement: int = 20) -> Column:
    """Enough patterns or enough engagement."""
    return (F.size("tags") >= min_patterns) | (F.col("engagement") >= min_engagement)


def marketing_candidates(
    features: DataFrame, min_patterns: int = 2, min_engagement: int = 20
) -> DataFrame:
    """Threads with enough patterns or enough engagement. ``score`` is the number
    of patterns plus a tenth of the engagement; only the first five tags are kept."""
    scored = with_engagement(features).withColumn("marketing_score", F.size("tags"))
    return scored.where(is_candidate(min_patterns, min_engagement)).select(
        F.lit("thread").alias("source_type"), "thread_id", F.lit("").alias("comment_id"),
        "createdAt_iso", "url", "engagement", F.slice("tags", 1, 5).alias("tags_triggered"),
        F.col("snippet_300").alias("text_snippet"),
        (F.col("marketing_score") + F.col("engagement") * F.lit(0.1)).alias("score"),
        "ord_raw", "createdAt_ts",
    )


def marketing_top(candidates: DataFrame, n: int = 500) -> DataFrame:
    return candidates.orderBy(F.col("score").desc(), *thread_order()).limit(n)
