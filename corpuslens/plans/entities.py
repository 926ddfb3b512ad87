"""Named resources: credentials, course providers, software."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.ordering import order_key
from corpuslens.operators.topk import top_per_key

SAMPLE = 5


def entity_occurrences(features: DataFrame) -> DataFrame:
    """One row per match of an entity in a thread. Features may be those of pieces; then
    places are by pattern, piece and place in it, which is the order of the whole text's."""
    in_pieces = "piece" in features.columns
    rows = features.select(
        "ord_raw", "createdAt_ts", "thread_id", F.col("url").alias("thread_url"),
        *(["piece", F.posexplode("numbered_entities").alias("at", "e")] if in_pieces
          else [F.posexplode("entities").alias("at", "e")]),
    )
    place = ["e.pattern", "piece", "at"] if in_pieces else ["at"]
    return rows.select(
        "e.entity", "e.category", "thread_id", "thread_url",
        order_key(*map(F.col, place)).alias("seen_at"),
    )


def entities_rollup(occurrences: DataFrame) -> DataFrame:
    """Per entity: mentions, category of the last mention, first five threads
    (repeats kept), distinct threads among those five, and over all mentions.

    Counts are added up before the shuffle. A single entity may hold most of all
    mentions, so its samples are cut in slices first.
    """
    counts = occurrences.groupBy("entity").agg(
        F.count("*").alias("count_mentions"),
        F.max_by("category", "seen_at").alias("category"),
        F.min("seen_at").alias("first_at"),
        F.count_distinct("thread_id").alias("doc_count_all"),
    )
    samples = (
        top_per_key(
            occurrences.select("entity", "thread_id", "thread_url", "seen_at"),
            ["entity"], [F.col("seen_at")], SAMPLE, spread=32,
        )
        .groupBy("entity")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "thread_id", "thread_url"))).alias("s"))
    )
    return counts.join(samples, "entity").select(
        "entity", "category", "count_mentions",
        F.size(F.array_distinct("s.thread_id")).alias("doc_count_threads"),
        "doc_count_all",
        F.col("s.thread_id").alias("sample_thread_ids"),
        F.col("s.thread_url").alias("sample_urls"),
        "first_at",
    )
