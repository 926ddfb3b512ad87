"""Topic index: the best threads of each topic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.lexicons import TOPICS
from corpuslens.operators.ordering import thread_order
from corpuslens.operators.topk import top_per_key
from corpuslens.plans.features import with_engagement


def lexicon_frame(spark: SparkSession, topics: dict[str, list[str]] = TOPICS) -> DataFrame:
    """The lexicon as rows ``(topic, topic_pos, keywords)``."""
    rows = [(topic, pos, keywords) for pos, (topic, keywords) in enumerate(topics.items())]
    return spark.createDataFrame(rows, "topic string, topic_pos int, keywords array<string>")


def topic_hits(features: DataFrame) -> DataFrame:
    """One row per thread and topic with a score above 0."""
    passed = [c for c in ("metrics", "engagement") if c in features.columns]
    return features.select(
        "ord_raw", "createdAt_ts", "thread_id", "url", *passed, F.explode("scores").alias("s")
    ).select("s.*", "ord_raw", "createdAt_ts", "thread_id", "url", *passed)


def topic_index(hits: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` best threads per topic by 0.7 x score + 0.3 x engagement.

    There are few topics and many threads, so each topic is cut in slices first.
    """
    scored = with_engagement(hits).withColumn(
        "rank_score", F.col("score") * F.lit(0.7) + F.col("engagement") * F.lit(0.3)
    )
    narrow = scored.select(
        "topic", "topic_pos", "rank_score", "createdAt_ts", "ord_raw", "thread_id", "url",
        "score", "engagement",
    )
    order = [F.col("rank_score").desc(), *thread_order()]
    return top_per_key(narrow, ["topic"], order, n, spread=32)


def topic_entries(index: DataFrame, topics: dict[str, list[str]] = TOPICS) -> DataFrame:
    """One row per lexicon topic with its keywords and ranked threads, topics
    without a hit included. At most ``n`` threads per topic are collected."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "thread_id", "url")))
    best = index.groupBy("topic").agg(ranked.alias("best"))
    none = F.array().cast("array<string>")
    return lexicon_frame(index.sparkSession, topics).join(best, "topic", "left").select(
        "topic", "topic_pos", "keywords",
        F.coalesce("best.thread_id", none).alias("top_thread_ids"),
        F.coalesce("best.url", none).alias("top_urls"),
    )


def topic_document(entries: DataFrame) -> DataFrame:
    """All entries as one nested record, topics in lexicon order."""
    entry = F.struct("keywords", "top_thread_ids", "top_urls")
    rows = F.array_sort(F.collect_list(F.struct("topic_pos", "topic", entry.alias("entry"))))
    return entries.agg(rows.alias("rows")).select(
        F.map_from_arrays(F.col("rows.topic"), F.col("rows.entry")).alias("topics")
    )
