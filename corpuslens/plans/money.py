"""Price mentions in posts and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.functions.money import money_count, money_mentions
from corpuslens.operators.staging import computed_once

_OUT = [
    "source_type", "thread_id", "comment_id", "createdAt_iso", "url", "pattern_pos",
    "matched_text", "amount_values", "context_tags", "text_snippet",
    "ord_raw", "createdAt_ts", "place",
]


def money_mentions_table(features: DataFrame) -> DataFrame:
    """One row per mention, posts and comments together. No shuffle.

    Features without ``comment_money`` give the posts' mentions alone; ``context_snippet``
    is passed on when they have it. ``place`` orders the mentions of one thread: post first (comment number -1),
    then comments, each by pattern and place in the text.
    """

    context = "context_snippet" in features.schema["money"].dataType.elementType.names
    more = ["context_snippet"] if context else []

    source = F.struct(
        F.lit("").alias("comment_id"), "createdAt_iso", "url", F.col("snippet_200").alias("text_snippet"),
        F.col("money").alias("mentions"),
    )
    sources = F.array(source)
    if "comment_money" in features.columns:
        sources = F.concat(sources, F.coalesce("comment_money", F.array()))
    # No functions on arrays: Spark compiles what explodes them.
    each = features.select("thread_id", "ord_raw", "createdAt_ts", F.posexplode(sources).alias("at", "s"))
    found = each.select(
        "thread_id", "ord_raw", "createdAt_ts", "at", "s.*"
    ).select("*", F.posexplode("mentions").alias("match_at", "m"))
    place = F.struct((F.col("at") - 1).alias("comment"), F.col("match_at"))
    kind = F.when(F.col("at") == 0, F.lit("thread")).otherwise(F.lit("comment"))
    return found.select(
        kind.alias("source_type"), "thread_id", "comment_id", "createdAt_iso", "url", "m.*", "text_snippet",
        "ord_raw", "createdAt_ts", place.alias("place"),
    ).select(*_OUT, *more)


def comment_mentions(comments: DataFrame, threads: DataFrame) -> DataFrame:
    """Mentions of a flat table of cleaned comments, as rows of
    :func:`money_mentions_table`. They are extracted first; the join for thread id
    and order then moves comments with mentions, one row each, not texts. A comment whose
    thread is absent keeps its mentions, without a thread id."""
    texts = comments.withColumn("_text", tx.post_text())
    texts = texts.withColumn("_lower", F.lower("_text"))
    found = computed_once(
        texts, ["ord_raw", "comment_id", "createdAt_iso", "url", "idx"],
        text_snippet=tx.snippet(F.col("_text"), 200),
        mentions=money_mentions("_text", "_lower"),
    ).where(F.size("mentions") > 0)
    keys = threads.select("ord_raw", "createdAt_ts", "thread_id")
    rows = found.join(keys, "ord_raw", "left").select("*", F.posexplode("mentions").alias("match_at", "m"))
    place = F.struct(F.col("idx").cast("int").alias("comment"), F.col("match_at"))
    return rows.select(
        F.lit("comment").alias("source_type"), "thread_id", "comment_id", "createdAt_iso", "url",
        "m.*", "text_snippet", "ord_raw", "createdAt_ts", place.alias("place"),
    ).select(*_OUT)


def mention_total(texts: DataFrame, name: str = "money_mentions") -> DataFrame:
    """One row: the mentions in a frame of posts or of flat comments, counted in place."""
    read = texts.withColumn("_text", tx.post_text()).withColumn("_lower", F.lower("_text"))
    return read.agg(F.coalesce(F.sum(money_count("_text", "_lower")), F.lit(0)).alias(name))


def money_per_month(features: DataFrame) -> DataFrame:
    """``(month, n)``: mentions in posts, by the thread's month. Comments do not count."""
    return (
        features.select(
            tx.month_key(F.col("createdAt_iso")).alias("month"),
            F.coalesce(F.size("money"), F.lit(0)).alias("k"),
        )
        .where("month is not null")
        .groupBy("month")
        .agg(F.sum("k").alias("n"))
        .where("n > 0")
        .orderBy("month")
    )
