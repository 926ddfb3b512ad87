"""Raw posts to threads, comments and cleaning statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as tx


def _or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def _or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast("long")


def comment_struct(comment: Column, thread: Column, index: Column) -> Column:
    """Cleaned comment from a raw one and its place among the thread's comments."""
    return F.struct(
        tx.comment_id(comment["url"], thread, index).alias("comment_id"),
        thread.alias("thread_id"),
        tx.iso_time(comment["createdAt"]).alias("createdAt_iso"),
        _or_empty(comment["url"]).alias("url"),
        _or_empty(comment["author"]["name"]).alias("author_name"),
        _or_empty(comment["text"]).alias("text_raw"),
        tx.clean_text(comment["text"]).alias("text_clean"),
    )


def _thread_id() -> Column:
    return tx.thread_id(_or_empty(F.col("url")), _or_zero(F.col("createdAt")))


def newest_first(posts: DataFrame) -> DataFrame:
    """Raw posts in thread order. Cleaned behind it, a text is moved once, not in both forms."""
    return posts.orderBy(_or_zero(F.col("createdAt")).desc(), F.col("ord_raw").asc())


def comments_in_order(posts: DataFrame) -> DataFrame:
    """One row per cleaned comment of raw posts, by post and place, as :func:`flatten_comments`
    of the threads. Raw comments are sorted and cleaned behind that."""
    raw = posts.select("ord_raw", _thread_id().alias("thread_id"), F.posexplode("topComments").alias("idx", "c"))
    shaped = raw.orderBy("ord_raw", "idx").select(
        "ord_raw", "idx", comment_struct(F.col("c"), F.col("thread_id"), F.col("idx")).alias("c")
    )
    return shaped.select("c.*", "ord_raw", "idx")


def clean_threads(posts: DataFrame) -> DataFrame:
    """Raw posts (with ``ord_raw``) to threads with their comments inside.

    A projection: no shuffle. Sort by :func:`thread_order` when writing files
    that must be newest first.
    """
    with_id = posts.withColumn("thread_id", _thread_id())
    comments = F.coalesce(
        F.transform(
            "topComments", lambda c, i: comment_struct(c, F.col("thread_id"), i)
        ),
        F.array(),
    )
    return with_id.select(
        "thread_id",
        tx.iso_time(F.col("createdAt")).alias("createdAt_iso"),
        _or_zero(F.col("createdAt")).alias("createdAt_ts"),
        _or_empty(F.col("url")).alias("url"),
        _or_empty(F.col("user.name")).alias("author_name"),
        _or_empty(F.col("user.url")).alias("author_url"),
        _or_empty(F.col("text")).alias("text_raw"),
        tx.clean_text(F.col("text")).alias("text_clean"),
        F.struct(
            *[_or_zero(F.col(n)).alias(n) for n in ("reactionCount", "shareCount", "commentCount")]
        ).alias("metrics"),
        comments.alias("comments"),
        _or_empty(F.col("groupId")).alias("groupId"),
        "ord_raw",
    )


def flatten_comments(threads: DataFrame) -> DataFrame:
    """One row per comment, with its place; threads without comments have none."""
    return threads.select("ord_raw", F.posexplode("comments").alias("idx", "c")).select(
        "c.*", "ord_raw", "idx"
    )


def clean_flat_comments(comments: DataFrame, threads: DataFrame) -> DataFrame:
    """Cleaned comments from a flat raw table ``(ord_raw, idx, url, createdAt,
    text, author)``, joined to their threads for the id. Only ids cross the join
    from the thread side. A comment whose thread is absent stays, without a thread id."""
    ids = threads.select("ord_raw", "thread_id")
    raw = F.struct("url", "createdAt", "text", "author")
    shaped = comments.join(ids, "ord_raw", "left").select(
        "ord_raw", "idx", comment_struct(raw, F.col("thread_id"), F.col("idx")).alias("c")
    )
    return shaped.select("c.*", "ord_raw", "idx")


def cleaning_stats(threads: DataFrame) -> DataFrame:
    """One row of totals over the cleaned threads. Counts the comments inside them,
    or adds up ``comments_n`` where comments are kept in their own table."""
    comments = F.col("comments_n") if "comments_n" in threads.columns else F.size("comments")
    return threads.agg(
        F.count("*").alias("threads_count"),
        F.coalesce(F.sum(comments), F.lit(0)).alias("comments_count"),
        F.min("createdAt_iso").alias("date_min"),
        F.max("createdAt_iso").alias("date_max"),
        *[
            F.coalesce(F.sum(f"metrics.{field}"), F.lit(0)).alias(f"total_{name}")
            for field, name in (
                ("reactionCount", "reactions"), ("commentCount", "comments"),
                ("shareCount", "shares"),
            )
        ],
    )
