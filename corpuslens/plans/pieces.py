"""Links, entities, tags and topics of threads whose comments are a flat table.

No row holds a post with all its comments. The full text is read in pieces that no match
lies across, so a thread of millions of comments is many rows of common size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.keywords import keyword_regex
from corpuslens.functions.patterns import java_regex, reach
from corpuslens.functions.sqltext import string_array
from corpuslens.functions.text import post_text
from corpuslens.functions.topics import topic_words
from corpuslens.operators.seams import Look, pieces
from corpuslens.plans.features import THREAD_KEYS, Lexicons, thread_features

PIECE_FEATURES = ["links", "numbered_entities", "tags", "scores"]


def looks(lex: Lexicons) -> list[Look]:
    """What of the word lists can match over a seam. URLs hold no white space."""
    found = [
        Look(java_regex(p, not in_upper), "upper" if in_upper else "", reach(p))
        for _, patterns, in_upper in lex.entities for p in patterns if reach(p)
    ]
    found += [Look(java_regex(p, True), "", reach(p)) for p in lex.marketing if reach(p)]
    spaced = [k for k in dict.fromkeys(topic_words(lex.topics)) if any(c.isspace() for c in k)]
    if spaced:
        found.append(Look(keyword_regex(spaced), "lower", max(map(len, spaced))))
    return found


def full_text_pieces(
    threads: DataFrame, comments: DataFrame, lex: Lexicons | None = None, per_block: int = 32
) -> DataFrame:
    """``(ord_raw, piece, text)``: the full texts (post, then comments by ``idx``) in pieces.

    ``comments`` is the flat cleaned table; those without a thread form pieces of their own.
    """
    return pieces(
        threads.select("ord_raw", post_text().alias("text")),
        comments.select("ord_raw", "idx", post_text().alias("text")),
        "ord_raw", "idx", looks(lex or Lexicons()), per_block,
    )


def piece_features(
    threads: DataFrame, comments: DataFrame, lex: Lexicons | None = None, only: list[str] | None = None,
    per_block: int = 32,
) -> DataFrame:
    """Per piece of a thread's full text: thread keys, ``piece`` and what is found in it, as
    :func:`thread_features` finds it in the whole text. Only narrow rows meet the threads."""
    lex = lex or Lexicons()
    found = thread_features(
        full_text_pieces(threads, comments, lex, per_block).select(
            "ord_raw", "piece", F.col("text").alias("text_clean"), F.lit(None).cast("string").alias("text_raw"),
            F.expr("cast(array() as array<struct<text_clean:string,text_raw:string>>)").alias("comments"),
        ),
        lex, only=only or PIECE_FEATURES, keys=["ord_raw", "piece"],
    )
    return found.where(" or ".join(f"size({c}) > 0" for c in only or PIECE_FEATURES)).join(
        threads.select(*THREAD_KEYS), "ord_raw"
    )


def topic_hits(features: DataFrame) -> DataFrame:
    """One row per thread and topic with a score above 0, added up over the pieces."""
    rows = features.select("ord_raw", "createdAt_ts", "thread_id", "url", F.explode("scores").alias("s"))
    return rows.groupBy(
        "s.topic", "s.topic_pos", "ord_raw", "createdAt_ts", "thread_id", "url"
    ).agg(F.sum("s.score").alias("score"))


def thread_tags(features: DataFrame, lex: Lexicons | None = None) -> DataFrame:
    """``(ord_raw, tags)`` of the threads with a marketing pattern in any piece, in list order.
    A thread has no more tags than the list has patterns."""
    each = features.select("ord_raw", F.explode("tags").alias("tag")).distinct()
    found = each.groupBy("ord_raw").agg(F.collect_list("tag").alias("found"))
    listed = string_array((lex or Lexicons()).marketing)
    return found.select(
        "ord_raw", F.filter(listed, lambda p: F.array_contains("found", p)).alias("tags")
    )
