"""What the texts say, extracted in one pass into a narrow table.

``thread_features`` reads each text once and keeps what the later tables need.
A pack build stages its result; a single query lets Catalyst drop the columns it
does not use, and with them their extraction.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens import lexicons
from corpuslens.functions import text as tx
from corpuslens.functions.entities import entity_mentions, pattern_tags, required_words
from corpuslens.functions.keywords import keyword_counts, present
from corpuslens.functions.money import money_mentions, money_mentions_each
from corpuslens.functions.patterns import fold_case, let
from corpuslens.functions.topics import topic_scores, topic_words
from corpuslens.functions.urls import links_sql
from corpuslens.operators.staging import computed_once


@dataclass(frozen=True)
class Lexicons:
    """The word lists of one run."""

    topics: dict[str, list[str]] = field(default_factory=lambda: lexicons.TOPICS)
    entities: list[tuple[str, list[str], bool]] = field(default_factory=lexicons.entity_families)
    marketing: list[str] = field(default_factory=lambda: lexicons.MARKETING_PATTERNS)
    money_patterns: list[str] = field(default_factory=lambda: lexicons.MONEY_PATTERNS)
    money_context: dict[str, list[str]] = field(default_factory=lambda: lexicons.MONEY_CONTEXT)


THREAD_KEYS = ["ord_raw", "createdAt_ts", "thread_id", "createdAt_iso", "url"]


FEATURES = [
    "comments_n", "snippet_200", "snippet_300", "links", "entities", "tags", "scores", "money",
    "comment_money",
]


def _comment_money(lex: Lexicons, context: bool) -> Column:
    """Per comment with a price: its id, time, url, snippet and mentions."""
    found = money_mentions_each(
        "_replies", patterns=lex.money_patterns, families=lex.money_context, with_context=context
    )

    def shaped(comment: Column, mentions: Column) -> Column:
        fields = [comment[name].alias(name) for name in ("comment_id", "createdAt_iso", "url")]
        clean = tx.clean_text(tx.first_text(comment["text_clean"], comment["text_raw"]))
        snippet = let(clean, lambda t: tx.cut(t, 200)).alias("text_snippet")
        return F.when(F.size(mentions) > 0, F.struct(*fields, snippet, mentions.alias("mentions")))

    return F.array_compact(F.zip_with("comments", found, shaped))


def thread_features(
    threads: DataFrame, lex: Lexicons | None = None, only: list[str] | None = None, context: bool = False,
    automaton: bool = False, keys: list[str] | None = None,
) -> DataFrame:
    """Thread keys plus, per thread: number of comments, snippets, canonical
    ``links``, ``entities``, marketing ``tags``, topic ``scores``, the post's and
    the comments' ``money``; or ``only`` some of these. ``context`` adds the words
    around each price to its mention, ``automaton`` is that of :func:`keyword_counts`,
    ``keys`` are other columns to keep, and ``numbered_entities`` can be asked for.

    Needs ``text_clean``, ``text_raw`` and ``comments``; passes on ``metrics``
    when present. Links, entities, tags and topics look at the full text (post
    and comments joined), so a match may span the seam.
    """
    lex = lex or Lexicons()
    texts = threads.withColumn("_post", tx.post_text()).withColumn("_full", tx.full_text())
    texts = texts.withColumns(
        {
            "_clean": tx.clean_text(F.col("_post")), "_post_lower": F.lower("_post"),
            "_lower": F.lower("_full"), "_upper": F.upper("_full"),
        }
    )
    # Comments without a digit name no price.
    def with_digit(comment: Column) -> Column:
        text = tx.first_text(comment["text_clean"], comment["text_raw"])
        return F.when(F.rlike(text, F.lit(r"\p{Nd}")), text)

    texts = texts.withColumn("_replies", F.transform("comments", with_digit))
    texts = texts.withColumn("_topic_words", keyword_counts(F.col("_lower"), topic_words(lex.topics), automaton))
    patterns = [p for _, family, _ in lex.entities for p in family] + lex.marketing
    texts = texts.withColumn(
        "_pattern_words",
        present(keyword_counts(fold_case(F.col("_full")), required_words(patterns), automaton)),
    )
    build = {
        "comments_n": lambda: F.size("comments"),
        "snippet_200": lambda: tx.cut(F.col("_clean"), 200),
        "snippet_300": lambda: tx.cut(F.col("_clean"), 300),
        "links": lambda: F.expr(links_sql("_full")),
        "entities": lambda: entity_mentions("_full", "_upper", "_pattern_words", lex.entities),
        "numbered_entities": lambda: entity_mentions(
            "_full", "_upper", "_pattern_words", lex.entities, numbered=True
        ),
        "tags": lambda: pattern_tags("_full", "_pattern_words", lex.marketing),
        "scores": lambda: topic_scores("_topic_words", lex.topics),
        "money": lambda: money_mentions(
            "_post", "_post_lower", patterns=lex.money_patterns, families=lex.money_context, with_context=context
        ),
        "comment_money": lambda: _comment_money(lex, context),
    }
    keep = (keys or THREAD_KEYS) + [c for c in ("metrics",) if c in threads.columns]
    return computed_once(texts, keep, **{name: build[name]() for name in only or FEATURES})


def with_engagement(frame: DataFrame) -> DataFrame:
    """Add ``engagement`` from ``metrics``."""
    return frame.withColumn(
        "engagement",
        tx.engagement(
            F.col("metrics.reactionCount"), F.col("metrics.commentCount"), F.col("metrics.shareCount")
        ),
    )
