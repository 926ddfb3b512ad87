"""Topic scores of a text: how often each topic's keywords occur in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.keywords import total_sql
from corpuslens.functions.sqltext import quote, strings
from corpuslens.lexicons import TOPICS


def topic_words(topics: dict[str, list[str]] = TOPICS) -> list[str]:
    """All keywords of a lexicon, as they are looked for."""
    return [k.lower() for keywords in topics.values() for k in keywords]


def topic_scores(counts: str, topics: dict[str, list[str]] = TOPICS) -> Column:
    """Array of ``(topic, topic_pos, score)`` for the topics with a hit, from the
    named column of counts of the topic words in the lower-cased text.

    Scoring happens inside the row: threads are neither multiplied by keywords nor
    shuffled to add the counts up.
    """
    lexicon = ", ".join(
        f"named_struct('topic', {quote(topic)}, 'topic_pos', {pos}, "
        f"'keywords', {strings([k.lower() for k in words])})"
        for pos, (topic, words) in enumerate(topics.items())
    )
    return F.expr(f"""
        case when size({counts}) > 0 then filter(
            transform(array({lexicon}), t -> named_struct(
                'topic', t.topic, 'topic_pos', t.topic_pos,
                'score', {total_sql(counts, 't.keywords')})),
            s -> s.score > 0)
        else cast(array() as array<struct<topic:string,topic_pos:int,score:bigint>>) end""")
