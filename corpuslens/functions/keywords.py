"""Find many keywords in a text with one pass over it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.patterns import let
from corpuslens.functions.text import substring_count

COUNTS = "array<struct<kw:string,n:bigint>>"


def keyword_counts(text: Column, keywords: list[str], automaton: bool = False) -> Column:
    """Array of ``(kw, n)`` for the keywords that occur in the text, with how often
    they do without overlapping themselves. Keywords may lie within each other.

    Built-in functions by default. ``automaton`` takes an automaton in Arrow batches
    instead, which needs the library pyahocorasick on every executor. For the topic
    lexicon on four cores (12 MB of text) it took 1.2 s against 5.5 s.
    """
    keywords = list(dict.fromkeys(keywords))
    if "" in keywords:
        raise ValueError("a keyword may not be empty")
    if not keywords:
        return F.array().cast(COUNTS)
    return _by_automaton(keywords)(text) if automaton else _by_pattern(text, keywords)


def _by_automaton(keywords: list[str]):
    @F.pandas_udf(COUNTS)
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        finder = ahocorasick.Automaton()
        for keyword in keywords:
            finder.add_word(keyword, (keyword, len(keyword)))
        finder.make_automaton()

        def in_text(text: str | None) -> list[dict]:
            counts: dict[str, int] = {}
            ends: dict[str, int] = {}
            for end, (keyword, length) in finder.iter(text or ""):
                if end - length >= ends.get(keyword, -1):
                    ends[keyword] = end
                    counts[keyword] = counts.get(keyword, 0) + 1
            return [{"kw": k, "n": n} for k, n in counts.items()]

        for batch in batches:
            yield batch.map(in_text)

    return count


def _tree(keywords: list[str]) -> dict:
    root: dict = {}
    for keyword in keywords:
        node = root
        for char in keyword:
            node = node.setdefault(char, {})
        node[""] = {}
    return root


def _branches(node: dict) -> str:
    """Alternatives of a node, the longer ones first."""
    ways = [re.escape(char) + _branches(child) for char, child in node.items() if char]
    if not ways:
        return ""
    body = ways[0] if len(ways) == 1 and "" not in node else "(?:" + "|".join(ways) + ")"
    return body + "?" if "" in node else body


def keyword_regex(keywords: list[str]) -> str:
    """A pattern for the longest of the keywords at a place."""
    return _branches(_tree(keywords))


def _by_pattern(text: Column, keywords: list[str]) -> Column:
    """The same with built-in functions. One pattern, in which keywords share their
    beginnings, gives the longest keyword at each place; the shorter ones it begins
    with are there too. Keywords that can overlap themselves are counted apart."""
    regex = f"(?=({keyword_regex(keywords)}))"
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(1))
    beginnings = {k: [p for p in keywords if k.startswith(p)] for k in keywords}
    nested = {k: ps for k, ps in beginnings.items() if len(ps) > 1}
    apart = [k for k in keywords if any(k.endswith(k[:n]) for n in range(1, len(k)))]

    def present(hit: Column) -> Column:
        if not nested:
            return F.array(hit)
        entries = [
            e for k, ps in nested.items() for e in (F.lit(k), F.array(*[F.lit(p) for p in ps]))
        ]
        return F.coalesce(F.try_element_at(F.create_map(*entries), hit), F.array(hit))

    def count(found: Column) -> Column:
        words = F.array_distinct(F.flatten(F.transform(F.array_distinct(found), present)))
        alone = F.array(*[F.lit(k) for k in apart]).cast("array<string>")
        return F.transform(
            words,
            lambda k: F.struct(
                k.alias("kw"),
                F.when(F.array_contains(alone, k), substring_count(text, k))
                .otherwise(F.size(F.filter(found, lambda h: h.startswith(k))).cast("long"))
                .alias("n"),
            ),
        )

    return let(hits, lambda h: F.when(F.size(h) > 0, count(h)).otherwise(F.array().cast(COUNTS)))


def present(counts: Column) -> Column:
    """The keywords that occur."""
    return F.transform(counts, lambda c: c["kw"])


def total_sql(counts: str, keywords: str) -> str:
    """Sum of the counts of those keywords that are in ``keywords``."""
    return (
        f"aggregate(filter({counts}, c -> array_contains({keywords}, c.kw)), "
        f"cast(0 as bigint), (acc, c) -> acc + c.n)"
    )
