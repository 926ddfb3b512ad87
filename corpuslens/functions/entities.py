"""Named resources and marketing patterns in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.patterns import java_regex, required_text
from corpuslens.functions.sqltext import NO_STRINGS, quote
from corpuslens.lexicons import MARKETING_PATTERNS, entity_families


def required_words(patterns: list[str]) -> list[str]:
    """What to look for before running the patterns, in lower case."""
    return list(dict.fromkeys(required_text(p).lower() for p in patterns if required_text(p)))


def _candidate(present: str, pattern: str) -> str:
    """Whether the pattern's required text occurs; true if it has none."""
    text = required_text(pattern).lower()
    return f"array_contains({present}, {quote(text)})" if text else "true"


def entity_mentions(
    text: str,
    uppered: str,
    present: str,
    families: list[tuple[str, list[str], bool]] | None = None,
    numbered: bool = False,
) -> Column:
    """Array of ``(entity, category)``, by family, then pattern, then place in the text.

    Arguments name columns. The entity is the match in upper case. ``uppered`` is the
    text in upper case, ``present`` the required words that occur in it; a pattern
    is only run when its own is among them. ``numbered`` adds the number of the
    pattern that matched to each, which texts in pieces are sorted by.
    """
    parts = []
    families = families or entity_families()
    before = 0
    for category, patterns, in_upper in families:
        source = uppered if in_upper else text
        found = [
            f"case when {_candidate(present, p)} then "
            f"regexp_extract_all({source}, {quote(java_regex(p, not in_upper))}, 0) else {NO_STRINGS} end"
            for p in patterns
        ]
        shape = f"'entity', upper(m), 'category', {quote(category)}"
        if numbered:
            found = [
                f"transform({f}, m -> named_struct({shape}, 'pattern', {before + i}))" for i, f in enumerate(found)
            ]
        matches = f"flatten(array({', '.join(found)}))"
        parts.append(matches if numbered else f"transform({matches}, m -> named_struct({shape}))")
        before += len(patterns)
    mentions = f"concat({', '.join(parts)})"
    if all(required_text(p) for _, patterns, _ in families for p in patterns):
        number = ",pattern:int" if numbered else ""
        none = f"cast(array() as array<struct<entity:string,category:string{number}>>)"
        mentions = f"case when size({present}) > 0 then {mentions} else {none} end"
    return F.expr(mentions)


def pattern_tags(text: str, present: str, patterns: list[str] = MARKETING_PATTERNS) -> Column:
    """The patterns that occur in the named text, in list order, case ignored."""

    def hit(pattern: str) -> str:
        candidate = _candidate(present, pattern)
        return f"{candidate} and rlike({text}, {quote(java_regex(pattern, ignore_case=True))})"

    cases = ", ".join(f"case when {hit(p)} then {quote(p)} end" for p in patterns)
    return F.expr(f"array_compact(array({cases}))")
