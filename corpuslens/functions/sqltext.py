"""Pieces of Spark SQL text. Long expressions are written as SQL: one call parses
them, where building them column by column takes thousands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_STRINGS = "cast(array() as array<string>)"


def quote(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values: list[str]) -> str:
    """An array literal of strings."""
    return f"cast(array({', '.join(map(quote, values))}) as array<string>)"


def string_array(values: list[str]) -> Column:
    return F.expr(strings(values))


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"
