"""Amounts of money in text, with the words around them."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.patterns import java_regex, keeps_off, required_text
from corpuslens.functions.sqltext import quote
from corpuslens.lexicons import MONEY_CONTEXT, MONEY_PATTERNS
from corpuslens.sources.arrays import byte_slices


@cache
def _other_digits() -> str:
    """Decimal digits outside ASCII, in code point order: each script's 0 to 9."""
    return "".join(
        chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Nd"
    )


def _number(value: str) -> str:
    """Number in a matched group; digits of any script count as digits."""
    other = _other_digits()
    ascii_digits = "0123456789" * (len(other) // 10)
    return f"try_cast(translate({value}, {quote(other)}, {quote(ascii_digits)}) as double)"


#: Stands between texts that are searched as one, where patterns keep off it.
_MARK = "\0"
#: Bytes of text searched as one.
_AT_ONCE = 1 << 20
_FLOAT = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?[dDfF]?")
_FIELDS = {
    "pattern_pos": "int", "matched_text": "string", "amount_values": "array<double>",
    "context_tags": "array<string>", "context_snippet": "string",
}


@cache
def _to_ascii() -> dict[int, str]:
    return {ord(c): str(i % 10) for i, c in enumerate(_other_digits())}


def _numbers(values: list[str | None]) -> np.ndarray:
    """The groups as numbers, digits of any script; NaN for what is none."""
    try:
        found = pc.cast(pa.array(values, pa.string()), pa.float64())
    except pa.ArrowInvalid:
        plain = [(v or "").translate(_to_ascii()).strip() for v in values]
        found = pa.array([float(v.rstrip("dDfF")) if _FLOAT.fullmatch(v) else None for v in plain], pa.float64())
    return found.to_numpy(zero_copy_only=False)


class _Texts:
    """Strings joined by marks: their starts there, and which string a place is in."""

    def __init__(self, strings: list[str]):
        self.joined = _MARK.join(strings)
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.lengths + 1) - self.lengths - 1

    def holder(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


def _matches(lowered: list[str], pattern: str) -> tuple[np.ndarray, np.ndarray, list[re.Match]]:
    """Text, offset there and match of each match of one pattern, in order."""
    needed, search = required_text(pattern), re.compile(pattern).finditer
    among = [i for i, low in enumerate(lowered) if needed in low]
    if keeps_off(pattern, _MARK):
        texts = _Texts([lowered[i] for i in among])
        found = list(search(texts.joined))
        at = np.array([m.start() for m in found], np.int64)
        of = texts.holder(at) if among else at
        return np.array(among, np.int64)[of], at - texts.starts[of], found
    found = [(i, m) for i in among for m in search(lowered[i])]
    return np.array([i for i, _ in found], np.int64), np.array([m.start() for _, m in found], np.int64), [m for _, m in found]


def _in_windows(texts: _Texts, lefts: np.ndarray, rights: np.ndarray, families: dict[str, list[str]]) -> np.ndarray:
    """Which families have a word in which window of the joined texts. Windows that overlap
    are searched as one piece."""
    order = np.argsort(lefts, kind="stable")
    far = np.maximum.accumulate(rights[order])
    new = np.append(True, lefts[order][1:] > far[:-1])
    first = np.flatnonzero(new)
    begins, ends = lefts[order][first], far[np.append(first[1:], len(order)) - 1]
    pieces = _Texts([texts.joined[a:b] for a, b in zip(begins.tolist(), ends.tolist())])
    moved = np.empty(len(order), np.int64)
    moved[order] = (pieces.starts - begins)[np.cumsum(new) - 1]
    lefts, rights = lefts + moved, rights + moved
    holds = np.zeros((len(order), len(families)), bool)
    for family, words in enumerate(families.values()):
        for word in words:
            places, at = [], pieces.joined.find(word)
            while at >= 0:
                places.append(at)
                at = pieces.joined.find(word, at + 1)
            if places:
                places = np.array(places, np.int64)
                next_one = np.searchsorted(places, lefts)
                here = places[np.minimum(next_one, len(places) - 1)]
                holds[:, family] |= (next_one < len(places)) & (here + len(word) <= rights)
    return holds


def _cut(context: str) -> str:
    clean = " ".join(context.split())
    return clean if len(clean) <= 100 else clean[:97] + "..."


def _mentions_in(
    texts: list[str], lowered: list[str], window: int, patterns: list[str], families: dict[str, list[str]],
    with_context: bool,
) -> tuple[np.ndarray, pa.StructArray]:
    """The text and the struct of each mention, by text, pattern and place."""
    rows, starts, lengths, numbers, words, priced, values = [], [], [], [], [], [], []
    for number, pattern in enumerate(patterns, 1):
        groups = re.compile(pattern).groups
        row, start, found = _matches(lowered, pattern) if groups else ([], [], [])
        if not len(found):
            continue
        amounts = _numbers([v for m in found for v in m.groups()]).reshape(-1, groups)
        fits = (amounts >= 1) & (amounts <= 9999)
        kept = np.flatnonzero(fits.any(axis=1))
        words += [found[i].group() for i in kept.tolist()]
        rows.append(row[kept])
        starts.append(start[kept])
        numbers.append(np.full(len(kept), number, np.int32))
        priced.append(fits[kept].sum(axis=1))
        values.append(amounts[kept][fits[kept]])
    if not words:
        return np.zeros(0, np.int64), pa.array([], _mention(with_context))
    row, start, number, count = (np.concatenate(parts) for parts in (rows, starts, numbers, priced))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    wide = np.fromiter(map(len, texts), np.int64, len(texts))
    left = np.maximum(start - window, 0)
    right = np.maximum(np.minimum(start + lengths + window, wide[row]), left)

    # Lower-casing part of a text gives that part of the lower-cased text, unless it changes
    # the length or has an ending of its own.
    together = _Texts(lowered)
    shifted = together.lengths != wide
    if any("Σ" in text for text in texts):
        shifted |= np.array(["Σ" in text for text in texts])
    alone = shifted[row]
    holds = np.zeros((len(row), len(families)), bool)
    if not alone.all():
        base = together.starts[row[~alone]]
        holds[~alone] = _in_windows(together, base + left[~alone], base + right[~alone], families)
    for i in np.flatnonzero(alone).tolist():
        near = texts[row[i]][left[i]:right[i]].lower()
        holds[i] = [any(word in near for word in family) for family in families.values()]

    def lists(sizes: np.ndarray, flat: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat)

    tags = pa.array(list(families), pa.string()).take(pa.array(np.nonzero(holds)[1]))
    columns = [
        pa.array(number), pa.array(words, pa.string()), lists(count, pa.array(np.concatenate(values))),
        lists(holds.sum(axis=1), tags),
    ]
    if with_context:
        cuts = zip(row.tolist(), left.tolist(), right.tolist())
        columns.append(pa.array([_cut(texts[i][a:b]) for i, a, b in cuts], pa.string()))
    order = np.argsort(row, kind="stable")
    return row[order], pa.StructArray.from_arrays(columns, fields=list(_mention(with_context))).take(pa.array(order))


def _mention(with_context: bool) -> pa.StructType:
    kinds = [pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.string()), pa.string()]
    return pa.struct(list(zip(_FIELDS, kinds))[: 5 if with_context else 4])


def _search(texts: pa.Array, lowered: pa.Array | None, **options) -> pa.Array:
    """An array of mentions for each text of a batch, null where it is null."""
    known = texts.is_valid() if lowered is None else pc.and_(texts.is_valid(), lowered.is_valid())
    texts, lowered = texts.filter(known), lowered.filter(known) if lowered is not None else None
    counts, parts = [np.zeros(0, np.int64)], [pa.array([], _mention(options["with_context"]))]
    for low, high in byte_slices(texts, _AT_ONCE):
        part = _strings(texts, low, high)
        row, mentions = _mentions_in(
            part, [t.lower() for t in part] if lowered is None else _strings(lowered, low, high), **options
        )
        counts.append(np.bincount(row, minlength=high - low))
        parts.append(mentions)
    sizes = np.zeros(len(known), np.int64)
    sizes[known.to_numpy(zero_copy_only=False)] = np.concatenate(counts)
    return _lists(sizes, pa.concat_arrays(parts), pc.invert(known))


def _strings(column: pa.Array, low: int, high: int) -> list[str]:
    return column.slice(low, high - low).to_numpy(zero_copy_only=False).tolist()


def _lists(sizes: np.ndarray, flat: pa.Array, null: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat, mask=null)


def _searcher(
    nested: bool, window: int = 50, patterns: list[str] = MONEY_PATTERNS,
    families: dict[str, list[str]] = MONEY_CONTEXT, with_context: bool = False,
):
    """The search as a function of texts and their lower-cased forms, or of arrays of texts."""
    options = {"window": window, "patterns": patterns, "families": families, "with_context": with_context}
    fields = [f"{name}: {kind}" for name, kind in _FIELDS.items()][: 5 if with_context else 4]
    kind = f"array<struct<{', '.join(fields)}>>"

    def search(texts: pa.Array, lowered: pa.Array) -> pa.Array:
        return _search(texts, lowered, **options)

    def search_each(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
        return _lists(sizes, _search(texts.flatten(), None, **options), texts.is_null())

    return F.arrow_udf(search_each, f"array<{kind}>") if nested else F.arrow_udf(search, kind)


def money_count(text: str, lowered: str, patterns: list[str] = MONEY_PATTERNS) -> Column:
    """How many mentions :func:`money_mentions` gives; neither places nor words around
    are looked at. 0 for a null text."""
    counts = []
    for pattern in patterns:
        regex, needed = quote(java_regex(pattern)), required_text(pattern)
        values = [_number(f"regexp_extract(m, {regex}, {g})") for g in range(1, re.compile(pattern).groups + 1)]
        priced = " or ".join(f"coalesce({v} between 1 and 9999, false)" for v in values)
        count = f"size(filter(regexp_extract_all({lowered}, {regex}, 0), m -> {priced}))"
        counts.append(f"case when contains({lowered}, {quote(needed)}) then {count} else 0 end" if needed else count)
    total = " + ".join(counts) or "0"
    return F.expr(f"cast(case when rlike({text}, {quote(r'\p{Nd}')}) then {total} else 0 end as bigint)")


def money_mentions(text: str, lowered: str, **options) -> Column:
    """One struct per match: pattern number, matched text, amounts, context tags,
    and the cleaned context if asked for. Patterns overlap, so one amount can give
    several structs.

    ``text`` and ``lowered`` name the column and its lower-cased form. Amounts
    outside 1..9999 are dropped, and a match left without any is too. Offsets come
    from the lower-cased text, the context from the text as written. Null when the
    text holds no digit. Options are ``window``, ``patterns``, ``families`` and
    ``with_context``. Texts are searched in Arrow batches, many short ones as one.
    """
    # Every amount needs a digit; texts without one skip all of this.
    priced = F.rlike(F.col(text), F.lit(r"\p{Nd}"))
    return _searcher(False, **options)(F.when(priced, F.col(text)), F.when(priced, F.col(lowered)))


def money_mentions_each(texts: str, **options) -> Column:
    """:func:`money_mentions` of each text of an array; a null text has null."""
    return _searcher(True, **options)(F.col(texts))
