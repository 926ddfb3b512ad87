"""How the sources of a language differ in their words, from counts of a translate-table tokenizer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.staging import stage

#: Letters are A to Z, lowered, a to z and every byte of a character beyond ASCII; all else is blank.
LETTERS = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of a text that are split at once, and terms that a task holds before it sends them on.
PIECE, HELD = 1 << 22, 200_000
SCALE = 1_000_000_000


def term_counts(text: bytes) -> Counter:
    """How often each term of a UTF-8 text occurs: one pass of the table, then one split a piece."""
    blanked, counts, at = text.translate(LETTERS), Counter(), 0
    while len(blanked) - at > PIECE:
        cut = blanked.find(b" ", at + PIECE)
        if cut < 0:
            break
        counts.update(blanked[at:cut].split())
        at = cut
    counts.update(blanked[at:].split())
    return counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), added up as far as a task can hold it."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def sums():
        for (lang, source), (n, docs) in held.items():
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()),
                    pa.array(list(n), pa.binary()).cast(pa.string()),
                    pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        groups = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()))
        for lang, source, text in groups:
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            counts = term_counts(text.as_py())
            n.update(counts)
            docs.update(counts.keys())
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield from sums()
            held.clear()
    yield from sums()


def _div(a: Column, b: Column) -> Column:
    """Whole division, null for a divisor of zero."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def _share(count: Column | str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exactly; null without terms."""
    count = F.col(count) if isinstance(count, str) else count
    above = (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return _div(above, (F.col(total) + 2 * F.col(terms)).cast("decimal(20,0)")) + 1


def _distance(p: Column | str, q: Column | str) -> Column:
    """floor((p - q) ** 2 / (p + q))."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return _div((p - q) * (p - q), p + q)


def kept_terms(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """The terms of each language that ``least`` of its documents hold, and its groups.

    (lang, term, total, held: occurrences by source) and (lang, source, g, seen, terms_seen,
    terms, lang_seen): a group's number, its occurrences and distinct kept terms, and how
    many kept terms and occurrences of them the language has. Both are written tables.
    """
    named = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = named.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    sums = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = F.collect_list(F.struct("source", "n")).alias("held")  # at most one entry a source
    terms = sums.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), held)
    terms = stage(terms.where(F.col("docs") >= least).drop("docs"), "terms")
    seen = terms.select("lang", F.inline("held")).groupBy("lang", "source").agg(F.sum("n").alias("seen"), F.count("n").alias("terms_seen"))
    langs = terms.groupBy("lang").agg(F.count("term").alias("terms"), F.sum("total").alias("lang_seen"))
    groups = named.select("lang", "source").distinct().join(seen, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["seen", "terms_seen", "terms", "lang_seen"]).withColumn("g", F.monotonically_increasing_id())
    return terms, stage(groups, "groups")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, value): for two groups the sum over the terms of both of what their distance
    differs from the distances at a count of zero, added up over the task's terms."""

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    total: dict[tuple[int, int], int] = {}
    for batch in batches:
        held = batch.column(0)
        g, p, zero = (held.values.field(i).to_numpy() for i in range(3))
        offsets = held.offsets.to_numpy()
        row = np.repeat(np.arange(len(held)), np.diff(offsets))
        g, p, zero = (x[offsets[0] : offsets[-1]] for x in (g, p, zero))
        for step in range(1, int(np.diff(offsets).max(initial=0))):
            i = np.flatnonzero(row[:-step] == row[step:])
            j = i + step
            swap = g[i] > g[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            value = f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j])
            order = np.lexsort((g[j], g[i]))
            a, b = g[i][order], g[j][order]
            new = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0))))
            for x, y, v in zip(a[new].tolist(), b[new].tolist(), np.add.reduceat(value[order], new).tolist()):
                total[x, y] = total.get((x, y), 0) + v
    a, b, v = (pa.array([r[k] for r in ((*key, n) for key, n in total.items())], pa.int64()) for k in range(3))
    yield pa.RecordBatch.from_arrays([a, b, v], names=["a", "b", "value"])


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(g, other, value) of every ordered pair of groups of a language.

    Most terms are in few groups, so their distances are taken as if a count were zero,
    from a group's histogram of counts, and only terms that both groups hold are met:
    sum f(p, q) = sum over a's terms f(p, q0) + sum over b's terms f(p0, q)
    + (V - |a| - |b|) f(p0, q0) + sum over shared terms of what that is wrong by.
    """
    zero = groups.select("lang", F.col("g").alias("other"), _share(F.lit(0), "seen", "terms").alias("q0"), F.col("terms_seen").alias("other_terms"))
    shares = rows.groupBy("lang", "g", "p").agg(F.count(F.lit(1)).alias("times"))
    apart = F.col("g") != F.col("other")
    half = shares.join(zero, "lang").where(apart).groupBy("g", "other").agg(F.sum(F.col("times") * _distance("p", "q0")).alias("value"))
    rest = groups.join(zero, "lang").where(apart).select(
        "g", "other",
        ((F.col("terms") - F.col("terms_seen") - F.col("other_terms")) * F.coalesce(_distance(_share(F.lit(0), "seen", "terms"), F.col("q0")), F.lit(0))).alias("value"),
    )
    lists = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("g", "p", "p0")).alias("held")).where(F.size("held") > 1)
    both = lists.select("held").mapInArrow(_shared, "g long, other long, value long")
    parts = rest
    for part in (half, both):
        parts = parts.union(part).union(part.select(F.col("other").alias("g"), F.col("g").alias("other"), "value"))
    return parts.groupBy("g", "other").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """How far the sources of each language are apart in their words, and by which words.

    Columns: lang, source, part, item, value, rank. Terms are runs of ASCII letters and
    characters beyond ASCII, A to Z lowered; a language keeps those that ``least`` of its
    documents hold. A group's smoothed share of a term is p = 1 + floor(10^9 (count + 2) /
    (N + 2 V)), N being its occurrences of kept terms and V their number; two shares are
    floor((p - q)^2 / (p + q)) apart, all in whole numbers. Part ``pair`` has for every
    other source of the language the sum over all kept terms (0 without any), largest
    first; part ``term`` the ``top`` terms that the group has and has more of than its
    language. Ties follow the item's bytes.

    Null texts, languages and sources count as empty, and the empty language and source are
    groups as others; repeated rows and ids count again; very long texts are split in
    pieces, never cut; an empty table gives no rows; other columns are not read, whatever
    their names. Counts are added up in each task before they are shuffled, as lists of one
    entry a source for each term; of pairs only sums leave a task.
    """
    terms, groups = kept_terms(docs, least)
    flat = terms.select("lang", "term", "total", F.inline("held")).join(groups, ["lang", "source"])
    rows = flat.select(
        "lang", "source", "g", "term", _share("n", "seen", "terms").alias("p"), _share(F.lit(0), "seen", "terms").alias("p0"),
        _share("total", "lang_seen", "terms").alias("q"),
    )
    order = [F.desc("value"), "item"]
    best = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _distance("p", "q").alias("value"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    names = groups.select("g", "lang", "source")
    pairs = _pairs(rows, groups).join(names, "g").join(names.select(F.col("g").alias("other"), F.col("source").alias("item")), "other")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)))
    return pairs.unionByName(best)
