"""Class-based bigram model (Brown et al., 1992) with distributed exchange clustering."""

from __future__ import annotations

import logging
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.staging import bounded_batches, stage
from corpuslens.llm.words import hashed_words, parts, slices

#: Discount of rare words' counts; what it frees goes to unknown words of the same ending.
DISCOUNT = 0.5
#: Added for each ending, so that one that never occurred has a probability.
FLOOR = 0.1
SLICE_WORDS = 300_000
#: Words of a task that are counted together before the shuffle.
GATHERED_WORDS = 1 << 21
#: Rows, or entries of their lists, that a task gives to Spark at once.
BATCH_ROWS = 1 << 17
#: Steps of a natural logarithm; sums of whole steps are the same in any order.
STEPS = 1 << 12


@dataclass
class Vocabulary:
    """What tasks need of the vocabulary; bounded by the two sizes, whatever the corpus.

    ``frequent`` are the hashes of the most frequent words, ascending, with their counts
    and units; a unit is one of the ``heads`` most frequent words, or for other words one
    of ``endings`` endings. The last unit is the end of a text.
    """

    frequent: np.ndarray
    counts: np.ndarray
    units: np.ndarray  # -1: by its ending
    heads: int
    endings: int
    texts: int  # training texts
    tokens: int  # training tokens with ends
    types: int  # distinct training tokens with the end
    unit_counts: np.ndarray
    unit_types: np.ndarray

    @property
    def end(self) -> int:
        return self.heads + self.endings

    @cached_property
    def _index(self) -> pd.Index:
        return pd.Index(self.frequent)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Place of each word among the frequent, -1 if it is none of them."""
        return self._index.get_indexer(words)


def _words(column: pa.Array, endings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found: list[np.ndarray] = []
    words, places = hashed_words(column, fold=True, endings=found)
    ends = np.concatenate(found) if found else np.empty(0, np.uint64)
    return words.view(np.int64), places, (ends % np.uint64(endings)).astype(np.int32)


def _gathered(columns: Iterable[tuple[np.ndarray, ...]], most: int = GATHERED_WORDS) -> Iterator[list[np.ndarray]]:
    """The columns of several slices in a row, ``most`` words or one slice at once."""
    held, size = [], 0
    for some in columns:
        held.append(some)
        size += len(some[0])
        if size >= most:
            yield [np.concatenate(x) for x in zip(*held)]
            held, size = [], 0
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def _grouped(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal words stand together, and where each begins there, with the end."""
    order = np.argsort(words)
    sorted_ = words[order]
    return order, np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(words)]))


def _rows(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The columns in batches of ``BATCH_ROWS``."""
    for lo in range(0, len(columns[0]), BATCH_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + BATCH_ROWS]) for x in columns], names=names)


def word_counts(texts: DataFrame, endings: int) -> DataFrame:
    """(word, ending, n) of all words of all texts; counted in each task before the shuffle."""

    def found(batches):
        for batch in parts(batches, 0):
            words, _, ends = _words(batch.column(0), endings)
            if len(words):
                order, starts = _grouped(words)
                first = order[starts[:-1]]
                yield words[first], ends[first], np.diff(starts)

    def run(batches):
        # Each word of a slice is one entry by now, with a count beside it.
        for words, ends, n in _gathered(found(batches), GATHERED_WORDS // 2):
            order, starts = _grouped(words)
            first = order[starts[:-1]]
            yield from _rows(["word", "ending", "n"], words[first], ends[first], np.add.reduceat(n[order], starts[:-1]))

    rows = texts.mapInArrow(run, "word long, ending int, n long")
    return rows.groupBy("word").agg(F.first("ending").alias("ending"), F.sum("n").alias("n"))


def frequent_words(counted: DataFrame, most: int):
    """At most ``most`` words with the largest counts, as pandas rows (word, ending, n).

    A histogram of the counts, a few thousand rows at any size, says from which count on
    there are few enough; only those words leave the executors.
    """
    level = F.floor(F.log2("n") * 64).cast("int")
    held, cut = 0, None
    for row in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += row["count"]
        if held > most:
            break
        cut = row["level"]
    chosen = counted.where("false") if cut is None else counted.where(level >= cut)
    return chosen.toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def vocabulary(counted: DataFrame, texts: int, heads: int, endings: int, frequent: int) -> Vocabulary:
    top = frequent_words(counted, max(heads, frequent))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    hashes, counts = top["word"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
    units = np.where(np.arange(len(top)) < heads, np.arange(len(top)), -1)
    unit_counts, unit_types = np.zeros(heads + endings + 1), np.zeros(heads + endings + 1)
    unit_counts[: min(heads, len(top))] = counts[:heads]
    for ending, n, kinds in counted.groupBy("ending").agg(F.sum("n"), F.count(F.lit(1))).collect():
        unit_counts[heads + ending], unit_types[heads + ending] = n, kinds
    for ending, n in zip(top["ending"][:heads], counts[:heads]):  # the heads stand for themselves
        unit_counts[heads + ending] -= n
        unit_types[heads + ending] -= 1
    unit_counts[-1] = texts
    order = np.argsort(hashes)
    return Vocabulary(
        hashes[order], counts[order], units[order].astype(np.int32), heads, endings, texts,
        int(total[0]) + texts, int(total[1]) + (texts > 0), unit_counts, unit_types,
    )


def _of_found(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values at the places that ``Vocabulary.find`` gave, -1 for words that are none of the frequent."""
    return np.append(values, -1)[at].astype(np.int64)


def _units(vocab: Vocabulary, at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    unit = _of_found(vocab.units, at)
    return np.where(unit >= 0, unit, vocab.heads + ends)


def _with_ends(values: np.ndarray, places: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of all texts with ``end`` after each, and where each text's end stands."""
    at = places[1:] - places[0] + np.arange(len(places) - 1)
    out = np.full(len(values) + len(at), end, dtype=np.int64)
    out[np.delete(np.arange(len(out)), at)] = values
    return out, at


def unit_bigrams(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(left, right, n) of neighbouring units; a text follows and precedes the end unit."""
    size = vocab.end + 1

    def found(batches):
        for batch in parts(batches, 0):
            words, places, ends = _words(batch.column(0), vocab.endings)
            for lo, hi in slices(places, SLICE_WORDS):
                a, b = places[lo], places[hi]
                seq, _ = _with_ends(_units(vocab, vocab.find(words[a:b]), ends[a:b]), places[lo : hi + 1], vocab.end)
                left = np.concatenate(([vocab.end], seq[:-1]))
                yield (left * size + seq,)

    def run(batches):
        for (codes,) in _gathered(found(batches)):
            codes, n = np.unique(codes, return_counts=True)
            yield from _rows(["a", "b", "n"], (codes // size).astype(np.int32), (codes % size).astype(np.int32), n)

    return texts.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------- clustering


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def move_gains(table: np.ndarray, own: int, right: np.ndarray, left: np.ndarray, loop: float) -> np.ndarray:
    """Change of the clustering's log likelihood for a unit put into each class.

    ``table`` counts class bigrams; ``right`` and ``left`` count the unit's neighbours by
    class (both with ``loop``, the unit next to itself).
    """
    rest = table.copy()
    rest[own] -= right
    rest[:, own] -= left
    rest[own, own] += loop
    right, left = right.copy(), left.copy()
    right[own] -= loop
    left[own] -= loop
    rows, columns = rest.sum(axis=1) + left, rest.sum(axis=0) + right
    gain = (_f(rest + right) - _f(rest)).sum(axis=1) + (_f(rest + left[:, None]) - _f(rest)).sum(axis=0)
    corner = np.diag(rest)
    gain += _f(corner + right + left + loop) - _f(corner + right) - _f(corner + left) + _f(corner)
    gain -= _f(rows + right.sum() + loop) - _f(rows) + _f(columns + left.sum() + loop) - _f(columns)
    return gain


def exchange(bigrams: DataFrame, units: int, classes: int, sweeps: int | None, counts: np.ndarray) -> np.ndarray:
    """Class of each unit.

    Units start in turn by frequency. In each sweep the tasks, each with some of the
    units and their neighbours, find the class that raises the likelihood most for half
    of the units, another half each time. Moves made together may spoil each other, so
    all of them, the better half, quarter and so on down to the best alone are tried, and
    those that raise the likelihood most are made; the best alone always raises it. Only
    the classes and their bigram tables go back and forth. It ends when no unit wants to
    move, or after ``sweeps``; then the log says how many still do.
    """
    spark = bigrams.sparkSession
    sides = bigrams.select(F.col("a").alias("unit"), F.lit(True).alias("after"), F.col("b").alias("other"), "n").union(
        bigrams.select(F.col("b").alias("unit"), F.lit(False).alias("after"), F.col("a").alias("other"), "n")
    )
    near = stage(
        sides.groupBy("unit").agg(F.collect_list(F.struct("after", "other", "n")).alias("near")).repartition("unit"), "neighbours"
    )
    order = np.argsort(-counts, kind="stable")
    of = np.empty(units, np.int64)
    of[order] = np.arange(units) % classes

    def by_class(near_units, of):
        """Neighbour counts by class of each unit of a batch."""
        for unit, flat in near_units:
            after, other, n = flat
            right = np.bincount(of[other[after]], n[after], classes)
            left = np.bincount(of[other[~after]], n[~after], classes)
            yield unit, right, left, float(n[after & (other == unit)].sum())

    def read(batch):
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy()
        after, other, n = (lists.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        for i, unit in enumerate(batch.column(0).to_pylist()):
            part = slice(offsets[i], offsets[i + 1])
            yield unit, (after[part], other[part], n[part])

    def class_tables(trials):
        """Class bigrams under each of several assignments."""

        def run(batches):
            total = np.zeros((len(trials), classes, classes), np.int64)
            for batch in batches:
                for unit, (after, other, n) in read(batch):
                    other, n = other[after], n[after]
                    for k, of in enumerate(trials):
                        total[k, of[unit]] += np.bincount(of[other], n, classes).astype(np.int64)
            there = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total.ravel()[there])], names=["cell", "n"])

        out = np.zeros(len(trials) * classes * classes)
        cells = near.mapInArrow(run, "cell long, n long").toArrow()  # units and tables bound it
        np.add.at(out, cells.column(0).to_numpy(), cells.column(1).to_numpy())
        return out.reshape(len(trials), classes, classes)

    def likelihood(table):
        return _f(table).sum() - _f(table.sum(axis=0)).sum() - _f(table.sum(axis=1)).sum()

    def wanted_moves(of, table, turn):
        """(gain, unit, class) of the units of a half that gain by a move, the best first."""
        least = 1e-12 * abs(likelihood(table))  # below it is rounding

        def run(batches):
            for batch in batches:
                rows = []
                for unit, right, left, loop in by_class(((u, x) for u, x in read(batch) if (u + turn) % 2), of):
                    gains = move_gains(table, int(of[unit]), right, left, loop)
                    target = int(gains.argmax())
                    if gains[target] - gains[of[unit]] > least:
                        rows.append((float(gains[target] - gains[of[unit]]), unit, target))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.float64(), pa.int32(), pa.int32()))],
                    names=["gain", "unit", "class"],
                )

        rows = near.mapInArrow(run, "gain double, unit int, class int").collect()  # one small row a unit at most
        return sorted(rows, key=lambda r: (-r["gain"], r["unit"]))

    (table,) = class_tables([of])
    turn = settled = 0
    while settled < 2 and (sweeps is None or turn < sweeps):
        wanted = wanted_moves(of, table, turn)
        turn += 1
        trials, share = [], len(wanted)
        while share:
            trials.append(of.copy())
            for _, unit, target in wanted[:share]:
                trials[-1][unit] = target
            share //= 2
        tables = class_tables(trials) if trials else []
        best = max(range(len(trials)), key=lambda k: likelihood(tables[k]), default=None)
        if best is not None and likelihood(tables[best]) > likelihood(table):
            of, table, settled = trials[best], tables[best], 0
        else:
            settled += 1
    if settled < 2:
        left = sum(len(wanted_moves(of, table, k)) for k in (0, 1))
        logging.getLogger(__name__).warning("exchange ended after %d sweeps, %d of %d units still gain by a move", turn, left, units)
    return of


# ---------------------------------------------------------------------- scoring


@dataclass
class Brown:
    vocab: Vocabulary
    classes: np.ndarray  # of each unit
    own: np.ndarray  # class of each of the frequent words
    transition: np.ndarray  # log10 P(class | class before)
    totals: np.ndarray  # mass of each class
    counted: DataFrame  # (word, ending, n, class) of the training texts
    rare: DataFrame  # (word, n, class) of the words that are none of the frequent


def fit(
    texts: DataFrame, heads: int = 2047, endings: int = 1024, classes: int = 64, sweeps: int | None = None, frequent: int = 131_072,
    prior: float = 5.0,
) -> Brown:
    """Learn from the one text column of ``texts``.

    All words are counted and each has its own count and class. First units are clustered:
    the ``heads`` most frequent words, and the others joined by one of ``endings`` hashed
    word endings; without ``sweeps`` this goes on until no unit gains by a move. Then every
    other word, however rare, is put into the class that its own neighbours make likeliest
    (``own_classes``). Class bigrams and masses are those of all words' own classes. ``prior``
    is the weight of the class frequencies in a transition.
    """
    bounded_batches(texts.sparkSession)
    counted = stage(word_counts(texts, endings), "words")
    vocab = vocabulary(counted, texts.count(), heads, endings, frequent)
    bigrams = stage(unit_bigrams(texts, vocab), "bigrams")
    of = exchange(bigrams, vocab.end + 1, classes, sweeps, vocab.unit_counts)
    totals = np.bincount(of, vocab.unit_counts, classes)
    totals += FLOOR * np.bincount(of[heads : vocab.end], minlength=classes)
    first = _transition(_class_bigrams(bigrams, of), totals, prior)
    placed = stage(own_classes(word_contexts(texts, vocab, of, classes), vocab, of, first, totals), "classes")
    at = vocab.units >= 0
    own = np.where(at, of[vocab.units], -1)
    chosen = placed.where("frequent").select("word", "class").toArrow()  # as many as the vocabulary holds at most
    own[np.searchsorted(vocab.frequent, chosen.column(0).to_numpy())] = chosen.column(1).to_numpy()
    named = texts.sparkSession.createDataFrame(
        [(int(w), int(c)) for w, c in zip(vocab.frequent[at], own[at])], "word long, class int"
    )
    counted = placed.drop("frequent").unionByName(counted.join(F.broadcast(named), "word"))
    totals = np.bincount(own[at], vocab.counts[at], classes).astype(float)
    totals[of[vocab.end]] += vocab.texts
    totals += np.bincount(of[heads : vocab.end], DISCOUNT * vocab.unit_types[heads : vocab.end] + FLOOR, classes)
    for c, n, kinds in placed.groupBy("class").agg(F.sum("n"), F.count(F.lit(1))).collect():
        totals[c] += n - DISCOUNT * kinds
    rare = placed.where("not frequent").select("word", "n", "class")
    pairs = _own_bigrams(texts, vocab, own, int(of[vocab.end]), classes, rare.drop("n"))
    return Brown(vocab, of, own, np.log10(_transition(pairs, totals, prior)), totals, counted, rare)


def _transition(bigrams: list, totals: np.ndarray, prior: float) -> np.ndarray:
    """P(class | class before) from rows (class before, class, n)."""
    table = np.zeros((len(totals), len(totals)))
    for a, b, n in bigrams:
        table[a, b] = n
    share = totals / totals.sum()
    return np.maximum((table + prior * share) / (table.sum(axis=1, keepdims=True) + prior), 1e-300)


def word_contexts(texts: DataFrame, vocab: Vocabulary, of: np.ndarray, classes: int) -> DataFrame:
    """(word, ending, around) of all words but the heads, one row for what a task has gathered of a word.

    ``around`` has the units' classes before and after each occurrence, as one number.
    """

    def found(batches):
        for batch in parts(batches, 0):
            words, places, ends = _words(batch.column(0), vocab.endings)
            for lo, hi in slices(places, SLICE_WORDS):
                a, b = places[lo], places[hi]
                unit = _units(vocab, vocab.find(words[a:b]), ends[a:b])
                seq, at = _with_ends(unit, places[lo : hi + 1], vocab.end)
                cls = np.concatenate((of[[vocab.end]], of[seq]))
                chosen = unit >= vocab.heads
                here = np.delete(np.arange(len(seq)), at)[chosen]
                yield words[a:b][chosen], ends[a:b][chosen], (cls[here] * classes + cls[here + 2]).astype(np.int32)

    def run(batches):
        for word, ending, around in _gathered(found(batches)):
            order, starts = _grouped(word)
            around, first = around[order], order[starts[:-1]]
            for lo, hi in slices(starts, BATCH_ROWS):
                a, b = starts[lo], starts[hi]
                lists = pa.ListArray.from_arrays(pa.array((starts[lo : hi + 1] - a).astype(np.int32)), pa.array(around[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word[first[lo:hi]]), pa.array(ending[first[lo:hi]]), lists], names=["word", "ending", "around"]
                )

    return texts.mapInArrow(run, "word long, ending int, around array<int>")


def _counted(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    starts = np.flatnonzero(new)
    return [c[starts] for c in columns], np.diff(np.append(starts, len(order)))


def own_classes(
    contexts: DataFrame, vocab: Vocabulary, of: np.ndarray, transition: np.ndarray, totals: np.ndarray
) -> DataFrame:
    """(word, ending, n, class, frequent) of all words but the heads.

    A word leaves its ending's class for the one that makes its occurrences likeliest, its
    neighbours and the transitions being those of the units, if that gains more than the
    choice of a class costs (the logarithm of their number). Its rows come together by a
    shuffle and are added up one after the other, so no word is too frequent or too rare.
    """
    classes = len(totals)
    logs = np.rint(np.log(transition) * STEPS)
    before, after = logs, np.ascontiguousarray(logs.T)

    def decided(word, ending, n, gain):
        own, row = of[vocab.heads + ending], np.arange(len(word))
        mass = totals + n[:, None]
        mass[row, own] -= n
        value = gain / STEPS - n[:, None] * np.log(np.maximum(mass, 1e-300))
        best = value.argmax(axis=1)
        chosen = np.where(value[row, best] - value[row, own] > np.log(classes), best, own)
        frequent = vocab.find(word) >= 0
        return pa.RecordBatch.from_arrays(
            [pa.array(word), pa.array(ending, pa.int32()), pa.array(n), pa.array(chosen, pa.int32()), pa.array(frequent)],
            names=["word", "ending", "n", "class", "frequent"],
        )

    def run(batches):
        held = None  # the last word, whose rows may go on
        for batch in batches:
            word, ending = (batch.column(k).to_numpy() for k in range(2))
            offsets, around = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
            for lo in range(0, len(word), 4096):
                w, part = word[lo : lo + 4096], offsets[lo : lo + 4097]
                new = np.concatenate(([True], w[1:] != w[:-1]))
                starts, codes = np.flatnonzero(new), around[part[0] : part[-1]]
                row = np.repeat(np.cumsum(new) - 1, np.diff(part)) * classes
                sides = (
                    np.bincount(row + side, minlength=len(starts) * classes).reshape(-1, classes).astype(float)
                    for side in (codes // classes, codes % classes)
                )
                gain = sum(times @ log for times, log in zip(sides, (before, after)))
                rows = [w[starts], ending[lo : lo + 4096][starts], np.add.reduceat(np.diff(part).astype(np.int64), starts), gain]
                if held is not None and held[0][0] == w[0]:
                    rows[2][0] += held[2][0]
                    rows[3][0] += held[3][0]
                elif held is not None:
                    rows = [np.concatenate(x) for x in zip(held, rows)]
                held = [x[-1:] for x in rows]
                if len(rows[0]) > 1:
                    yield decided(*(x[:-1] for x in rows))
        if held is not None:
            yield decided(*held)

    together = contexts.repartition("word").sortWithinPartitions("word")
    return together.mapInArrow(run, "word long, ending int, n long, class int, frequent boolean")


def _own_bigrams(texts: DataFrame, vocab: Vocabulary, own: np.ndarray, end: int, classes: int, rare: DataFrame) -> list:
    """Class bigram counts by the words' own classes, at most classes squared rows.

    Pairs of frequent words are counted in the task; each other word comes with its neighbours'
    classes, and two of them in a row as a pair of words, to be joined with ``rare`` (word, class).
    """

    def run(batches):
        def rows_of(a, b, x, y, n):
            there = lambda v: pa.array(v, pa.int64()) if v is not None else pa.nulls(len(n), pa.int64())
            return pa.RecordBatch.from_arrays(
                [there(a), there(b), *(pa.array(v, pa.int32()) if v is not None else pa.nulls(len(n), pa.int32()) for v in (x, y)), pa.array(n, pa.int64())],
                names=["a", "b", "x", "y", "n"],
            )

        table = np.zeros(classes * classes, np.int64)
        for batch in parts(batches, 0):
            words, places = hashed_words(batch.column(0), fold=True)
            words = words.view(np.int64)
            for lo, hi in slices(places, SLICE_WORDS):
                a, b = places[lo], places[hi]
                word, at = _with_ends(words[a:b], places[lo : hi + 1], 0)
                cls, _ = _with_ends(_of_found(own, vocab.find(words[a:b])), places[lo : hi + 1], end)
                cls, word = np.concatenate(([end], cls)), np.concatenate(([0], word))
                known = cls >= 0
                both = known[:-1] & known[1:]
                table += np.bincount(cls[:-1][both] * classes + cls[1:][both], minlength=classes * classes)
                here = np.flatnonzero(~known)
                (w, x, y), n = _counted(word[here], cls[here - 1], cls[here + 1])
                yield rows_of(w, None, x, y, n)
                two = here[~known[here + 1]]
                (w, v), n = _counted(word[two], word[two + 1])
                yield rows_of(w, v, None, None, n)
        there = np.flatnonzero(table)
        yield rows_of(None, None, there // classes, there % classes, table[there])

    found = stage(texts.mapInArrow(run, "a long, b long, x int, y int, n long"), "pairs")
    met = found.where("a is not null and b is null").join(rare.withColumnRenamed("word", "a"), "a").select(
        "n", F.inline(F.array(F.struct(F.col("x"), F.col("class").alias("y")), F.struct(F.col("class").alias("x"), F.col("y")))),
    ).where("x >= 0 and y >= 0")
    two = found.where("b is not null").join(rare.toDF("a", "p"), "a").join(rare.toDF("b", "q"), "b")
    pairs = found.where("a is null").select("x", "y", "n").union(met.select("x", "y", "n")).union(two.select("p", "q", "n"))
    return pairs.groupBy("x", "y").agg(F.sum("n")).collect()


def _class_bigrams(bigrams: DataFrame, of: np.ndarray) -> list:
    """Class bigram counts, at most classes squared rows."""
    names = bigrams.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(of)], "unit int, class int")
    one = names.select(F.col("unit").alias("a"), F.col("class").alias("ca"))
    two = names.select(F.col("unit").alias("b"), F.col("class").alias("cb"))
    return bigrams.join(one, "a").join(two, "b").groupBy("ca", "cb").agg(F.sum("n")).collect()


def score(docs: DataFrame, model: Brown, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words between ASCII white space, A to Z lowered, and one end. base_score
    is the sum of log10 (c + 0.1) / (N + 0.1 (V + 1)). score is the log10 probability
    P(class | class before) P(word | class) of the tokens; the first follows an end. A
    frequent word's emission is its share of the class; any other word's is its count less
    the discount, and an unknown word takes what its ending's words were discounted, in
    the class of that ending.
    Null texts count as empty and have the end alone; null and repeated keys are rows of
    their own; an empty table gives no rows; other columns are not read.

    Words that are not among the frequent are joined with their counts by a shuffle of
    (row, word, classes before and after, times), pairs of two such words by another;
    everything else is summed in the task that reads the text.
    """
    bounded_batches(docs.sparkSession)
    v, of, named, trans, totals = model.vocab, model.classes, model.own, model.transition, model.totals
    kind = docs.schema[key].dataType.simpleString()
    lower = math.log10(v.tokens + 0.1 * (v.types + 1))
    class_log = np.log10(np.maximum(totals, 1e-300))
    unknown = np.log10(DISCOUNT * v.unit_types[v.heads : v.end] + FLOOR)

    def run(batches):
        for batch in parts(batches, 2):
            words, places, ends = _words(batch.column(2), v.endings)
            out: list[list] = [[], [], [], []]
            alone: list[list] = [[], [], [], [], [], []]
            paired: list[list] = [[], [], [], [], [], []]
            for lo, hi in slices(places, SLICE_WORDS):
                a, b = places[lo], places[hi]
                part = places[lo : hi + 1]
                place = v.find(words[a:b])
                seq, at = _with_ends(_units(v, place, ends[a:b]), part, v.end)
                cls, _ = _with_ends(_of_found(named, place), part, of[v.end])
                before = np.concatenate(([of[v.end]], cls[:-1]))
                local = np.where(cls >= 0, -class_log[cls], 0.0) + np.where((cls >= 0) & (before >= 0), trans[before, cls], 0.0)
                seen, _ = _with_ends(_of_found(v.counts, place), part, v.texts)
                head = (seq < v.heads) | (seq == v.end)
                own = np.where(head, seen, seen - DISCOUNT)
                local += np.where(seen > 0, np.log10(np.maximum(own, 1e-300)), np.where(head, -300.0, 0.0))
                base = np.where(seen > 0, np.log10(np.maximum(seen, 0) + 0.1), 0.0)
                first = np.concatenate(([0], at[:-1] + 1)).astype(np.int64)
                out[0].append(at + 1 - first)
                out[1].append(np.add.reduceat(seen > 0, first, dtype=np.int64))
                out[2].append(np.add.reduceat(base, first))
                out[3].append(np.add.reduceat(local, first))
                word, _ = _with_ends(words[a:b], part, 0)
                ending, _ = _with_ends(ends[a:b], part, 0)
                rare = np.flatnonzero(cls < 0)
                doc = np.searchsorted(at, rare)
                two = rare[cls[rare + 1] < 0]
                for held, columns in (
                    (alone, (doc, word[rare], ending[rare], before[rare], cls[rare + 1])),
                    (paired, (np.searchsorted(at, two), word[two], ending[two], word[two + 1], ending[two + 1])),
                ):
                    found, times = _counted(*columns)
                    for k, x in enumerate((np.bincount(found[0], minlength=hi - lo), *found[1:], times)):
                        held[k].append(x)
            flat = [np.concatenate(x) if x else np.empty(0) for x in out]

            def lists(held, names, kinds):
                sizes, *columns = (np.concatenate(x) if x else np.empty(0, np.int64) for x in held)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                return pa.ListArray.from_arrays(
                    offsets, pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)
                )

            number, whole = pa.int64(), pa.int32()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(flat, (number, number, pa.float64(), pa.float64()))),
                    lists(alone, ["word", "ending", "x", "y", "times"], (number, whole, whole, whole, whole)),
                    lists(paired, ["a", "ea", "b", "eb", "times"], (number, whole, number, whole, whole)),
                ],
                names=["row", "key", "n_tokens", "n_known", "base", "local", "rare", "pairs"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    scored = stage(
        rows.mapInArrow(
            run,
            f"row long, key {kind}, n_tokens long, n_known long, base double, local double, "
            "rare array<struct<word: long, ending: int, x: int, y: int, times: int>>, "
            "pairs array<struct<a: long, ea: int, b: long, eb: int, times: int>>",
        ),
        "scored",
    )

    def value(numbers, at):
        return F.element_at(F.expr(f"array({', '.join(f'{float(x)!r}D' for x in numbers)})"), at + 1)

    def moved(x, y):
        """log10 P(y | x), 0 if one of them is not known here."""
        return F.when((x >= 0) & (y >= 0), value(trans.ravel(), F.greatest(x, F.lit(0)) * len(totals) + F.greatest(y, F.lit(0)))).otherwise(0.0)

    def class_of(joined, ending):
        """A word's own class, or for an unknown word that of its ending."""
        return F.coalesce(joined, value(of[v.heads : v.end], F.col(ending)).cast("int"))

    classed = model.rare
    rare = scored.select("row", F.inline("rare")).join(classed, "word", "left").withColumn("class", class_of(F.col("class"), "ending"))
    times, n, c = F.col("times"), F.coalesce("n", F.lit(0)), F.col("class")
    emitted = F.when(n > 0, F.log10(n - DISCOUNT)).otherwise(value(unknown, F.col("ending"))) - value(class_log, c)
    one = rare.select(
        "row", F.when(n > 0, times).otherwise(0).alias("known"), (times * F.log10(n + 0.1)).alias("base_more"),
        (times * (emitted + moved(F.col("x"), c) + moved(c, F.col("y")))).alias("more"),
    )
    two = scored.select("row", F.inline("pairs")).join(classed.select(F.col("word").alias("a"), F.col("class").alias("p")), "a", "left").join(
        classed.select(F.col("word").alias("b"), F.col("class").alias("q")), "b", "left"
    ).select(
        "row", F.lit(0).alias("known"), F.lit(0.0).alias("base_more"),
        (times * moved(class_of(F.col("p"), "ea"), class_of(F.col("q"), "eb"))).alias("more"),
    )
    added = one.union(two).groupBy("row").agg(*(F.sum(k).alias(k) for k in ("known", "base_more", "more")))
    zero = F.lit(0.0)
    return scored.drop("rare", "pairs").join(added, "row", "left").select(
        F.col("key").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", zero) - F.col("n_tokens") * lower).alias("base_score"),
        (F.col("local") + F.coalesce("more", zero)).alias("score"),
    )


def held_out(doc_id: Column) -> Column:
    """Rows that are not learned from: crc32 of the id as text, mod 10, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0
