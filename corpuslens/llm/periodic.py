"""Stretches of repeated word sequences in a document, by seeds on diagonals that are extended."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.words import draws, hashed_words, mix, slices

#: Words handled at once by a task; a longer document is handled whole.
GROUP_WORDS = 300_000
_BITS = 22
_NONE = np.empty(0, np.int64)


def _repeated(grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the places ``at``, those whose gram is there twice or more, ordered by gram and
    place, and the number of each one's gram."""
    low = (grams & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    often = np.flatnonzero(np.bincount(low, minlength=1 << _BITS)[low] > 1)  # a superset, at the cost of a table
    order = often[np.argsort(grams[often], kind="stable")]
    held, places = grams[order], at[order]
    new = np.concatenate(([True], held[1:] != held[:-1])) if len(held) else np.empty(0, bool)
    number = np.cumsum(new) - 1
    many = np.bincount(number, minlength=1)[number] > 1
    return places[many], number[many]


def _short_lags(grams: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Stretches of equal k-grams at lags below 2k: first and last place, lag.

    ``at`` are the places of repeated grams, ascending. Next to an equal pair lies the
    next of its diagonal, so a stretch is covered whole by its first pair.
    """
    found = []
    for lag in range(1, 2 * k):
        here = at[at < len(grams) - lag]
        here = here[grams[here] == grams[here + lag]]
        if len(here):
            gap = np.flatnonzero(np.diff(here) != 1)
            first, last = here[np.concatenate(([0], gap + 1))], here[np.append(gap, len(here) - 1)]
            found.append((first, last, np.full(len(first), lag)))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (_NONE,) * 3


def _long_lags(at: np.ndarray, number: np.ndarray, k: int, n: int) -> tuple[np.ndarray, ...]:
    """Chains of seeds at lags from 2k to below 4k: first and last anchor, lag.

    Places that k divides are anchors: an overlap of 2k words holds the whole k-gram of
    one. Each meets the later places of its gram in reach; a gram that is there often in
    so short a stretch has a short period itself, so there are at most about 2n pairs.
    Anchors next to each other on a lag are one chain, extended once.
    """
    anchor = at % k == 0
    key = number * np.int64(n + 1) + at
    own, place = number[anchor] * np.int64(n + 1), at[anchor]
    low = np.searchsorted(key, own + np.minimum(place + 2 * k, n))
    many = np.searchsorted(key, own + np.minimum(place + 4 * k, n)) - low
    which = np.repeat(np.arange(len(place)), many)
    other = at[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(len(which))]
    first = place[which]
    lag = other - first
    order = np.lexsort((first, lag))
    first, lag = first[order], lag[order]
    if not len(first):
        return (_NONE,) * 3
    broken = np.flatnonzero((np.diff(lag) != 0) | (np.diff(first) != k))
    heads, tails = np.concatenate(([0], broken + 1)), np.append(broken, len(first) - 1)
    return first[heads], first[tails], lag[heads]


def _agree(words: np.ndarray, a: int, b: int, n: int, step: int) -> int:
    """How many words agree from a and b on, at most n, forwards or backwards."""
    done, block = 0, 16
    while done < n:
        m = min(block, n - done)
        i, j = a + step * done, b + step * done
        same = words[i : i + m] == words[j : j + m] if step > 0 else (words[i - m + 1 : i + 1] == words[j - m + 1 : j + 1])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, block = done + m, block * 4
    return done


class _Known:
    """Runs found so far, and for each word the longest one that holds it."""

    def __init__(self, n: int):
        self.begin = self.end = self.period = _NONE
        self.of = np.full(n, -1)

    def add(self, begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        """A stretch that several lags give is a run of the smallest of them."""
        begin, end, period = (np.concatenate(x) for x in zip((self.begin, self.end, self.period), (begin, end, period)))
        order = np.lexsort((period, end, begin))
        begin, end, period = begin[order], end[order], period[order]
        new = np.concatenate(([True], (np.diff(begin) != 0) | (np.diff(end) != 0))) if len(begin) else np.empty(0, bool)
        self.begin, self.end, self.period = begin[new], end[new], period[new]
        for i in np.argsort(self.end - self.begin, kind="stable").tolist():
            self.of[self.begin[i] : self.end[i]] = i

    def settles(self, first: np.ndarray, last: np.ndarray, lag: np.ndarray, k: int) -> np.ndarray:
        """Whether a chain lies in a run whose period divides its lag and that is longer
        than both together: it would only give that run again."""
        if not len(self.begin):
            return np.zeros(len(first), bool)
        i = self.of[first]
        inside = (i >= 0) & (self.begin[i] <= first) & (self.end[i] >= last + k + lag)
        return inside & (lag % self.period[i] == 0) & (self.end[i] - self.begin[i] >= lag + self.period[i])


def find_runs(words: np.ndarray, places: np.ndarray, least: int = 12) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of the texts, by text, start and period.

    ``words`` are word numbers or hashes of all texts in a row, ``places`` where each text
    begins. A run is a stretch with smallest period q (words q apart agree) of at least
    ``least`` and 2q words that no neighbouring word extends. On the diagonal of lag q it
    overlaps with itself by max(least - q, q) words or more, thus by k = least / 2, and
    from lag 2k on by the largest k * 2^m up to the lag. Grams of k words are indexed,
    then grams of k * 2^(m-1) words of those places whose shorter gram repeats.
    """
    n, k = len(words), (least + 1) // 2
    if n < least:
        return (_NONE,) * 4
    doc = np.repeat(np.arange(len(places) - 1), np.diff(places))
    stop = places[1:][doc]  # where the text of a word ends
    factors = draws(41, k) | np.uint64(1)
    grams = np.zeros(n, np.uint64)
    for t in range(k):
        grams[: n - t] += words[t:] * factors[t]
    grams = mix(grams + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    whole = np.arange(n) + k <= stop
    grams[~whole] = 0  # no gram
    at, number = _repeated(grams[whole], np.flatnonzero(whole))
    known = _Known(n)
    if not len(at):
        return (_NONE,) * 4
    first, last, lag = _short_lags(grams, np.sort(at), k)
    begin, end = first, last + k + lag
    enough = end - begin >= np.maximum(least, 2 * lag)
    known.add(begin[enough], end[enough], lag[enough])
    longest = int(np.diff(places).max())
    while len(at) and 4 * k <= longest:  # lags from 2k on need 4k words
        first, last, lag = _long_lags(at, number, k, n)
        fresh = ~known.settles(first, last, lag, k)
        fresh &= last + k - first + 2 * k > lag  # else too short for its lag however it extends
        rows = []
        for i, j, q in zip(first[fresh].tolist(), last[fresh].tolist(), lag[fresh].tolist()):
            # Beyond its ends the chain's next grams differ, or the text ends.
            left = _agree(words, i - 1, i - 1 + q, min(k, i - int(places[doc[i]])), -1)
            right = _agree(words, j + k, j + k + q, min(k, int(stop[i]) - (j + k + q)), 1)
            if j + k + right - (i - left) >= q:
                rows.append((i - left, j + k + right + q, q))
        if rows:
            known.add(*np.array(rows, dtype=np.int64).T)
        if 8 * k > longest:
            break
        # Grams twice as long, of the places where both halves repeat.
        longer = np.zeros(n, np.uint64)
        both = at[(at + k < n) & (at + 2 * k <= stop[at])]
        both = np.sort(both[grams[np.minimum(both + k, n - 1)] != 0])
        longer[both] = mix(grams[both] + grams[both + k] * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
        at, number = _repeated(longer[both], both)
        kept = np.zeros(n, bool)
        kept[at] = True
        longer[~kept] = 0
        grams, k = longer, 2 * k
    order = np.lexsort((known.period, known.begin))
    begin, end, period = known.begin[order], known.end[order], known.period[order]
    return doc[begin], begin - places[doc[begin]], end - begin, period


def periodic_runs(docs: DataFrame, least: int = 12, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its runs, and its text without what they repeat.

    Columns: the key, n_words, runs (start, length, period; by start, then period) and
    collapsed: the words, joined by one space, without those that any run holds after its
    first period. Words are what stands between ASCII white space; a run is a stretch of
    words with smallest period q, of at least ``least`` and 2q words, that no neighbouring
    word extends. Words are told apart by 64-bit hashes. Null, empty and blank texts have
    no words and no runs; very long ones are searched whole, in a task of their own size;
    null and repeated keys, and repeated rows, are rows like others; two runs that start
    at the same word are both given; an empty table gives no rows; other columns are not
    read, whatever their names.
    """
    kind = docs.schema[key].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = f"key {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            words, places = hashed_words(texts)
            for lo, hi in slices(places, GROUP_WORDS):
                part = places[lo : hi + 1]
                own = part - part[0]
                text_of, start, length, period = find_runs(words[part[0] : part[-1]], own, least)
                offsets = np.searchsorted(text_of, np.arange(hi - lo + 1)).astype(np.int32)
                repeats = np.zeros(int(own[-1]) + 1, np.int64)
                first = own[text_of] + start
                np.add.at(repeats, first + period, 1)
                np.add.at(repeats, first + length, -1)
                kept = np.cumsum(repeats)[:-1] == 0
                collapsed = []
                for i, value in enumerate(texts.slice(lo, hi - lo).cast(pa.binary())):
                    tokens = (value.as_py() or b"").split()  # at ASCII white space, as the word hashes
                    if offsets[i] < offsets[i + 1]:
                        tokens = [tokens[t] for t in np.flatnonzero(kept[own[i] : own[i + 1]]).tolist()]
                    collapsed.append(b" ".join(tokens))
                found = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], fields=list(run_type.value_type))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), pa.array(np.diff(part)),
                        pa.ListArray.from_arrays(pa.array(offsets), found, type=run_type), pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=["key", "n_words", "runs", "collapsed"],
                )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
