"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.exact_dedup import LOCATOR, addressable, located, whole_rows
from corpuslens.llm.staging import bounded_batches
from corpuslens.llm.words import MARKS, hashed_words, shingles, slices

#: Words of test items that one pass over the documents looks for; bounds what is broadcast.
BLOCK_WORDS = 1_000_000
SEED = 3
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Items shorter than this must be there word for word.
SHORT = 8
_TABLE_BITS = 22


@dataclass
class Items:
    """A block of test items as word hashes, and their seed n-grams."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray  # distinct, ascending
    gram_of: np.ndarray  # for each seed place: its gram, ascending
    item_of: np.ndarray  # its item
    place_of: np.ndarray  # its word in the item
    table: np.ndarray  # whether a gram may be there, by its low bits


def _items(ids: list, texts: list) -> Items:
    words, places = hashed_words(pa.array(texts, pa.string()), fold=True, gaps=MARKS)
    own = [words[a:b] for a, b in zip(places[:-1], places[1:])]
    grams, item = shingles(words, places, SEED)
    counts = np.diff(places)
    place = np.concatenate([np.arange(max(0, c - SEED + 1) or min(c, 1)) for c in counts]) if len(counts) else np.empty(0, int)
    enough = np.flatnonzero(counts[item] >= SEED)
    enough = enough[np.argsort(grams[enough], kind="stable")]
    grams, item, place = grams[enough], item[enough], place[enough]
    distinct, gram_of = np.unique(grams, return_inverse=True)
    return _tabled(Items(ids, own, distinct, gram_of, item, place, np.empty(0, bool)))


def _tabled(items: Items) -> Items:
    items.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
    items.table[items.grams & np.uint64((1 << _TABLE_BITS) - 1)] = True
    return items


def _found(items: Items, words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each occurrence of a seed in the texts: gram, text, word in the text."""
    grams, doc = shingles(words, places, SEED)
    likely = np.flatnonzero(items.table[grams & np.uint64((1 << _TABLE_BITS) - 1)])
    if not len(likely) or not len(items.grams):
        return (np.empty(0, np.int64),) * 3
    at = np.minimum(np.searchsorted(items.grams, grams[likely]), len(items.grams) - 1)
    hit = items.grams[at] == grams[likely]
    # A text's shingles stand in order of its words.
    first = np.searchsorted(doc, doc[likely[hit]], side="left")
    return at[hit], doc[likely[hit]], likely[hit] - first


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment: score, first and last word of the text in it (end not included).

    A row of the table at a time; gaps within the row are a running maximum.
    """
    n = len(text)
    slope = -GAP * np.arange(n + 1)
    score, begin = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, 0)
    for word in item:
        step = np.where(text == word, MATCH, MISMATCH)
        diagonal = score[:-1] + step
        up = score[1:] + GAP
        take = np.concatenate(([0.0], np.maximum(diagonal, up)))
        origin = np.concatenate(([0], np.where(diagonal >= up, begin[:-1], begin[1:])))
        fresh = take <= 0
        take[fresh] = 0
        origin[fresh] = np.flatnonzero(fresh)
        climbed = take + slope
        top = np.maximum.accumulate(climbed)
        source = np.maximum.accumulate(np.where(climbed >= top, np.arange(n + 1), 0))
        new = top - slope
        dry = new <= 0
        score, begin = np.where(dry, 0.0, new), np.where(dry, np.arange(n + 1), origin[source])
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (float(score[j]), int(begin[j]), j)
    return best


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[Items]:
    """The items in blocks of bounded size, read one partition after the other."""
    ids, texts, held = [], [], 0
    for row in benchmark.select(key, text).toLocalIterator():
        size = (row[1] or "").count(" ") + 1
        if ids and held + size > BLOCK_WORDS:
            yield _items(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        held += size
    if ids:
        yield _items(ids, texts)


def _possible(items: Items, pair_item: np.ndarray, own: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each item has enough words in the text to score ``threshold``; a match adds one
    to the score and nothing else does, so items without are below it."""
    chosen, back = np.unique(pair_item, return_inverse=True)
    there = np.unique(own)
    sizes = np.array([len(items.words[i]) for i in chosen])
    words = np.concatenate([items.words[i] for i in chosen])
    at = np.minimum(np.searchsorted(there, words), len(there) - 1)
    held = np.add.reduceat((there[at] == words).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
    return (held >= np.where(sizes >= SHORT, threshold, 1.0) * sizes * MATCH)[back]


def _windows(items: Items, at: np.ndarray, place: np.ndarray, own: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(item, begin, end): the stretches of a text that hold every copy around a seed hit,
    joined where they overlap. What is added to a copy costs its score, so there is a bound."""
    lo, hi = np.searchsorted(items.gram_of, at, side="left"), np.searchsorted(items.gram_of, at, side="right")
    many = hi - lo
    k = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    item, begin = items.item_of[k], np.repeat(place, many) - items.place_of[k]
    fits = _possible(items, item, own, threshold)
    item, begin = item[fits], begin[fits]
    order = np.lexsort((begin, item))
    spans: dict[int, list[list[int]]] = {}
    for i, p in zip(item[order].tolist(), begin[order].tolist()):
        size = len(items.words[i])
        slack = math.ceil(size * (1 - threshold) * MATCH / -GAP) if size >= SHORT else 0
        a, b = max(0, p - slack), min(len(own), p + size + slack)
        held = spans.setdefault(i, [])
        if held and a <= held[-1][1]:
            held[-1][1] = max(b, held[-1][1])
        else:
            held.append([a, b])
    for i, found in spans.items():
        for a, b in found:
            yield i, a, b


def contaminations(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, item_key: str = "item_id", text: str = "text"
) -> DataFrame:
    """One row for each document and test item that it holds a copy of.

    Columns: doc_id, item_id, score, first_word, last_word (end not included) and the
    row's locator. Words are runs of letters and digits, A to Z lowered. ``score`` is the
    best local alignment of the item within the document (match 1, mismatch and gap -0.5)
    over the item's number of words; copies score ``threshold`` or more, items of fewer
    than eight words only if they are there word for word. Items of fewer than three
    words or null text have no seed and are never found; null and empty documents hold
    nothing; null and repeated ids are rows of their own; empty tables on either side
    give no rows; other columns are not read.

    The benchmark is read in blocks of at most a million words, each looked for in all
    documents for any run of three words of an item; where one is found and the text has
    enough of the item's words, it is aligned. A copy in which no three words in a row are
    left as they were is not found, whatever its score. Texts never leave the task that
    reads them.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema[item_key].dataType.simpleString()
    schema = f"doc_id {kind}, _file string, _row long, item_id {item_kind}, score double, first_word long, last_word long"
    source = located(addressable(docs), "doc_id", "text")

    def search(items: Items):
        def run(batches):
            for batch in batches:
                words, places = hashed_words(batch.column(3), fold=True, gaps=MARKS)
                rows: list[list] = [[], [], [], [], []]
                for lo, hi in slices(places, 500_000):
                    part = places[lo : hi + 1]
                    gram, doc, place = _found(items, words[part[0] : part[-1]], part - part[0])
                    for d in np.unique(doc):
                        mine = doc == d
                        own = words[part[d] : part[d + 1]]
                        best: dict[int, tuple[float, int, int]] = {}
                        for i, a, b in _windows(items, gram[mine], place[mine], own, threshold):
                            size = len(items.words[i])
                            score, begin, end = align(items.words[i], own[a:b])
                            score /= size * MATCH
                            if score >= (threshold if size >= SHORT else 1.0) and score > best.get(i, (0,))[0]:
                                best[i] = (score, a + begin, a + end)
                        for i, (score, a, b) in best.items():
                            for column, x in zip(rows, (lo + int(d), items.ids[i], score, a, b)):
                                column.append(x)
                at = pa.array(rows[0], pa.int64())
                ids = pa.array(rows[1], batch_type)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(at) for k in range(3)), ids, *(pa.array(r, t) for r, t in zip(rows[2:], (pa.float64(), pa.int64(), pa.int64())))],
                    names=[c.split()[0] for c in schema.split(", ")],
                )

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(benchmark.schema[item_key].dataType)
    out = None
    for items in _blocks(benchmark.select(item_key, text), item_key, text):
        hits = source.select("doc_id", *LOCATOR, "text").mapInArrow(search(items), schema)
        out = hits if out is None else out.union(hits)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def contamination_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, contaminated, items (how many), item_id and score of
    the best copy (of ties the smallest item_id), null where there is none, and the locator."""
    docs = addressable(docs)
    order = F.struct((-F.col("score")).alias("s"), "item_id")
    hits = contaminations(docs, benchmark, **options).groupBy(*LOCATOR).agg(
        F.min(order).alias("best"), F.count(F.lit(1)).alias("items")
    )
    rows = located(docs, "doc_id").join(hits, list(LOCATOR), "left")
    return rows.select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.lit(0)).alias("items"),
        F.col("best.item_id").alias("item_id"), (-F.col("best.s")).alias("score"), *LOCATOR,
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no copy of a test item, all columns as they were."""
    docs = addressable(docs)
    gone = contaminations(docs, benchmark, **options).select(*LOCATOR).distinct()
    return whole_rows(docs).join(gone, list(LOCATOR), "left_anti").select("_document.*")
