"""Files that hold one JSON array, read by many tasks.

Where a byte range of such a file starts inside a text or a nested object can only be
told from all that stands before it. The file is cut after closing braces, which any file
system's text reader can do from any byte on, and read three times. The first pass tells
of each split what it does to the state of reading: whether it ends inside a text, how
many levels it opens or closes, how low it gets. Running sums over these rows, one a
split, give the state each split starts in. The second pass picks up the few records that
lie across splits, whose parts meet by a shuffle; the third parses all others where they
are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.operators.staging import staged
from corpuslens.sources.places import placed

_ESCAPED = re.compile(rb"\\.", re.DOTALL)
_QUOTE, _OPEN, _CLOSE = 1, 2, 3
_MARKS = np.zeros(256, np.uint8)
_MARKS[ord('"')] = _QUOTE
_MARKS[[ord("{"), ord("[")]] = _OPEN
_MARKS[[ord("}"), ord("]")]] = _CLOSE


def _braces(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of braces and brackets, whether each opens (1) or closes (-1), and how
    many quotes stand before it; then, as a last entry, for the end of the data."""
    plain = _ESCAPED.sub(b"  ", data) if b"\\" in data else data
    kinds = _MARKS[np.frombuffer(plain, np.uint8)]
    at = np.flatnonzero(kinds)
    kinds = kinds[at]
    quotes = np.cumsum(kinds == _QUOTE)
    brace = kinds != _QUOTE
    places = np.append(at[brace], len(data))
    steps = np.append(np.where(kinds[brace] == _OPEN, 1, -1), 0)
    return places, steps, np.append(quotes[brace], quotes[-1] if len(quotes) else 0)


#: Bytes of text worked on at once; an Arrow batch may hold many times that.
PART_BYTES = 4 << 20


def byte_slices(column: pa.Array, most: int = PART_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, end
        at = end


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """First row, split number and bytes of each stretch of rows from one split, with
    the closing braces that the reader took away; long stretches in parts."""
    splits = batch.column("_split").to_numpy()
    starts = np.flatnonzero(np.diff(splits, prepend=splits[:1] - 1)) if len(splits) else []
    for start, end in zip(starts, [*starts[1:], len(splits)]):
        values = batch.column("value").slice(start, end - start)
        for low, high in byte_slices(values):
            yield int(start), int(splits[start]), b"}".join(values.slice(low, high - low).to_pylist()) + b"}"


class _Effect:
    """What a part of a file does to one who reads it, begun outside or inside of a text:
    levels opened less closed, the lowest level on the way, objects begun at each level,
    quotes passed."""

    def __init__(self):
        self.quotes, self.first = 0, None
        self.shift, self.low, self.objects = [0, 0], [0, 0], [Counter(), Counter()]

    def then(self, data: bytes) -> None:
        at, steps, quotes = _braces(data)
        curly = np.frombuffer(data, np.uint8)[np.minimum(at, len(data) - 1)] == ord("{")
        for begun in (0, 1):
            outside = np.where((quotes + self.quotes + begun) % 2, 0, steps)
            levels = self.shift[begun] + np.cumsum(outside)
            reached, times = np.unique(levels[curly & (outside == 1)], return_counts=True)
            self.objects[begun].update(dict(zip(reached.tolist(), times.tolist())))
            self.shift[begun], self.low[begun] = int(levels[-1]), int(min(self.low[begun], levels.min()))
        self.quotes = (self.quotes + int(quotes[-1])) % 2
        if self.first is None:
            self.first = data.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1") or None


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a split."""
    key, effect = None, _Effect()

    def row() -> pa.RecordBatch:
        objects = [list(levels.items()) for levels in effect.objects]
        values = [*key, effect.quotes, *effect.shift, *effect.low, *objects, effect.first]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _EFFECT.types)], schema=_EFFECT)

    for batch in batches:
        for start, split, data in _runs(batch):
            if key is None or split != key[1]:
                if key is not None:
                    yield row()
                key = (batch.column("_file")[start].as_py(), split, batch.column("_length")[start].as_py())
                effect = _Effect()
            effect.then(data)
    if key is not None:
        yield row()


_EFFECT = pa.schema([
    *[(name, pa.int64()) for name in ("_file", "_split", "_length", "quotes", "shift0", "shift1", "low0", "low1")],
    *[(name, pa.map_(pa.int64(), pa.int64())) for name in ("objects0", "objects1")], ("first", pa.string()),
])
_EFFECT_DDL = (
    "_file long, _split long, _length long, quotes long, shift0 long, shift1 long, low0 long, low1 long, "
    "objects0 map<long, long>, objects1 map<long, long>, first string"
)
_PIECE_DDL = "_key long, _part long, ord_raw long, piece binary"
_PIECE = pa.schema([*[(name, pa.int64()) for name in ("_key", "_part", "ord_raw")], ("piece", pa.binary())])


def _states(effects: DataFrame) -> DataFrame:
    """The state each split starts in: inside a text or not, levels open, the level of
    records, the objects of the dump before it, and the split in which the one that is
    open there began. One narrow row for each split of the dump."""
    file = Window.partitionBy("_file")
    before = file.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    whole = file.orderBy("_split").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    outside = F.col("inside") == 0
    known = effects.withColumns({
        "inside": (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"),
        "records_at": F.when(F.first("first", True).over(whole) == "[", 1).otherwise(0),
    }).withColumns({
        "shift": F.when(outside, F.col("shift0")).otherwise(F.col("shift1")),
        "low": F.when(outside, F.col("low0")).otherwise(F.col("low1")),
        "objects": F.when(outside, F.col("objects0")).otherwise(F.col("objects1")),
    })
    # What follows the last closing brace is a row too, and gets a brace it has not.
    levels = F.sum("shift").over(file)
    complete = (F.sum("quotes").over(file) % 2 == 0) & ((levels == -1) | ((levels == 0) & (F.col("records_at") == 0)))
    failed = F.raise_error(F.lit("a file ends within its JSON array")).cast("long")
    known = known.withColumn(
        "level", F.when(complete, F.coalesce(F.sum("shift").over(before), F.lit(0))).otherwise(failed)
    )
    begun = F.coalesce(F.try_element_at("objects", F.col("records_at") + 1 - F.col("level")), F.lit(0))
    known = known.withColumn("begun", begun)
    of_file = known.groupBy("_file").agg(F.sum("begun").alias("n"))
    files_before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    of_file = of_file.select("_file", F.coalesce(F.sum("n").over(files_before), F.lit(0)).alias("of_files"))
    opened = F.col("level") > F.col("records_at")
    through = opened & (F.col("level") + F.col("low") > F.col("records_at"))
    began = F.max(F.when(~through, F.col("_split"))).over(before)
    states = known.select(
        "_file", "_split", "_length", "inside", "level", "records_at", F.when(opened, began).alias("began"),
        F.coalesce(F.sum("begun").over(before), F.lit(0)).alias("in_file"),
    ).join(of_file, "_file")
    return states.withColumn("first", F.col("of_files") + F.col("in_file")).drop("_file", "of_files", "in_file")


_STATE = ("inside", "level", "records_at", "first", "began")


class _Records:
    """Cuts splits into the array's entries; ``across`` picks those that lie across
    splits, in parts with the key of the split they begin in, or else all others."""

    def __init__(self, across: bool):
        self.across = across

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        self.split, self.out = None, []
        for batch in batches:
            for start, split, data in _runs(batch):
                if split != self.split:
                    self._leave()
                    self._enter(split, *(batch.column(name)[start].as_py() for name in _STATE))
                self._stretch(data)
                yield self._given()
        self._leave()
        yield self._given()

    def _enter(self, split: int, inside: int | None, level: int, records_at: int, first: int, began: int | None) -> None:
        if inside is None:
            raise ValueError("the dump was split in another way when it was read again")
        self.split, self.inside, self.level, self.records_at, self.began = split, inside, level, records_at, began
        self.next, self.place, self.parts = first, None, []

    def _leave(self) -> None:
        """An entry that is open at the end of a split goes on in the next one."""
        if self.split is not None and self.level > self.records_at:
            self._give(self.split if self.began is None else self.began)

    def _begin(self, data: bytes) -> None:
        self.parts, self.place = [data], None
        if data.startswith(b"{"):
            self.place, self.next = self.next, self.next + 1

    def _stretch(self, data: bytes) -> None:
        at, steps, quotes = _braces(data)
        steps = np.where((quotes + self.inside) % 2, 0, steps)
        levels = self.level + np.cumsum(steps)
        begins = at[(steps == 1) & (levels == self.records_at + 1)]
        ends = at[(steps == -1) & (levels == self.records_at)] + 1
        if self.level > self.records_at:
            self.parts.append(data[: ends[0]] if len(ends) else data)
            if len(ends):
                self._give(self.began)
                ends = ends[1:]
        for begin, end in zip(begins, ends):
            self._begin(data[begin:end])
            self._give(None)
        if len(begins) > len(ends):
            self._begin(data[begins[-1]:])
        self.level, self.inside = int(levels[-1]), (self.inside + int(quotes[-1])) % 2

    def _give(self, key: int | None) -> None:
        if (key is not None) == self.across:
            self.out.append((key, self.split, self.place, b"".join(self.parts)))
        self.place, self.parts, self.began = None, [], None

    def _given(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [()] * len(_PIECE)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE.types)], schema=_PIECE)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that each hold one JSON array (or objects one after the
    other), read by as many tasks as the bytes ask for. ``ord_raw`` numbers them from 0:
    files by name, then as they stand.

    Texts are UTF-8. Null fields, missing fields and fields of another type are null, as
    is every field of an object that does not parse; entries that are no objects give no
    row; empty arrays and empty files give none. A file that ends within an entry or
    before its array is closed fails the job. An entry is held whole, as the row it
    becomes; all else is read in Arrow batches.
    """
    scan = placed(spark.read.option("lineSep", "}").text(path), path)
    rows = scan.select("_file", "_split", "_length", F.col("value").cast("binary").alias("value"))
    # One row of seven numbers for each split that tasks read.
    states = F.broadcast(_states(staged(rows.mapInArrow(_effects, _EFFECT_DDL), "splits")))
    known = rows.join(states, ["_split", "_length"], "left").drop("_file", "_length")

    def entries(across: bool) -> DataFrame:
        cut = known.mapInArrow(_Records(across), _PIECE_DDL)
        return cut.select("_key", "_part", "ord_raw", F.col("piece").cast("string").alias("piece"))

    joined = entries(True).groupBy("_key").agg(
        F.array_sort(F.collect_list(F.struct("_part", "ord_raw", "piece"))).alias("parts")
    ).select(F.col("parts")[0]["ord_raw"].alias("ord_raw"), F.concat_ws("", "parts.piece").alias("piece"))
    found = entries(False).drop("_key", "_part").unionByName(joined).where(F.col("piece").startswith("{"))
    return found.select(F.from_json("piece", schema).alias("entry"), "ord_raw").select("entry.*", "ord_raw")
