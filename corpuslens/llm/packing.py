"""Harmonic packing: token sequences from bins with a fixed number of pieces per class."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.numbering import number_within
from corpuslens.llm.staging import bounded_batches
from corpuslens.llm.tokens import id_bytes


def harmonic_classes(capacity: int) -> list[int]:
    """Pieces per bin of each class, ascending. Class j takes lengths up to capacity // j.

    Powers of two down to capacity / 32 are the sizes that documents are cut to; below,
    classes lie a 512th of the capacity apart, so that a piece wastes less than that.
    """
    halves = [1 << i for i in range(6) if capacity >> i >= 1]
    step = max(1, capacity // 512)
    small = [capacity // u for u in range(step, capacity // 32, step)]
    return sorted({*halves, *small, capacity})


def cut_lengths(total: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document: as many whole sequences as it holds, then
    exact halves, quarters and so on to a 32nd, then the rest as it is."""
    pieces, size = [capacity] * (total // capacity), capacity // 2
    rest = total % capacity
    while size >= 1 and size * 32 >= capacity and capacity % size == 0:
        if rest >= size:
            pieces.append(size)
            rest -= size
        size //= 2
    return pieces + [rest] * (rest > 0)


def pack_documents(
    docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, keep_ids: bool = False,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens.

    A document's ids are those of the tokenizer, then ``end_id``; each id lies in exactly
    one piece. Class j holds pieces with capacity // j tokens or fewer, and each of its
    sequences takes exactly j of them (the last one of a class may take fewer). Pieces
    are numbered within a class over all workers, so a class is filled wherever its
    pieces are, and a common class is spread over all of them.

    Columns: the key, start, length, ids_crc32, doc_tokens, sequence_id, offset, class
    and, with ``keep_ids``, the ids. Null and empty texts are packed as their end id
    alone; null and repeated keys are packed like others; an empty table gives no rows;
    other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    classes = harmonic_classes(capacity)
    takes = {}
    for j in classes:
        takes.update({n: j for n in range(1, capacity // j + 1)})
    end = end_id.to_bytes(4, "little")
    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, class int" + ", ids array<int>" * keep_ids

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for at, value in enumerate(batch.column(1)):
                data = id_bytes(value.as_py() or "", path) + end
                start, total = 0, len(data) // 4
                for length in cut_lengths(total, capacity):
                    piece = data[4 * start : 4 * (start + length)]
                    rows[0].append(at)
                    for column, x in zip(rows[1:6], (start, length, zlib.crc32(piece), total, takes[length])):
                        column.append(x)
                    if keep_ids:
                        rows[6].append(memoryview(piece).cast("I").tolist())
                    start += length
            columns = [batch.column(0).take(pa.array(rows[0], pa.int64()))] + [pa.array(c, pa.int64()) for c in rows[1:5]]
            columns.append(pa.array(rows[5], pa.int32()))
            if keep_ids:
                columns.append(pa.array(rows[6], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    pieces = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)
    numbered = number_within(pieces, "class", ["key", "start", "ids_crc32"], "_place")
    bins = numbered.withColumn("_bin", F.floor(F.col("_place") / F.col("class")).cast("long"))
    # A number for each class and bin: the bins of each class follow those of the classes before.
    place = F.create_map(*[F.lit(x) for i, j in enumerate(classes) for x in (j, i)])
    bins = bins.withColumn("sequence_id", F.col("_bin") * len(classes) + F.element_at(place, F.col("class")).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long")
    return bins.withColumn("offset", offset).select(
        F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class", *["ids"] * keep_ids
    )
