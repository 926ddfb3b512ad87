"""Token counts; huge documents in overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.tokens import id_bytes, tokenizer

#: Characters of a chunk, and of the overlap that is tried first.
CHUNK, OVERLAP = 32_768, 512
#: The end of a chunk says nothing about tokens this close to it: a special token, a
#: contraction or a letter with its marks may have been cut there.
GUARD = 64


def _starts(text: str, begin: int, end: int, tok) -> tuple[list[int], list[int], list[int]]:
    """Ids of text[begin:end], each with the place where it begins, and the places where
    the tokenizer's splitting pattern begins a match."""
    got = tok.encode(text[begin:end], add_special_tokens=False)
    at = [begin + a for a, _ in got.offsets]
    words = got.word_ids
    edges = [p for i, p in enumerate(at) if i == 0 or words[i] != words[i - 1]]
    return got.ids, at, edges


def _inert(text: str, at: int) -> bool:
    """Whether normalisation treats what stands before and after ``at`` apart."""
    if text[at] < "̀":
        return True
    if unicodedata.combining(text[at]):
        return False
    a, b = text[at - 1], text[at]
    nfc = unicodedata.normalize
    return nfc("NFC", a + b) == nfc("NFC", a) + nfc("NFC", b)


def spliced_ids(text: str, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[int]]:
    """Ids of a text of any length, chunk by chunk, equal to encoding it whole.

    A boundary is proven when both chunks begin a match of the splitting pattern there,
    away from the end of the left chunk, and normalisation cannot reach across it: the
    pattern only looks ahead, so from there on both read the same. Where the overlap
    holds no such place it is doubled, and in the end the two chunks become one.
    """
    tok = tokenizer(path)
    begin, size = 0, chunk
    while True:
        end = min(len(text), begin + size)
        ids, at, edges = _starts(text, begin, end, tok)
        if end == len(text):
            yield ids
            return
        wide, cut = overlap, None
        known = {p for p in edges if begin < p <= end - GUARD and _inert(text, p)}
        while cut is None and wide < size:
            # Nothing of the overlap before its own first common edge is trusted.
            _, _, again = _starts(text, end - wide, min(len(text), end + GUARD + wide), tok)
            common = [p for p in again if p in known and p > end - wide]
            cut = common[0] if common else None
            wide *= 2
        if cut is None:
            size *= 2
            continue
        yield [i for i, p in zip(ids, at) if p < cut]
        begin, size = cut, chunk


def count_one(text: str, path: str, chunk: int, overlap: int) -> int:
    if len(text) > chunk:
        return sum(map(len, spliced_ids(text, path, chunk, overlap)))
    return len(id_bytes(text, path)) // 4


def count_tokens(
    docs: DataFrame, path: str, limit: int, chunk: int = CHUNK, overlap: int = OVERLAP,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: key, n_bytes (UTF-8), n_tokens, over_limit.

    Null texts count as empty (no bytes, no tokens); null or repeated keys give a row
    each; an empty table gives no rows; other columns are not read. ``path`` names the
    tokenizer's file on every worker. Texts never leave the task that reads them, and a
    text longer than ``chunk`` characters is encoded in pieces of bounded size.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            counts = [count_one(t.as_py() or "", path, chunk, overlap) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["key", "n_bytes", "n_tokens"]
            )

    rows = docs.select(
        F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text")
    )
    counted = rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
