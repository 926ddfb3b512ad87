"""Writers. Each replaces its own output folder and nothing else."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.sources.arrays import byte_slices


def pipe_cell(values: str):
    """Array column as one cell, values separated by ``|``."""
    return F.array_join(F.col(values).cast("array<string>"), "|")


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header, quotes only where needed, empty text for null, CRLF ends.

    ``single_file`` is for tables of a bounded size.
    """
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").options(
        header=True, quote='"', escape='"', emptyValue="", nullValue="", lineSep="\r\n",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_json(df: DataFrame, path: str, single_file: bool = False) -> None:
    """One JSON object per line, UTF-8, null fields written out."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_array(df: DataFrame, path: str, single_file: bool = False) -> None:
    """One JSON array per file, an entry a line; a partition's rows are passed on as they
    come. Null fields are written out."""
    out = df.coalesce(1) if single_file else df
    entries = out.select(F.to_json(F.struct(*out.columns), {"ignoreNullFields": "false"}).alias("value"))
    entries.mapInArrow(_bracketed, "value string").write.mode("overwrite").text(path)


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = "["
    for batch in batches:
        for low, high in byte_slices(batch.column(0)):
            lines = []
            for entry in batch.column(0).slice(low, high - low).to_pylist():
                lines.append(before + entry)
                before = ","
            yield pa.RecordBatch.from_pydict({"value": pa.array(lines, pa.string())})
    yield pa.RecordBatch.from_pydict({"value": ["[]" if before == "[" else "]"]})
