"""Where a row stands in a dump, as one number that costs no shuffle and no counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How many times more rows a task may read than its splits have bytes; compressed
# files hold more rows than bytes.
_ROOM = 64


def _steps(spark: SparkSession) -> tuple[int, int]:
    """The least distance of two splits of a file in bytes, and the numbers kept free
    for each byte, so that a task's row numbers fit between two splits."""
    conf = spark._jsparkSession.sessionState().conf()
    largest, least = conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes()
    least = max(1, min(largest, least))
    return least, _ROOM * (largest // least + 2)


def _files(spark: SparkSession, path: str, step: int) -> list[tuple[str, int, int]]:
    """Name, rank and first byte of each file, in the order of the names. Only the
    listing is read, which the driver holds to plan the scan anyway."""
    listing = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "_metadata.file_size")
    found, start = [], 0
    for rank, (name, size) in enumerate(sorted(tuple(row) for row in listing.collect())):
        found.append((name, rank, start))
        start += size + step
    return found


def placed(scan: DataFrame, path: str) -> DataFrame:
    """Add ``_file`` (rank of its file by name), ``_split`` (a number for the part of the
    file that was read as one, growing with its place), ``_length`` (bytes of that part)
    and ``ord_raw`` (grows with the row's place in the whole dump, unique, not gapless).

    A split's number is the bytes before it, times the numbers kept free for each byte;
    the row's number in its task is added. A task reads no more rows than its splits have
    bytes, so numbers of splits never overlap, whatever the size of splits, files or
    rows; if compressed files or ``spark.sql.files.maxPartitionNum`` should make more
    rows than there is room for, the job fails and nothing is misplaced. Four petabytes
    fit with Spark's own settings.
    """
    spark = scan.sparkSession
    step, room = _steps(spark)
    files = spark.createDataFrame(_files(spark, path, step), "_name string, _file long, _first long")
    rows = scan.select(
        "*", F.col("_metadata.file_path").alias("_name"), F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_block_length").alias("_length"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("_row"),
    ).join(F.broadcast(files), "_name", "left")
    split = (F.col("_first") + F.col("_block")) * F.lit(room)
    fits = F.col("_file").isNotNull() & (F.col("_row") < F.lit(step * room))
    return rows.withColumns({"_split": split, "ord_raw": _or_fail(fits, split + F.col("_row"))}).drop(
        "_name", "_first", "_block", "_row"
    )


def _or_fail(fits: Column, number: Column) -> Column:
    failed = F.raise_error(F.concat(F.lit("cannot number the rows of "), "_name")).cast("long")
    return F.when(fits, number).otherwise(failed)
