"""Readers. Schemas are fixed, so no file is read to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpuslens.sources import schemas
from corpuslens.sources.arrays import read_array
from corpuslens.sources.places import placed


def _input_order(scan: DataFrame, path: str) -> DataFrame:
    """Add ``ord_raw``, which grows with the place in the dump: files by name, then
    splits, then rows. A projection, so texts are not moved to be numbered."""
    return placed(scan, path).drop("_file", "_split", "_length")


def read_posts(spark: SparkSession, path: str, lines: bool = False, tasks: int | None = None) -> DataFrame:
    """Raw posts with ``ord_raw``, their place in the dump.

    A dump is files that each hold one JSON array, or one object per line
    (``lines=True``); both are split by bytes. ``tasks`` deals what few files hold over
    that many tasks once read.
    """
    if lines:
        numbered = _input_order(spark.read.schema(schemas.RAW_POST).json(path), path)
    else:
        numbered = read_array(spark, path, schemas.RAW_POST)
    return numbered.repartition(tasks, "ord_raw") if tasks else numbered


def read_threads(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """Threads from JSON lines. Files written elsewhere have no ``ord_raw``: with
    ``numbered=False`` they are numbered in file order; write such a frame to a table
    once and go on from there."""
    if numbered:
        return spark.read.schema(schemas.THREAD).json(path)
    unnumbered = ", ".join(
        part for part in _columns(schemas.THREAD) if not part.startswith("ord_raw ")
    )
    return _input_order(spark.read.schema(unnumbered).json(path), path)


def _columns(schema: str) -> list[str]:
    """The top-level fields of a schema text."""
    return [f"{f.name} {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields]


def read_comments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COMMENT).json(path)


def read_topic_index(spark: SparkSession, path: str) -> DataFrame:
    """Topic index file as rows ``(topic, topic_pos, keywords, top_thread_ids, top_urls)``."""
    index = spark.read.schema(schemas.TOPIC_INDEX).option("multiLine", True).json(path)
    return index.select(F.posexplode("topics").alias("topic_pos", "topic", "entry")).select(
        "topic", "topic_pos", "entry.*"
    )


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EVIDENCE).json(path)
