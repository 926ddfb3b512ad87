"""Written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. Only a local session without
    one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="corpuslens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/corpuslens-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the application's part of the shared folder that nothing has used yet."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> None:
    """Remove all that this application has staged, once its results are written."""
    remove(spark, _own_folder(spark))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, what a write shuffled is removed when the write ends. Spark keeps it until the
    driver happens to collect its memory, and texts sorted once lie on disk beside the outputs."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write the frame as a Parquet table in the shared folder and read it back; ``options``
    are the writer's.

    For narrow tables that several results are computed from: the texts behind
    them are scanned once, and lost executors cost no rescan.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Remove the tables staged by this application that the frame reads, once nothing needs it."""
    spark = df.sparkSession
    own = f"/corpuslens-{spark.sparkContext.applicationId}/"
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles() if own in file}:
        remove(spark, folder)


def computed_once(df: DataFrame, keep: list[str], **computed: Column) -> DataFrame:
    """Select ``keep`` and the computed columns, each evaluated once per row.

    A filter on a computed column is pushed below the projection that computes it
    and then computes it again, with everything it is built from. Text features
    are too costly for that; a generator holds such filters above itself.
    """
    row = F.struct(*[column.alias(name) for name, column in computed.items()])
    return df.select(*keep, F.inline(F.array(row)))


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Deal a scan over as many tasks as ``spark.corpuslens.spread`` says; as it is when
    that is not set, which is right for inputs of many files or row groups.

    A file with one row group is one task however large the cluster.
    """
    tasks = scan.sparkSession.conf.get("spark.corpuslens.spread", None)
    return scan.repartition(int(tasks), key) if tasks else scan
