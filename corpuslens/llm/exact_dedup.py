"""Exact deduplication by a streaming keyed state on disk, with a full check of bytes."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm.staging import fresh_path, stage

#: White space that counts as one space.
SPACES = r"[\x20\x09-\x0D]+"
LOCATOR = ("_file", "_row")
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    # An executor holds one write buffer a state partition, beside its heap.
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    # A manifest is else preallocated with 4 MB in each state partition.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def addressable(docs: DataFrame) -> DataFrame:
    """The documents as rows of files, so that each has a content locator for good.

    Scans of Parquet files are that already; anything else is written to the shared
    folder. Operators that read documents more than once do this first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException as error:  # not a file scan
        if not (error.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            raise
        return stage(docs, "located")
    return docs


def located(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """The chosen columns of addressable documents with the locator: file and row number in it."""
    return docs.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """Each addressable document as one struct, so that no column name can clash, with its locator."""
    return located(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_document"))


def keyed_state(arrivals: DataFrame, checkpoint: str) -> None:
    """Run the stateful stream: one state row for each digest, kept without expiry.

    ``arrivals`` is a streaming frame with digest, doc_id and locator. The state holds,
    for each digest, the smallest stable identifier with its content locator, and the
    number of rows. It lives in RocksDB on the executors' disks; changes go to the
    checkpoint after each batch, and a restarted stream goes on from there.
    """
    first = F.struct(F.isnull("doc_id").alias("none"), "doc_id", *LOCATOR)
    state = arrivals.groupBy("digest").agg(F.min(first).alias("keeper"), F.count(F.lit(1)).alias("n"))
    run = (
        state.writeStream.format("noop").outputMode("update").trigger(availableNow=True)
        .option("checkpointLocation", checkpoint).start()
    )
    run.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, keeper (none, doc_id, file, row), n."""
    stored = spark.read.format("statestore").load(checkpoint)
    parts = stored.schema["value"].dataType.names
    return stored.select(
        F.col("key.digest").alias("digest"), F.col("value")[parts[0]].alias("keeper"), F.col("value")[parts[1]].alias("n")
    )


def exact_groups(docs: DataFrame, digest=sha256_hex, files_per_trigger: int | None = None) -> DataFrame:
    """One row per document with the document that stands for its text.

    Columns: doc_id, keep_id, group_size, kept, text_sha256 and the row's locator. Texts
    are equal when they are so after each run of ASCII white space became one space;
    null texts count as empty; empty texts are equal to each other. The smallest doc_id
    stays, null ids come last, and of rows that repeat an id the first locator stays, so
    exactly one row of a group is kept. Empty tables give no rows; other columns are not
    read. ``digest`` may be any function of the text: rows that share a digest with
    different bytes are found by the full check and grouped by their bytes.
    """
    spark = docs.sparkSession
    docs = addressable(docs)
    source = located(docs, "doc_id", normalised(F.col("text")).alias("_text"))
    prints = source.select(
        "doc_id", *LOCATOR, digest(F.col("_text")).alias("digest"), sha256_hex(F.col("_text")).alias("text_sha256")
    )
    path, checkpoint = fresh_path(spark, "prints"), fresh_path(spark, "dedup-state")
    prints.write.parquet(path)
    rows = spark.read.schema(prints.schema).parquet(path)
    if rows.isEmpty():
        return rows.select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
            F.lit(True).alias("kept"), "text_sha256", *LOCATOR,
        )
    with _settings(spark, STATE_SETTINGS):
        reader = spark.readStream.schema(prints.schema)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        keyed_state(reader.parquet(path), checkpoint)
        state = stage(read_state(spark, checkpoint), "dedup-index")
    grouped = rows.join(state, "digest")
    is_keeper = (F.col("_file") == F.col("keeper._file")) & (F.col("_row") == F.col("keeper._row"))

    # Full bytes of every hit against those at the keeper's locator.
    members = grouped.where("n > 1").select("digest", "doc_id", *LOCATOR, "text_sha256", is_keeper.alias("first"))
    members = members.join(source.drop("doc_id"), list(LOCATOR))
    keepers = members.where("first").select("digest", F.col("_text").alias("_kept_text"))
    differing = stage(
        members.where("not first").join(keepers, "digest").where("_text <> _kept_text").drop("_kept_text", "first"), "collisions"
    )
    other = differing.groupBy("digest", "_text").agg(
        F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", *LOCATOR)).alias("own"), F.count(F.lit(1)).alias("own_n")
    )
    own = differing.join(other, ["digest", "_text"]).select(*LOCATOR, "own", "own_n")
    fewer = differing.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    keeper = F.coalesce("own", "keeper")
    return (
        grouped.join(fewer, "digest", "left").join(own, list(LOCATOR), "left")
        .withColumn("_keep", keeper)
        .select(
            "doc_id", F.col("_keep.doc_id").alias("keep_id"),
            F.coalesce(F.col("own_n"), F.col("n") - F.coalesce(F.col("gone"), F.lit(0))).alias("group_size"),
            ((F.col("_file") == F.col("_keep._file")) & (F.col("_row") == F.col("_keep._row"))).alias("kept"),
            "text_sha256", *LOCATOR,
        )
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents without exact copies, all columns as they were."""
    docs = addressable(docs)
    kept = exact_groups(docs).where("kept").select(*LOCATOR)
    return whole_rows(docs).join(kept, list(LOCATOR), "left_semi").select("_document.*")
