import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import bagminhash
from corpuslens.llm.staging import BATCH_BYTES, bounded_batches

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    held = spark.conf.get(NAME, None)
    spark.conf.unset(NAME)
    yield
    spark.conf.unset(NAME) if held is None else spark.conf.set(NAME, held)


def test_batches_of_long_texts_are_bounded(spark, unset, no_documents):
    """A task gets its texts in batches of a few MB, not all 20 MB of them at once."""
    docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100_000).alias("text"))
    bagminhash.near_duplicates(no_documents)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(1).nbytes])], names=["n"])

    sizes = [r.n for r in docs.mapInArrow(run, "n long").collect()]
    assert sum(sizes) >= 200 * 100_000 and max(sizes) < BATCH_BYTES + 200_000


def test_lower_bound_of_the_session_is_kept(spark, unset):
    spark.conf.set(NAME, "64k")
    bounded_batches(spark)
    assert spark.conf.get(NAME) == "64k"
