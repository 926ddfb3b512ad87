"""Score threads as their files arrive.

Scoring needs nothing but the thread itself, so the batch projection runs
unchanged on a stream: no state, no watermark. The scores land in a table, from
which the best threads are picked at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslens.operators.ordering import thread_order
from corpuslens.operators.topk import number_rows
from corpuslens.plans.retrieval import score_threads, single_query_plan, with_score
from corpuslens.sources import schemas


def stream_scores(
    spark: SparkSession, threads_path: str, entries: DataFrame, query: str
) -> DataFrame:
    """Streaming frame of thread keys and scores for one query.

    The files must carry ``ord_raw``: a stream has no place in a dump.
    """
    threads = spark.readStream.schema(schemas.THREAD).json(threads_path)
    return with_score(score_threads(threads, *single_query_plan(entries, query)))


def start_scoring(scores: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append the scores to a Parquet table, everything available now."""
    return (
        scores.writeStream.format("parquet")
        .option("path", table_path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def best_so_far(scores: DataFrame, k: int = 60) -> DataFrame:
    """The ``k`` best threads of a table of scores, ranked."""
    return number_rows(scores, [F.col("score").desc(), *thread_order()], k)
