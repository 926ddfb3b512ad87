import zlib

import pytest
from pyspark.sql import functions as F

from corpuslens.llm.sharding import jump_shard, shard_documents

MASK = (1 << 64) - 1


def jump(key: int, shards: int) -> int:
    """The published algorithm on unsigned integers."""
    key, b, j = key & MASK, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & MASK
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 1000])
def test_jump_equals_the_published_algorithm(spark, shards):
    keys = [0, 1, -1, 7, 2**63 - 1, -(2**63), *(i * 7919 - 555 for i in range(150))]
    rows = spark.createDataFrame([(k,) for k in keys], "key long").select("key", jump_shard(F.col("key"), shards).alias("s"))
    assert all(r.s == jump(r.key, shards) for r in rows.collect())


def test_new_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(3000).select(jump_shard(F.col("id"), 16).alias("a"), jump_shard(F.col("id"), 17).alias("b")).collect()
    moved = [r for r in rows if r.a != r.b]
    assert all(r.b == 16 for r in moved) and 100 < len(moved) < 260


def test_slots_sizes_and_checksums(odd_documents):
    rows = shard_documents(odd_documents, 4).collect()
    texts = [(r.doc_id, r.text or "") for r in odd_documents.collect()]
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(i), len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts
    )
    assert all(r.shard == jump(r.doc_id or 0, 4) for r in rows)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_other_keys_and_empty_tables(spark, no_documents):
    assert shard_documents(no_documents, 4).count() == 0
    named = spark.createDataFrame([("a", "x"), ("b", None), (None, "y")], "doc_id string, text string")
    assert {r.shard for r in shard_documents(named, 3).collect()} <= {0, 1, 2}
    with pytest.raises(ValueError):
        jump_shard(F.lit(1), 0)


def test_hot_key_is_numbered_gaplessly(spark):
    docs = spark.range(500).select(F.lit(3).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    assert sorted(r.slot for r in shard_documents(docs, 16).collect()) == list(range(500))
