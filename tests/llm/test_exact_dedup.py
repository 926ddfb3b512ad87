import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from corpuslens.llm.exact_dedup import drop_exact_copies, exact_groups, sha256_hex

COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = min((i is None, i or 0) for i in ids)
        keep = None if keep[0] else keep[1]
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out.append((i, keep, len(ids), first, hashlib.sha256(text.encode()).hexdigest()))
            first = False
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_odd_documents(spark, odd_documents):
    assert rows_of(exact_groups(odd_documents)) == brute([(r.doc_id, r.text) for r in odd_documents.collect()])


def test_empty_table(no_documents):
    groups = exact_groups(no_documents)
    assert set(COLUMNS) <= set(groups.columns) and groups.count() == 0


def test_state_goes_on_over_batches(spark):
    rows = [(i, f"text {i % 7}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(exact_groups(docs, files_per_trigger=1)) == brute(rows)


def test_weak_digest_is_mended_by_the_bytes(spark):
    rows = [(i, f"text  {i % 7}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for digest in (lambda t: F.substring(sha256_hex(t), 1, 0), lambda t: (F.crc32(t.cast("binary")) % 3).cast("string")):
        assert rows_of(exact_groups(docs, digest)) == brute(rows)


def test_dropped_copies_leave_columns_alone(odd_documents):
    kept = drop_exact_copies(odd_documents)
    assert kept.columns == odd_documents.columns
    assert kept.count() == sum(r[3] for r in brute([(r.doc_id, r.text) for r in odd_documents.collect()]))


def test_no_python_in_the_plan(spark, odd_documents):
    plan = exact_groups(odd_documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
