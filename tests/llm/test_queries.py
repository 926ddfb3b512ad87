import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import toxicity
from corpuslens.llm.decontamination import align
from corpuslens.llm.queries import ORACLES, QUERIES
from corpuslens.llm.words import MARKS, hashed_words
from tests.compare import connect, difference
from tests.llm.test_near_duplicates import classes

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(spark, connect(SF), SF, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_for_each_document(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.select("doc_id").distinct().count() == 200


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def _without_toxic(spark, rows):
    """Label 1 is what the fitted model says, document by document."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~toxicity.held_out(F.col("doc_id")))
    return {i: t for i, t in rows.items() if model.score(t) < 0.3}


def _without_copies(spark, rows):
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    return {i: rows[i] for i in first.values()}


def _without_near_copies(spark, rows):
    kept = {min(map(int, group)) for group in classes(list(rows.items()))}
    return {i: rows[i] for i in kept}


def _without_benchmark(spark, rows):
    """Every item aligned with every whole document."""
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def words(text):
        return hashed_words(pa.array([text], pa.string()), fold=True, gaps=MARKS)[0]

    items = [w for w in map(words, items) if len(w) >= 3]
    return {
        i: t for i, t in rows.items()
        if not any(align(w, words(t))[0] >= len(w) * (0.5 if len(w) >= 8 else 1.0) for w in items)
    }


BRUTE = [_without_toxic, _without_copies, _without_near_copies, _without_benchmark]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    for (name, stage), brute in zip(corpus_pipeline.STAGES, BRUTE):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        want = brute(spark, want)
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows if r.start == 0} == set(want)


def test_pipeline_on_odd_documents(spark, odd_documents, no_documents, tmp_path):
    for at, docs in (("odd", odd_documents), ("none", no_documents)):
        docs = docs.withColumnRenamed("n", "n_chars")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF).write.parquet(f"{tmp_path}/{at}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{at}-{name}")
        assert (docs.count() > 0) == (at == "odd")
