import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import decontamination
from corpuslens.llm.decontamination import align, contamination_report, contaminations, drop_contaminated
from tests.llm.conftest import prose


def brute(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            step = 1 if a[i - 1] == b[j - 1] else -0.5
            table[i, j] = max(0, table[i - 1, j - 1] + step, table[i - 1, j] - 0.5, table[i, j - 1] - 0.5)
    return table.max()


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(1, n)).astype(np.uint64) for n in (15, 25))
        score, begin, end = align(a, b)
        assert score == pytest.approx(brute(a, b))
        if score:
            assert align(a, b[begin:end])[0] == pytest.approx(score)
    assert align(np.empty(0, np.uint64), np.arange(3, dtype=np.uint64)) == (0.0, 0, 0)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"t{rng.randrange(400)}" for _ in range(30))) for i in range(12)]
    items += [(50, "la de los"), (51, "one two"), (52, None), (53, ""), (54, items[0][1]), (None, prose(77, 25))]
    docs, want = [], {}
    for k in range(60):
        words = prose(1000 + k, 200).split()
        if k % 3 == 0:
            item = items[k % 12][1].split()
            if k % 2:
                for p in range(3, 30, 7):  # every seventh word is edited
                    item[p] = "edited"
                del item[11]
            words[50:50] = [w.upper() + "," for w in item]
            want[k] = k % 12
        docs.append((k, " ".join(words)))
    frame = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, item_id string, score double")
    return frame, spark.createDataFrame(items, "item_id long, text string"), want


def test_exact_and_edited_copies_are_found(planted):
    docs, items, want = planted
    got = {}
    for r in contaminations(docs, items).collect():
        if r.item_id != 54:
            got[r.doc_id] = r.item_id
            assert 40 < r.first_word <= 51 and 75 < r.last_word <= 85
    assert got == want


def test_blocks_give_the_same(planted, monkeypatch):
    docs, items, want = planted
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 70)
    assert {r.doc_id for r in contaminations(docs, items).select("doc_id").distinct().collect()} == set(want)


def test_report_and_filter(planted):
    docs, items, want = planted
    rows = contamination_report(docs, items).collect()
    assert len(rows) == 60 and {r.doc_id for r in rows if r.contaminated} == set(want)
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(60)) - set(want)


def test_seeds_of_a_common_passage_stay(spark):
    """A passage that most documents hold is still found, everyday words alone are not."""
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(i, prose(i, 60) + (" " + passage if i % 10 else "")) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(1, passage + " " + prose(500, 4))], "item_id long, text string")
    assert {r.doc_id for r in contaminations(frame, items).collect()} == {i for i in range(80) if i % 10}


@pytest.mark.parametrize("every, instead", [(4, True), (5, True), (6, True), (3, False)])
def test_edited_copies_are_those_of_full_alignment(spark, every, instead):
    """A word put in place of every fourth to sixth, or after every third."""
    items = [(n, [f"i{n}w{k}" for k in range(n)]) for n in (16, 20, 30, 40, 60)]
    docs = []
    for n, item in items:
        copy = []
        for k, word in enumerate(item):
            new = k % every == every - 1
            copy += [word] * (not (new and instead)) + [f"new{n}x{k}"] * new
        docs.append((n, prose(n, 40).split() + copy + prose(n + 1, 40).split()))
    got = contaminations(
        spark.createDataFrame([(i, " ".join(d)) for i, d in docs], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(d)) for i, d in items], "item_id long, text string"),
    ).collect()
    numbers = {w: k for k, w in enumerate(dict.fromkeys(w for _, d in [*docs, *items] for w in d))}
    coded = lambda words: np.array([numbers[w] for w in words])
    want = {(d, i): brute(coded(b), coded(a)) / len(b) for d, a in docs for i, b in items}
    assert {(r.doc_id, r.item_id): pytest.approx(r.score) for r in got} == {k: v for k, v in want.items() if v >= 0.5}
    assert len(got) == len(docs)


def test_odd_documents(spark, odd_documents, no_documents):
    items = spark.createDataFrame([("a", "a plain text of some words"), ("b", "X" * 50_000)], "item_id string, text string")
    rows = contamination_report(odd_documents, items).collect()
    assert len(rows) == odd_documents.count()
    assert sorted(r.doc_id for r in rows if r.contaminated) == [1, 5, 5, 8]
    assert contamination_report(no_documents, items).count() == 0
    assert contamination_report(odd_documents, items.where("false")).where("contaminated").count() == 0
    assert drop_contaminated(odd_documents, items).where(F.col("doc_id").isNull()).count() == 2
