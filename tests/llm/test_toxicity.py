import itertools
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm.queries import op1_noisy_channel_toxicity
from corpuslens.llm.toxicity import (
    CLASSES, decode, decode_spaced, drop_toxic, fit, held_out, is_noisy, lattice, log_model, score_toxicity, stripped,
    symbol, trigram_counts, viterbi,
)

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def fitted(tables):
    return fit(*tables, ~held_out(F.col("doc_id")))


def test_trigrams_count_every_character(spark, odd_documents):
    counts = trigram_counts(odd_documents)
    want = np.zeros(CLASSES**3, np.int64)
    batches = [r.text for r in odd_documents.collect() if r.text is not None]
    inner = sum(max(0, len(t)) for t in batches)
    assert inner <= counts.sum() <= inner + 4 * 12 + 2 * len(batches)
    assert want.shape == counts.shape
    x = symbol("x")
    assert counts[(x * CLASSES + x) * CLASSES + x] == 49_998


def test_model_is_a_distribution(fitted):
    assert np.allclose(np.exp(fitted.model.astype(float)).sum(axis=2), 1, atol=1e-4)


@pytest.mark.parametrize("core", ["1d10t", "l0s3rr", "i.d.i", "aaab", "s5s", "a-b", "tr@sh", "$$um"])
def test_viterbi_finds_the_likeliest_path(fitted, core):
    """Against all paths of the lattice, one by one."""

    def weigh(path):
        x = y = 0
        total = 0.0
        for string, cost in path:
            total += cost
            for char in string:
                c = symbol(char)
                total += fitted.model[x, y, c]
                x, y = y, c
        return total + fitted.model[x, y, 0]

    arcs = lattice(core)
    best = max(itertools.product(*arcs), key=weigh)
    found = viterbi(arcs, fitted.model)
    assert weigh(best) == pytest.approx(max(weigh(p) for p in itertools.product(*arcs) if "".join(s for s, _ in p) == found), abs=1e-3)


@pytest.mark.parametrize("written", ["idiot", "1d10t", "id1ot!!!", "i.d.i.o.t", "i-d-i-o-t", "IDIOTTTT", "iiidiot", "!diot", "i_d_i_0_t"])
def test_written_forms_are_restored(fitted, written):
    assert "idiot" in decode(stripped(written), fitted.model)
    assert fitted.score(f"some words and {written} here") >= 0.3


@pytest.mark.parametrize("written", ["idioott", "iddiot", "iiddiioott", "IiDdIiOoTt"])
def test_doubled_letters_are_restored(fitted, written):
    assert "idiot" in decode(stripped(written), fitted.model)


@pytest.mark.parametrize("sign", [",", "/", "-", "."])
def test_long_tokens_are_decoded_whole(fitted, sign):
    token = sign.join(["plain", "words", "without", "any", "blank"] * 5 + ["1d10t", "and", "more"])
    assert "idiot" in decode(stripped(token), fitted.model)


@pytest.mark.parametrize("gap", ["  ", "\n", " \n\t", "\u00a0"])
def test_letters_with_any_white_space_between_are_joined(fitted, gap):
    assert "idiot" in fitted.restored("such an" + gap + gap.join("idiot") + gap + "there")


def test_spaced_letters_are_joined(fitted):
    assert decode_spaced("i d i o t", fitted.model) == ["idiot"]
    assert fitted.score("the l o s e r is here") >= 0.3


def test_plain_words_stay(fitted):
    for word in ("plain", "été", "Straße", "a"):
        assert not is_noisy(word) and decode(word, fitted.model) == [word.lower()]
    assert stripped("word$$$") == "word" and stripped("(word),") == "word" and stripped("...") == ""
    assert fitted.score("costs $300 in 2024, see b2b section 3.1") < 0.3


def test_held_out_accuracy(spark, tables, fitted):
    rows = score_toxicity(tables[0], fitted).join(tables[1], "doc_id").where(held_out(F.col("doc_id"))).collect()
    right = sum(r.predicted == r.toxic for r in rows)
    ranks = sorted((r.score, r.toxic) for r in rows)
    pairs = [(a, b) for a, ya in ranks if ya for b, yb in ranks if not yb]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert right / len(rows) > 0.9 and auc > 0.8


def test_held_out_labels_are_not_seen(spark, tables, fitted):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = fit(docs, turned, ~held_out(F.col("doc_id")))
    assert other.weights == fitted.weights and np.allclose(other.scale, fitted.scale)


def test_query_has_every_document(spark):
    rows = op1_noisy_channel_toxicity(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1


def test_odd_documents(spark, fitted, odd_documents, no_documents):
    rows = score_toxicity(odd_documents, fitted).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score < 0.3 for r in rows)
    kept = drop_toxic(odd_documents, fitted)
    assert kept.schema == odd_documents.schema and kept.count() == len(rows)
    assert score_toxicity(no_documents, fitted).count() == 0
    nothing = spark.createDataFrame([], "doc_id long, toxic int")
    assert math.isclose(fit(odd_documents, nothing).score("x"), 0.5)
    odd = spark.createDataFrame([(1, None), (None, 1), (99, 1), (5, 0), (5, 1)], "doc_id long, toxic int")
    assert 0 <= fit(odd_documents, odd).score("a plain text") <= 1
    assert fit(no_documents, odd).score(None) == 0.5
    assert log_model(np.zeros(CLASSES**3)).shape == (CLASSES,) * 3
