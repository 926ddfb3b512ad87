import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import words as words_module
from corpuslens.llm.bagminhash import drop_near_duplicates, near_duplicates, signatures, similarity, weighted_elements
from corpuslens.llm.components import components
from corpuslens.llm.words import hashed_words, mix
from tests.llm.conftest import prose


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def bag(text, n=5):
    w = split(text)
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else Counter([tuple(w)] if w else [])


def overlap(a, b):
    if not a or not b:
        return float(not a and not b)
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def test_word_hashes_in_blocks(monkeypatch):
    texts = ["a b  c", None, "", " \t ", "é x\ny", " ".join(f"w{i}" for i in range(300)), "q" * 500 + " r", "x" * 300, "a"]
    whole, places = hashed_words(pa.array(texts))
    assert np.diff(places).tolist() == [len(split(t)) for t in texts]
    names = {}
    for text, a, b in zip(texts, places[:-1], places[1:]):
        for word, h in zip(split(text), whole[a:b]):
            assert names.setdefault(word, h) == h
    assert len(set(names.values())) == len(names)
    monkeypatch.setattr(words_module, "BLOCK", 64)
    again, places2 = hashed_words(pa.array(texts))
    assert (whole == again).all() and (places == places2).all()
    sliced, _ = hashed_words(pa.array(["zz", *texts])[1:])
    assert (whole == sliced).all()


@pytest.mark.parametrize("a, b", [({1: 1, 2: 1, 3: 1}, {2: 1, 3: 1, 4: 1}), ({1: 9, 2: 4}, {1: 7, 2: 8}), ({1: 100}, {1: 60}), ({1: 3, 2: 1}, {1: 3, 2: 1})])
def test_signatures_are_unbiased(a, b):
    def sign(weights):
        keys = mix(np.array([k for k, w in weights.items() for _ in range(w)], dtype=np.uint64))
        return signatures(*weighted_elements(keys, np.zeros(len(keys), np.int64)), 1, 4000)

    agree = (sign(a) == sign(b)).mean()
    want = overlap(Counter(a), Counter(b))
    assert abs(agree - want) < 0.04


def test_similarity_counts_multisets():
    texts = ["a b c d e f g", "a b c d e f", "", None, "x y", "x y", "a a a a a a a a", "a a a a a a"]
    for x in texts:
        for y in texts:
            assert similarity(pa.array([x]), pa.array([y]), 5)[0] == pytest.approx(overlap(bag(x), bag(y)))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 200 + i) for i in range(30)] + [(300, 300), (301, 302), (302, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(41)}, **{200 + i: 100 for i in range(30)}, 100: 100, 301: 301, 302: 301}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def classes(rows):
    """Brute force: all pairs, then components."""
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if split(rows[i][1]) == split(rows[j][1]) or overlap(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(sorted(map(str, g)) for g in groups.values())


def got_classes(df):
    groups = {}
    for i, r in enumerate(df.collect()):
        groups.setdefault((r.class_id, r.class_size, None if r.class_id is not None else i), []).append(r)
    for (_, size, _), rows in groups.items():
        assert len(rows) == size and sum(r.kept for r in rows) == 1
    return sorted(sorted(str(r.doc_id) for r in rows) for rows in groups.values())


def edited(text, rng, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**9)}"
    return " ".join(w)


def test_groups_with_a_centre_and_chains(spark):
    """Copies that are near their original but not each other, chains, and exact copies."""
    rng = random.Random(5)
    base, rows = prose(9, 300), []
    rows += [(i, edited(base, rng, 5)) for i in range(30)] + [(30, base)]
    chain = prose(10, 300)
    for i in range(40, 52):
        rows.append((i, chain))
        chain = edited(chain, rng, 4)
    rows += [(60 + i, prose(100 + i, 120)) for i in range(20)] + [(80 + i, rows[3][1]) for i in range(5)]
    rows += [(90, base + " " + base), (91, "two words"), (92, "two  words"), (93, "two other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_classes(near_duplicates(docs)) == classes(rows)


def test_exact_rest_without_stars(spark):
    rng = random.Random(6)
    base = prose(11, 200)
    rows = [(i, edited(base, rng, 4)) for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for rounds in (0, 1):
        assert got_classes(near_duplicates(docs, star_rounds=rounds, bands=48, rows=2)) == classes(rows)


def test_odd_documents(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    found = near_duplicates(odd_documents)
    assert found.count() == len(rows)
    kept = drop_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns and kept.count() == len(classes(rows))
    assert near_duplicates(no_documents).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got_classes(near_duplicates(docs)) == classes(rows)


@pytest.mark.parametrize("links, passes", [([(5, 1), (1, 7), (9, 9), (8, 3)], 0), ([(1, 9), (5, 9), (7, 9), (9, 8)], 1)])
def test_components_make_no_pass_once_all_links_go_to_roots(spark, monkeypatch, links, passes):
    import importlib

    module = importlib.import_module("corpuslens.llm.components")
    written = []
    monkeypatch.setattr(module, "stage", lambda df, name, stage=module.stage: written.append(name) or stage(df, name))
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 5: 1, 7: 1, **({8: 3, 3: 3} if passes == 0 else {8: 1, 9: 1})}
    assert len(written) == passes


def test_pairs_are_compared_together(monkeypatch):
    """Texts of all pairs of a part go through one count of shingles, or through slices of bounded size."""
    from corpuslens.llm import bagminhash

    rng, calls = random.Random(3), []
    texts = ["", None, "x y", *(prose(i, 40) for i in range(6))]
    texts += [edited(t, rng, 3) for t in texts[3:]] + ["a a a a a a a a", "a a a a a a"]
    left, right = zip(*[(x, y) for x in texts for y in texts])
    monkeypatch.setattr(bagminhash, "shingles", lambda *a, f=bagminhash.shingles: calls.append(1) or f(*a))
    want = [overlap(bag(x), bag(y)) for x, y in zip(left, right)]
    assert similarity(pa.array(left), pa.array(right), 5).tolist() == want and len(calls) == 2
    monkeypatch.setattr(bagminhash, "GROUP_WORDS", 100)
    assert similarity(pa.array(left), pa.array(right), 5).tolist() == want
