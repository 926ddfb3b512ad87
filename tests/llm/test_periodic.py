"""Runs of repeated words, against every lag of every document."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from corpuslens.llm.periodic import find_runs, periodic_runs
from corpuslens.llm.queries import QUERIES
from corpuslens.llm.words import draws
from tests.llm.conftest import plain, prose

SF = "/root/testdata/sf0.001"
NAMES = draws(5, 64)


def runs_of_all_lags(x, least=12):
    """(start, length, period) by comparing the text with itself at every lag."""
    found = {}
    for q in range(1, len(x) // 2 + 1):
        equal = (x[:-q] == x[q:]).astype(np.int8)
        edge = np.diff(np.concatenate(([0], equal, [0])))
        for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if e - s + q >= max(least, 2 * q):
                found.setdefault((int(s), int(e) + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def numbered(words):
    names = {}
    return np.array([names.setdefault(w, len(names)) for w in words], dtype=np.int64)


def _texts(rng):
    for _ in range(rng.randrange(1, 6)):
        n, kinds = rng.choice([0, 3, 11, 12, 13, 30, 100, 300, 900]), rng.choice([1, 2, 3, 5, 40])
        x = [rng.randrange(kinds) for _ in range(n)]
        for _ in range(rng.randrange(4) if n else 0):
            start, period = rng.randrange(n), rng.randrange(1, n)
            for i in range(max(start, period), rng.randrange(start, n)):
                x[i] = x[i - period]
        if rng.random() < 0.2:
            a, b = [0], [0, 1]
            while len(b) < n:
                a, b = b, b + a
            x = b[:n]
        yield np.array([bin(i).count("1") % 2 for i in range(n)] if rng.random() < 0.2 else x, dtype=np.int64)


def test_runs_equal_those_of_all_lags():
    rng = random.Random(11)
    for _ in range(150):
        texts, least = list(_texts(rng)), rng.choice([12, 12, 7, 4, 20])
        places = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
        found = find_runs(np.concatenate([NAMES[x] for x in texts]), places, least)
        want = [(i, *r) for i, x in enumerate(texts) for r in runs_of_all_lags(x, least)]
        assert list(zip(*(c.tolist() for c in found))) == want


def test_one_word_a_hundred_thousand_times():
    text, start, length, period = find_runs(np.full(100_000, NAMES[0]), np.array([0, 100_000]))
    assert (text.tolist(), start.tolist(), length.tolist(), period.tolist()) == ([0], [0], [100_000], [1])


def test_query_against_brute_force(spark):
    want = {}
    for row in spark.read.parquet(f"{SF}/documents.parquet").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", row.text or "")
        n, h = len(words), zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = runs_of_all_lags(numbered(words))
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        want[row.doc_id] = (
            len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
        )
    rows = QUERIES["op13_periodic_runs"](spark, SF).collect()
    assert len(rows) == len(want) and any(r.n_runs for r in rows)
    for r in rows:
        got = (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
        assert got == want[r.doc_id], r.doc_id


def test_odd_documents(spark, odd_documents, no_documents):
    out = periodic_runs(odd_documents)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"] and out.count() == odd_documents.count()
    got = plain(out.where("doc_id <> 6 or doc_id is null").select("doc_id", "n_words", F.size("runs"), "collapsed").where("doc_id in (2, 3, 4, 5, 8)"))
    text = "a plain text of some words"
    assert got == [(2, 0, 0, ""), (3, 0, 0, ""), (4, 0, 0, ""), (5, 6, 0, text), (5, 6, 0, text), (8, 6, 0, text)]
    assert periodic_runs(no_documents).count() == 0


def test_two_runs_of_one_start_and_long_repeats(spark):
    twice = "a a a a a a a a a a a a b " * 3
    long = f"{prose(3, 40_000)} " * 3
    rows = [(1, twice), (1, twice), (2, long)]
    out = {r.doc_id: r for r in periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in out[1].runs] == runs_of_all_lags(numbered(twice.split()))
    assert [tuple(r) for r in out[2].runs if r.length == 120_000] == [(0, 120_000, 40_000)]
    assert len(out[2].collapsed.split()) <= 40_000
