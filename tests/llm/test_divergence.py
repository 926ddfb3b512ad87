"""Divergence of sources, against whole loops over terms and groups."""

import random
import re
from collections import Counter, defaultdict

from corpuslens.llm import divergence
from corpuslens.llm.divergence import source_divergence, term_counts
from tests.llm.conftest import plain, prose


def brute(rows, least, top):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in terms]
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = []

    def share(count, n, v):
        return 1 + 10**9 * (count + 2) // (n + 2 * v)

    def apart(p, q):
        return (p - q) ** 2 // (p + q)

    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]
        v = len(kept)
        total = {g: sum(counts[g][t] for t in kept) for g in groups if g[0] == lang}
        p = {g: {t: share(counts[g][t], total[g], v) for t in kept} for g in total}
        q = {t: share(sum(counts[g][t] for g in total), sum(total.values()), v) for t in kept}
        own = (lang, source)
        parts = {
            "pair": [(g[1], sum(apart(p[own][t], p[g][t]) for t in kept)) for g in total if g != own],
            "term": [(t, apart(p[own][t], q[t])) for t in kept if counts[own][t] and p[own][t] > q[t]],
        }
        for part, items in parts.items():
            items.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(items) if part == "pair" or i < top]
    return sorted(out, key=str)


def _rows(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        words = [rng.choice(["Über", "naïve", "ZEBRA", "zebra", "it's", "x1y", "日本", "a_b", "É"]) for _ in range(rng.randrange(6))]
        yield rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", None]), " ".join([*words, prose(i % 40, rng.randrange(30))])


def test_against_brute_force(spark):
    rows = [*_rows(1, 400), ("de", "alone", "zu wenig"), ("de", "b", None), ("it", "", ""), ("xx", "a", "one"), ("xx", "b", "two")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    for least, top in ((10, 10), (1, 3)):
        assert plain(source_divergence(docs, least, top)) == brute(rows, least, top)


def test_many_sources_share_few_terms(spark):
    rng = random.Random(5)
    rows = [("en", f"s{rng.randrange(60)}", prose(rng.randrange(300), 12)) for _ in range(900)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert plain(source_divergence(docs, 3)) == brute(rows, 3, 10)


def test_pieces_of_a_long_text_and_flushes(monkeypatch):
    text = prose(2, 5_000).encode() + b" ABC " + "é".encode() * 50
    whole = term_counts(text)
    monkeypatch.setattr(divergence, "PIECE", 64)
    assert term_counts(text) == whole and whole[b"abc"] == 1 and whole["é".encode() * 50] == 1


def test_odd_documents(spark, odd_documents, no_documents):
    docs = odd_documents.selectExpr("*", "_file as lang", "node as source", "1 as term", "2 as g", "3 as held")
    rows = [(r.lang, r.source, r.text) for r in docs.select("lang", "source", "text").collect()]
    assert plain(source_divergence(docs, 2)) == brute(rows, 2, 10)
    assert source_divergence(no_documents.selectExpr("*", "_file as lang", "node as source")).count() == 0
