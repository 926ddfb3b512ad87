import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import brown

SF = "/root/testdata/sf0.001"


def tokens(text):
    low = re.sub("[A-Z]+", lambda m: m.group(0).lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def test_move_gains_equal_the_change_of_likelihood():
    rng = np.random.default_rng(0)
    units, classes = 12, 4
    table, of = rng.integers(0, 9, (units, units)).astype(float), rng.integers(0, classes, units)

    def likelihood(of):
        t = np.zeros((classes, classes))
        np.add.at(t, (of[:, None].repeat(units, 1), of[None].repeat(units, 0)), table)
        return brown._f(t).sum() - brown._f(t.sum(0)).sum() - brown._f(t.sum(1)).sum(), t

    before, t = likelihood(of)
    for u in range(units):
        right, left = np.bincount(of, table[u], classes), np.bincount(of, table[:, u], classes)
        gains = brown.move_gains(t, of[u], right, left, table[u, u])
        for c in range(classes):
            moved = of.copy()
            moved[u] = c
            assert gains[c] - gains[of[u]] == pytest.approx(likelihood(moved)[0] - before)


def test_exchange_goes_on_until_no_unit_gains(spark):
    """On counts where moving whole halves of the units stops early."""
    rng = np.random.default_rng(0)
    units, classes = 60, 6
    table = rng.poisson(rng.gamma(0.3, 5, (units, units))).astype(float)
    rows = [(a, b, int(table[a, b])) for a in range(units) for b in range(units) if table[a, b]]
    of = brown.exchange(spark.createDataFrame(rows, "a int, b int, n long").coalesce(1), units, classes, 100, table.sum(axis=0))
    t = np.zeros((classes, classes))
    np.add.at(t, (of[:, None].repeat(units, 1), of[None].repeat(units, 0)), table)
    for u in range(units):
        right, left = np.bincount(of, table[u], classes), np.bincount(of, table[:, u], classes)
        gains = brown.move_gains(t, of[u], right, left, table[u, u])
        assert gains.max() - gains[of[u]] < 1e-6


def test_exchange_separates_two_languages(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice([f"{lang}{i}" for i in range(8)], 30)) for lang in ("un", "deux") for _ in range(40)]
    model = brown.fit(spark.createDataFrame([(t,) for t in texts], "text string"), heads=16, endings=4, classes=3, sweeps=6)
    words = model.vocab.frequent
    from corpuslens.llm.words import hashed_words
    import pyarrow as pa

    def classes(lang):
        hashes, _ = hashed_words(pa.array([" ".join(f"{lang}{i}" for i in range(8))]), fold=True)
        return {int(model.classes[model.vocab.units[np.searchsorted(words, h)]]) for h in hashes.view(np.int64)}

    assert not classes("un") & classes("deux")


@pytest.mark.parametrize("frequent", [10, 300, 100_000])
def test_counts_and_base_against_brute_force(spark, frequent):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = brown.held_out(F.col("doc_id"))
    model = brown.fit(docs.where(~out).select("text"), heads=200, endings=64, classes=8, sweeps=2, frequent=frequent)
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update(tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    rows = brown.score(docs, model).collect()
    assert len(rows) == len(texts)
    base = better = 0.0
    for r in rows:
        t = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t))
        if zlib.crc32(str(r.doc_id).encode()) % 10 == 0:
            base, better = base + r.base_score, better + r.score
    assert better > base


def test_probabilities_sum_to_one(spark):
    """Over all classes, their words and the unknown word of each ending."""
    texts = ["a b a c", "b a d e", "a c f g h", ""]
    model = brown.fit(spark.createDataFrame([(t,) for t in texts], "text string"), heads=3, endings=4, classes=2, sweeps=3)
    assert np.allclose((10**model.transition).sum(axis=1), 1)
    mass = np.zeros(2)
    v = model.vocab
    mass += np.bincount(model.classes[: v.heads], v.unit_counts[: v.heads], 2)
    mass[model.classes[v.end]] += v.unit_counts[v.end]
    for e in range(v.endings):
        u = v.heads + e
        seen = model.counted.where(f"ending = {e}").collect()
        heads = {int(h) for h, unit in zip(v.frequent, v.units) if unit >= 0}
        rare = sum(r.n - brown.DISCOUNT for r in seen if r.word not in heads)
        mass[model.classes[u]] += rare + brown.DISCOUNT * v.unit_types[u] + brown.FLOOR
    assert np.allclose(mass, model.totals)


def test_score_is_the_probability_of_the_text(spark):
    """A document's score from the model's parts, token by token."""
    texts = ["a b a c", "b a d e", "a c f g h", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frequent in (3, 100):
        m = brown.fit(frame.select("text"), heads=3, endings=4, classes=2, sweeps=3, frequent=frequent)
        v = m.vocab
        counted = {r.word: (r.n, r.ending) for r in m.counted.collect()}
        heads = {int(h): int(u) for h, u in zip(v.frequent, v.units) if u >= 0}
        import pyarrow as pa

        for r in brown.score(frame.union(spark.createDataFrame([(9, "a zz b")], frame.schema)), m).collect():
            text = dict(enumerate(texts)).get(r.doc_id, "a zz b")
            words, _, ends = brown._words(pa.array([text]), v.endings)
            before, total = m.classes[v.end], 0.0
            for w, e in [*zip(words.tolist(), ends.tolist()), (None, None)]:
                u = v.end if w is None else heads.get(w, v.heads + (e or 0))
                n = v.texts if w is None else counted.get(w, (0, 0))[0]
                p = n if w is None or w in heads else n - brown.DISCOUNT if n else brown.DISCOUNT * v.unit_types[u] + brown.FLOOR
                total += m.transition[before, m.classes[u]] + math.log10(p / m.totals[m.classes[u]])
                before = m.classes[u]
            assert r.score == pytest.approx(total)


def test_odd_documents(spark, odd_documents, no_documents):
    model = brown.fit(odd_documents.select("text"), heads=20, endings=8, classes=4, sweeps=2, frequent=50)
    rows = brown.score(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert brown.score(no_documents, model).count() == 0
    bare = brown.fit(no_documents.select("text"), heads=20, endings=8, classes=4, sweeps=2)
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in brown.score(odd_documents, bare).collect())


@pytest.mark.parametrize("frequent", [16, 100])
def test_words_beyond_the_heads_have_classes_of_their_own(spark, frequent):
    """Words of two languages that share one ending, frequent ones and others: classes, transitions and scores."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = []
    for lang, rare in (("un", "p"), ("deux", "q")):
        for i in range(60):
            words = rng.choice([f"{lang}{k}" for k in range(8)], 30).tolist()
            texts.append(" ".join([*words[:10], f"{rare}{i % 4}abc", *words[10:20], f"{rare}7abc", f"{rare}8abc", *words[20:]]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = brown.fit(frame.select("text"), heads=16, endings=1, classes=3, sweeps=6, frequent=frequent)
    held = {r.word: r for r in m.counted.collect()}

    def hashes(text):
        return brown._words(pa.array([text]), 1)[0].tolist()

    assert len(held) == 16 + 12 and sum(r.n for r in held.values()) == sum(len(t.split()) for t in texts)
    p, q = ({held[hashes(f"{x}{k}abc")[0]]["class"] for k in range(4)} for x in "pq")
    assert not p & q
    end, blank = int(m.classes[-1]), int(m.classes[16])
    table, mass = np.zeros((3, 3)), np.zeros(3)
    mass[end] += len(texts)
    mass[blank] += brown.FLOOR
    heads = {int(h) for h, u in zip(m.vocab.frequent, m.vocab.units) if u >= 0}
    for h, r in held.items():
        mass[r["class"]] += r.n if h in heads else r.n - brown.DISCOUNT
        mass[blank] += 0 if h in heads else brown.DISCOUNT
    for t in texts:
        seq = [end, *(held[h]["class"] for h in hashes(t)), end]
        np.add.at(table, (seq[:-1], seq[1:]), 1)
    share = mass / mass.sum()
    assert np.allclose(m.totals, mass)
    assert np.allclose(10**m.transition, (table + 5 * share) / (table.sum(axis=1, keepdims=True) + 5))
    extra = [(900, "p0abc q1abc zzabc yabc un1 zzabc p7abc p7abc"), (901, texts[0])]
    for r in brown.score(spark.createDataFrame(extra, frame.schema), m).collect():
        before, total = end, 0.0
        for h in [*hashes(dict(extra)[r.doc_id]), None]:
            c = end if h is None else held[h]["class"] if h in held else blank
            n = len(texts) if h is None else held[h].n if h in heads else held[h].n - brown.DISCOUNT if h in held else 12 * brown.DISCOUNT + brown.FLOOR
            total += m.transition[before, c] + math.log10(n / mass[c])
            before = c
        assert r.score == pytest.approx(total)


def test_a_task_sends_one_row_for_each_word(spark):
    """Whatever neighbours it has: a word's occurrences in several slices leave the task together."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 50, 200)) for _ in range(30)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    hashes, _, _ = brown._words(pa.array([f"w{i}" for i in range(50)]), 4)
    none, endings = np.empty(0, np.int64), 4
    vocab = brown.Vocabulary(none, none, none.astype(np.int32), 0, endings, 30, 6030, 51, np.ones(5), np.ones(5))
    of = np.arange(5)
    assert vocab.find(hashes).tolist() == [-1] * 50
    assert brown.word_counts(frame, endings).agg(F.sum("n")).first()[0] == 6000
    rows = brown.word_contexts(frame, vocab, of, 5).collect()
    assert sorted(r.word for r in rows) == sorted(hashes.tolist())
    want = Counter()
    for t in texts:
        words, _, ends = brown._words(pa.array([t]), endings)
        around = [4, *ends.tolist(), 4]
        want.update((int(w), around[i] * 5 + around[i + 2]) for i, w in enumerate(words))
    assert Counter((r.word, code) for r in rows for code in r.around) == want
