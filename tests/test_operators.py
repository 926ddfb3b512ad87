"""Operators against plain Python, skewed keys included."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators.ordering import nth_in_group
from corpuslens.operators.distribution import descending_order_stats, equal_width_histogram
from corpuslens.operators.impact import in_groups, reachable, term_sums
from corpuslens.operators.staging import computed_once, staged
from corpuslens.operators.topk import number_rows, top_per_key


@pytest.mark.parametrize("spread", [None, 4])
def test_top_per_key_with_a_hot_key(spark, spread):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), rng.randint(0, 50), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k string, v int, i int").repartition(13)
    top = top_per_key(frame, ["k"], [F.col("v").desc(), F.col("i")], 5, spread=spread)
    got = sorted((r["k"], r["rank"], r["i"]) for r in top.collect())
    want = []
    for key in ("hot", "a", "b"):
        best = sorted((-v, i) for k, v, i in rows if k == key)[:5]
        want += [(key, n, i) for n, (_, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_top_per_key_is_cut_before_the_shuffle(spark):
    frame = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = top_per_key(frame, ["k"], [F.col("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_number_rows(spark):
    assert [r["rank"] for r in number_rows(spark.range(10), [F.col("id").desc()], 3).collect()] == [1, 2, 3]


def test_descending_order_stats(spark):
    rng = random.Random(2)
    for size in (1, 2, 9, 10, 777):
        values = [int(rng.paretovariate(0.6)) - rng.randint(0, 3) for _ in range(size)]
        frame = spark.createDataFrame([(v,) for v in values], "v long")
        row = descending_order_stats(frame, "v", {"p90": 0.1, "p50": 0.5}).first()
        ordered = sorted(values, reverse=True)
        assert (row["p90"], row["p50"]) == (ordered[int(size * 0.1)], ordered[int(size * 0.5)])
    empty = descending_order_stats(spark.createDataFrame([], "v long"), "v", {"p90": 0.1}).first()
    assert empty["p90"] is None


@pytest.mark.parametrize("values", [[0, 0, 1, 7, 7, 3], list(range(36)), [5, 5], [-3, 12, 90, 91]])
def test_histogram(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    rows = equal_width_histogram(frame, "v").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=50)
    assert [r["n"] for r in rows] == counts.tolist()
    assert np.allclose([r["bin_low"] for r in rows], edges[:-1])


def test_staged(spark):
    frame = staged(spark.range(5).withColumn("x", F.col("id") * 2), "numbers")
    assert sorted(r["x"] for r in frame.collect()) == [0, 2, 4, 6, 8]


def test_computed_once_holds_filters(spark):
    frame = computed_once(spark.range(9), ["id"], y=F.col("id") * 3).where("y > 6")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate") and plan.count("* 3") == 1
    assert frame.count() == 6


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reachable_pairs_of_term_queries(spark, seed):
    """No pair that reaches a threshold is left out, sums are exact, few others stay."""
    rng = random.Random(seed)
    counts = {(f"t{rng.randrange(60) ** 2 // 60}", i): rng.randint(1, 1 + i // 20) for i in range(400) for _ in range(rng.randrange(1, 25))}
    rest = {(c, i): rng.random() * 5 for c in ("x", "y") for i in range(400) if rng.random() < 0.3}
    boost = {i: rng.random() for i in range(400)}
    asked = {q: {f"t{rng.randrange(70)}": rng.randint(1, 2) for _ in range(rng.randrange(1, 6))} for q in range(30)}
    kind = {q: rng.choice(["x", "y", "z"]) for q in asked}
    hits = {
        (q, i): sum(times * counts.get((t, i), 0) for t, times in terms.items()) for q, terms in asked.items() for i in range(400)
    }

    def score(q, i):
        return 2.0 * hits[q, i] + max(rest.get((kind[q], i), 0.0), boost[i])

    least = {q: sorted((score(q, i) for i in range(400)), reverse=True)[4] for q in asked}
    postings = staged(in_groups(spark.createDataFrame([(t, i, n) for (t, i), n in counts.items()], "term string, item int, n int")), "p")
    wanted = spark.createDataFrame(
        [(q, t, n, 2.0 * n, kind[q], least[q]) for q, terms in asked.items() for t, n in terms.items()],
        "query_id int, term string, times int, weight double, class string, threshold double",
    )
    groups = postings.select("item", "group").distinct()
    own = spark.createDataFrame([(c, i, max(r, boost[i])) for (c, i), r in rest.items()], "class string, item int, rest double")
    rests = groups.join(own, "item").groupBy("class", "group").agg(F.max("rest").alias("rest"))
    boosts = spark.createDataFrame(list(boost.items()), "item int, rest double")
    found = reachable(postings, wanted, rests, groups.join(boosts, "item").groupBy("group").agg(F.max("rest").alias("rest")))
    got = {(r["query_id"], r["item"]): r["n"] for r in found.collect()}
    assert all(hits[pair] == n for pair, n in got.items())
    reach = {pair for pair, n in hits.items() if n and score(*pair) >= least[pair[0]]}
    assert reach <= set(got) and len(got) < sum(n > 0 for n in hits.values()) / 2
    pairs = spark.createDataFrame(list(got), "query_id int, item int")
    assert {(r["query_id"], r["item"]): r["n"] for r in term_sums(pairs, postings, wanted).collect()} == got


def test_nth_in_group_with_a_hot_group(spark):
    rows = [(None if n % 50 == 0 else "hot" if n % 3 else f"g{n % 7}", n * 3) for n in range(2000)]
    found = nth_in_group(spark.createDataFrame(rows, "g string, at long"), "g", "at", "nth").collect()
    seen, expected = {}, {}
    for group, at in rows:
        seen[group] = seen.get(group, 0) + 1
        expected[at] = (group, seen[group])
    assert {r["at"]: (r["g"], r["nth"]) for r in found} == expected and len(found) == 2000
