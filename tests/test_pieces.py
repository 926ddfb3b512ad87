"""Full texts in pieces against the same texts in one row."""

import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.patterns import reach
from corpuslens.plans import entities, pieces
from corpuslens.plans.features import Lexicons, thread_features

LEX = Lexicons(
    topics={"work": ["dry needling", "work life balance", "stress"], "rates": ["rate", "cash pay", "a a"]},
    entities=[("credential", [r"\bPT\b", r"\bDPT PT\b"], True),
              ("software", [r"Jane\s+App\s*Two", r"Jane\s*App", r"a\s+a", r"Zoom"], False)],
    marketing=[r"before.{1,10}after", r"call to action", r"^zoom", r"end$", r"(?<=cash )pay"],
)
WORDS = [
    "Jane", "App", "Two", "janeapp", "a", "a", "a", "dry", "needling", "work", "life", "balance", "before", "after",
    "call", "to", "action", "cash", "pay", "pt", "DPT", "zoom", "Zoom https://a.ex/b?c=1,", "end", "stress", "rate",
]


def _tables(spark, texts):
    """Threads with nested comments, and the same as two flat tables."""
    threads = spark.createDataFrame(
        [(i, 100 - i, f"t{i}", "2024-01-01", f"u{i}", post, "") for i, (post, _) in enumerate(texts)],
        "ord_raw long, createdAt_ts long, thread_id string, createdAt_iso string, url string, "
        "text_clean string, text_raw string",
    )
    rows = [(i, c, text, "") for i, (_, replies) in enumerate(texts) for c, text in enumerate(replies)]
    comments = spark.createDataFrame(rows, "ord_raw long, idx long, text_clean string, text_raw string")
    nested = comments.groupBy("ord_raw").agg(
        F.array_sort(F.collect_list(F.struct("idx", "text_clean", "text_raw"))).alias("comments")
    )
    return threads.join(nested, "ord_raw", "left"), threads, comments


def _found(whole, cut):
    """Entities, topics, tags and links of both forms, as comparable values."""

    def places(frame):
        rows = entities.entity_occurrences(frame).orderBy("seen_at").collect()
        return [(r.thread_id, r.entity, r.category) for r in rows]

    def links(frame, *order):
        rows = frame.select("ord_raw", *order, F.posexplode("links").alias("at", "link"))
        return [(r.ord_raw, r.link) for r in rows.orderBy("ord_raw", *order, "at").collect()]

    tags = {r.ord_raw: r.tags for r in whole.where("size(tags) > 0").collect()}
    scores = {(r.ord_raw, s.topic): s.score for r in whole.collect() for s in r.scores}
    return (
        (places(whole), links(whole), tags, scores),
        (
            places(cut), links(cut, "piece"), {r.ord_raw: r.tags for r in pieces.thread_tags(cut, LEX).collect()},
            {(r.ord_raw, r.topic): r.score for r in pieces.topic_hits(cut).collect()},
        ),
    )


def _some(rng, words):
    return " ".join(rng.choices(words, k=rng.randint(0, 3)))


@pytest.mark.parametrize("per_block", [1, 3, 32])
def test_pieces_find_what_whole_texts_do(spark, per_block):
    rng = random.Random(per_block)
    texts = [(_some(rng, WORDS), [_some(rng, WORDS) for _ in range(rng.randint(0, 40))]) for _ in range(60)]
    texts += [("", []), (None, [None, "", "zoom"]), ("Jane", [""] * 200 + ["App"]), ("a", [" a"] * 50), ("x" * 5000, ["pt"] * 3)]
    nested, threads, comments = _tables(spark, texts)
    whole = thread_features(nested, LEX, only=["links", "entities", "tags", "scores"]).cache()
    cut = pieces.piece_features(threads, comments, LEX, per_block=per_block).cache()
    want, got = _found(whole, cut)
    assert got == want


def test_pieces_are_the_whole_text(spark):
    rng = random.Random(5)
    filler = ["and so it goes on for a good while", "with nothing of note in this one at all", "stress"]
    texts = [("first", [rng.choice(filler) for _ in range(6000)]), ("", ["b"]), ("alone", [])]
    _, threads, comments = _tables(spark, texts)
    rows = pieces.full_text_pieces(threads, comments, LEX, per_block=16).orderBy("ord_raw", "piece").collect()
    for i, (post, replies) in enumerate(texts):
        assert " ".join(r.text for r in rows if r.ord_raw == i) == " ".join([post, *replies])
    lengths = [len(r.text) for r in rows if r.ord_raw == 0]
    assert len(lengths) > 350 and max(lengths) < 16 * 40 * 3


def test_gaps_orphans_and_empty_tables(spark):
    _, threads, comments = _tables(spark, [("Jane", ["App"]), ("pt", ["x"])])
    far = comments.withColumn("idx", F.col("idx") * 1000 + 500)
    orphans = spark.createDataFrame([(77, 0, "zoom", ""), (77, 9, "pt", "")], comments.schema)
    found = entities.entity_occurrences(pieces.piece_features(threads, far.union(orphans), LEX, per_block=2))
    assert sorted((r.thread_id, r.entity) for r in found.collect()) == [("t0", "JANE APP"), ("t1", "PT")]
    assert pieces.piece_features(threads.where("false"), comments.where("false"), LEX).collect() == []
    assert {r.ord_raw for r in pieces.piece_features(threads, comments.where("false"), LEX).collect()} == {1}


def test_reach():
    assert reach(r"Jane\s+App") == 8
    assert reach(r"before.{1,10}after") == 21
    assert reach(r"\w+[^\s]*") == 0
    with pytest.raises(ValueError):
        reach(r"\w+\s\w+")
