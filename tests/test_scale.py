import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import money
from corpuslens.functions.patterns import keeps_off
from corpuslens.lexicons import MONEY_CONTEXT, MONEY_PATTERNS
from corpuslens.operators import seams
from corpuslens.operators.staging import drop_staged, shuffles_removed
from corpuslens.plans import pack, retrieval
from corpuslens.plans.features import thread_features
from corpuslens.plans.money import comment_mentions, money_mentions_table
from corpuslens.sources import arrays
from corpuslens.sources.writers import _bracketed


def test_dumps_are_worked_on_in_parts():
    entries = [f'{{"a":"{i}{"x" * 5000}"}}' for i in range(3000)]
    batch = pa.RecordBatch.from_pydict({"value": pa.array(entries)})
    parts = list(_bracketed(iter([batch])))
    assert max(p.nbytes for p in parts) < 2 * arrays.PART_BYTES
    assert "".join(v for p in parts for v in p.column(0).to_pylist()) == "[" + ",".join(entries) + "]"
    cells = [f'{{"a":"{i}{"x" * 5000}"'.encode() for i in range(3000)]
    run = pa.RecordBatch.from_pydict({"value": pa.array(cells), "_split": [0] * 3000})
    stretches = [data for _, _, data in arrays._runs(run)]
    assert max(map(len, stretches)) < 2 * arrays.PART_BYTES
    assert b"".join(stretches) == b"}".join(cells) + b"}"


@pytest.mark.parametrize("gap", [" ", "  ", "\t \n"])
def test_ends_of_blocks_are_cut_once(spark, monkeypatch, gap):
    plans = {}
    staged = seams.staged

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return staged(df, name)

    monkeypatch.setattr(seams, "staged", seen)
    openings = spark.createDataFrame([(1, "see the"), (2, None)], "k long, text string")
    parts = spark.createDataFrame([(1, 0, f"mit{gap}"), (1, 1, f"{gap}license"), (1, 2, "over"), (2, 0, gap)], "k long, i long, text string")
    rows = seams.pieces(openings, parts, "k", "i", [seams.Look(r"mit\s+license", "", 11)], per_block=1).collect()
    whole = {}
    for row in sorted(rows):
        whole.setdefault(row["k"], []).append(row["text"])
    assert " ".join(whole[1]) == f"see the mit{gap} {gap}license over"
    assert any(f"mit{gap} {gap}license" in t for t in whole[1])
    # Ordering by ranges reads its rows twice.
    assert "regexp" not in plans["ends"].lower() and "rlike" not in plans["ends"].lower()


def test_records_search_each_text_once(spark):
    """Not once per keyword and query: nothing within a search for keywords is built from the text."""
    kind = "array<struct<text_clean string, text_raw string>>"
    threads = spark.createDataFrame(
        [(n, f"t{n}", "u", "2022", n, f"Rate {n} of License", None, [("the rate", None)]) for n in range(5)],
        f"ord_raw long, thread_id string, url string, createdAt_iso string, createdAt_ts long, text_clean string, text_raw string, comments {kind}",
    ).withColumn("metrics", F.struct(*[F.lit(1).cast("long").alias(c) for c in ("reactionCount", "shareCount", "commentCount")]))
    entries = spark.createDataFrame(
        [(0, "money", ["Rate", "Lic"], ["t3"], ["u"])],
        "topic_pos int, topic string, keywords array<string>, top_thread_ids array<string>, top_urls array<string>",
    )
    asked = spark.createDataFrame([(1, "license rate rate"), (2, "zzz")], "query_id long, query string")
    one = retrieval.evidence_pack(threads, entries, "license rate rate", 2)
    chosen = retrieval.evidence_for_queries(threads, entries, asked, 2)
    many = retrieval.evidence_records(threads, entries, asked, chosen)
    for found in (one, many.where("query_id = 1")):
        reasons = [r["why_selected"].split(";")[0] for r in found.orderBy("rank").collect()]
        assert reasons == ["Matched keywords: license, rate, rate, Rate, Lic"] * 2
    for frame in (one, many):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" in plan and "array_contains(regexp_extract_all" not in plan and "Contains(concat" not in plan


def test_prices_of_joined_texts_are_those_of_each():
    """Many texts are searched as one, unless a pattern looks beyond what it matches."""
    texts = ["$20", "5 to", "9 dollars", "x", "", "a\0$7\0b", "Σ SESSION ΌΣ 30/hr ΣΑΣ", "İİ visit 40 per visit", "80", "per hour", "٣/hr"] * 3
    looking = [r"\d+$", r"(?<!\w)(\d{1,4})(?!\d)", r"^(\d+)", r"(\d+)[^a]*"]
    assert all(keeps_off(p, "\0") for p in MONEY_PATTERNS) and not any(keeps_off(p, "\0") for p in looking)
    options = {"window": 3, "patterns": MONEY_PATTERNS + looking, "families": MONEY_CONTEXT | {"end": ["ς"]}, "with_context": True}
    both = [pa.array(c, pa.string()) for c in (texts, [t.lower() for t in texts])]
    together = money._search(*both, **options).to_pylist()
    for text, found in zip(texts, together):
        want = []
        for number, pattern in enumerate(options["patterns"], 1):
            for m in re.finditer(pattern, text.lower()):
                amounts = [float(g) for g in m.groups() if g and 1 <= float(g) <= 9999]
                near = text[max(m.start() - 3, 0):min(m.end() + 3, len(text))]
                tags = [tag for tag, words in options["families"].items() if any(w in near.lower() for w in words)]
                if amounts:
                    want.append((number, m.group(), amounts, tags, " ".join(near.split())))
        assert [tuple(m.values()) for m in found] == want, text


def test_prices_in_posts_and_comments_are_not_searched_step_by_step(spark):
    """Functions on arrays are interpreted: none goes over the matches of a text or over its mentions."""
    comment = "struct<comment_id string, createdAt_iso string, url string, text_clean string, text_raw string>"
    threads = spark.createDataFrame(
        [(1, 5, "t1", "2022", "u", "$20 each", None, [("c0", "2022", "v", "no price", None), ("c1", "2022", "w", None, "9/hr, 5 to 7")]),
         (2, 5, "t2", "2022", "u", "1", None, [("c2", "2022", "v", "3", None), None]), (3, 5, "t3", "2022", "u", None, None, None)],
        f"ord_raw long, createdAt_ts long, thread_id string, createdAt_iso string, url string, text_clean string, text_raw string, comments array<{comment}>",
    )
    features = thread_features(threads, only=["money", "snippet_200", "comment_money"], context=True)
    table = money_mentions_table(features)
    rows = sorted((r["place"]["comment"], r["place"]["match_at"], r["comment_id"], r["source_type"], r["matched_text"]) for r in table.collect())
    assert rows == [(-1, 0, "", "thread", "$20"), (0, 0, "c1", "comment", "5 to 7"), (0, 1, "c1", "comment", "9/hr")]
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "aggregate(" not in plan and "flatten" not in plan


def test_comments_meet_threads_before_their_mentions_part(spark):
    comments = spark.createDataFrame(
        [(1, "c1", None, "u", 0, "5 to 7 or 9/hr", None), (4, "c4", None, "u", 1, "$3", None), (1, "c5", None, "u", 2, "none 5", None)],
        "ord_raw long, comment_id string, createdAt_iso string, url string, idx long, text_clean string, text_raw string",
    )
    threads = spark.createDataFrame([(1, 5, "t1")], "ord_raw long, createdAt_ts long, thread_id string")
    found = comment_mentions(comments, threads)
    rows = sorted((r["comment_id"], r["thread_id"], r["place"]["match_at"], r["matched_text"]) for r in found.collect())
    assert rows == [("c1", "t1", 0, "5 to 7 "), ("c1", "t1", 1, "9/hr"), ("c4", None, 0, "$3")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("Join") and "regexp_extract" not in plan


def test_cleaning_keeps_one_form_of_each_text_beside_its_outputs(spark, tmp_path, monkeypatch):
    """What is staged and sorted are the raw posts; a dump made on the way goes when they are read."""
    post = {"url": "https://h/p/1", "createdAt": 5, "text": " a  b ", "topComments": [{"url": "u", "text": " c\t"}, None, {"url": "?comment_id=7", "text": ""}]}
    posts = [post, {"url": "https://h/p/2", "createdAt": 9, "text": None}, {"url": None, "topComments": []}]
    (tmp_path / "dump").mkdir()
    (tmp_path / "dump" / "part-0").write_text(json.dumps(posts))
    sorted_plans, kinds = [], []
    written = pack.write_json

    def seen(df, path, **options):
        sorted_plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        kinds.append(spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"))
        written(df, path, **options)

    monkeypatch.setattr(pack, "write_json", seen)
    threads = pack.clean_dump(spark, str(tmp_path / "dump"), str(tmp_path / "out"), drop_dump=True)
    assert not (tmp_path / "dump").exists()
    assert kinds == ["true"] * 3 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    for plan in sorted_plans[:2]:
        below = plan[plan.index("Sort ["):]
        assert "regexp_replace" not in below and "regexp_replace" in plan
    assert sorted(r["text_clean"] for r in threads.collect()) == ["", "", "a b"]
    found = [json.loads(x) for f in sorted((tmp_path / "out" / "threads").glob("part-*")) for x in f.read_text().splitlines()]
    assert [t["url"] for t in found] == ["https://h/p/2", "https://h/p/1", ""]
    rows = [json.loads(x) for f in sorted((tmp_path / "out" / "comments").glob("part-*")) for x in f.read_text().splitlines()]
    assert rows == found[1]["comments"] and [c["text_clean"] for c in rows] == ["c", "", ""]
    assert rows[1]["comment_id"] == found[1]["thread_id"] + "_comment_1" and rows[2]["comment_id"] == "comment_7"
    files = threads.inputFiles()
    drop_staged(threads)
    assert files and not any((tmp_path / f.removeprefix("file://")).exists() for f in files)


def test_shuffles_of_a_write_are_removed_only_within(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), shuffles_removed(spark):
        assert spark.conf.get(name) == "true"
        1 / 0
    assert spark.conf.get(name) == before
