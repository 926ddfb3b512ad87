"""The whole job on a small generated dump, checked with plain Python."""

import csv
import glob
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpuslens.lexicons import STOP_WORDS, TOPICS
from corpuslens.plans import ingest, pack, retrieval, topics
from corpuslens.plans.features import thread_features
from corpuslens.sources import readers
from corpuslens.streaming import scoring

PIECES = [
    "What do you charge per session?", "Eval is $150-200, 80/hr", "see https://www.ex.com/a?utm_x=1&b=2.",
    "and (https://docs.ex.org/p;v?ref=z#top)", "PT and DPT", "Jane App or Zoom", "OCS", "“quoted”, with comma",
    "insurance, LLC", "marketing\n\ntestimonial", "dry needling course", "https://facebook.com/x", "referral script",
    "$20 per visit", "ok", "  spaced   out ",
]
QUERY = "CEU course certification cost: course per session worth it"


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    rng = random.Random(4)
    posts = []
    for i in range(160):
        post = {
            "url": f"https://f.com/groups/g/permalink/{i // 2 * 2 if i % 40 == 1 else i}/" if i % 3 else f"https://f.com/p/{i}",
            "createdAt": 1690000000 + rng.randint(0, 40) * 864000 if i % 17 else 0,
            "text": " ".join(rng.choices(PIECES, k=rng.randint(0, 4))),
            "user": {"name": f"u{i % 5}", "url": "https://f.com/u"},
            "reactionCount": rng.randint(0, 9), "commentCount": rng.randint(0, 5), "shareCount": rng.randint(0, 2),
            "topComments": [
                {"url": f"https://f.com/c?comment_id={i * 10 + c}" if c % 2 else None, "createdAt": 0,
                 "text": rng.choice(PIECES + [""]), "author": {"name": "a"}}
                for c in range(rng.randint(0, 12))
            ],
        }
        if i % 23 == 0:
            del post["topComments"], post["user"]
        posts.append(post)
    path = tmp_path_factory.mktemp("dump") / "dump.json"
    path.write_text(json.dumps(posts, ensure_ascii=False), encoding="utf-8")
    return str(path), posts


@pytest.fixture(scope="module")
def built(spark, dump, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    threads = pack.clean_dump(spark, dump[0], f"{out}/clean")
    tables = pack.build_pack(threads, f"{out}/pack", topn=20)
    return out, threads, tables


def lines(folder):
    return [json.loads(x) for f in sorted(glob.glob(f"{folder}/part-*")) for x in open(f, encoding="utf-8")]


def cells(folder):
    rows = []
    for name in sorted(glob.glob(f"{folder}/part-*")):
        with open(name, newline="", encoding="utf-8") as f:
            part = list(csv.reader(f))
        rows += part if not rows else part[1:]
    return [dict(zip(rows[0], r)) for r in rows[1:]]


def clean(text):
    return re.sub(r"\s+", " ", text or "").strip()


def ordered(posts):
    return sorted(range(len(posts)), key=lambda i: -posts[i]["createdAt"])


def full(post):
    return " ".join([clean(post["text"])] + [clean(c["text"]) for c in post.get("topComments", [])])


def engagement(post):
    return post["reactionCount"] + 2 * post["commentCount"] + 3 * post["shareCount"]


def test_clean_files(built, dump):
    out, posts = built[0], dump[1]
    threads = lines(f"{out}/clean/threads")
    assert [t["ord_raw"] for t in threads] == ordered(posts)
    assert [t["text_clean"] for t in threads] == [clean(posts[i]["text"]) for i in ordered(posts)]
    assert all(set(t) == set(threads[0]) for t in threads)  # null fields are written
    comments = lines(f"{out}/clean/comments")
    assert [c["text_clean"] for c in comments] == [
        clean(c["text"]) for p in posts for c in p.get("topComments", [])
    ]
    (stats,) = lines(f"{out}/clean/stats")
    assert stats["threads_count"] == 160 and stats["comments_count"] == len(comments)
    assert stats["total_shares"] == sum(p["shareCount"] for p in posts)


def test_engagement_and_money_files(built, dump):
    out, posts = built[0], dump[1]
    top = cells(f"{out}/pack/engagement_threads_top")
    want = sorted(ordered(posts), key=lambda i: -engagement(posts[i]))[:20]
    assert [r["url"] for r in top] == [posts[i]["url"] for i in want]
    assert [r["rank"] for r in top] == [str(n) for n in range(1, 21)]
    mentions = cells(f"{out}/pack/money_mentions")
    texts = []
    for i in ordered(posts):
        texts += [clean(posts[i]["text"])] + [clean(c["text"]) for c in posts[i].get("topComments", [])]
    price = re.compile(r"\$150(?!\d)|\$20(?!\d)")
    found = [m["matched_text"] for m in mentions if price.fullmatch(m["matched_text"])]
    assert found == [m for t in texts for m in price.findall(t)]
    ranges = [m for m in mentions if m["matched_text"] == "$150-200"]
    assert ranges and all(m["amount_values"] == "150.0|200.0" for m in ranges)


def test_link_and_entity_files(built, dump):
    out, posts = built[0], dump[1]
    order = ordered(posts)
    urls = {"https://www.ex.com/a?utm_x=1&b=2": "https://www.ex.com/a?b=2", "https://docs.ex.org/p;v?ref=z#top": "https://docs.ex.org/p"}
    counts = Counter()
    for i in order:
        for raw, canonical in urls.items():
            if raw in full(posts[i]):
                counts[canonical] += full(posts[i]).count(raw)
    rows = cells(f"{out}/pack/links_all")
    assert {r["url_canonical"]: int(r["counts"]) for r in rows} == dict(counts)
    domains = cells(f"{out}/pack/domains_top")
    assert {r["domain"] for r in domains} == {"ex.com", "docs.ex.org"}
    entities = cells(f"{out}/pack/resources_entities")
    dpt = next(r for r in entities if r["entity"] == "DPT")
    holders = [i for i in order for _ in re.findall(r"\bDPT\b", full(posts[i]).upper())]
    assert int(dpt["count_mentions"]) == len(holders)
    assert dpt["sample_urls"].split("|") == [posts[i]["url"] for i in holders[:5]]
    assert int(dpt["doc_count_threads"]) == len(set(dpt["sample_thread_ids"].split("|")))
    assert [int(r["count_mentions"]) for r in entities] == sorted((int(r["count_mentions"]) for r in entities), reverse=True)


def test_topic_index_file(spark, built, dump):
    out, posts = built[0], dump[1]
    (document,) = lines(f"{out}/pack/topic_index")
    assert list(document["topics"]) == list(TOPICS)
    for topic, words in TOPICS.items():
        scored = []
        for i in ordered(posts):
            score = sum(full(posts[i]).lower().count(w) for w in words)
            if score:
                scored.append((score * 0.7 + engagement(posts[i]) * 0.3, posts[i]["url"]))
        best = sorted(scored, key=lambda s: -s[0])[:50]
        assert document["topics"][topic]["top_urls"] == [u for _, u in best]
        assert document["topics"][topic]["keywords"] == words
    index = readers.read_topic_index(spark, f"{out}/pack/topic_index")
    assert [r["topic"] for r in index.orderBy("topic_pos").collect()] == list(TOPICS)


def test_counts_agree(built, dump):
    out, posts = built[0], dump[1]
    (report,), (counts,) = lines(f"{out}/pack/report"), lines(f"{out}/pack/pack_counts")
    assert report["threads"] == counts["threads"] == 160 and counts["topics"] == 9
    assert report["money_mentions"] == len(cells(f"{out}/pack/money_mentions"))
    assert report["unique_entities"] == len(cells(f"{out}/pack/resources_entities"))
    descending = sorted((engagement(p) for p in posts), reverse=True)
    assert (report["p90"], report["p50"]) == (descending[16], descending[80])


def evidence_in_python(posts, document, query, ids):
    keywords = [w for w in re.findall(r"\b[a-zA-Z0-9]+\b", query.lower()) if w not in STOP_WORDS and len(w) > 2]
    overlap = {
        t: sum(any(k in w for w in e["keywords"]) for k in keywords) for t, e in document["topics"].items()
    }
    chosen = sorted((t for t in overlap if overlap[t]), key=lambda t: -overlap[t])[:3]
    words = list(dict.fromkeys(w for t in chosen for w in document["topics"][t]["keywords"]))
    bonus = {i for t in chosen for i in document["topics"][t]["top_thread_ids"]}
    scored = []
    for i in ordered(posts):
        comments = [clean(c["text"]) for c in posts[i].get("topComments", [])[:10]]
        text = clean(posts[i]["text"]).lower() + " " + " ".join(c for c in comments if c).lower()
        score = sum(2.0 * len(re.findall(rf"\b{k}\b", text)) for k in keywords)
        score += sum(text.count(w) for w in words)
        score += 0.5 * math.log1p(engagement(posts[i])) + (5 if ids[i] in bonus else 0)
        if score > 0:
            scored.append((round(score, 9), i))
    return sorted(scored, key=lambda s: -s[0])


def test_evidence_one_and_many_and_streamed(spark, built, dump, tmp_path):
    out, threads, tables = built
    posts = dump[1]
    (document,) = lines(f"{out}/pack/topic_index")
    ids = {r["ord_raw"]: r["thread_id"] for r in threads.collect()}
    entries = readers.read_topic_index(spark, f"{out}/pack/topic_index")
    want = evidence_in_python(posts, document, QUERY, ids)

    evidence = retrieval.evidence_pack(threads, entries, QUERY, 25)
    rows = evidence.collect()
    assert [(round(r["score"], 9), r["url"]) for r in rows] == [(s, posts[i]["url"]) for s, i in want[:25]]
    assert rows[0]["why_selected"].startswith("Matched keywords: ")
    assert len(rows[0]["comments_text"]) <= 5
    assert pack.write_evidence(evidence, f"{out}/evidence") == 25
    assert set(lines(f"{out}/evidence")[0]) == {
        "thread_id", "url", "createdAt_iso", "metrics", "post_text", "comments_text", "why_selected"
    }
    strict = retrieval.evidence_pack(threads, entries, "zzz", 25, require_match=True)
    assert strict.count() == 0
    assert retrieval.evidence_pack(threads, entries, "zzz", 25).count() == 25

    queries = [QUERY, "zzz", "referral script", "session hour session", "gym jane app", "PT ok spaced"]
    frame = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    many = retrieval.evidence_for_queries(threads, entries, frame, 12)
    got = {}
    for r in sorted(many.collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((round(r["score"], 9), r["ord_raw"]))
    for n, query in enumerate(queries):
        assert got[n] == evidence_in_python(posts, document, query, ids)[:12], query

    scores = scoring.stream_scores(spark, f"{out}/clean/threads", entries, QUERY)
    stream = scoring.start_scoring(scores, f"{tmp_path}/scores", f"{tmp_path}/checkpoint")
    assert stream.awaitTermination(120)
    best = scoring.best_so_far(spark.read.parquet(f"{tmp_path}/scores"), 25).collect()
    assert [r["ord_raw"] for r in best] == [i for _, i in want[:25]]


def test_files_read_back(spark, built):
    out, threads, _ = built
    again = readers.read_threads(spark, f"{out}/clean/threads")
    assert again.exceptAll(threads.select(again.columns)).count() == 0
    assert readers.read_comments(spark, f"{out}/clean/comments").count() == ingest.flatten_comments(threads).count()
    foreign = f"{out}/foreign"
    again.drop("ord_raw").orderBy("url").coalesce(1).write.json(foreign)
    numbered = readers.read_threads(spark, foreign, numbered=False)
    assert [r["url"] for r in numbered.orderBy("ord_raw").collect()] == sorted(r["url"] for r in again.collect())


def test_many_files_are_numbered_in_name_order(spark, tmp_path):
    sizes = [3, 500, 1, 120]
    for n, size in enumerate(sizes):
        rows = [json.dumps({"url": f"{n}-{i:04d}", "text": "x" * 50}) for i in range(size)]
        (tmp_path / f"part-{n}.json").write_text("\n".join(rows))
    posts = readers.read_posts(spark, str(tmp_path), lines=True).orderBy("ord_raw").collect()
    assert [p["url"] for p in posts] == [f"{n}-{i:04d}" for n, size in enumerate(sizes) for i in range(size)]
    big = tmp_path / "big"
    big.mkdir()
    rows = [json.dumps({"url": f"{i:06d}", "text": "y" * 300}) for i in range(40000)]
    (big / "one file.json").write_text("\n".join(rows))
    frame = readers.read_posts(spark, str(big), lines=True)
    assert [p["url"] for p in frame.select("url", "ord_raw").orderBy("ord_raw").collect()] == [
        f"{i:06d}" for i in range(40000)
    ]


def test_empty_corpus(spark, built):
    empty = built[1].where(F.lit(False))
    features = thread_features(empty)
    index = topics.topic_index(topics.topic_hits(features))
    assert topics.topic_entries(index).count() == 9
    assert ingest.cleaning_stats(empty).first()["date_min"] is None

def test_topics_of_many_keywords(spark):
    """A hundred thousand topic keywords against every pair of word and keyword."""
    rng = random.Random(9)
    stems = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(700)]
    lexicon = [[" ".join(rng.sample(stems, rng.randint(1, 2))).title() for _ in range(100)] for _ in range(1000)]
    entries = spark.createDataFrame(
        [(n, f"topic {n}", words, [f"t{n}", "both"]) for n, words in enumerate(lexicon)],
        "topic_pos int, topic string, keywords array<string>, top_thread_ids array<string>",
    )
    rare = ["".join(rng.choices("abcdefgh", k=k)) for k in (4, 5, 6) for _ in range(25)]
    asked = [rng.choices(rare + ["zzz", "qqqq"], k=rng.randint(0, 6)) for _ in range(40)] + [["zzz"], []]
    queries = spark.createDataFrame([(n, " ".join(words)) for n, words in enumerate(asked)], "query_id int, query string")
    lowered = [[k.lower() for k in words] for words in lexicon]
    holders = {w: {n for n, words in enumerate(lowered) if any(w in k for k in words)} for w in rare + ["zzz", "qqqq"]}
    want, best = set(), {}
    for q, words in enumerate(asked):
        overlap = Counter(n for w in words for n in holders[w])
        best[q] = sorted(overlap, key=lambda n: (-overlap[n], n))[:3]
        want |= {(q, n, overlap[n], rank) for rank, n in enumerate(best[q], 1)}
    got = retrieval.query_topics(queries, entries).collect()
    assert {(r.query_id, r.topic_pos, r.overlap, r.topic_rank) for r in got} == want
    plans = {r.query_id: r for r in retrieval.query_plans(queries, entries).collect()}
    assert len(plans) == len(asked)
    for q, topics_of in best.items():
        assert plans[q].topic_keywords == list(dict.fromkeys(w for n in topics_of for w in lexicon[n]))
        assert plans[q].bonus_ids == list(dict.fromkeys(i for n in topics_of for i in (f"t{n}", "both")))
        assert plans[q].topic_set == "|".join(map(str, sorted(topics_of)))
    one = retrieval.single_query_plan(entries, " ".join(asked[3]))
    assert one == (plans[3].keywords, plans[3].topic_keywords, plans[3].bonus_ids)
