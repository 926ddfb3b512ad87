"""One named query per operator group. Array columns leave as joined text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.catalog import adapters as ad
from corpuslens.functions import text as tx
from corpuslens.functions.patterns import fold_case
from corpuslens.functions.entities import pattern_tags, required_words
from corpuslens.functions.keywords import keyword_counts, present
from corpuslens.functions.urls import canonical_url, domain, extract_urls
from corpuslens.lexicons import OWN_DOMAIN_PREFIXES, TOPICS
from corpuslens.operators.ordering import nth_in_group, thread_order
from corpuslens.operators.staging import drop_staged, fresh_path, shuffles_removed, staged
from corpuslens.operators.topk import number_rows
from corpuslens.plans import (
    engagement, entities, ingest, links, marketing, money, pieces, report, retrieval, topics,
)
from corpuslens.plans.features import Lexicons, thread_features
from corpuslens.plans.pack import build_pack, clean_dump, write_evidence
from corpuslens.sources.readers import read_comments, read_evidence, read_posts, read_threads, read_topic_index
from corpuslens.sources.writers import write_array, write_csv, write_json

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# Patterns that occur in the test tables; the default lists hardly do.
TEST_ENTITIES = [
    ("credential", [r"\bTHE\b", r"\bEN\b", r"\bMIT\b", r"\bTION\b"], True),
    ("ceu_provider", [r"MIT\s+License", r"Heno", r"than\s*the", r"Apache License"], False),
    ("software", [r"in\s+the", r"Mit", r"nicht", r"Version"], False),
]
TEST_MARKETING = [
    r"license", r"version", r"th.{1,4}ing", r"nicht", r"pour", r"from", r"would", r"heno", r"para"
]
TEST_QUERY = "What license rate is worth it, nicht pour than the rate from ortho"
TEST_LEXICONS = Lexicons(entities=TEST_ENTITIES, marketing=TEST_MARKETING)


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def pipe(name: str):
    return F.array_join(F.col(name).cast("array<string>"), "|").alias(name)


# ---------------------------------------------------------------- cleaning


@query
def clean_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Raw posts to cleaned threads, counters joined afterwards."""
    threads = ad.threads(spark, sf).drop("comments", "text_raw")
    return ad.with_metrics(spark, sf, threads).select("*", "metrics.*").drop("metrics")


@query
def threads_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of the threads in thread order, the order of the cleaned file."""
    keys = ad.threads(spark, sf, keys_only=True).select("thread_id", "createdAt_iso", "createdAt_ts", "ord_raw")
    return keys.orderBy(*thread_order())


@query
def clean_comments(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.clean_flat_comments(
        ad.raw_comments(spark, sf), ad.threads(spark, sf, keys_only=True)
    ).drop("text_raw")


@query
def nested_comments(spark: SparkSession, sf: str) -> DataFrame:
    """The comments inside the threads, one row each."""
    return ingest.flatten_comments(ad.threads_with_comments(spark, sf)).drop("text_raw")


def _counted_threads(spark: SparkSession, sf: str) -> DataFrame:
    """Thread keys with metrics and number of comments; no texts."""
    keys = ad.threads(spark, sf, keys_only=True).select("ord_raw", "thread_id", "createdAt_ts", "createdAt_iso", "url")
    counted = ad.with_metrics(spark, sf, keys).join(ad.comment_counts(spark, sf), "ord_raw", "left")
    return counted.withColumn("comments_n", F.coalesce("comments_n", F.lit(0)))


@query
def cleaning_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.cleaning_stats(_counted_threads(spark, sf))


@query
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The three snippet lengths in use, over whole documents."""
    text = F.col("text")
    return ad.texts(spark, sf, "documents", "doc_id").select(
        "doc_id", *[tx.snippet(text, n).alias(f"snippet_{n}") for n in (100, 200, 300)]
    )


# -------------------------------------------------------------- engagement


@query
def threads_per_month(spark: SparkSession, sf: str) -> DataFrame:
    return engagement.threads_per_month(ad.threads(spark, sf, keys_only=True))


@query
def top_months(spark: SparkSession, sf: str) -> DataFrame:
    return engagement.top_months(ad.threads(spark, sf, keys_only=True))


@query
def months_of_orders(spark: SparkSession, sf: str) -> DataFrame:
    """The five busiest of some eighty months."""
    return engagement.top_months(ad.money_threads(spark, sf))


@query
def engagement_top(spark: SparkSession, sf: str) -> DataFrame:
    keys = ad.threads(spark, sf, keys_only=True).select("ord_raw", "createdAt_ts", "thread_id", "createdAt_iso", "url")
    return engagement.engagement_top(ad.with_metrics(spark, sf, keys), 300, ad.threads(spark, sf))


@query
def engagement_order_stats(spark: SparkSession, sf: str) -> DataFrame:
    return engagement.engagement_order_stats(ad.post_metrics(spark, sf))


@query
def reaction_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return engagement.reaction_histogram(ad.post_metrics(spark, sf)).select("bin", "n")


# ------------------------------------------------------------------- money


def _mention_columns(mentions: DataFrame, *more: str) -> DataFrame:
    return mentions.select(
        "source_type", "thread_id", "comment_id", "createdAt_iso", "url", "pattern_pos",
        "matched_text", pipe("amount_values"), pipe("context_tags"), "text_snippet", *more,
    )


def _money_features(spark: SparkSession, sf: str) -> DataFrame:
    return thread_features(ad.money_threads(spark, sf), only=["money", "snippet_200"])


@query
def money_mentions(spark: SparkSession, sf: str) -> DataFrame:
    features = _money_features(spark, sf)
    return _mention_columns(money.money_mentions_table(features)).drop("comment_id", "source_type")


@query
def money_mentions_union(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions in posts and in a flat table of comments."""
    posts = money.money_mentions_table(_money_features(spark, sf))
    comments = money.comment_mentions(ad.money_comments(spark, sf), ad.money_threads(spark, sf))
    return _mention_columns(posts.unionByName(comments))


@query
def money_mentions_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions in posts and in the comments inside them, with the words around."""
    threads = ad.money_threads_with_comments(spark, sf)
    features = thread_features(threads, only=["money", "snippet_200", "comment_money"], context=True)
    mentions = money.money_mentions_table(features)
    return _mention_columns(mentions, "context_snippet")


@query
def money_per_month(spark: SparkSession, sf: str) -> DataFrame:
    return money.money_per_month(thread_features(ad.money_threads(spark, sf), only=["money"]))


# ------------------------------------------------------------------- links


@query
def extract_links(spark: SparkSession, sf: str) -> DataFrame:
    """URLs in texts as written, with their place."""
    texts = ad.link_threads(spark, sf).select("thread_id", tx.post_text().alias("post"))
    return texts.select("thread_id", F.posexplode(extract_urls("post")).alias("place", "url_found"))


@query
def canonical_links(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical form and domain of page addresses outside the forum's own site."""
    pages = ad.texts(spark, sf, "pages", "page_id").select("page_id", canonical_url("url").alias("url_canonical"))
    pages = pages.withColumn("domain", domain("url_canonical")).where("domain <> ''")
    for prefix in OWN_DOMAIN_PREFIXES:
        pages = pages.where(~F.col("domain").startswith(prefix))
    return pages


def _link_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return links.link_occurrences(thread_features(ad.link_threads(spark, sf), only=["links"]))


@query
def links_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rolled = links.links_rollup(staged(_link_occurrences(spark, sf), "links"))
    return rolled.orderBy(F.col("counts").desc(), "first_at").select(
        "url_canonical", "domain", "counts", pipe("sample_thread_ids"), pipe("sample_urls"),
        "first_seen_iso", "last_seen_iso",
    )


@query
def domains_top(spark: SparkSession, sf: str) -> DataFrame:
    urls = staged(links.url_counts(_link_occurrences(spark, sf)), "urls")
    return links.domains_top(urls).orderBy(F.col("counts").desc(), "first_at").select(
        "domain", "counts", pipe("sample_urls")
    )


@query
def domains_composed(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred of 150 domains, many with the same count."""
    rows = links.link_occurrences(thread_features(ad.composed_threads(spark, sf), only=["links"]))
    return links.domains_top(staged(links.url_counts(rows), "urls")).select("domain", "counts", pipe("sample_urls"))


@query
def domains_by_unique_url(spark: SparkSession, sf: str) -> DataFrame:
    return links.domains_by_unique_url(links.url_counts(_link_occurrences(spark, sf)), 15)


# ---------------------------------------------------------------- entities


@query
def entities_found(spark: SparkSession, sf: str) -> DataFrame:
    features = thread_features(ad.threads_with_comments(spark, sf), TEST_LEXICONS, only=["entities"])
    rows = staged(entities.entity_occurrences(features), "entities")
    return entities.entities_rollup(rows).select(
        "entity", "category", "count_mentions", "doc_count_threads", "doc_count_all",
        pipe("sample_thread_ids"), pipe("sample_urls"),
    )


@query
def entities_top(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred entities of the written table: most mentions first, then first seen."""
    features = thread_features(ad.threads_with_comments(spark, sf), TEST_LEXICONS, only=["entities"])
    rolled = entities.entities_rollup(staged(entities.entity_occurrences(features), "entities"))
    return number_rows(rolled, [F.col("count_mentions").desc(), F.col("first_at")], 100).select(
        "rank", "entity", "count_mentions"
    )


@query
def entities_default_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions per entity and category with the default pattern lists."""
    rows = entities.entity_occurrences(thread_features(ad.threads_with_comments(spark, sf), only=["entities"]))
    return rows.groupBy("entity", "category").agg(F.count("*").alias("count_mentions"))


# --------------------------------------------------------------- marketing


@query
def marketing_candidates(spark: SparkSession, sf: str) -> DataFrame:
    features = thread_features(ad.threads_with_comments(spark, sf), TEST_LEXICONS, only=["tags", "snippet_300"])
    candidates = marketing.marketing_candidates(ad.with_metrics(spark, sf, features))
    return marketing.marketing_top(candidates).select(
        "thread_id", "createdAt_iso", "url", "engagement", pipe("tags_triggered"), "text_snippet",
        F.round("score", 6).alias("score"),
    )


@query
def marketing_composed(spark: SparkSession, sf: str) -> DataFrame:
    """The first five hundred of more candidates, nearly all with the same score, default patterns."""
    features = thread_features(ad.composed_threads(spark, sf), only=["tags", "snippet_300"])
    top = marketing.marketing_top(marketing.marketing_candidates(features))
    return top.select("thread_id", pipe("tags_triggered"), F.round("score", 6).alias("score"))


@query
def entities_composed(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that hold an example of each default pattern."""
    rows = entities.entity_occurrences(thread_features(ad.composed_threads(spark, sf), only=["entities"]))
    return rows.groupBy("entity", "category").agg(F.count("*").alias("count_mentions"))


@query
def pattern_join(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document and pattern found in it."""
    folded = fold_case(F.col("text"))
    texts = ad.texts(spark, sf, "documents", "doc_id").select(
        "doc_id", "text", present(keyword_counts(folded, required_words(TEST_MARKETING))).alias("words")
    )
    tags = pattern_tags("text", "words", TEST_MARKETING)
    return texts.select("doc_id", F.explode(tags).alias("pattern"))


# ------------------------------------------------------------------ topics


def _topic_hits(spark: SparkSession, sf: str) -> DataFrame:
    features = thread_features(ad.threads_with_comments(spark, sf), only=["scores"])
    return topics.topic_hits(features)


@query
def topic_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _topic_hits(spark, sf).select("ord_raw", "topic", "score")


def _topic_index(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_index(ad.with_metrics(spark, sf, _topic_hits(spark, sf)))


@query
def topic_index(spark: SparkSession, sf: str) -> DataFrame:
    return _topic_index(spark, sf).select(
        "topic", "rank", "thread_id", "url", "score", "engagement"
    )


@query
def topic_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The index as stored: one row per topic of the lexicon."""
    return topics.topic_entries(_topic_index(spark, sf)).select(
        "topic", "topic_pos", pipe("keywords"), pipe("top_thread_ids"), pipe("top_urls")
    )


# --------------------------------------------------- full texts in pieces
# The same tables from a flat table of comments: no row holds a thread's full text. Blocks
# of two comments make many seams out of the short threads of the test tables.


def _flat_comments(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.clean_flat_comments(ad.raw_comments(spark, sf), ad.threads(spark, sf, keys_only=True))


def _piece_features(spark: SparkSession, sf: str, only: list[str]) -> DataFrame:
    return pieces.piece_features(
        ad.threads(spark, sf), _flat_comments(spark, sf), TEST_LEXICONS, only, per_block=2
    )


@query
def entities_in_pieces(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities.entity_occurrences(_piece_features(spark, sf, ["numbered_entities"]))
    return entities.entities_rollup(staged(rows, "entities")).select(
        "entity", "category", "count_mentions", "doc_count_threads", "doc_count_all",
        pipe("sample_thread_ids"), pipe("sample_urls"),
    )


@query
def entities_over_seams(spark: SparkSession, sf: str) -> DataFrame:
    """Examples of the default patterns, every word a comment of its own."""
    threads, words = ad.in_words(ad.composed_threads(spark, sf))
    rows = entities.entity_occurrences(pieces.piece_features(threads, words, only=["numbered_entities"], per_block=2))
    return rows.groupBy("entity", "category").agg(F.count("*").alias("count_mentions"))


@query
def marketing_over_seams(spark: SparkSession, sf: str) -> DataFrame:
    """Marketing patterns in texts of which every word is a comment of its own."""
    threads, words = ad.in_words(ad.composed_threads(spark, sf))
    tags = pieces.thread_tags(pieces.piece_features(threads, words, only=["tags"], per_block=2))
    shown = thread_features(threads, only=["snippet_300"]).join(tags, "ord_raw")
    top = marketing.marketing_top(marketing.marketing_candidates(shown))
    return top.select("thread_id", pipe("tags_triggered"), F.round("score", 6).alias("score"))


@query
def links_in_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The link table of texts of which every word is a comment of its own."""
    threads, words = ad.in_words(ad.link_threads(spark, sf))
    rows = links.link_occurrences(pieces.piece_features(threads, words, only=["links"], per_block=2))
    return links.links_rollup(staged(rows, "links")).select(
        "url_canonical", "domain", "counts", pipe("sample_thread_ids"), pipe("sample_urls"),
        "first_seen_iso", "last_seen_iso",
    )


@query
def topic_scores_in_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.topic_hits(_piece_features(spark, sf, ["scores"])).select("ord_raw", "topic", "score")


# --------------------------------------------------------------- retrieval


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    return staged(topics.topic_entries(_topic_index(spark, sf)), "topic-entries")


@query
def query_keywords(spark: SparkSession, sf: str) -> DataFrame:
    queries = retrieval.queries_with_keywords(ad.free_text_queries(spark, sf))
    return queries.select("query_id", pipe("keywords"))


@query
def query_topics(spark: SparkSession, sf: str) -> DataFrame:
    entries = topics.lexicon_frame(spark, TOPICS).withColumn(
        "top_thread_ids", F.array().cast("array<string>")
    )
    return retrieval.query_topics(ad.free_text_queries(spark, sf), entries).select(
        "query_id", "topic", "overlap", "topic_rank"
    )


@query
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-word counts of three words in every document, German and French included."""
    lowered = ad.texts(spark, sf, "documents", "doc_id").select("doc_id", F.lower("text").alias("low"))
    return lowered.select(
        "doc_id", *[tx.word_count(F.col("low"), w).alias(f"n_{w}") for w in ("en", "the", "license")]
    )


@query
def comment_texts(spark: SparkSession, sf: str) -> DataFrame:
    """First five comment texts, and the text queries are matched against."""
    threads = ad.threads_with_comments(spark, sf, first=10)
    return threads.select(
        "ord_raw",
        F.array_join(tx.comment_texts(F.col("comments"), 5), "|").alias("first_five"),
        F.size(tx.comment_texts(F.col("comments"), 10)).alias("n_ten"),
        retrieval.scoring_text().alias("scoring_text"),
    )


@query
def full_text(spark: SparkSession, sf: str) -> DataFrame:
    return ad.threads_with_comments(spark, sf).select("ord_raw", tx.full_text().alias("full_text"))


def _evidence(spark: SparkSession, sf: str, k: int = 60) -> DataFrame:
    threads = ad.threads_with_comments(spark, sf, first=10)
    return retrieval.evidence_pack(
        threads, _entries(spark, sf), TEST_QUERY, k, metrics=ad.post_metrics(spark, sf)
    )


@query
def evidence_pack(spark: SparkSession, sf: str) -> DataFrame:
    return _evidence(spark, sf).select(
        "rank", "thread_id", "url", "createdAt_iso", "metrics.*", "post_text",
        pipe("comments_text"), "why_selected", F.round("score", 6).alias("score"),
    )


@query
def evidence_preview(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.evidence_preview(_evidence(spark, sf))


@query
def evidence_for_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Best ten threads for every benchmark passage asked as a question."""
    best = retrieval.evidence_for_queries(
        ad.threads_with_comments(spark, sf, first=10), _entries(spark, sf), ad.free_text_queries(spark, sf), 10,
        metrics=ad.post_metrics(spark, sf),
    )
    return best.select("query_id", "rank", "ord_raw", F.round("score", 6).alias("score"))


@query
def evidence_with_match(spark: SparkSession, sf: str) -> DataFrame:
    """Records of the best three threads for every benchmark passage that share a word
    with it or its topics, with the reasons."""
    threads = ad.threads_with_comments(spark, sf, first=10)
    entries, asked = _entries(spark, sf), ad.free_text_queries(spark, sf)
    best = retrieval.evidence_for_queries(
        threads, entries, asked, 3, metrics=ad.post_metrics(spark, sf), require_match=True
    )
    return retrieval.evidence_records(threads, entries, asked, staged(best, "chosen")).select(
        "query_id", "rank", "thread_id", "url", "createdAt_iso", "metrics.*", "post_text",
        pipe("comments_text"), "why_selected", F.round("score", 6).alias("score"),
    )


# ------------------------------------------------------------- round trips
# Written to the shared folder and read back, twice where the output replaces the first.


@query
def round_trip_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Raw posts as JSON lines, read with their place in the dump, and cleaned."""
    path = fresh_path(spark, "dump")
    posts = ad.posts_with_comments(spark, sf).orderBy("ord_raw")
    write_json(posts.drop("ord_raw"), path)
    return _posts_in_group(read_posts(spark, path, lines=True))


@query
def array_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Raw posts as files of one JSON array each, cut by bytes when read, and cleaned."""
    path = fresh_path(spark, "array")
    posts = ad.posts_with_comments(spark, sf).orderBy("ord_raw")
    write_array(posts.drop("ord_raw"), path)
    return _posts_in_group(read_posts(spark, path))


@query
def cleaned_dump(spark: SparkSession, sf: str) -> DataFrame:
    """The whole cleaning job, from a dump of JSON arrays to its three outputs, read back:
    every thread with its place in the file, its comments there and in their own file, and
    the totals."""
    dump, out = fresh_path(spark, "dump"), fresh_path(spark, "clean")
    with shuffles_removed(spark):
        write_array(ad.posts_with_comments(spark, sf).orderBy("ord_raw").drop("ord_raw"), dump)
    drop_staged(clean_dump(spark, dump, out, drop_dump=True))
    own = read_comments(spark, f"{out}/comments").groupBy("thread_id").agg(F.count("*").alias("in_own_file"))
    totals = spark.read.json(f"{out}/stats").select("threads_count", "comments_count", "date_min", "date_max")
    return read_threads(spark, f"{out}/threads").join(own, "thread_id", "left").select(
        "ord_raw", "thread_id", "createdAt_iso", "url", "text_clean", F.size("comments").alias("comments_n"),
        F.coalesce("in_own_file", F.lit(0)).alias("in_own_file"),
    ).join(F.broadcast(totals))


@query
def built_pack(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pack built from threads with comments and counters, its files read back:
    what each of four tables names, with its number."""
    out = fresh_path(spark, "pack")
    threads = ad.with_metrics(spark, sf, ad.threads_with_comments(spark, sf))
    build_pack(threads, out, lex=TEST_LEXICONS)

    def named(table: str, name: str, number: str) -> DataFrame:
        rows = spark.read.options(header=True, escape='"', lineSep="\r\n").csv(f"{out}/{table}")
        return rows.select(F.lit(table).alias("tbl"), F.col(name).alias("name"), F.col(number).cast("long").alias("number"))

    entries = read_topic_index(spark, f"{out}/topic_index")
    best = entries.select("topic", F.posexplode("top_thread_ids").alias("at", "thread_id")).select(
        F.lit("topic_index").alias("tbl"), F.concat_ws(":", "topic", "thread_id").alias("name"),
        (F.col("at") + 1).cast("long").alias("number"),
    )
    counted = spark.read.json(f"{out}/pack_counts").select(
        F.lit("pack_counts").alias("tbl"),
        F.explode(F.create_map(*[
            part for name in ("threads", "unique_entities", "marketing_candidates", "topics")
            for part in (F.lit(name), F.col(name))
        ])).alias("name", "number"),
    )
    return (
        named("engagement_threads_top", "thread_id", "rank")
        .unionByName(named("resources_entities", "entity", "count_mentions"))
        .unionByName(named("marketing_swipe_file", "thread_id", "engagement"))
        .unionByName(best).unionByName(counted)
    )


def _posts_in_group(posts: DataFrame) -> DataFrame:
    threads = staged(ingest.clean_threads(posts), "threads")
    numbered = nth_in_group(threads, "groupId", "ord_raw", "nth_in_group").drop("groupId")
    return threads.join(numbered, "ord_raw").select(
        "thread_id", "groupId", F.col("nth_in_group").cast("int").alias("nth_in_group"), "createdAt_ts", "text_clean",
        F.size("comments").alias("comments_n"),
    )


@query
def round_trip_threads(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "threads")
    threads = ingest.clean_threads(ad.posts_with_comments(spark, sf))
    for _ in range(2):
        write_json(threads, path)
    return read_threads(spark, path).select(
        "ord_raw", "thread_id", "createdAt_iso", "createdAt_ts", "url", "text_clean", F.size("comments").alias("comments_n")
    )


@query
def round_trip_comments(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "comments")
    write_json(ingest.flatten_comments(ad.threads_with_comments(spark, sf)).drop("ord_raw", "idx"), path)
    return read_comments(spark, path).drop("text_raw")


@query
def round_trip_stats(spark: SparkSession, sf: str) -> DataFrame:
    path, stats = fresh_path(spark, "stats"), ingest.cleaning_stats(_counted_threads(spark, sf))
    write_json(stats, path, single_file=True)
    return spark.read.schema(stats.schema).json(path)


@query
def round_trip_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The link table as CSV with joined cells."""
    path, rows = fresh_path(spark, "links"), links_rollup(spark, sf)
    for _ in range(2):
        write_csv(rows, path)
    return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)


@query
def round_trip_topic_index(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "topic-index")
    write_json(topics.topic_document(topics.topic_entries(_topic_index(spark, sf))), path, single_file=True)
    return read_topic_index(spark, path).select(
        "topic", "topic_pos", pipe("keywords"), pipe("top_thread_ids"), pipe("top_urls")
    )


@query
def round_trip_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence file, and on each row how many records were found in it."""
    path = fresh_path(spark, "evidence")
    found = write_evidence(_evidence(spark, sf), path, read_back=True)
    return read_evidence(spark, path).select(
        "thread_id", "url", "createdAt_iso", "metrics.*", "post_text", pipe("comments_text"), "why_selected",
        F.lit(found).cast("long").alias("records"),
    )


# ------------------------------------------------------------------ report


def _report_inputs(spark: SparkSession, sf: str):
    docs = thread_features(
        ad.threads_with_comments(spark, sf), TEST_LEXICONS, only=["entities", "tags", "snippet_300"]
    )
    docs = staged(docs, "features")
    prices = money.mention_total(
        ad.money_threads(spark, sf).select("text_clean", "text_raw").unionByName(
            ad.money_comments(spark, sf).select("text_clean", "text_raw")
        )
    )
    urls = links.url_counts(_link_occurrences(spark, sf))
    found = entities.entity_occurrences(docs).select("entity").distinct()
    counted = staged(_counted_threads(spark, sf), "counted")
    candidates = marketing.marketing_candidates(docs.join(counted.select("ord_raw", "metrics"), "ord_raw"))
    sizes = report.counts(unique_urls=urls, unique_entities=found, marketing_candidates=candidates)
    return counted, report.side_by_side([prices, sizes])


@query
def corpus_report(spark: SparkSession, sf: str) -> DataFrame:
    frame = report.corpus_report(*_report_inputs(spark, sf))
    return frame.withColumns(
        {c: F.round(c, 6) for c in ("avg_reactions", "avg_comments")}
    )


@query
def pack_counts(spark: SparkSession, sf: str) -> DataFrame:
    return report.pack_counts(*_report_inputs(spark, sf), topics=len(TOPICS))
