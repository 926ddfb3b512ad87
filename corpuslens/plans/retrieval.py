"""Evidence for free-text queries: score every thread, keep and explain the best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.functions.keywords import keyword_counts, total_sql
from corpuslens.functions.sqltext import string_array, strings
from corpuslens.operators.impact import in_groups, reachable, term_sums
from corpuslens.operators.ordering import thread_order
from corpuslens.operators.staging import computed_once, staged
from corpuslens.operators.topk import number_rows, top_per_key
from corpuslens.plans.features import with_engagement

TOPICS_PER_QUERY = 3
BONUS = 5.0
#: What a word of the query counts in a score.
WORD_WEIGHT = 2.0


def scoring_text() -> Column:
    """Lower-cased post and first ten comments, what queries are matched against."""
    comments = F.array_join(tx.comment_texts(F.col("comments"), 10), " ")
    return F.concat(F.lower(tx.post_text()), F.lit(" "), F.lower(comments))


def queries_with_keywords(queries: DataFrame) -> DataFrame:
    """``(query_id, query)`` plus ``keywords``: in order, repeats kept."""
    return queries.withColumn("keywords", tx.query_keywords(F.col("query")))


def _overlaps(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """``(query_id, topic_pos, overlap)`` of the queries and topics that share a keyword.

    Each different word of the queries meets the topic keywords that hold its rarest
    three characters in a row, by an equal join; whether they hold the word is then asked
    of those alone. A word with three characters that no keyword has meets none.
    """
    keyword = entries.select("topic_pos", F.explode("keywords").alias("_keyword")).select(
        "topic_pos", F.lower("_keyword").alias("keyword")
    ).distinct()
    index = staged(
        keyword.select("keyword").distinct().select("keyword", F.explode(_grams(F.col("keyword"))).alias("gram")),
        "keyword-grams",
    )
    frequency = index.groupBy("gram").agg(F.count("*").alias("n"))
    words = asked.select("query_id", F.explode("keywords").alias("word")).groupBy("query_id", "word").agg(
        F.count("*").alias("times")
    )
    words = staged(words, "asked-words")
    grams = words.select("word").distinct().select(
        "word", F.explode(_grams(F.col("word"))).alias("gram"), F.size(_grams(F.col("word"))).alias("all")
    )
    rarest = grams.join(frequency, "gram").groupBy("word", "all").agg(
        F.count("*").alias("known"), F.min_by("gram", F.struct("n", "gram")).alias("gram")
    ).where(F.col("known") == F.col("all"))
    holds = rarest.join(index, "gram").where(F.contains("keyword", "word")).select("word", "keyword")
    topics = staged(holds.join(keyword, "keyword").select("word", "topic_pos").distinct(), "word-topics")
    return words.join(topics, "word").groupBy("query_id", "topic_pos").agg(F.sum("times").cast("int").alias("overlap"))


def _grams(word: Column) -> Column:
    """The different runs of three characters; query words have at least as many."""
    at = F.sequence(F.lit(1), F.length(word) - 2)
    runs = F.array_distinct(F.transform(at, lambda i: F.substring(word, i, F.lit(3))))
    return F.when(F.length(word) > 2, runs).otherwise(F.array().cast("array<string>"))


def query_topics(queries: DataFrame, entries: DataFrame, n: int = TOPICS_PER_QUERY) -> DataFrame:
    """The best topics of each query, one row each, ranked.

    A query keyword counts once per place it has in the query, when any keyword of
    the topic contains it. ``entries`` has one row per topic.
    """
    overlaps = _overlaps(queries_with_keywords(queries), entries)
    best = top_per_key(overlaps, ["query_id"], [F.col("overlap").desc(), F.col("topic_pos")], n, rank="topic_rank")
    return best.join(entries.select("topic_pos", "topic"), "topic_pos").select(
        "query_id", "topic", "topic_pos", "overlap", "topic_rank"
    )


def query_plans(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Per query: keywords, the keywords of its topics (by topic rank, then place in
    the topic, each once), the ids of the topics' best threads, and a name for the
    set of its topics. ``query_id`` differs in every row."""
    known = entries.select("topic_pos", "keywords", "top_thread_ids")
    topic = F.struct("topic_rank", "topic_pos", "keywords", "top_thread_ids")
    # No more than three topics a query.
    best = query_topics(queries, entries).join(known, "topic_pos").groupBy("query_id").agg(
        F.array_sort(F.collect_list(topic)).alias("best")
    )
    return queries_with_keywords(queries).join(best, "query_id", "left").select(
        "query_id", "query", "keywords", *_plan_columns()
    )


def _plan_columns() -> list[Column]:
    """What ``best``, the topics of a query in order, says of it; empty for null."""
    none = F.array().cast("array<string>")
    positions = F.sort_array(F.col("best.topic_pos"))
    return [
        F.coalesce(F.array_distinct(F.flatten("best.keywords")), none).alias("topic_keywords"),
        F.coalesce(F.array_distinct(F.flatten("best.top_thread_ids")), none).alias("bonus_ids"),
        F.coalesce(F.array_join(positions.cast("array<string>"), "|"), F.lit("")).alias("topic_set"),
    ]


def _explain(matched: Column, engagement: Column, score: Column) -> Column:
    """Why a thread was chosen: first five keywords, high engagement, score."""
    return F.concat_ws(
        "; ",
        F.when(
            F.size(matched) > 0,
            F.concat(F.lit("Matched keywords: "), F.array_join(F.slice(matched, 1, 5), ", ")),
        ),
        F.when(
            engagement > 10,
            F.concat(F.lit("High engagement ("), engagement.cast("string"), F.lit(")")),
        ),
        F.format_string("Relevance score: %.1f", score),
    )


def _boost(engagement: Column) -> Column:
    return F.when(engagement > 0, F.log1p(engagement.cast("double")) * 0.5).otherwise(F.lit(0.0))


def _record_texts(threads: DataFrame) -> DataFrame:
    """What records say of a thread's text and ``_lower``, ``_words`` to look keywords up in,
    computed once per thread; in :func:`matched_keywords` itself it would be once per keyword."""
    keep = [c for c in threads.columns if c not in ("comments", "text_clean", "text_raw")]
    texts = computed_once(
        threads, keep, _lower=scoring_text(), post_text=tx.post_text(),
        comments_text=tx.comment_texts(F.col("comments"), 5),
    )
    return computed_once(texts, texts.columns, _words=F.array_distinct(tx.words(F.col("_lower"))))


def matched_keywords(text: Column, found_words: Column, keywords: Column, topic_keywords: Column) -> Column:
    """Query keywords that occur as words (repeats kept), then topic keywords that
    occur anywhere and are not named yet. ``text`` and its words are columns of a row:
    what they are built from would be computed again for each keyword."""
    from_query = F.filter(keywords, lambda k: F.array_contains(found_words, k))
    from_topics = F.filter(topic_keywords, lambda k: F.contains(text, F.lower(k)))
    return F.concat(from_query, F.array_except(from_topics, from_query))


def word_hits(lowered: Column, keywords: list[str]) -> Column:
    """Whole-word occurrences of the query's keywords; a repeated one counts again."""
    total = F.lit(0).cast("long")
    for keyword in keywords:
        total = total + tx.word_count(lowered, keyword)
    return total


def score_threads(
    threads: DataFrame, keywords: list[str], topic_keywords: list[str], bonus_ids: list[str]
) -> DataFrame:
    """Thread keys with ``hits`` (words), ``topic_hits`` and ``bonus``: the parts of
    the score that come from the text. A projection, so it also runs on a stream."""
    lowered = [k.lower() for k in topic_keywords]
    texts = threads.withColumn("_lower", scoring_text())
    texts = texts.withColumn("_counts", keyword_counts(F.col("_lower"), lowered))
    bonus = F.when(F.col("thread_id").isin(bonus_ids), BONUS) if bonus_ids else F.lit(None)
    keep = ["ord_raw", "createdAt_ts", "thread_id"]
    return computed_once(
        texts, keep + [c for c in ("metrics",) if c in threads.columns],
        hits=word_hits(F.col("_lower"), keywords),
        topic_hits=F.expr(total_sql("_counts", strings(lowered))),
        bonus=F.coalesce(bonus.cast("double"), F.lit(0.0)),
    )


def with_score(scored: DataFrame) -> DataFrame:
    """Add ``engagement`` and ``score``; only threads with a score above 0 stay."""
    total = (
        F.col("hits") * WORD_WEIGHT + F.col("topic_hits") * 1.0 + _boost(F.col("engagement")) + F.col("bonus")
    )
    return with_engagement(scored).withColumn("score", total).where(F.col("score") > 0)


def single_query_plan(entries: DataFrame, query: str) -> tuple[list[str], list[str], list[str]]:
    """Keywords, topic keywords and bonus ids of one query, as values for the plan.

    The query's words are looked for in each topic's row; the three best topics come to
    the driver.
    """
    spark = entries.sparkSession
    asked = spark.range(1).select(tx.query_keywords(F.lit(query)).alias("keywords"))
    keywords = asked.first()["keywords"]
    lowered = F.transform("keywords", lambda k: F.lower(k))
    shared = F.filter(string_array(keywords), lambda q: F.exists(lowered, lambda k: F.contains(k, q)))
    best = (
        entries.select("keywords", "top_thread_ids", "topic_pos", F.size(shared).alias("overlap"))
        .where("overlap > 0").orderBy(F.desc("overlap"), "topic_pos").limit(TOPICS_PER_QUERY).collect()
    )
    words = dict.fromkeys(w for row in best for w in row["keywords"])
    ids = dict.fromkeys(i for row in best for i in row["top_thread_ids"])
    return keywords, list(words), list(ids)


def evidence_pack(
    threads: DataFrame,
    entries: DataFrame,
    query: str,
    k: int = 60,
    metrics: DataFrame | None = None,
    require_match: bool = False,
) -> DataFrame:
    """The ``k`` threads that answer the query best, ranked and explained.

    ``entries`` is the topic index, one row per topic. ``metrics`` gives
    ``(ord_raw, metrics)`` when the threads do not carry them. A thread with any
    engagement has a score above 0; ``require_match`` asks for a keyword too.

    Ranking moves keys and numbers only; the texts of the chosen ``k`` threads are then
    picked by a broadcast of their keys.
    """
    keywords, topic_keywords, bonus_ids = single_query_plan(entries, query)
    scored = score_threads(threads, keywords, topic_keywords, bonus_ids)
    if metrics is not None:
        scored = scored.join(metrics, "ord_raw")
    if require_match:
        scored = scored.where("hits > 0 or topic_hits > 0")
    ranked = with_score(scored).select(
        "ord_raw", "createdAt_ts", "metrics", "engagement", "score"
    )
    best = number_rows(ranked, [F.col("score").desc(), *thread_order()], k).drop("createdAt_ts")
    # At most k rows.
    texts = threads.drop("metrics", "createdAt_ts").join(F.broadcast(best), "ord_raw")
    matched = matched_keywords(
        F.col("_lower"), F.col("_words"), string_array(keywords), string_array(topic_keywords),
    )
    return (
        _record_texts(texts).withColumn("_matched", matched)
        .select(
            "rank", "thread_id", "url", "createdAt_iso", "metrics", "post_text", "comments_text",
            _explain(F.col("_matched"), F.col("engagement"), F.col("score")).alias("why_selected"),
            "score",
        )
        .orderBy("rank")
    )


def evidence_preview(evidence: DataFrame, n: int = 5) -> DataFrame:
    """The first rows with the start of each text on one line."""
    line = F.concat(F.translate(F.substring("post_text", 1, 100), "\n", " "), F.lit("..."))
    return evidence.orderBy("rank").limit(n).select(
        "rank", "thread_id", F.format_string("%.1f", "score").alias("score_text"), "url",
        line.alias("text_start"),
    )


def _text_facts(threads: DataFrame, wanted: DataFrame, lexicon: list[str]) -> DataFrame:
    """``(ord_raw, is_word, term, n)``: the lexicon's keywords that occur in each thread's
    text, and those of its words that some query asks for. One scan; counted before the
    shuffle, so a word that a text repeats moves once."""
    texts = computed_once(threads, ["ord_raw"], _lower=scoring_text())
    keyword = F.transform(
        keyword_counts(F.col("_lower"), lexicon),
        lambda c: F.struct(F.lit(False).alias("is_word"), c["kw"].alias("term"), c["n"].alias("n")),
    )
    one = F.lit(1).cast("long")
    word = F.transform(
        tx.words(F.col("_lower")),
        lambda w: F.struct(F.lit(True).alias("is_word"), w.alias("term"), one.alias("n")),
    )
    rows = texts.select("ord_raw", F.inline(F.concat(keyword, word)))
    asked = wanted.select("term", F.lit(True).alias("asked")).distinct()
    kept = rows.join(asked, "term", "left").where("not is_word or asked")
    return kept.groupBy("ord_raw", "is_word", "term").agg(F.sum("n").alias("n"))


def evidence_for_queries(
    threads: DataFrame,
    entries: DataFrame,
    queries: DataFrame,
    k: int = 60,
    metrics: DataFrame | None = None,
    require_match: bool = False,
    observation: Observation | None = None,
) -> DataFrame:
    """The ``k`` best threads for each row of ``(query_id, query)``:
    ``query_id, rank, ord_raw, score, engagement, metrics``.

    Same scores as :func:`evidence_pack`. Queries that match the same topics share one
    *topic set*, and everything in a score but the word hits depends on the set alone. So
    a thread without a word of the query can only be among its best ``k`` if it is among
    the best ``k`` of the topic set: ``k`` threads ahead of it there are ahead of it for
    the query. And a thread without a topic word or bonus has the same score for every
    set, its boost. Those two and the ``k`` threads with the largest parts of the score for
    one word of the query are scored first. The ``k``-th best of these scores is a threshold,
    and other threads are met only in groups of like impact that can reach it
    (:mod:`corpuslens.operators.impact`), which is exact. A query with fewer than ``k``
    threads of any score has the threshold 0.
    ``require_match`` asks for a word or topic word, as there.

    Texts are scanned once, for a written table of the terms that matter; from there on
    keys and numbers move. All tables that are joined are written ones, so that Spark knows
    their bytes when it chooses what to broadcast. ``observation`` gets the number of
    ``pairs`` of query and thread that were scored.
    """
    plans = staged(
        query_plans(queries, entries).select(
            "query_id", "keywords", "bonus_ids", F.xxhash64("topic_set").alias("set_no"),
            F.transform("topic_keywords", lambda w: F.lower(w)).alias("words"),
        ), "query-plans",
    )
    # Distinct topic sets: at most the ways to choose three of the lexicon's topics.
    sets = staged(plans.dropDuplicates(["set_no"]).select("set_no", "words", "bonus_ids"), "topic-sets")
    asked = plans.select("query_id", F.explode("keywords").alias("term"))
    wanted = staged(asked.groupBy("query_id", "term").agg(F.count("*").alias("times")), "query-words")
    # The lexicon's words come to the driver to be looked for all at once.
    lexicon = [w.lower() for row in entries.select("keywords").collect() for w in row["keywords"]]
    facts = staged(_text_facts(threads, wanted, lexicon), "text-facts")
    keys = threads.select("ord_raw", "createdAt_ts", "thread_id", *[c for c in ("metrics",) if c in threads.columns])
    if metrics is not None:
        keys = keys.join(metrics, "ord_raw")
    keys = staged(with_engagement(keys).withColumn("boost", _boost(F.col("engagement"))), "thread-keys")

    none = F.lit(0.0)
    words = sets.select("set_no", F.explode("words").alias("term"))
    hits = facts.where("not is_word").join(words, "term").groupBy("set_no", "ord_raw").agg(
        F.sum("n").cast("double").alias("topic_hits"), F.max(none).alias("bonus")
    )
    marked = sets.select("set_no", F.explode("bonus_ids").alias("thread_id"))
    bonus = keys.join(marked, "thread_id").select(
        "set_no", "ord_raw", none.alias("topic_hits"), F.lit(BONUS).alias("bonus")
    )
    met = staged(
        hits.unionByName(bonus).groupBy("set_no", "ord_raw").agg(
            F.sum("topic_hits").alias("topic_hits"), F.max("bonus").alias("bonus")
        ), "topic-parts",
    )
    base = F.col("topic_hits") + F.col("boost") + F.col("bonus")
    counted = facts.where("is_word").select("term", F.col("ord_raw").alias("item"), "n")
    postings = staged(in_groups(counted), "postings")
    boosts = keys.select(F.col("ord_raw").alias("item"), "boost")
    grouped = postings.select("item", "group").distinct().join(boosts, "item")

    led = top_per_key(met.join(keys, "ord_raw"), ["set_no"], [base.desc(), *thread_order()], k, spread=32)
    boosted = keys.where("engagement > 0").orderBy(F.col("engagement").desc(), *thread_order()).limit(k)
    every = sets.agg(F.collect_list("set_no").alias("all")).scalar()
    leading = led.select("set_no", "ord_raw").unionByName(boosted.select(F.explode(every).alias("set_no"), "ord_raw")).distinct()
    leading = plans.select("query_id", "set_no").join(leading, "set_no").select("query_id", F.col("ord_raw").alias("item"))
    by_word = top_per_key(postings, ["term"], [F.desc("n"), F.asc("item")], k, rank="_n", spread=32)
    by_word = by_word.join(wanted, "term").groupBy("query_id", "item").agg(F.sum(F.col("n") * F.col("times")).alias("part"))
    by_word = top_per_key(by_word, ["query_id"], [F.desc("part"), F.asc("item")], k, rank="_n")
    first = staged(leading.unionByName(by_word.select("query_id", "item")).distinct(), "first-pairs")

    def scored(pairs: DataFrame) -> DataFrame:
        found = pairs.join(plans.select("query_id", "set_no"), "query_id").select(
            "query_id", "set_no", F.col("item").alias("ord_raw"), F.coalesce("n", F.lit(0)).alias("hits")
        )
        found = found.join(met, ["set_no", "ord_raw"], "left").join(keys.drop("thread_id"), "ord_raw").withColumns(
            {c: F.coalesce(c, none) for c in ("topic_hits", "bonus")}
        )
        found = found.withColumn("score", F.col("hits") * WORD_WEIGHT + base).where("score > 0")
        return found.where("hits > 0 or topic_hits > 0") if require_match else found

    seeds = staged(scored(first.join(term_sums(first, postings, wanted), ["query_id", "item"], "left")), "first-scores")
    kth = top_per_key(seeds, ["query_id"], [F.col("score").desc(), *thread_order()], k).where(F.col("rank") == k)
    bounds = plans.select("query_id", F.col("set_no").alias("class")).join(
        kth.select("query_id", F.col("score").alias("threshold")), "query_id", "left"
    ).withColumn("threshold", F.coalesce("threshold", none))
    bounds = wanted.withColumn("weight", F.col("times") * WORD_WEIGHT).join(staged(bounds, "thresholds"), "query_id")
    rests = grouped.join(met.withColumnRenamed("ord_raw", "item"), "item").groupBy(F.col("set_no").alias("class"), "group").agg(
        F.max(base).alias("rest")
    )
    least_rest = grouped.groupBy("group").agg(F.max("boost").alias("rest"))
    further = reachable(postings, bounds, rests, least_rest).join(first, ["query_id", "item"], "left_anti")
    both = seeds.unionByName(scored(further))
    if observation is not None:
        both = both.observe(observation, F.count(F.lit(1)).alias("pairs"))
    return top_per_key(both, ["query_id"], [F.col("score").desc(), *thread_order()], k, spread=32).select(
        "query_id", "rank", "ord_raw", "score", "engagement", "metrics"
    )


def evidence_records(
    threads: DataFrame, entries: DataFrame, queries: DataFrame, chosen: DataFrame
) -> DataFrame:
    """The records of :func:`evidence_pack` for rows of :func:`evidence_for_queries`.

    The texts of the chosen threads are read by their keys. These are a written table,
    so that Spark knows its bytes and, if they are few, sends them to the texts.
    """
    picked = staged(chosen.select("ord_raw").distinct(), "chosen-keys")
    texts = _record_texts(threads.drop("metrics", "createdAt_ts").join(picked, "ord_raw", "left_semi"))
    plans = query_plans(queries, entries).select("query_id", "keywords", "topic_keywords")
    joined = chosen.join(plans, "query_id").join(texts, "ord_raw")
    matched = matched_keywords(F.col("_lower"), F.col("_words"), F.col("keywords"), F.col("topic_keywords"))
    return joined.withColumn("_matched", matched).select(
        "query_id", "rank", "thread_id", "url", "createdAt_iso", "metrics", "post_text", "comments_text",
        _explain(F.col("_matched"), F.col("engagement"), F.col("score")).alias("why_selected"),
        "score",
    )
