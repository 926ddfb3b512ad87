"""The test tables seen as a forum: documents are posts, conversations are
comments, events are reactions."""

from __future__ import annotations

from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.lexicons import MARKETING_PATTERNS, entity_families
from corpuslens.operators.staging import spread
from corpuslens.operators.topk import top_per_key
from corpuslens.plans import ingest

FORUM = "https://forum.example.com"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table whose rows are costly to work on."""
    return spread(table(spark, sf_dir, name), key)


def post_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ord_raw, metrics)`` for every document: events are dealt out by number."""
    documents = table(spark, sf_dir, "documents")
    size = documents.agg(F.count("*").alias("n")).scalar()
    kind = F.col("event_type")

    def count(event: str):
        return F.sum(F.when(kind == event, 1).otherwise(0))

    counted = (
        table(spark, sf_dir, "events")
        .withColumn("ord_raw", F.col("event_id") % size)
        .groupBy("ord_raw")
        .agg(
            count("click").alias("reactionCount"), count("purchase").alias("shareCount"),
            count("view").alias("commentCount"),
        )
    )
    zero = F.lit(0)
    return documents.select(F.col("doc_id").alias("ord_raw")).join(counted, "ord_raw", "left").select(
        "ord_raw",
        F.struct(
            *[F.coalesce(c, zero).cast("long").alias(c) for c in ("reactionCount", "shareCount", "commentCount")]
        ).alias("metrics"),
    )


def _post_columns(documents: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    number = doc.cast("string")
    return documents.select(
        doc.alias("ord_raw"),
        F.when(doc % 2 == 0, F.concat(F.lit(f"{FORUM}/groups/g/permalink/"), number, F.lit("/")))
        .otherwise(F.concat(F.lit(f"{FORUM}/p/"), number))
        .alias("url"),
        F.when(doc % 50 == 49, F.lit(0)).otherwise(F.lit(1640995200) + doc * 7200)
        .cast("long").alias("createdAt"),
        "text",
        F.struct(
            F.col("source").alias("name"), F.concat(F.lit(f"{FORUM}/u/"), "source").alias("url")
        ).alias("user"),
        F.col("lang").alias("groupId"),
    )


def raw_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat raw comments ``(ord_raw, idx, url, createdAt, text, author)``: all turns
    of the conversations."""
    turns = table(spark, sf_dir, "conversations")
    number = (F.col("conv_id") * 100 + F.col("turn")).cast("string")
    return turns.select(
        F.col("conv_id").alias("ord_raw"),
        F.col("turn").alias("idx"),
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit(f"{FORUM}/c/"), number))
        .otherwise(F.concat(F.lit(f"{FORUM}/c?comment_id="), number)).alias("url"),
        F.when(F.col("turn") % 4 == 0, F.lit(0))
        .otherwise(F.lit(1640995200) + F.col("conv_id") * 7200 + F.col("turn") * 60)
        .cast("long").alias("createdAt"),
        "text",
        F.struct(F.col("role").alias("name")).alias("author"),
    )


def posts(spark: SparkSession, sf_dir: str, keys_only: bool = False) -> DataFrame:
    """Raw posts without comments or counters: a projection of the documents.
    Queries that leave the texts alone take ``keys_only`` and need no spreading."""
    documents = (
        table(spark, sf_dir, "documents") if keys_only else texts(spark, sf_dir, "documents", "doc_id")
    )
    return _post_columns(documents).select(
        "*",
        *[F.lit(0).cast("long").alias(c) for c in ("reactionCount", "shareCount", "commentCount")],
        F.lit(None).cast(
            "array<struct<url:string,createdAt:bigint,text:string,author:struct<name:string>>>"
        ).alias("topComments"),
    )


def posts_with_comments(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    """Raw posts with their comments inside, all of them or the first few.

    A post is one record, so its own comments meet in one row; with ``first`` the
    rest is cut before the shuffle.
    """
    comments = raw_comments(spark, sf_dir)
    if first is not None:
        comments = top_per_key(comments, ["ord_raw"], [F.col("idx")], first).drop("rank")
    nested = comments.groupBy("ord_raw").agg(
        F.array_sort(
            F.collect_list(F.struct("idx", "url", "createdAt", "text", "author"))
        ).alias("c")
    )
    nested = nested.select(
        "ord_raw",
        F.transform("c", lambda c: F.struct(c["url"], c["createdAt"], c["text"], c["author"])).alias("topComments"),
    )
    return posts(spark, sf_dir).drop("topComments").join(nested, "ord_raw", "left")


def threads(spark: SparkSession, sf_dir: str, keys_only: bool = False) -> DataFrame:
    """Cleaned threads without comments or metrics."""
    return ingest.clean_threads(posts(spark, sf_dir, keys_only)).drop("metrics")


def threads_with_comments(spark: SparkSession, sf_dir: str, first: int | None = None) -> DataFrame:
    return ingest.clean_threads(posts_with_comments(spark, sf_dir, first)).drop("metrics")


def with_metrics(spark: SparkSession, sf_dir: str, frame: DataFrame) -> DataFrame:
    """Join the counters to a frame of threads or of what was extracted from them.

    Extract first: then keys and numbers are shuffled, not texts.
    """
    return frame.join(post_metrics(spark, sf_dir), "ord_raw")


def _composed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Threads around composed texts ``(ord_raw, createdAt, text)``."""
    return ingest.clean_threads(
        rows.select(
            "ord_raw", "createdAt", "text",
            F.concat(F.lit(f"{FORUM}/p/"), F.col("ord_raw").cast("string")).alias("url"),
            F.struct(F.lit("").alias("name"), F.lit("").alias("url")).alias("user"),
            F.lit("").alias("groupId"),
            *[F.lit(0).cast("long").alias(c) for c in ("reactionCount", "shareCount", "commentCount")],
            F.lit(None).cast(
                "array<struct<url:string,createdAt:bigint,text:string,author:struct<name:string>>>"
            ).alias("topComments"),
        )
    )


def money_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads whose texts name prices, one per order."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(
        F.lit("Eval is $"), (key % 400 + 1).cast("string"), F.lit("-"), (key % 400 + 51).cast("string"),
        F.lit(" then "), (customer % 200).cast("string"), F.lit("/hr or 80 per session, "),
        F.col("o_orderpriority"),
    )
    seconds = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    return _composed(
        spark,
        texts(spark, sf_dir, "orders", "o_orderkey").select(
            key.alias("ord_raw"), seconds.alias("createdAt"), text.alias("text")
        ),
    )


def money_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat cleaned comments that name prices, one per line item. The comment's
    number is all its id needs, so no thread is looked up here."""
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    text = F.concat(
        F.lit("Paid $"), F.col("l_quantity").cast("long").cast("string"),
        F.lit(" per visit, monthly\n"), F.col("l_linenumber").cast("string"), F.lit(" to 9"),
    )
    raw = F.struct(
        F.concat(F.lit(f"{FORUM}/c?comment_id="), key.cast("string")).alias("url"),
        F.lit(0).cast("long").alias("createdAt"), text.alias("text"),
        F.struct(F.lit("").alias("name")).alias("author"),
    )
    cleaned = texts(spark, sf_dir, "lineitem", "l_orderkey").select(
        F.col("l_orderkey").alias("ord_raw"), F.col("l_linenumber").cast("long").alias("idx"),
        ingest.comment_struct(raw, F.lit(""), F.col("l_linenumber")).alias("c"),
    )
    return cleaned.select("c.*", "ord_raw", "idx")


def money_threads_with_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threads of :func:`money_threads`, each with its line items as comments inside."""
    key = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    text = F.concat(
        F.lit("Paid $"), F.col("l_quantity").cast("long").cast("string"),
        F.lit(" per visit, monthly\n"), F.col("l_linenumber").cast("string"), F.lit(" to 9"),
    )
    raw = F.struct(
        F.concat(F.lit(f"{FORUM}/c?comment_id="), key.cast("string")).alias("url"),
        F.lit(0).cast("long").alias("createdAt"), text.alias("text"),
        F.struct(F.lit("").alias("name")).alias("author"),
    )
    # Numbers are shuffled and texts made and cleaned where they meet; an id made of the place waits for it.
    items = table(spark, sf_dir, "lineitem").repartition("l_orderkey")
    flat = ingest.comment_struct(raw, F.lit(""), F.lit(None))
    nested = items.select(F.col("l_orderkey").alias("ord_raw"), F.struct(F.col("l_linenumber").alias("at"), flat.alias("c")).alias("c"))
    nested = nested.groupBy("ord_raw").agg(F.array_sort(F.collect_list("c")).alias("c"))

    def numbered(comment: Column, at: Column) -> Column:
        placed = comment.withField("comment_id", tx.comment_id(comment["url"], F.lit(""), at))
        return F.when(comment["comment_id"].isNull(), placed).otherwise(comment)

    waits = F.exists("c.c", lambda c: c["comment_id"].isNull())
    cleaned = nested.select(
        "ord_raw", F.when(waits, F.transform("c.c", numbered)).otherwise(F.col("c.c")).alias("comments")
    )
    return money_threads(spark, sf_dir).drop("comments").join(cleaned, "ord_raw", "left")


def comment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ord_raw, comments_n)`` for threads with comments."""
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy(F.col("conv_id").alias("ord_raw")).agg(F.count("*").alias("comments_n"))


def link_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads whose texts hold links, one per page; times repeat every 40 pages."""
    page, url = F.col("page_id"), F.col("url")
    text = F.concat(
        F.lit("see ("), url, F.lit("). and "), url, F.lit(", or https://www.Facebook.com/x!")
    )
    return _composed(
        spark,
        texts(spark, sf_dir, "pages", "page_id").select(
            page.alias("ord_raw"),
            (F.lit(1640995200) + (page % 40) * 86400).cast("long").alias("createdAt"),
            text.alias("text"),
        ),
    )


def _example(parts) -> str:
    """A shortest text that a parsed pattern matches."""
    out = ""
    for kind, value in parts:
        name = str(kind)
        if name == "LITERAL":
            out += chr(value)
        elif name == "SUBPATTERN":
            out += _example(value[3])
        elif name.endswith("_REPEAT"):
            out += _example(value[2]) * max(1, value[0])
        elif name == "BRANCH":
            out += _example(value[1][0])
        elif name == "IN":
            out += " " if str(value[0][1]) == "CATEGORY_SPACE" else _example(value[:1])
        elif name == "ANY":
            out += "x"
    return out


def examples() -> list[str]:
    """One text for each default entity and marketing pattern."""
    patterns = [p for _, family, _ in entity_families() for p in family] + MARKETING_PATTERNS
    return [_example(_parser.parse(p)) for p in patterns]


def composed_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads whose texts hold examples of the default patterns and a link, one per order."""
    phrases = F.array(*[F.lit(p) for p in examples()])
    n, key = len(examples()), F.col("o_orderkey")
    text = F.concat(
        F.lit("We like "), F.element_at(phrases, (key % n + 1).cast("int")), F.lit(" and "),
        F.element_at(phrases, (F.col("o_custkey") % n + 1).cast("int")), F.lit(". https://site"),
        (key % 150).cast("string"), F.lit(".example.com/"), (F.col("o_custkey") % 7).cast("string"),
    )
    seconds = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
    return _composed(
        spark,
        texts(spark, sf_dir, "orders", "o_orderkey").select(
            key.alias("ord_raw"), seconds.alias("createdAt"), text.alias("text")
        ),
    )


def in_words(threads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Threads whose post is the first word of their text, and a flat table of comments with
    the other words, one each."""
    words = F.split(F.col("text_clean"), " ")
    rest = threads.select("ord_raw", F.posexplode(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1)))).alias("idx", "text_clean"))
    posts = threads.withColumn("text_clean", F.element_at(words, 1)).withColumn("text_raw", F.col("text_clean"))
    return posts.drop("comments").withColumn("comments", F.lit(None).cast(threads.schema["comments"].dataType)), (
        rest.withColumn("text_raw", F.col("text_clean"))
    )


def free_text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, query)``: the benchmark passages, asked as questions."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
