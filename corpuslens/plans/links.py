"""Links and the domains they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.urls import domain
from corpuslens.lexicons import OWN_DOMAIN_PREFIXES
from corpuslens.operators.ordering import order_key
from corpuslens.operators.topk import top_per_key

SAMPLE = 5


def link_occurrences(
    features: DataFrame, own_prefixes: list[str] = OWN_DOMAIN_PREFIXES
) -> DataFrame:
    """One row per link in a thread, links within the forum's own site left out.

    Stage this before several rollups: it is the only step that needs the texts.
    Features may be those of pieces.
    """
    piece = [c for c in ("piece",) if c in features.columns]
    rows = features.select(
        "ord_raw", "createdAt_ts", "thread_id", "createdAt_iso", *piece,
        F.col("url").alias("thread_url"), F.posexplode("links").alias("at", "url_canonical"),
    ).withColumn("domain", domain("url_canonical"))
    rows = rows.where(F.col("domain") != "")
    for prefix in own_prefixes:
        rows = rows.where(~F.col("domain").startswith(prefix))
    return rows.select(
        "url_canonical", "domain", "thread_id", "thread_url",
        F.nullif("createdAt_iso", F.lit("")).alias("createdAt_iso"),
        order_key(*map(F.col, piece), F.col("at")).alias("seen_at"),
    )


def links_rollup(occurrences: DataFrame) -> DataFrame:
    """Per URL: occurrences, domain, first five threads (repeats kept), first and
    last time seen. ``first_at`` is where it occurs first; order by ``counts``
    descending, then ``first_at``. One URL may hold most links, so its samples are
    cut in slices first."""
    counts = occurrences.groupBy("url_canonical", "domain").agg(
        F.count("*").alias("counts"),
        F.min("createdAt_iso").alias("first_seen_iso"),
        F.max("createdAt_iso").alias("last_seen_iso"),
        F.min("seen_at").alias("first_at"),
    )
    samples = (
        top_per_key(
            occurrences.select("url_canonical", "thread_id", "thread_url", "seen_at"),
            ["url_canonical"], [F.col("seen_at")], SAMPLE, spread=32,
        )
        .groupBy("url_canonical")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "thread_id", "thread_url"))).alias("s"))
    )
    return counts.join(samples, "url_canonical").select(
        "url_canonical", "domain", "counts",
        F.col("s.thread_id").alias("sample_thread_ids"),
        F.col("s.thread_url").alias("sample_urls"),
        "first_seen_iso", "last_seen_iso", "first_at",
    )


def url_counts(occurrences: DataFrame) -> DataFrame:
    """Per URL: domain, occurrences, first place. The rollup without samples."""
    return occurrences.groupBy("url_canonical", "domain").agg(
        F.count("*").alias("counts"), F.min("seen_at").alias("first_at")
    )


def domains_top(urls: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` domains with the most link occurrences, with their first five URLs.

    ``urls`` is :func:`links_rollup` or :func:`url_counts`. Samples are looked up
    for the ``n`` chosen domains only.
    """
    top = (
        urls.groupBy("domain")
        .agg(F.sum("counts").alias("counts"), F.min("first_at").alias("first_at"))
        .orderBy(F.col("counts").desc(), F.col("first_at"))
        .limit(n)
    )
    chosen = urls.select("domain", "url_canonical", "first_at").join(
        F.broadcast(top.select("domain")), "domain", "left_semi"
    )
    samples = (
        top_per_key(chosen, ["domain"], [F.col("first_at")], SAMPLE, spread=32)
        .groupBy("domain")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "url_canonical"))).alias("s"))
    )
    return top.join(samples, "domain").select(
        "domain", "counts", F.col("s.url_canonical").alias("sample_urls"), "first_at"
    )


def domains_by_unique_url(urls: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` domains with the most different URLs; ties to the one seen first."""
    return (
        urls.groupBy("domain")
        .agg(F.count("*").alias("unique_urls"), F.min("first_at").alias("first_at"))
        .orderBy(F.col("unique_urls").desc(), F.col("first_at"))
        .limit(n)
        .select("domain", "unique_urls")
    )
