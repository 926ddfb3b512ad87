"""The whole job: dump to cleaned files, cleaned threads to a pack of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpuslens.operators.ordering import thread_order
from corpuslens.operators.staging import remove, shuffles_removed, staged
from corpuslens.plans import engagement, entities, ingest, links, marketing, money, report, topics
from corpuslens.plans.features import Lexicons, thread_features
from corpuslens.sources.readers import read_posts
from corpuslens.sources.writers import pipe_cell, write_csv, write_json


def clean_dump(
    spark: SparkSession, dump: str, outdir: str, lines: bool = False, drop_dump: bool = False
) -> DataFrame:
    """Write ``threads`` (newest first), ``comments`` (dump order) and ``stats``.

    Returns the cleaned threads, made from a staged table of the posts as they were read.
    ``drop_dump`` removes the dump once that table is written, for a dump that is itself made
    on the way and would lie beside the outputs.
    """
    with shuffles_removed(spark):
        posts = staged(read_posts(spark, dump, lines), "posts", compression="zstd")
        if drop_dump:
            remove(spark, dump)
        threads = ingest.clean_threads(posts)
        write_json(ingest.clean_threads(ingest.newest_first(posts)), f"{outdir}/threads")
        write_json(ingest.comments_in_order(posts).drop("ord_raw", "idx"), f"{outdir}/comments")
        write_json(ingest.cleaning_stats(threads), f"{outdir}/stats", single_file=True)
    return threads


def _joined(df: DataFrame, *arrays: str) -> DataFrame:
    """Array columns as cells."""
    return df.withColumns({name: pipe_cell(name) for name in arrays})


def build_pack(
    threads: DataFrame, outdir: str, topn: int = 300, lex: Lexicons | None = None
) -> dict[str, DataFrame]:
    """Build every table of the pack, write the files, return the tables.

    The texts are read once, for the staged feature table. Occurrences of links
    and entities are staged too, as two results come from each. Written tables are
    counted as they are written; the report comes last.
    """
    lex = lex or Lexicons()
    features = staged(thread_features(threads, lex), "features")
    link_rows = staged(links.link_occurrences(features), "links")
    entity_rows = staged(entities.entity_occurrences(features), "entities")
    urls = staged(links.links_rollup(link_rows), "urls")
    found = entities.entities_rollup(entity_rows)
    mentions = money.money_mentions_table(features)
    candidates = marketing.marketing_candidates(features)
    index = topics.topic_index(topics.topic_hits(features))
    entries = topics.topic_entries(index, lex.topics)
    sizes = {name: Observation(name) for name in ("money_mentions", "unique_urls", "unique_entities")}
    tables = {
        "engagement_threads_top": engagement.engagement_top(features, topn),
        "money_mentions": mentions,
        "links_all": urls,
        "domains_top": links.domains_top(urls),
        "resources_entities": found,
        "marketing_swipe_file": marketing.marketing_top(candidates),
        "topic_index": entries,
        "top_months": engagement.top_months(features),
        "top_domains": links.domains_by_unique_url(urls),
        "threads_over_time": engagement.threads_per_month(features),
        "engagement_hist_reactions": engagement.reaction_histogram(features),
        "top_domains_chart": links.domains_by_unique_url(urls, 15),
        "money_mentions_over_time": money.money_per_month(features),
    }
    _write_tables(tables, outdir, sizes)
    observed = report.counts(
        **{name: seen.get["rows"] for name, seen in sizes.items()}, marketing_candidates=candidates
    )
    more = {
        "report": report.corpus_report(features, observed),
        "pack_counts": report.pack_counts(features, observed, len(lex.topics)),
    }
    for name, table in more.items():
        write_json(table, f"{outdir}/{name}", single_file=True)
    return tables | more


def _seen(df: DataFrame, observation: Observation) -> DataFrame:
    """The sorted rows, counted as they are written. Nothing is shuffled behind it, so a task
    that runs again after a loss counts once."""
    return df.observe(observation, F.count(F.lit(1)).alias("rows"))


def _write_tables(tables: dict[str, DataFrame], outdir: str, sizes: dict[str, Observation]) -> None:
    def most_first(count: str) -> list[Column]:
        return [F.col(count).desc(), F.col("first_at")]

    write_csv(
        tables["engagement_threads_top"].orderBy("rank"), f"{outdir}/engagement_threads_top", True
    )
    mentions = _seen(tables["money_mentions"].orderBy(*thread_order(), "place"), sizes["money_mentions"])
    mentions = _joined(mentions, "amount_values", "context_tags")
    write_csv(
        mentions.select(
            "source_type", "thread_id", "comment_id", "createdAt_iso", "url", "matched_text",
            "amount_values", "context_tags", "text_snippet",
        ),
        f"{outdir}/money_mentions",
    )
    links_all = _seen(tables["links_all"].orderBy(*most_first("counts")), sizes["unique_urls"])
    links_all = _joined(links_all, "sample_thread_ids", "sample_urls")
    write_csv(links_all.drop("first_at"), f"{outdir}/links_all")
    domains = _joined(tables["domains_top"].orderBy(*most_first("counts")), "sample_urls")
    write_csv(domains.drop("first_at"), f"{outdir}/domains_top", True)
    found = _seen(tables["resources_entities"].orderBy(*most_first("count_mentions")), sizes["unique_entities"])
    found = _joined(found, "sample_thread_ids", "sample_urls")
    write_csv(
        found.select(
            "entity", "category", "count_mentions", "doc_count_threads", "sample_thread_ids",
            "sample_urls",
        ),
        f"{outdir}/resources_entities",
    )
    swipe = _joined(
        tables["marketing_swipe_file"].orderBy(F.col("score").desc(), *thread_order()),
        "tags_triggered",
    )
    write_csv(
        swipe.select(
            "source_type", "thread_id", "comment_id", "createdAt_iso", "url", "engagement",
            "tags_triggered", "text_snippet",
        ),
        f"{outdir}/marketing_swipe_file", True,
    )
    write_json(topics.topic_document(tables["topic_index"]), f"{outdir}/topic_index", True)
    for name in (
        "top_months", "top_domains", "threads_over_time", "engagement_hist_reactions",
        "top_domains_chart", "money_mentions_over_time",
    ):
        write_json(tables[name], f"{outdir}/{name}", single_file=True)


def write_evidence(evidence: DataFrame, path: str, read_back: bool = False) -> int:
    """Write an evidence pack in rank order; returns the number of records, counted as they
    are written, or with ``read_back`` as found in the file."""
    record = evidence.orderBy("rank").select(
        "thread_id", "url", "createdAt_iso", "metrics", "post_text", "comments_text", "why_selected"
    )
    seen = Observation("evidence")
    write_json(_seen(record, seen), path, single_file=True)
    if not read_back:
        return seen.get["rows"]
    return evidence.sparkSession.read.json(path, schema=record.schema).count()
