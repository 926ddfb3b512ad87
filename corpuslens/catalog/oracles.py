"""The same results in DuckDB SQL, written from the definitions: brute force
joins and lists in place of the Spark plans."""

from __future__ import annotations

from corpuslens.catalog.registry import TEST_ENTITIES, TEST_MARKETING, TEST_QUERY
from corpuslens.catalog.adapters import examples
from corpuslens.lexicons import MARKETING_PATTERNS, STOP_WORDS, TOPICS, entity_families

_SPACE = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _clean(column: str) -> str:
    return f"coalesce(trim(regexp_replace({column}, '[{_SPACE}]+', ' ', 'g')), '')"


def _snippet(clean: str, n: int) -> str:
    return f"case when length({clean}) <= {n} then {clean} else substr({clean}, 1, {n - 3}) || '...' end"


def _iso(ts: str) -> str:
    return f"case when {ts} <> 0 then strftime(make_timestamp({ts} * 1000000), '%Y-%m-%dT%H:%M:%SZ') end"


def _words(column: str) -> str:
    return rf"regexp_extract_all({column}, '[\p{{L}}\p{{N}}_]+')"


def _thread_id(url: str, ts: str) -> str:
    number = f"nullif(regexp_extract({url}, '/permalink/([0-9]+)', 1), '')"
    return f"'thread_' || coalesce({number}, substr(md5({url} || cast({ts} as varchar)), 1, 12))"


FORUM = "https://forum.example.com"

# Building blocks, in an order in which each needs only earlier ones.
_BLOCKS = {
    "metrics": """
        select d.doc_id as ord_raw,
               cast(coalesce(sum(case when e.event_type = 'click' then 1 end), 0) as bigint) as reactions,
               cast(coalesce(sum(case when e.event_type = 'view' then 1 end), 0) as bigint) as comments_n,
               cast(coalesce(sum(case when e.event_type = 'purchase' then 1 end), 0) as bigint) as shares
        from documents d
        left join events e on e.event_id % (select count(*) from documents) = d.doc_id
        group by 1""",
    "engaged": "select *, reactions + 2 * comments_n + 3 * shares as eng from metrics",
    "posts": f"""
        select doc_id as ord_raw, source, lang, text as text_raw, {_clean('text')} as text_clean,
               case when doc_id % 2 = 0
                    then '{FORUM}/groups/g/permalink/' || cast(doc_id as varchar) || '/'
                    else '{FORUM}/p/' || cast(doc_id as varchar) end as url,
               case when doc_id % 50 = 49 then 0 else 1640995200 + doc_id * 7200 end as ts
        from documents""",
    "threads": f"""
        select *, {_thread_id('url', 'ts')} as thread_id, {_iso('ts')} as iso,
               coalesce(nullif(text_clean, ''), nullif(text_raw, ''), '') as post
        from posts""",
    "replies": f"""
        select conv_id as ord_raw, turn as idx, role, text as text_raw, {_clean('text')} as text_clean,
               case when turn % 3 = 0 then '{FORUM}/c/' || cast(conv_id * 100 + turn as varchar)
                    else '{FORUM}/c?comment_id=' || cast(conv_id * 100 + turn as varchar) end as url,
               case when turn % 4 = 0 then 0 else 1640995200 + conv_id * 7200 + turn * 60 end as ts
        from conversations""",
    "comments": f"""
        select r.*, t.thread_id,
               case when r.url like '%comment_id=%'
                    then 'comment_' || regexp_extract(r.url, 'comment_id=([0-9]+)', 1)
                    else t.thread_id || '_comment_' || cast(r.idx as varchar) end as comment_id,
               {_iso('r.ts')} as iso,
               coalesce(nullif(r.text_clean, ''), nullif(r.text_raw, ''), '') as body
        from replies r left join threads t on t.ord_raw = r.ord_raw""",
    "money_posts": f"""
        select o_orderkey as ord_raw, '{FORUM}/p/' || cast(o_orderkey as varchar) as url,
               cast(epoch(o_orderdate) as bigint) as ts,
               o_orderkey % 400 + 1 as a, o_orderkey % 400 + 51 as b, o_custkey % 200 as c,
               'Eval is $' || cast(o_orderkey % 400 + 1 as varchar) || '-' ||
               cast(o_orderkey % 400 + 51 as varchar) || ' then ' || cast(o_custkey % 200 as varchar) ||
               '/hr or 80 per session, ' || o_orderpriority as post
        from orders""",
    "money_threads": f"""
        select *, {_thread_id('url', 'ts')} as thread_id, {_iso('ts')} as iso from money_posts""",
    "money_in_posts": """
        select 'thread' as source_type, thread_id, '' as comment_id, iso, url, post as body, m.*
        from money_threads, lateral (values
            (1, '$' || cast(a as varchar), cast(a as double), null),
            (2, '$' || cast(a as varchar) || '-' || cast(b as varchar), cast(a as double), cast(b as double)),
            (4, cast(c as varchar) || '/hr', cast(c as double), null),
            (6, '80 per session', 80.0, null)) as m(pattern_pos, matched_text, x, y)
        where not (pattern_pos = 4 and c < 1)""",
    "money_comments": f"""
        select l_orderkey * 100 + l_linenumber as number, l_orderkey, cast(l_quantity as bigint) as q,
               l_linenumber as n,
               'Paid $' || cast(cast(l_quantity as bigint) as varchar) || ' per visit, monthly ' ||
               cast(l_linenumber as varchar) || ' to 9' as body
        from lineitem""",
    "money_in_comments": f"""
        select 'comment' as source_type, t.thread_id, 'comment_' || cast(number as varchar) as comment_id,
               cast(null as varchar) as iso, '{FORUM}/c?comment_id=' || cast(number as varchar) as url,
               body, m.*
        from money_comments c left join money_threads t on t.ord_raw = c.l_orderkey, lateral (values
            (1, '$' || cast(q as varchar), cast(q as double), null),
            (3, cast(n as varchar) || ' to 9', cast(n as double), 9.0),
            (6, cast(q as varchar) || ' per visit', cast(q as double), null))
            as m(pattern_pos, matched_text, x, y)""",
    "money_all": """
        select * from money_in_posts union all select * from money_in_comments""",
    "money_around": """
        select *, strpos(lower(body), matched_text) - 1 as spot from money_all""",
    "money_context": """
        select *, lower(near_text) as near from (
            select *, substr(body, greatest(spot - 50, 0) + 1,
                             least(spot + length(matched_text) + 50, length(body)) - greatest(spot - 50, 0)) as near_text
            from money_around)""",
    "money_rows": f"""
        select source_type, thread_id, comment_id, iso as "createdAt_iso", url, pattern_pos, matched_text,
               concat_ws('|', cast(x as varchar), cast(y as varchar)) as amount_values,
               concat_ws('|',
                   case when contains(near, 'eval') or contains(near, 'initial') or contains(near, 'assessment') then 'eval' end,
                   case when contains(near, 'follow') or contains(near, 'return') then 'followup' end,
                   case when regexp_matches(near, 'session|visit|appointment|treatment') then 'session' end,
                   case when regexp_matches(near, 'hour|/hr') then 'hour' end,
                   case when regexp_matches(near, 'package|bundle') then 'package' end,
                   case when regexp_matches(near, 'membership|monthly|subscription') then 'membership' end,
                   case when regexp_matches(near, 'cash|oop') then 'cash' end) as context_tags,
               {_snippet('body', 200)} as text_snippet, {_clean('near_text')} as near_clean
        from money_context""",
    "canonical": """
        select page_id, url, split_part(split_part(url, '#', 1), '?', 1) as base,
               list_filter(string_split(split_part(split_part(url, '#', 1), '?', 2), '&'),
                           lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|fbclid|gclid|ref|source)(=|$)')) as params
        from pages""",
    "page_links": """
        select page_id, url, base || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as u,
               replace(lower(split_part(base, '/', 3)), 'www.', '') as domain
        from canonical""",
    "link_posts": f"""
        select page_id as ord_raw, 1640995200 + (page_id % 40) * 86400 as ts,
               '{FORUM}/p/' || cast(page_id as varchar) as url, u, domain
        from (select page_id, u, domain from page_links)""",
    "link_rows": f"""
        select ord_raw, ts, {_thread_id('url', 'ts')} as thread_id, {_iso('ts')} as iso, url as thread_url,
               u, domain, spot
        from link_posts, (values (0), (1)) as twice(spot)""",
    "link_places": """
        select *, row_number() over (order by -ts, ord_raw, spot) as place from link_rows""",
    "link_numbered": """
        select *, row_number() over (partition by u order by place) as nth from link_places""",
    "urls": """
        select u, domain, count(*) as counts, min(iso) as first_iso, max(iso) as last_iso,
               min(place) as first_place,
               string_agg(thread_id, '|' order by nth) filter (where nth <= 5) as ids,
               string_agg(thread_url, '|' order by nth) filter (where nth <= 5) as thread_urls
        from link_numbered group by 1, 2""",
}


def _lexicon_rows() -> str:
    rows = [
        f"({_text(topic)}, {pos}, {_text(word)}, {spot})"
        for pos, (topic, words) in enumerate(TOPICS.items())
        for spot, word in enumerate(words)
    ]
    return "(values " + ", ".join(rows) + ") as lexicon(topic, topic_pos, kw, kw_pos)"


_COUNT = "cast((length({t}) - length(replace({t}, {k}, ''))) / length({k}) as bigint)"

_BLOCKS["whole"] = """
        select t.*, t.post || coalesce(c.all_comments, '') as body
        from threads t left join (
            select ord_raw, string_agg(' ' || body, '' order by idx) as all_comments
            from comments group by 1) c using (ord_raw)"""
_BLOCKS["lexicon"] = f"select * from {_lexicon_rows()}"
_BLOCKS["topic_hits"] = f"""
        select t.ord_raw, l.topic, l.topic_pos, cast(sum({_COUNT.format(t='lower(t.body)', k='l.kw')}) as bigint) as score
        from whole t join lexicon l on contains(lower(t.body), l.kw) group by 1, 2, 3"""
_BLOCKS["ranked_topics"] = """
        select h.topic, h.topic_pos, h.score, t.thread_id, t.url, m.eng,
               row_number() over (partition by h.topic
                   order by cast(h.score as double) * cast(0.7 as double) + cast(m.eng as double) * cast(0.3 as double) desc,
                            t.ts desc, t.ord_raw) as rank
        from topic_hits h join threads t using (ord_raw) join engaged m using (ord_raw)"""
_BLOCKS["topic_best"] = "select * from ranked_topics where rank <= 50"

_STOPS = "[" + ", ".join(_text(w) for w in STOP_WORDS) + "]"


def _keywords(query: str) -> str:
    """ASCII words between characters that are not word characters."""
    return (
        f"list_filter({_words(f'lower({query})')}, lambda w: regexp_full_match(w, '[a-z0-9]+') "
        f"and length(w) > 2 and not list_contains({_STOPS}, w))"
    )


_BLOCKS["asked"] = f"select item_id as query_id, {_keywords('text')} as kws from benchmark"
_BLOCKS["asked_once"] = f"select 0 as query_id, {_keywords(_text(TEST_QUERY))} as kws"


def _topics_of(source: str) -> str:
    return f"""
        select query_id, topic, topic_pos, overlap,
               row_number() over (partition by query_id order by overlap desc, topic_pos) as topic_rank
        from (select q.query_id, l.topic, l.topic_pos,
                     len(list_filter(any_value(q.kws),
                         lambda w: len(list_filter(list(l.kw), lambda k: contains(k, w))) > 0)) as overlap
              from {source} q, lexicon l group by 1, 2, 3)
        where overlap > 0"""


# Texts queries are matched against: the post with its first ten comments.
_BLOCKS["first_ten"] = """
        select ord_raw, string_agg(body, ' ' order by idx) filter (where body <> '') as ten,
               string_agg(body, '|' order by idx) filter (where body <> '' and idx < 5) as five,
               count(*) filter (where body <> '') as n_ten
        from comments where idx < 10 group by 1"""
_BLOCKS["with_ten"] = """
        select t.ord_raw, lower(t.post) || ' ' || lower(coalesce(c.ten, '')) as low
        from threads t left join first_ten c using (ord_raw)"""


def _scores(asked: str, texts: str) -> dict[str, str]:
    """Blocks that score every pair of thread and query."""
    return {
        "topics_of": _topics_of(asked),
        "chosen": "select * from topics_of where topic_rank <= 3",
        "bonus": "select distinct c.query_id, b.thread_id from chosen c join topic_best b using (topic)",
        "topic_words": """
            select query_id, kw, min(topic_rank * 1000 + kw_pos) as spot
            from chosen join lexicon using (topic) group by 1, 2""",
        "query_words": f"select query_id, unnest(kws) as kw, generate_subscripts(kws, 1) as spot from {asked}",
        "thread_words": f"""
            select ord_raw, w, count(*) as n from (select ord_raw, unnest({_words('low')}) as w from {texts}) group by 1, 2""",
        "word_part": """
            select q.query_id, t.ord_raw, sum(t.n) as n
            from query_words q join thread_words t on t.w = q.kw group by 1, 2""",
        "topic_part": f"""
            select w.query_id, t.ord_raw, sum({_COUNT.format(t='t.low', k='w.kw')}) as n
            from topic_words w join {texts} t on contains(t.low, w.kw) group by 1, 2""",
        "scored": f"""
            select q.query_id, t.ord_raw, m.eng, t.ts,
                   coalesce(w.n, 0) * cast(2.0 as double) + coalesce(k.n, 0) * cast(1.0 as double)
                   + case when m.eng > 0 then ln(1.0 + cast(m.eng as double)) * cast(0.5 as double) else 0 end
                   + case when b.thread_id is not null then 5.0 else 0 end as score
            from {asked} q cross join threads t join engaged m on m.ord_raw = t.ord_raw
            left join word_part w on w.query_id = q.query_id and w.ord_raw = t.ord_raw
            left join topic_part k on k.query_id = q.query_id and k.ord_raw = t.ord_raw
            left join bonus b on b.query_id = q.query_id and b.thread_id = t.thread_id""",
        "best": """
            select *, row_number() over (partition by query_id
                       order by round(score, 9) desc, ts desc, ord_raw) as rank
            from scored where score > 0""",
    }


def _sql(select: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """The statement with the blocks it needs, directly or through others."""
    import re

    blocks = {**_BLOCKS, **(extra or {})}
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name in blocks:
            if name not in wanted and re.search(rf"(?:from|join|,)\s+{name}\b", text):
                wanted.add(name)
                visit(blocks[name])

    visit(select)
    wanted.update(needs)
    used = [f"{name} as ({body})" for name, body in blocks.items() if name in wanted]
    return ("with " + ",\n".join(used) + "\n" if used else "") + select


def _entity_blocks(families, source: str = "whole") -> dict[str, str]:
    """Matches per pattern. Word-bounded patterns are looked up among the words."""
    parts = []
    number = 0
    for category, patterns, in_upper in families:
        for pattern in patterns:
            number += 1
            if in_upper:
                word = pattern.replace(r"\b", "")
                found = f"list_filter({_words('upper(body)')}, lambda w: w = {_text(word)})"
            else:
                found = f"regexp_extract_all(body, {_text('(?i)' + pattern)})"
            parts.append(
                f"select ord_raw, ts, thread_id, url, {number} as pat, '{category}' as category, "
                f"unnest(f) as m, generate_subscripts(f, 1) as spot "
                f"from (select *, {found} as f from {source})"
            )
    return {
        "matches": " union all ".join(parts),
        "entity_rows": """
            select upper(m) as entity, category, thread_id, url,
                   row_number() over (order by -ts, ord_raw, pat, spot) as place from matches""",
        "entity_nth": """
            select *, row_number() over (partition by entity order by place) as nth,
                   row_number() over (partition by entity order by place desc) as from_end
            from entity_rows""",
        "entity_stats": """
            select entity, max(category) filter (where from_end = 1) as category,
                   count(*) as count_mentions, min(place) as first_place,
                   count(distinct thread_id) filter (where nth <= 5) as doc_count_threads,
                   count(distinct thread_id) as doc_count_all,
                   string_agg(thread_id, '|' order by nth) filter (where nth <= 5) as ids,
                   string_agg(url, '|' order by nth) filter (where nth <= 5) as urls
            from entity_nth group by 1""",
    }


_TAGS = "list_filter([{}], lambda p: p is not null)".format(
    ", ".join(
        f"case when regexp_matches(body, {_text('(?i)' + p)}) then {_text(p)} end"
        for p in TEST_MARKETING
    )
)
_CANDIDATES = {
    "tagged": f"select *, {_TAGS} as tags from whole",
    "candidates": """
        select t.*, m.eng, len(tags) + cast(m.eng as double) * cast(0.1 as double) as score
        from tagged t join engaged m using (ord_raw) where len(tags) >= 2 or m.eng >= 20""",
    "ranked_candidates": """
        select *, row_number() over (order by round(score, 9) desc, ts desc, ord_raw) as nth from candidates""",
}

_BUSY = {
    "months": "select substr(iso, 1, 7) as month, count(*) as n from threads where iso is not null group by 1",
}
_TOTALS = """
    select count(*) as threads, cast(coalesce(sum(c.n), 0) as bigint) as comments_in_data,
           substr(min(t.iso), 1, 10) as date_min, substr(max(t.iso), 1, 10) as date_max,
           cast(sum(m.reactions) as bigint) as total_reactions,
           cast(sum(m.comments_n) as bigint) as total_comments,
           round(cast(sum(m.reactions) as double) / count(*), 6) as avg_reactions,
           round(cast(sum(m.comments_n) as double) / count(*), 6) as avg_comments
    from threads t join engaged m using (ord_raw)
    left join (select ord_raw, count(*) as n from comments group by 1) c using (ord_raw)"""
_ORDER_STATS = {
    "sorted": "select eng, row_number() over (order by eng desc) - 1 as spot, count(*) over () as n from engaged",
    "stats": """
        select max(eng) filter (where spot = cast(floor(n * cast(0.1 as double)) as bigint)) as p90,
               max(eng) filter (where spot = cast(floor(n * cast(0.5 as double)) as bigint)) as p50
        from sorted""",
}
_PACK = {
    **_CANDIDATES,
    **_entity_blocks(TEST_ENTITIES),
    **_ORDER_STATS,
    "sizes": """
        select (select count(*) from threads) as threads,
               (select count(*) from money_all) as money_mentions,
               (select count(*) from urls) as unique_urls,
               (select count(*) from entity_stats) as unique_entities,
               (select count(*) from candidates) as marketing_candidates""",
}


def _evidence_blocks() -> dict[str, str]:
    return {
        **_scores("asked_once", "with_ten"),
        "named": """
            select t.ord_raw,
                   list_filter(q.kws, lambda w: list_contains(x.ws, w)) as from_query,
                   (select list(kw order by spot) from topic_words) as topic_list, t.low
            from with_ten t cross join asked_once q
            join (select ord_raw, list(w) as ws from thread_words group by 1) x using (ord_raw)""",
        "matched": """
            select ord_raw, list_concat(from_query,
                       list_filter(topic_list, lambda k: contains(low, k) and not list_contains(from_query, k))) as kws
            from named""",
        "evidence": """
            select b.rank, t.thread_id, t.url, t.iso, m.reactions, m.shares, m.comments_n, t.post,
                   coalesce(c.five, '') as five, b.score,
                   concat_ws('; ',
                       case when len(k.kws) > 0 then 'Matched keywords: ' || array_to_string(k.kws[1:5], ', ') end,
                       case when b.eng > 10 then 'High engagement (' || cast(b.eng as varchar) || ')' end,
                       'Relevance score: ' || printf('%.1f', b.score)) as why
            from best b join threads t using (ord_raw) join engaged m using (ord_raw)
            join matched k using (ord_raw) left join first_ten c using (ord_raw)
            where b.rank <= 60""",
    }


def _composed() -> str:
    """The texts of ``composed_threads``."""
    phrases = "[" + ", ".join(_text(p) for p in examples()) + "]"
    n = len(examples())
    url = f"'{FORUM}/p/' || cast(o_orderkey as varchar)"
    ts = "cast(epoch(o_orderdate) as bigint)"
    return f"""
        select o_orderkey as ord_raw, o_custkey as cust, {ts} as ts, {url} as url, {_thread_id(url, ts)} as thread_id,
               {_clean("'We like ' || p[o_orderkey % {0} + 1] || ' and ' || p[o_custkey % {0} + 1] || '. https://site' ||"
                       " cast(o_orderkey % 150 as varchar) || '.example.com/' || cast(o_custkey % 7 as varchar)".format(n))} as body
        from orders, (select {phrases} as p)"""


def oracle_sql() -> dict[str, str]:
    scored_many = _scores("asked", "with_ten")
    found = {
        "clean_threads": _sql("""
            select t.ord_raw, t.thread_id, t.iso as "createdAt_iso", t.ts as "createdAt_ts", t.url,
                   t.source as author_name, 'https://forum.example.com/u/' || t.source as author_url,
                   t.text_clean, t.lang as "groupId", m.reactions as "reactionCount",
                   m.shares as "shareCount", m.comments_n as "commentCount"
            from threads t join engaged m using (ord_raw)"""),
        "threads_newest_first": _sql("""
            select thread_id, iso as "createdAt_iso", ts as "createdAt_ts", ord_raw
            from threads order by ts desc, ord_raw"""),
        "nested_comments": _sql("""
            select comment_id, thread_id, iso as "createdAt_iso", url, role as author_name, text_clean,
                   ord_raw, idx from comments where thread_id is not null"""),
        "clean_comments": _sql("""
            select comment_id, thread_id, iso as "createdAt_iso", url, role as author_name, text_clean,
                   ord_raw, idx from comments"""),
        "cleaning_stats": _sql("""
            select (select count(*) from threads) as threads_count,
                   (select count(*) from comments) as comments_count,
                   (select min(iso) from threads) as date_min, (select max(iso) from threads) as date_max,
                   cast(sum(reactions) as bigint) as total_reactions,
                   cast(sum(comments_n) as bigint) as total_comments,
                   cast(sum(shares) as bigint) as total_shares from engaged"""),
        "snippets": _sql(f"""
            select doc_id, {_snippet('c', 100)} as snippet_100, {_snippet('c', 200)} as snippet_200,
                   {_snippet('c', 300)} as snippet_300
            from (select doc_id, {_clean('text')} as c from documents)"""),
        "threads_per_month": _sql("select month, n from months order by month", extra=_BUSY),
        "top_months": _sql(
            "select month, n from months order by n desc, month desc limit 5", extra=_BUSY
        ),
        "engagement_top": _sql(f"""
            select rank, thread_id, iso as "createdAt_iso", url, reactions as "reactionCount",
                   comments_n as "commentCount", shares as "shareCount", {_snippet('post', 200)} as text_snippet
            from (select t.*, m.*, row_number() over (order by m.eng desc, t.ts desc, t.ord_raw) as rank
                  from threads t join engaged m on m.ord_raw = t.ord_raw) where rank <= 300"""),
        "engagement_order_stats": _sql("select p90, p50 from stats", extra=_ORDER_STATS),
        "reaction_histogram": _sql("""
            select b.bin, count(x.reactions) as n
            from (select cast(range + 1 as integer) as bin, range as k from range(50)) b
            cross join (select cast(min(reactions) as double) as lo, cast(max(reactions) as double) as hi from engaged) r
            left join engaged x
              on x.reactions >= lo + b.k * ((hi - lo) / 50) and (b.k = 49 or x.reactions < lo + (b.k + 1) * ((hi - lo) / 50))
            group by 1"""),
        "money_mentions": _sql("""
            select thread_id, "createdAt_iso", url, pattern_pos, matched_text, amount_values, context_tags,
                   text_snippet from money_rows where source_type = 'thread'"""),
        "money_mentions_union": _sql("select * exclude (near_clean) from money_rows"),
        "money_mentions_nested": _sql(f"""
            select source_type, thread_id, comment_id, "createdAt_iso", url, pattern_pos, matched_text,
                   amount_values, context_tags, text_snippet, {_snippet('near_clean', 100)} as context_snippet
            from money_rows"""),
        "money_per_month": _sql("""
            select substr(iso, 1, 7) as month, count(*) as n from money_in_posts
            where iso is not null group by 1"""),
        "extract_links": _sql(f"""
            select {_thread_id('url', 'ts')} as thread_id, p.place, p.url_found
            from (select page_id, url as page_url, 1640995200 + (page_id % 40) * 86400 as ts,
                         '{FORUM}/p/' || cast(page_id as varchar) as url from pages) x,
                 lateral (values (0, rtrim(page_url, '.,;:!?)')), (1, rtrim(page_url, '.,;:!?)')),
                                 (2, 'https://www.Facebook.com/x')) as p(place, url_found)"""),
        "canonical_links": _sql("""
            select page_id, u as url_canonical, domain from page_links
            where domain <> '' and not starts_with(domain, 'facebook.com') and not starts_with(domain, 'fb.')"""),
        "links_rollup": _sql("""
            select u as url_canonical, domain, counts, ids as sample_thread_ids, thread_urls as sample_urls,
                   first_iso as first_seen_iso, last_iso as last_seen_iso from urls"""),
        "domains_top": _sql("""
            select domain, counts, sample_urls from (
                select domain, cast(sum(counts) as bigint) as counts, min(first_place) as first_place,
                       string_agg(u, '|' order by nth) filter (where nth <= 5) as sample_urls
                from (select *, row_number() over (partition by domain order by first_place) as nth from urls)
                group by 1)
            order by counts desc, first_place limit 100"""),
        "domains_by_unique_url": _sql("""
            select domain, count(*) as unique_urls from urls group by 1
            order by count(*) desc, min(first_place) limit 15"""),
        "entities_found": _sql("""
            select entity, category, count_mentions, doc_count_threads, doc_count_all,
                   ids as sample_thread_ids, urls as sample_urls from entity_stats""",
            extra=_entity_blocks(TEST_ENTITIES)),
        "entities_top": _sql("""
            select row_number() over (order by count_mentions desc, first_place) as rank, entity, count_mentions
            from entity_stats qualify rank <= 100""", extra=_entity_blocks(TEST_ENTITIES)),
        "entities_default_lists": _sql("""
            select entity, category, count(*) as count_mentions from entity_rows group by 1, 2""",
            extra=_entity_blocks(entity_families())),
        "marketing_candidates": _sql(f"""
            select thread_id, iso as "createdAt_iso", url, eng as engagement,
                   array_to_string(tags[1:5], '|') as tags_triggered, {_snippet('post', 300)} as text_snippet,
                   round(score, 6) as score
            from ranked_candidates where nth <= 500""", extra=_CANDIDATES),
        "pattern_join": " union all ".join(
            f"select doc_id, {_text(p)} as pattern from documents where regexp_matches(text, {_text('(?i)' + p)})"
            for p in TEST_MARKETING
        ),
        "topic_scores": _sql("select ord_raw, topic, score from topic_hits"),
        "topic_index": _sql("""
            select topic, rank, thread_id, url, score, eng as engagement from topic_best"""),
        "topic_entries": _sql("""
            select l.topic, l.topic_pos, l.keywords, coalesce(b.ids, '') as top_thread_ids,
                   coalesce(b.urls, '') as top_urls
            from (select topic, topic_pos, string_agg(kw, '|' order by kw_pos) as keywords
                  from lexicon group by 1, 2) l
            left join (select topic, string_agg(thread_id, '|' order by rank) as ids,
                              string_agg(url, '|' order by rank) as urls from topic_best group by 1) b using (topic)"""),
        "query_keywords": _sql("select query_id, array_to_string(kws, '|') as keywords from asked"),
        "query_topics": _sql(
            "select query_id, topic, overlap, topic_rank from topics_of where topic_rank <= 3",
            extra={"topics_of": _topics_of("asked")},
        ),
        "word_counts": _sql("select doc_id, " + ", ".join(
            f"len(list_filter({_words('lower(text)')}, lambda w: w = '{w}')) as n_{w}"
            for w in ("en", "the", "license")
        ) + " from documents"),
        "comment_texts": _sql("""
            select t.ord_raw, coalesce(c.five, '') as first_five, coalesce(c.n_ten, 0) as n_ten,
                   w.low as scoring_text
            from threads t join with_ten w using (ord_raw) left join first_ten c using (ord_raw)"""),
        "full_text": _sql("select ord_raw, body as full_text from whole"),
        "evidence_pack": _sql("""
            select rank, thread_id, url, iso as "createdAt_iso", reactions as "reactionCount",
                   shares as "shareCount", comments_n as "commentCount", post as post_text,
                   five as comments_text, why as why_selected, round(score, 6) as score
            from evidence""", extra=_evidence_blocks()),
        "evidence_preview": _sql("""
            select rank, thread_id, printf('%.1f', score) as score_text, url,
                   replace(substr(post, 1, 100), chr(10), ' ') || '...' as text_start
            from evidence where rank <= 5""", extra=_evidence_blocks()),
        "evidence_for_queries": _sql("""
            select query_id, rank, ord_raw, round(score, 6) as score from best where rank <= 10""",
            extra=scored_many),
        "evidence_with_match": _sql("""
            select b.query_id, b.rank, t.thread_id, t.url, t.iso as "createdAt_iso", m.reactions as "reactionCount",
                   m.shares as "shareCount", m.comments_n as "commentCount", t.post as post_text,
                   coalesce(c.five, '') as comments_text,
                   concat_ws('; ',
                       case when len(k.kws) > 0 then 'Matched keywords: ' || array_to_string(k.kws[1:5], ', ') end,
                       case when b.eng > 10 then 'High engagement (' || cast(b.eng as varchar) || ')' end,
                       'Relevance score: ' || printf('%.1f', b.score)) as why_selected,
                   round(b.score, 6) as score
            from first_matched b join threads t using (ord_raw) join engaged m using (ord_raw)
            join matched_many k on k.ord_raw = b.ord_raw and k.query_id = b.query_id
            left join first_ten c on c.ord_raw = b.ord_raw""",
            extra={**scored_many, "first_matched": """
                select * exclude (rank), row_number() over (partition by query_id
                           order by round(score, 9) desc, ts desc, ord_raw) as rank
                from scored s where score > 0 and (
                    exists (from word_part w where w.query_id = s.query_id and w.ord_raw = s.ord_raw and w.n > 0)
                    or exists (from topic_part k where k.query_id = s.query_id and k.ord_raw = s.ord_raw and k.n > 0))
                qualify rank <= 3""".replace("* exclude (rank)", "*"),
                "topic_lists": "select query_id, list(kw order by spot) as topic_list from topic_words group by 1",
                "thread_lists": "select ord_raw, list(w) as ws from thread_words group by 1",
                "matched_many": """
                    select query_id, ord_raw, list_concat(from_query,
                               list_filter(topic_list, lambda k: contains(low, k) and not list_contains(from_query, k))) as kws
                    from (select b.query_id, b.ord_raw, w.low, coalesce(l.topic_list, []) as topic_list,
                                 list_filter(q.kws, lambda x: list_contains(coalesce(t.ws, []), x)) as from_query
                          from first_matched b join asked q on q.query_id = b.query_id
                          join with_ten w on w.ord_raw = b.ord_raw left join topic_lists l on l.query_id = b.query_id
                          left join thread_lists t on t.ord_raw = b.ord_raw)"""}),
        "corpus_report": _sql(f"""
            select t.*, s.p90, s.p50, z.money_mentions, z.unique_urls, z.unique_entities, z.marketing_candidates
            from ({_TOTALS}) t, stats s, sizes z""", extra=_PACK),
        "pack_counts": _sql(f"select *, cast({len(TOPICS)} as bigint) as topics from sizes", extra=_PACK),
    }
    composed = {"composed": _composed(), "link_parts": """
        select *, 'https://site' || cast(ord_raw % 150 as varchar) || '.example.com/' || cast(cust % 7 as varchar) as u,
               'site' || cast(ord_raw % 150 as varchar) || '.example.com' as domain,
               row_number() over (order by -ts, ord_raw) as place from composed""",
        "composed_urls": "select u, domain, count(*) as counts, min(place) as first_place from link_parts group by 1, 2"}
    found["months_of_orders"] = _sql("""
        select substr(iso, 1, 7) as month, count(*) as n from money_threads where iso is not null
        group by 1 order by n desc, month desc limit 5""")
    found["domains_composed"] = _sql("""
        select domain, counts, sample_urls from (
            select domain, cast(sum(counts) as bigint) as counts, min(first_place) as first_place,
                   string_agg(u, '|' order by nth) filter (where nth <= 5) as sample_urls
            from (select *, row_number() over (partition by domain order by first_place) as nth from composed_urls)
            group by 1)
        order by counts desc, first_place limit 100""", extra=composed)
    found["entities_composed"] = _sql(
        "select entity, category, count(*) as count_mentions from entity_rows group by 1, 2",
        extra={**composed, **_entity_blocks(entity_families(), "composed")})
    default_tags = "list_filter([{}], lambda p: p is not null)".format(", ".join(
        f"case when regexp_matches(body, {_text('(?i)' + p)}) then {_text(p)} end" for p in MARKETING_PATTERNS))
    found["marketing_composed"] = _sql("""
        select thread_id, array_to_string(tags[1:5], '|') as tags_triggered, cast(len(tags) as double) as score
        from tagged_composed where len(tags) >= 2 order by len(tags) desc, ts desc, ord_raw limit 500""",
        extra={**composed, "tagged_composed": f"select *, {default_tags} as tags from composed"})
    found["cleaned_dump"] = _sql("""
        select t.ord_raw, t.thread_id, t.iso as "createdAt_iso", t.url, t.text_clean,
               cast(coalesce(c.n, 0) as integer) as comments_n, coalesce(c.n, 0) as in_own_file,
               count(*) over () as threads_count, cast(sum(coalesce(c.n, 0)) over () as bigint) as comments_count,
               min(t.iso) over () as date_min, max(t.iso) over () as date_max
        from threads t left join (select ord_raw, count(*) as n from comments group by 1) c using (ord_raw)""")
    found["built_pack"] = f"""
        select 'engagement_threads_top' as tbl, thread_id as name, cast(rank as bigint) as number
        from ({found['engagement_top']}) union all
        select 'resources_entities', entity, cast(count_mentions as bigint) from ({found['entities_found']}) union all
        select 'marketing_swipe_file', thread_id, cast(engagement as bigint) from ({found['marketing_candidates']}) union all
        select 'topic_index', topic || ':' || thread_id, cast(rank as bigint) from ({found['topic_index']}) union all
        select 'pack_counts', name, number from (
            select threads, unique_entities, marketing_candidates, topics from ({found['pack_counts']}))
        unpivot (number for name in (threads, unique_entities, marketing_candidates, topics))"""
    # Texts in pieces give what whole texts do.
    found["entities_in_pieces"] = found["entities_found"]
    found["entities_over_seams"] = found["entities_composed"]
    found["marketing_over_seams"] = found["marketing_composed"]
    found["links_in_pieces"] = found["links_rollup"]
    found["topic_scores_in_pieces"] = found["topic_scores"]
    found["round_trip_dump"] = _sql("""
        select t.thread_id, t.lang as "groupId",
               cast(row_number() over (partition by t.lang order by t.ord_raw) as integer) as nth_in_group,
               t.ts as "createdAt_ts", t.text_clean, cast(coalesce(c.n, 0) as integer) as comments_n
        from threads t left join (select ord_raw, count(*) as n from comments group by 1) c using (ord_raw)""")
    found["array_dump"] = found["round_trip_dump"]
    found["round_trip_threads"] = _sql("""
        select t.ord_raw, t.thread_id, t.iso as "createdAt_iso", t.ts as "createdAt_ts", t.url, t.text_clean,
               cast(coalesce(c.n, 0) as integer) as comments_n
        from threads t left join (select ord_raw, count(*) as n from comments group by 1) c using (ord_raw)""")
    found["round_trip_comments"] = _sql("""
        select comment_id, thread_id, iso as "createdAt_iso", url, role as author_name, text_clean
        from comments where thread_id is not null""")
    found["round_trip_stats"] = found["cleaning_stats"]
    found["round_trip_csv"] = found["links_rollup"]
    found["round_trip_topic_index"] = found["topic_entries"]
    found["round_trip_evidence"] = _sql("""
        select thread_id, url, iso as "createdAt_iso", reactions as "reactionCount", shares as "shareCount",
               comments_n as "commentCount", post as post_text, five as comments_text, why as why_selected,
               count(*) over () as records
        from evidence""", extra=_evidence_blocks())
    return found
