"""Column functions on URLs: extraction, canonical form, domain."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.patterns import java_regex
from corpuslens.functions.sqltext import NO_STRINGS, let, quote, strings
from corpuslens.lexicons import TRACKING_PARAMS, TRACKING_PREFIX, URL_PATTERN

_URL = java_regex(URL_PATTERN)


def links_sql(text: str) -> str:
    """Canonical form of every http(s) URL of a text, in order."""
    return f"transform({_found(text)}, link -> {canonical_sql('link')})"


def _found(text: str) -> str:
    return (
        f"case when contains({text}, 'http') then regexp_extract_all({text}, {quote(_URL)}, 0) "
        f"else {NO_STRINGS} end"
    )


def extract_urls(text: str) -> Column:
    """All http(s) URLs of the named text column, without trailing punctuation."""
    return F.expr(_found(text))


@cache
def _lookalikes() -> str:
    """Characters that normalize to a URL delimiter; a host with one is not valid."""
    return "".join(
        chr(c)
        for c in range(0x80, 0x10000)
        if not 0xD800 <= c < 0xE000
        and any(d in unicodedata.normalize("NFKC", chr(c)) for d in "/?#@:")
    )


def _host(url: str) -> str:
    return f"regexp_extract({url}, {quote(r'^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)')}, 1)"


def _bad_host(host: str) -> str:
    """Hosts that cannot be parsed: an unpaired bracket or a delimiter lookalike."""
    return (
        f"(contains({host}, '[') != contains({host}, ']') "
        f"or rlike({host}, {quote('[' + _lookalikes() + ']')}))"
    )


def domain(url: str) -> Column:
    """Host of the named column in lower case, every ``www.`` removed, port kept; ''
    when not valid."""
    body = f"case when {_bad_host('h')} then '' else replace(lower(h), 'www.', '') end"
    return F.expr(let("h", _host(url), body))


def _decode(value: str) -> str:
    """Percent-decoding that leaves stray percent signs alone."""
    return f"url_decode(regexp_replace({value}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"


def _encode(value: str) -> str:
    return f"replace(replace(url_encode({value}), '*', '%2A'), '%7E', '~')"


def _clean_query(query: str) -> str:
    """Drop tracking parameters, group repeated keys at their first place, re-encode."""
    pairs = f"""transform(
        filter(split({query}, '&'), p -> p <> ''),
        p -> named_struct(
            'k', {_decode("substring_index(p, '=', 1)")},
            'v', case when contains(p, '=') then {_decode("regexp_replace(p, '(?s)^[^=]*=', '')")}
                 else '' end))"""
    kept = f"""filter({pairs}, p -> not startswith(p.k, {quote(TRACKING_PREFIX)})
        and not array_contains({strings(TRACKING_PARAMS)}, p.k))"""
    grouped = "flatten(transform(array_distinct(kept.k), k -> filter(kept, p -> p.k = k)))"
    pair = f"concat({_encode('p.k')}, '=', {_encode('p.v')})"
    return let("kept", kept, f"array_join(transform({grouped}, p -> {pair}), '&')")


def canonical_sql(url: str) -> str:
    """:func:`canonical_url` as SQL text."""
    parts = f"""named_struct(
        'scheme', lower(regexp_extract({url}, '^([a-zA-Z]+)://', 1)), 'host', {_host(url)},
        'base', regexp_replace(regexp_replace({url}, '(?s)#.*$', ''), {quote(r'(?s)\?.*$')}, ''),
        'rest', regexp_replace({url}, '(?s)#.*$', ''))"""
    path = "regexp_replace(regexp_replace(u.base, '^[a-zA-Z]+://[^/]*', ''), '(?s);[^/]*$', '')"
    query = f"""case when contains(u.rest, '?')
        then {_clean_query("regexp_replace(u.rest, " + quote(r'(?s)^[^?]*\?') + ", '')")} else '' end"""
    rebuilt = f"concat(u.scheme, '://', u.host, {path}, case when q <> '' then concat('?', q) else '' end)"
    body = f"""case when u.scheme = '' or {_bad_host('u.host')} then {url}
        else {let("q", query, rebuilt)} end"""
    return f"case when {url} is null or {url} = '' then '' else {let('u', parts, body)} end"


def canonical_url(url: str) -> Column:
    """URL of the named column without tracking parameters, fragment and path
    parameters. Scheme in lower case, query values re-encoded, everything else as
    it was."""
    return F.expr(canonical_sql(url))
