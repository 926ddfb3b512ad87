"""Column functions on text: cleaning, fallbacks, snippets, ids, counts, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions.patterns import UNEVEN_SPACE, WORD_CHAR, whole_word
from corpuslens.lexicons import STOP_WORDS


def clean_text(text: Column) -> Column:
    """Collapse each run of whitespace to one space and trim; null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(text, UNEVEN_SPACE, " ")), F.lit(""))


def first_text(*texts: Column) -> Column:
    """The first text that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def cut(clean: Column, max_len: int = 200) -> Column:
    """At most ``max_len`` characters; a cut is marked by ``...``."""
    return F.when(F.length(clean) <= max_len, clean).otherwise(
        F.concat(F.substring(clean, 1, max_len - 3), F.lit("..."))
    )


def snippet(text: Column, max_len: int = 200) -> Column:
    """Start of the cleaned text."""
    return cut(clean_text(text), max_len)


def thread_id(url: Column, created_ts: Column) -> Column:
    """Id from the permalink number, else from a digest of url and time."""
    number = F.regexp_extract(url, r"/permalink/(\p{Nd}+)", 1)
    digest = F.substring(F.md5(F.concat(url, created_ts.cast("string"))), 1, 12)
    return F.concat(F.lit("thread_"), F.coalesce(F.nullif(number, F.lit("")), digest))


def comment_id(url: Column, thread: Column, index: Column) -> Column:
    """Id from the ``comment_id`` in the url, else thread id and position."""
    number = F.regexp_extract(F.coalesce(url, F.lit("")), r"comment_id=(\p{Nd}+)", 1)
    return F.when(number != "", F.concat(F.lit("comment_"), number)).otherwise(
        F.concat(thread, F.lit("_comment_"), index.cast("string"))
    )


def substring_count(text: Column, keyword: Column) -> Column:
    """How often ``keyword`` occurs in ``text`` without overlap (both lower case)."""
    removed = F.octet_length(text) - F.octet_length(F.replace(text, keyword, F.lit("")))
    return F.when(
        F.contains(text, keyword), (removed / F.octet_length(keyword)).cast("long")
    ).otherwise(F.lit(0).cast("long"))


def word_count(text: Column, word: str) -> Column:
    """How often ``word`` (letters and digits) occurs in ``text`` as a whole word."""
    return F.when(
        F.contains(text, F.lit(word)), F.regexp_count(text, F.lit(whole_word(word))).cast("long")
    ).otherwise(F.lit(0).cast("long"))


def words(text: Column) -> Column:
    """The words of a text: maximal runs of letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit(f"{WORD_CHAR}+"), F.lit(0))


def query_keywords(query: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Keywords of a free-text query in order, repeats kept: ASCII words of three
    or more characters that are not stop words."""
    ascii_words = F.regexp_extract_all(
        F.lower(query), F.lit(f"(?<!{WORD_CHAR})[a-zA-Z0-9]+(?!{WORD_CHAR})"), F.lit(0)
    )
    stops = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(ascii_words, lambda w: (F.length(w) > 2) & ~F.array_contains(stops, w))


def iso_time(epoch_seconds: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ``, null for a missing or zero time. Does not depend
    on the session time zone."""
    zero = F.lit(0)
    moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        zero, zero, zero, epoch_seconds.cast("decimal(18,6)")
    )
    text = F.concat(F.replace(moment.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    return F.when(epoch_seconds != 0, text)


# A date, extended or compact, alone or with a time and an offset behind any one character.
_ISO_TIME = (
    r"^(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2}))"
    r"(?:(?s:.)(?:(?:[01]\d|2[0-3])(?::[0-5]\d(?::[0-5]\d(?:[.,]\d+)?)?|[0-5]\d(?:[0-5]\d(?:[.,]\d+)?)?)?"
    r"(?:Z|[+-](?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:\.\d+)?)?)?)?))?$"
)


def month_key(iso: Column) -> Column:
    """``YYYY-MM`` of an ISO date or time in its own offset; null when it is none, as
    for a year or month alone, a time alone, spaces around it or a day that is not in
    the calendar."""

    def part(extended: int) -> Column:
        found = F.regexp_extract(iso, _ISO_TIME, extended)
        return F.when(found != "", found).otherwise(F.regexp_extract(iso, _ISO_TIME, extended + 3))

    year, month, day = part(1), part(2), part(3)
    dated = F.concat_ws("-", year, month, day)
    valid = F.rlike(iso, F.lit(_ISO_TIME)) & (year != "0000") & F.try_to_date(dated, "yyyy-MM-dd").isNotNull()
    return F.when(valid, F.concat_ws("-", year, month))


def day_key(iso: Column) -> Column:
    return F.substring(iso, 1, 10)


def engagement(reactions: Column, comments: Column, shares: Column) -> Column:
    """Reactions + 2 x comments + 3 x shares; null counts as 0."""
    zero = F.lit(0)
    return (
        F.coalesce(reactions, zero) + F.coalesce(comments, zero) * 2 + F.coalesce(shares, zero) * 3
    ).cast("long")


def post_text(clean: str = "text_clean", raw: str = "text_raw") -> Column:
    return first_text(F.col(clean), F.col(raw))


def comment_texts(comments: Column, first: int | None = None) -> Column:
    """Texts of the first comments, empty ones dropped after the cut."""
    head = comments if first is None else F.slice(comments, 1, first)
    texts = F.transform(head, lambda c: first_text(c["text_clean"], c["text_raw"]))
    return F.coalesce(F.filter(texts, lambda t: t != ""), F.array().cast("array<string>"))


def full_text(comments: str = "comments") -> Column:
    """Post and all its comments with one space between; empty comments keep theirs."""
    replies = F.transform(F.col(comments), lambda c: first_text(c["text_clean"], c["text_raw"]))
    replies = F.coalesce(replies, F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(post_text()), replies), " ")
