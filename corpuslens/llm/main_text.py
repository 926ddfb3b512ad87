"""Main text of web pages by the text and punctuation that each tag path leads to."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# ------------------------------------------------------------------ fixed values: tags and names

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no markup, as far as their end tag.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: Elements that hold no main text.
NO_TEXT = frozenset(
    "aside audio button canvas datalist dialog footer head input label menu meter nav noscript object option progress script "
    "search select style svg template textarea title video".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in the class or id of elements that hold no main text.
NO_TEXT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices outbrain popup promo "
    "promoted related respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe taboola toolbar topbar "
    "widget widgets".split()
)
#: Words before one of those that say where an element is or what it lacks, not what it is.
SET_ASIDE = frozenset("has no with without".split())
NO_TEXT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Tags that end an open element, and the tags beyond which they don't reach.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, set()),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？؟،।]")

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|</[^a-zA-Z][^>]*>", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# ------------------------------------------------------------------ page to leaves

#: Why text is no candidate: an element or a name that holds none, a comment, a form.
ELEMENT, NAME, COMMENT, FORM = 1, 2, 4, 8


@dataclass
class Leaf:
    """The text of a block, between the tags of blocks, and where it stands."""

    path: tuple[str, ...]
    why_not: int
    article: bool
    text: str = ""
    linked: int = 0


@dataclass
class _Open:
    tag: str
    path: tuple[str, ...]
    why_not: int
    article: bool
    block: bool = field(default=True)


@lru_cache(maxsize=4096)
def _names(attributes: str) -> tuple[str, bool, frozenset[str], str]:
    """Of an element's attributes: its label, whether it is hidden, what its class and id
    say that it holds, and its role."""
    found: dict[str, str] = {}
    for key, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), "".join(values))
    style = found.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in found or "display:none" in style or "visibility:hidden" in style
    said = f"{found.get('class', '')} {found.get('id', '')}"
    words: set[str] = set()
    for name in said.split():
        parts = [w.lower() for w in _WORD.findall(name)]
        words.update(w for before, w in zip(["", *parts], parts) if before not in SET_ASIDE)
    if "comment" in found.get("itemprop", "").lower() or found.get("itemtype", "").lower().endswith("/comment"):
        words.add("comment")
    label = re.sub(r"\d+", "", (found.get("class", "").split() or [found.get("id", "")])[0])
    return label, hidden, frozenset(words & NO_TEXT_NAMES), found.get("role", "").lower().strip()


def _why_not(tag: str, attributes: str, above: _Open) -> tuple[int, str]:
    """What speaks against the text in an element, and its label."""
    why = ELEMENT if tag in NO_TEXT else FORM if tag == "form" else 0
    if tag == "header" and not above.article:
        why = ELEMENT
    label = ""
    if "=" in attributes or "hidden" in attributes:
        label, hidden, words, role = _names(attributes)
        if hidden:
            why |= ELEMENT
        if tag not in ("html", "body", "main", "article") and tag not in HEADINGS:
            if above.article:
                words -= {"header"}
            if words & {"comment", "comments", "commentlist", "disqus", "respond"}:
                why |= COMMENT
            elif words:
                why |= NAME
            if role in NO_TEXT_ROLES and not (role == "banner" and above.article):
                why |= FORM if role == "form" else ELEMENT
        elif tag == "article" and words & {"comment", "comments"}:
            why |= COMMENT
    return why, label


def leaves(page: str) -> list[Leaf]:
    """The blocks of a page that hold text, in page order.

    Markup is read as browsers read it: elements whose end tags may be left out end where
    the next begins, end tags without a start are passed over, and what is not closed ends
    with the page. An article or main element that is not inside an article begins anew
    whatever stands open before it; an article in an article is a reader's comment.
    """
    root = _Open("", (), 0, False)
    stack, out, parts = [root], [], []
    in_link, linked, at = False, 0, 0

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            top = next(o for o in reversed(stack) if o.block)
            out.append(Leaf(top.path, top.why_not, top.article, text, linked))
        parts.clear()
        linked = 0

    def add(raw: str):
        nonlocal linked
        if not stack[-1].block and stack[-1].why_not:  # inside a line, and not of its text
            return
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len("".join(text.split()))

    def close(i: int):
        if any(o.block for o in stack[i:]):
            flush()
        del stack[i:]

    while True:
        match = _TAG.search(page, at)
        if match is None:
            add(page[at:])
            break
        if match.start() > at:
            add(page[at : match.start()])
        at = match.end()
        slash, tag, attributes, slash2, tag2, attributes2 = match.groups()
        if tag2 is not None:
            slash, tag, attributes = slash2, tag2, attributes2
            if not match.group().endswith(">"):
                break  # a tag that the page ends in
        if tag is None:
            continue
        tag = tag.lower()
        if slash:
            if tag == "a":
                in_link = False
            if tag == "p" and not any(o.tag == "p" for o in stack):
                flush()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCKS and stack[i].block:
                    break
            continue
        block = tag in BLOCKS
        if tag == "br" or tag == "wbr":
            if tag == "br":
                add(" ")
            continue
        if block:
            in_link = False
            ends, beyond = ENDS.get(tag, ({"p"}, {"td", "th", "caption", "button", "object"}))
            for _ in range(2):
                low = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ends or stack[i].tag in beyond), 0)
                if low and stack[low].tag in ends:
                    if tag in ENDS:  # the outermost of those that end
                        while low > 1 and stack[low - 1].tag in ends:
                            low -= 1
                    close(low)
                ends, beyond = {"p"}, {"td", "th", "caption", "button", "object"}
            flush()
        elif tag == "a":
            in_link = True
        if tag == "hr" or tag in EMPTY:
            continue
        above = stack[-1]
        why, label = _why_not(tag, attributes, above)
        if block:
            article, base = above.article, above.why_not
            if tag in ("article", "main"):
                if above.article and tag == "article" and any(o.tag == "article" for o in stack):
                    why |= COMMENT
                elif not above.article:
                    base &= COMMENT
                article = True
            stack.append(_Open(tag, (*above.path, f"{tag}.{label}" if label else tag), base | why, article))
        elif tag in RAW or why or above.why_not and not above.block:
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                at = end.start() if end else len(page)
                if end:
                    at = page.find(">", at) + 1 or len(page)
                continue
            if not attributes.endswith("/"):
                stack.append(_Open(tag, above.path, above.why_not | why, above.article, False))
    flush()
    return out


# ------------------------------------------------------------------ leaves to text


def path_distance(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    """How many labels two paths differ by: what is below their common beginning, at the longer one."""
    common = 0
    for x, y in zip(a, b):
        if x != y:
            break
        common += 1
    return max(len(a), len(b)) - common


def path_scores(found: list[Leaf]) -> dict[tuple[str, ...], float]:
    """Score of each tag path, 0 to about 1.

    Characters a leaf and punctuation marks a leaf, each over the page's largest, are fused
    as their geometric mean, then smoothed over the paths with Gaussian weights of the paths'
    distance, so that a heading counts with the paragraphs beside it. Paths inside the
    page's article, or inside what holds its best path, get a part of the score for that.
    Last, what a path's text owes to links is taken off.
    """
    sums: dict[tuple[str, ...], list] = {}
    for leaf in found:
        s = sums.setdefault(leaf.path, [0, 0, 0, 0, leaf.article])
        s[0] += 1
        s[1] += len(leaf.text)
        s[2] += len(PUNCTUATION.findall(leaf.text))
        s[3] += min(leaf.linked, len(leaf.text))
    most_text = max(s[1] / s[0] for s in sums.values())
    most_marks = max(s[2] / s[0] for s in sums.values())
    ratio = {
        p: ((s[1] / s[0] / most_text) * (s[2] / s[0] / most_marks if most_marks else 1.0)) ** 0.5 for p, s in sums.items()
    }
    best = max(sums, key=lambda p: (ratio[p] * sums[p][1] * (1 - sums[p][3] / sums[p][1]), p))
    holder = best[:-1]
    weight = [math.exp(-d * d / 2) for d in range(64)]
    out = {}
    for p, s in sums.items():
        near = [(weight[d], ratio[q]) for q in ratio if (d := path_distance(p, q)) < 5]
        score = sum(w * r for w, r in near) / sum(w for w, _ in near)
        inside = s[4] or len(holder) > 2 and p[: len(holder)] == holder
        out[p] = (score + PRIOR * inside) * (1 - s[3] / s[1])
    return out


#: Score of a path for standing inside the article, and the least score of a path that is kept.
PRIOR, LEAST = 0.25, 0.2


def candidates(found: list[Leaf]) -> list[Leaf]:
    """The leaves that may be main text: those in the page's article if it has one. Forms
    are left out unless they hold most of the page, names unless they hold all of it."""
    plain = [x for x in found if not x.why_not]
    formed = [x for x in found if x.why_not in (0, FORM)]
    if sum(len(x.text) for x in formed) > 2 * sum(len(x.text) for x in plain):
        plain = formed
    if not plain:
        plain = [x for x in found if not x.why_not & (ELEMENT | COMMENT)]
    return [x for x in plain if x.article] or plain


def main_text(page: str | None) -> str:
    """The blocks of main text of a page, joined by line feeds."""
    found = candidates(leaves(page or ""))
    if not found:
        return ""
    scores = path_scores(found)
    return "\n".join(x.text for x in found if scores[x.path] >= LEAST)


def extract_main_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """The rows without the page, with its main text behind their columns.

    A block is what stands between the tags of block elements. Its references are decoded,
    its white space (also of ``br`` and of the no-break kind) becomes one space, and it is
    trimmed; blocks are joined in page order by a line feed. Menus, headers and footers,
    sidebars, notices, adverts, forms, scripts, styles, hidden elements and readers' comments
    are told by their elements, roles and names; of the rest, those tag paths are kept whose
    text and punctuation ratios, smoothed and fused, reach the threshold.

    Null, empty and textless pages give an empty text; pages are read whole, however long,
    one at a time; null and repeated keys, and repeated rows, are rows like others; paths
    with the same score are kept or left alike; an empty table gives no rows. A column that
    has the name of the new one is replaced; others stay as they are, whatever their names.
    """
    kept = [c for c in pages.columns if c not in (html, name)]
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("page"), F.col(f"`{html}`").alias("html"))
    schema = StructType([rows.schema["page"]]).add("text", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema).select("page.*", F.col("text").alias(name))
