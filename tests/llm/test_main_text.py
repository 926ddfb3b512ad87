"""Main text of web pages."""

import html
import random
import re

from corpuslens.llm.main_text import extract_main_text, leaves, main_text
from tests.llm.conftest import plain, prose

SF = "/root/testdata/sf0.01"


def sentence(rng):
    return f"{prose(rng.random(), rng.randrange(1, 30)).capitalize()}."


def test_query_against_plain_cutting(spark):
    """Between the article's tags, cut at tags of blocks, other tags and references undone."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for row in pages.collect():
        body = re.search(r"<article>(.*?)</article>", row.html, re.S).group(1).replace("<br>", " ")
        blocks = (html.unescape(re.sub(r"<[^>]*>", "", b)).split() for b in re.split(r"</?(?:p|h1)>", body))
        want[row.page_id] = "\n".join(" ".join(b) for b in blocks if b)
    assert {r.page_id: r.text for r in extract_main_text(pages).collect()} == want


def _soup(rng, declared):
    """A page and its main text; names, elements or nothing but the text tell the rest."""
    body, want = [], []

    def block(tag, text, inner=None):
        body.append(f"<{tag}>{inner or html.escape(text)}</{tag.split()[0]}>")
        want.append(" ".join(text.split()))

    block("h1", prose(rng.random(), 5))
    for _ in range(rng.randrange(3, 9)):
        kind = rng.randrange(6)
        text = " ".join(sentence(rng) for _ in range(rng.randrange(1, 6)))
        if kind == 0:
            block("h2", prose(rng.random(), 3))
        block("p", text, text.replace(" ", "\n  ", 1) if kind == 1 else f"<b>{text}</b>" if kind == 2 else None)
    links = "".join(f"<li><a href='/{i}'>{prose(rng.random(), 2)}</a>" for i in range(12))
    comments = "".join(f"<div class='comment' id='c{i}'><p>{sentence(rng)} {sentence(rng)}</p></div>" for i in range(4))
    article = f"<article>{''.join(body)}</article>" if declared else f"<div class='post-body'>{''.join(body)}</div>"
    page = (
        f"<!DOCTYPE html><html><head><title>{sentence(rng)}</title><style>p > a {{}}</style><script>if (1 < 2) x('</p>')</script></head>"
        f"<body class='no-sidebar'><div class='cookie-notice'>{sentence(rng)} {sentence(rng)}</div><header><p>{sentence(rng)}</p></header>"
        f"<div class='top'><ul>{links}</ul></div><!-- <p>{sentence(rng)}</p> --><div class='columns'>"
        f"<div class='sidebar'><p>{sentence(rng)}</p><ul>{links}</ul></div>{article}<aside>{sentence(rng)}</aside></div>"
        f"<section id='comments'>{comments}</section><form action='/s'><label>{prose(1, 2)}</label><button>Go</button></form>"
        f"<div class='ad'>{sentence(rng)}</div><footer>&copy; {sentence(rng)}</footer></body></html>"
    )
    return page, "\n".join(want)


def test_text_is_told_from_the_rest_with_and_without_an_article():
    rng = random.Random(3)
    for n in range(60):
        page, want = _soup(rng, n % 2 == 0)
        assert main_text(page) == want, n


def test_ratios_decide_where_no_name_or_element_does():
    text = "".join(f"<p>{prose(i, 40)}, {prose(i + 50, 20)}. {prose(i + 99, 9)}.</p>" for i in range(6))
    rest = "".join(f"<div class=x{i}><span>{prose(i, 2)}</span></div>" for i in range(9))
    links = "".join(f"<td><a href=/>{prose(i, 4)}</a></td>" for i in range(9))
    page = f"<body><div><div>{rest}</div></div><table><tr>{links}</tr></table><div class=m><div class=n><h2>{prose(4, 4)}</h2>{text}</div></div></body>"
    got = main_text(page).split("\n")
    assert got[0] == prose(4, 4) and len(got) == 7 and got[1].startswith(prose(0, 40))


def test_markup():
    cases = {
        "": "", "   ": "", "no markup &amp; all": "no markup & all", "<p>a<p>b": "a\nb", "a < b <c": "a < b",
        "<article><p>one<br>two&nbsp;three</p>four</article>": "one two three\nfour",
        "<article><ul><li>a<li>b<ul><li>c</ul><li>d</ul></article>": "a\nb\nc\nd",
        "<article><table><tr><td>a<td>b<tr><td>c</table></article>": "a\nb\nc",
        "<article>x<script>'<p>'</script >y<!-- z --><![CDATA[q]]></article>": "xy",
        "<article title='>'><p title=\"a>b\">t</p></article>": "t", "<article><p>t<span class=ad>no</span> u</p></article>": "t u",
        "<article>&#x41;&#66;&lt;p&gt;&eacute;&unknown;</article>": "AB<p>é&unknown;",
        "<article>a<article>answer</article>b</article>": "a\nb", "<div class=ad>x<article>t</article>": "t",
        "<nav>x</nav>": "", "<article><p>a</b></i></p></div>b</article>": "a\nb", "<article>a<p hidden>b</p><p style='display: none'>c</p></article>": "a",
        "<article><header><h1>t</h1></header><p>a</p><footer>f</footer></article>": "t\na", "<article>a<script>never closed": "a",
        "<form><p>a whole page, in a form.</p></form>": "a whole page, in a form.", "<article>a<p class=\"x": "a",
    }
    for page, want in cases.items():
        assert main_text(page) == want, page


def test_hostile_pages_take_linear_time():
    for page in ("<" * 200_000, "<p \"" * 50_000, "<!--" * 50_000, "<div>" * 20_000 + "x", "&" * 200_000, "<a b='" * 50_000):
        leaves(page)


def test_odd_pages(spark):
    long_page = "<article>" + "".join(f"<p>{prose(i, 200)}.</p>" for i in range(400)) + "</article>"
    rows = [(1, None, "u"), (2, "", None), (None, "<p>x", "u"), (1, None, "u"), (3, long_page, "v"), (4, "<article>x</article>", "v")]
    pages = spark.createDataFrame([(i, h, u, "old", "c") for i, h, u in rows], "page_id long, html string, url string, text string, `a b.c` string")
    out = extract_main_text(pages)
    assert out.columns == ["page_id", "url", "a b.c", "text"]
    got = plain(out.select("page_id", "text").where("page_id is null or page_id <> 3"))
    assert got == [(1, ""), (1, ""), (2, ""), (4, "x"), (None, "x")]
    assert out.where("page_id = 3").first().text.count("\n") == 399
    assert extract_main_text(pages.where("false")).count() == 0
