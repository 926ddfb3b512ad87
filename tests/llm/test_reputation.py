from pyspark.sql import functions as F

from corpuslens.llm.reputation import DOMAIN_PATTERN, SUFFIX_PATTERN, Rule, host_reputations, judge_urls

RULES = [Rule("net/", True), Rule("bad.net/x", False), Rule("bad.net/x/ok", True)]


def test_hosts_domains_and_suffixes(spark):
    cases = {"a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "xco.uk": ("uk", "xco.uk"), "www.a.org": ("org", "a.org"), "localhost": ("localhost", "")}
    rows = spark.createDataFrame([(h,) for h in cases], "h string").select(
        "h", F.regexp_extract("h", SUFFIX_PATTERN, 1).alias("s"), F.regexp_extract("h", DOMAIN_PATTERN, 1).alias("d")
    )
    assert {r.h: (r.s, r.d) for r in rows.collect()} == cases


def test_rules_and_odd_urls(spark):
    urls = [
        "http://A.Bad.NET/x?q", "http://bad.net/x/ok#a", "https://good.net", "https://good.net/", "no scheme", None, "", "x://",
        "http://h.org/p://q/r", "http://notbad.net/x", "HTTP://BÄD.Net/x",
    ]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    pages = pages.union(spark.createDataFrame([(None, "http://a.org/", None, None), (3, "https://good.net/", None, None)], pages.schema))
    labels = spark.createDataFrame([(0, 0), (1, None), (None, 0), (77, 1)], "doc_id long, quality int")
    rows = judge_urls(pages, labels, RULES).collect()
    got = {r.page_id: (r.host, r.path, r.rule) for r in rows}
    assert len(rows) == len(urls) + 2
    assert got[0] == ("a.bad.net", "/x", "bad.net/x") and got[1] == ("bad.net", "/x/ok", "bad.net/x/ok")
    assert got[2] == ("good.net", "", None) and got[3] == ("good.net", "/", "net/")
    assert got[4] == got[5] == got[6] == ("", "", None) and got[7] == ("", "", None)
    assert got[8] == ("h.org", "/p://q/r", None) and got[9] == ("notbad.net", "/x", "net/") and got[10] == ("bÄd.net", "/x", "net/")
    assert all(r.verdict == {"net/": "allow", "bad.net/x": "block", "bad.net/x/ok": "allow"}.get(r.rule, r.verdict) for r in rows)


def test_shrinkage_goes_down_the_hierarchy(spark):
    rows = [("a.bad.com", 1)] * 60 + [("b.bad.com", 1)] * 55 + [("b.bad.com", 0)] * 5 + [("www.fine.com", 0)] * 80 + [("new.bad.com", None), ("new.fine.com", None), ("one.bad.com", 0)]
    got = {r.host: r for r in host_reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["new.bad.com"].rate > 0.6 > 0.4 > got["new.fine.com"].rate
    assert got["a.bad.com"].low > 0.8 and got["www.fine.com"].high < 0.2
    assert got["one.bad.com"].rate < got["new.bad.com"].rate
    assert all(r.low < r.rate < r.high for r in got.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert judge_urls(none, labels, RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/x")], none.schema)
    assert judge_urls(one, labels, RULES).first().verdict in ("allow", "block")
