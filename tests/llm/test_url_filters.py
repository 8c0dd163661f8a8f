import re

from lexspark.llm.url_filters import RULES, judge

PAGES = "page_id bigint, url string, html string, node string, alias string"


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], PAGES)


def plain(url):
    """Host, path and rule of a URL, written out."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


URLS = ["http://A.Example.COM/de/x?y#z", "https://example.net/en/", "https://example.net/en", "x://org/fr/", "http://notnet/", "http://net", "http://a.net?q=/en/", "http://b.example.net/en/#f", "nothing", "", None, "http://ÄB.org/fr/1", "a://b://net/"]


def test_rules(spark):
    for r in judge(pages(spark, *((u, None) for u in URLS))).collect():
        host, path, verdict, rule = plain(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def test_aliases(spark):
    rows = [
        ("http://a.fr/1", '<link rel="canonical" href="http://bad.net/x">'),  # alias of a blocked URL
        ("http://b.fr/2?utm_source=f#top", "<meta http-equiv=refresh content='0; URL=http://a.fr/1'>"),  # by way of an alias
        ("http://b.fr/2", None),  # the same node
        ("http://c.org/fr/3", '<link href="http://a.fr/1" rel=canonical>'),  # allowed by a rule
        ("http://d.fr/4", '<link rel="stylesheet" href="http://bad.net/x">'),
        ("http://e.fr/x/5", '<link rel="canonical" href="../y">'),
    ]
    got = {r["page_id"]: r["verdict"] for r in judge(pages(spark, *rows)).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    more = spark.createDataFrame([("http://d.fr/4", "http://a.fr/1"), (None, "x")], "source string, target string")
    assert {r["page_id"]: r["verdict"] for r in judge(pages(spark, *rows), redirects=more).collect()}[4] == "block"


TARGETS = [
    '<link rel="canonical" href="../../bad">',
    '<link rel="canonical" href="/x/./../bad?utm_source=z">',
    "<link href='/bad' rel='canonical'>",
    '<base href="http://a{}.fr/"><link rel=canonical href=bad>',
    '<base href="/p/q/"><link rel="canonical" href="../../bad">',
    '<link rel="canonical" href="http&#58;&#x2F;&#x2F;a{}.fr/bad">',
    '<!-- <link rel="canonical" href="http://e.fr/"> --><link rel="canonical" href="//a{}.fr/bad">',
    '<META CONTENT="0;url=/bad#top" HTTP-EQUIV="Refresh">',
]


def test_targets(spark):
    """Each names /bad of its own site, whose alias a rule blocks."""
    rows = [x for i, html in enumerate(TARGETS) for x in ((f"http://a{i}.fr/x/y/5?q=1#f", html.format(i)), (f"http://a{i}.fr/bad", f'<link rel="canonical" href="http://bad{i}.net/">'), (f"http://a{i}.fr/other", None))]
    got = {r["page_id"]: r["verdict"] for r in judge(pages(spark, *rows)).collect()}
    assert [got[i] for i in range(len(rows))] == ["block", "block", "allow"] * len(TARGETS)


def test_query_and_fragment_targets_and_non_links(spark):
    rows = [
        ("http://a.fr/p?a=1", '<link rel="canonical" href="?b=2&amp;c=3">'),
        ("http://a.fr/p?b=2&c=3", '<link rel="canonical" href="http://bad.net/">'),
        ("http://a.fr/self", '<link rel="canonical" href="#top">'),
        ("http://a.fr/comment", '<!--<link rel="canonical" href="http://bad.net/">'),
        ("http://a.fr/mail", '<link rel="canonical" href="mailto:x@bad.net">'),
        ("http://a.fr/long", "x" * 300_000 + '<link rel="canonical" href="http://bad.net/">'),
    ]
    clash = pages(spark, *rows).selectExpr("page_id", "url", "html", "'h' as host", "'p' as path", "'r' as rule", "'v' as verdict", "1 as bad", "2 as root")
    got = {r["page_id"]: r["verdict"] for r in judge(clash).collect()}
    assert got == {0: "block", 1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block"}


def test_odd_rows(spark):
    assert judge(pages(spark, ("x", "y")).where("page_id > 5")).count() == 0
    assert judge(pages(spark, (None, None), (None, None), ("http://bad.net/", ""))).count() == 3
