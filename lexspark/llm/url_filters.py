"""URL filters with redirect equivalence, in DataFrame operations alone.

A rule names a host and the start of a path, and blocks or allows; it fits the host and
its subdomains, and of all that fit the longest wins. Pages, and the targets of their
canonical links and refresh redirects, are nodes; such links are edges. Within a connected
component a block decided by a rule passes to all aliases that no rule decides. An explicit
allow comes first: a URL that a rule allows is allowed whatever its aliases are, and it
passes nothing on.

URLs that differ only in their fragment, in tracking parameters or in the dots of their
path are one node. Links in comments of the html don't count; a link's target may hold
the usual entities, and is resolved against the page's ``base``, if it has one, and its
URL: full, ``//host``, ``/path``, ``?query``, ``#fragment`` and relative targets, with
``.`` and ``..``.

Defined results. Null URL, or one without ``://``: empty host and path, no rule; such rows
are no nodes, and are allowed. Null or link-free html: no edges. Very long html: whole.
Repeated rows: each is judged. Equally long rules: allow first, then by text. Empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import connected_components

#: (verdict, host, path): the rules of the query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref)=[^&#]*"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def undotted(path: Column) -> Column:
    """A path without ``.`` and ``..``; those lead no higher than the root."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))),
    )
    folder = F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"\A/(.*/)?\.\.?(/|\z)"), F.concat(F.lit("/"), F.array_join(kept, "/"), folder)).otherwise(path)


def node(url: Column) -> Column:
    """What aliases share: host, path and query, without the scheme, tracking parameters and the fragment."""
    query = F.regexp_extract(_after_scheme(url), r"\A[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"\A{TRACKING}\z")), "&")
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), F.when(path(url) == "", F.lit("/")).otherwise(undotted(path(url))), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


#: The entities that links are written with; the one for & comes last.
ENTITIES = [("(?i)&(quot|#34|#x22);", '"'), ("(?i)&(apos|#39|#x27);", "'"), ("(?i)&(lt|#60|#x3c);", "<"), ("(?i)&(gt|#62|#x3e);", ">"), ("(?i)&(sol|#47|#x2f);", "/"), ("(?i)&(colon|#58|#x3a);", ":"), ("(?i)&(amp|#38|#x26);", "&")]
_HREF = r"\bhref\s*=\s*(?:\"\s*([^\"]*?)\s*\"|'\s*([^']*?)\s*'|([^\"'\s>]+))"


def uncommented(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", " ")


def _unescaped(target: Column) -> Column:
    for pattern, mark in ENTITIES:
        target = F.regexp_replace(target, pattern, mark)
    return target


def _attribute(html: Column, tag: str) -> Column:
    """The href of each tag, whatever its quotes are."""
    found = [F.regexp_extract_all(html, F.lit(tag + _HREF), F.lit(k)) for k in (1, 2, 3)]
    return F.zip_with(F.zip_with(found[0], found[1], lambda a, b: F.concat(a, b)), found[2], lambda a, b: F.concat(a, b))


def links(html: Column) -> Column:
    """The targets of canonical links and of refresh redirects in html without comments."""
    rel = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?\s*canonical\b)[^>]*?"
    refresh = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*['\"]?([^\"'\s>]+)"
    return F.transform(F.concat(_attribute(html, rel), F.regexp_extract_all(html, F.lit(refresh), F.lit(1))), _unescaped)


def base_of(html: Column, url: Column) -> Column:
    """The URL that the page's relative links follow."""
    found = _unescaped(F.get(_attribute(html, r"(?is)<base\b[^>]*?"), F.lit(0)))
    return F.when(found.isNull() | (found == ""), url).otherwise(resolved(found, url))


def resolved(target: Column, url: Column) -> Column:
    """A link's target as a full URL; relative ones follow the page's URL."""
    scheme = F.regexp_extract(url, r"\A([^:]*://)", 1)
    site = F.concat(scheme, F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1))
    folder = F.concat(site, F.coalesce(F.nullif(F.regexp_extract(path(url), r"\A(.*/)?", 0), F.lit("")), F.lit("/")))
    return (
        F.when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"\A([^:]*:)", 1), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path(url), target))
        .when(target.startswith("#"), F.concat(F.regexp_extract(url, r"\A([^#]*)", 1), target))
        .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))  # mailto: and the like name no page
        .otherwise(F.concat(folder, target))
    )


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of its verdict and text; null if none does."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    for verdict, name, start in reversed(ordered):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(name + start).alias("rule"))).otherwise(found)
    return found


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict. redirects: more edges, as (source, target) URLs."""
    view = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    h, p = host(F.col("url")), path(F.col("url"))
    named = view.select("page_id", h.alias("host"), p.alias("path"), node(F.col("url")).alias("node"), rule_of(h, p, rules).alias("found"))

    linking = view.where(F.col("html").rlike("(?i)canonical|refresh")).select("url", uncommented(F.col("html")).alias("html"))
    edges = linking.select("url", base_of(F.col("html"), F.col("url")).alias("base"), F.explode(links(F.col("html"))).alias("target"))
    edges = edges.select(F.col("url").alias("source"), resolved(F.col("target"), F.col("base")).alias("target")).where("target is not null")
    if redirects is not None:
        edges = edges.unionByName(redirects.select(F.col("source").cast("string"), F.col("target").cast("string")))
    pairs = materialise(edges.select("source", "target", node(F.col("source")).alias("a"), node(F.col("target")).alias("b")), "redirects")
    roots = connected_components(pairs, "a", "b").withColumnRenamed("node", "alias")

    # Every URL of an edge decides too, whether or not it is a page of the table.
    ends = pairs.select(F.col("source").alias("url")).unionByName(pairs.select(F.col("target").alias("url")))
    blocked = ends.where(rule_of(host(F.col("url")), path(F.col("url")), rules)["verdict"] == "block").select(node(F.col("url")).alias("alias")).distinct()
    # Two plain shuffles meet, so that a component of any size can be split.
    bad = materialise(blocked.join(roots, "alias").select("root").distinct().withColumn("bad", F.lit(True)), "blocked")
    passed = roots.join(bad.hint("merge"), "root").select("alias", "bad")
    joined = named.join(passed, F.col("node") == F.col("alias"), "left")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("bad"), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))
