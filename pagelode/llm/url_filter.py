"""URL filters with redirect equivalence, in DataFrame operations only.

Method. A rule (host, path) fits its host and all subdomains where the URL's path starts with its own; the longest
rule wins. Pages that no rule fits are judged by their aliases: redirects, meta refreshes and canonical links are
edges between URLs, connected components over them are equivalence classes, and a class with an explicitly allowed
URL is allowed; otherwise one blocked URL blocks it; otherwise it is allowed.

Scale. Pages are read once for their rules and once for their links; only the URLs at either end of a link enter the
components, whose hubs can be split. The rules are an expression, so their number is bounded (1,000).

Defined cases. A null URL, or one without "://", has empty host and path, fits no rule and is allowed. Null html has
no links. Hosts are compared without A-Z case, paths as they are. Fragments don't tell URLs apart, queries do.
Equally long rules: allow wins. Null ids and repeated rows are judged like any other row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm.components import connected_components
from pagelode.llm.scratch import materialize

MOST_RULES = 1000
#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b)[^>]*\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*["']?([^"'>\s]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no "://"."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (size, first, rule, verdict); null where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = []
    for verdict, at, start in rules:
        mine = ((host == at) | host.endswith(f".{at}")) & path.startswith(start)
        fits.append(F.when(mine, F.struct(F.lit(len(at) + len(start)).alias("size"), F.lit(int(verdict == "allow")).alias("first"), F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def node_of(url: Column) -> Column:
    """The URL as its class sees it: scheme and host lower-cased, no fragment; null where it isn't a URL."""
    bare = F.regexp_extract(url, r"(?s)^([^#]*)", 1)
    origin = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    return F.when(F.length(origin) > 0, F.concat(F.translate(origin, _UPPER, _LOWER), F.regexp_extract(bare, r"(?s)^.*?://[^/?]*(.*)$", 1)))


def resolved(base: Column, link: Column) -> Column:
    """A link as an absolute URL, seen from a page; null where it isn't one of the web."""
    link = F.trim(F.regexp_replace(link, "&amp;|&#38;", "&"))
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = url_parts(base)[1]
    folder = F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise(F.lit("/"))
    return (
        F.when((F.length(origin) == 0) | (F.length(link) == 0) | link.isNull(), F.lit(None))
        .when(link.rlike(r"(?i)^https?://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .when(link.startswith("#"), base)
        .otherwise(F.concat(origin, folder, link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): each page's URL and the URLs that its canonical links and its refreshes name."""
    told = pages.where(F.col("html").rlike("(?i)canonical|http-equiv") & F.col("url").isNotNull())
    found = [(_CANONICAL, 1), (_CANONICAL, 2), (_CANONICAL, 3), (_REFRESH, 1)]
    links = F.array_distinct(F.concat(*[F.regexp_extract_all("html", F.lit(pattern), F.lit(n)) for pattern, n in found]))
    links = told.select("url", F.explode(links).alias("link"))
    return links.select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("url"), F.col("link"))).alias("b")).where("b is not null and a <> b")


def url_filter(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages (page_id, url, html).

    redirects: more edges, (a, b) of absolute URLs, where a crawl has recorded them.
    """
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")))
    edges = materialize(edges.where("a is not null and b is not null and a <> b").distinct(), "aliases")
    host, path = url_parts(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node"))
    judged = judged.withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    own = F.col("own.verdict")
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(own, F.lit("allow")).alias("verdict"))
    classes = materialize(connected_components(edges, native=True), "classes")
    at, to = url_parts(F.col("node"))
    marked = classes.withColumn("v", rule_for(at, to, rules)["verdict"])
    verdicts = marked.groupBy("component").agg(F.coalesce(F.bool_or(F.col("v") == "allow"), F.lit(False)).alias("allowed"), F.coalesce(F.bool_or(F.col("v") == "block"), F.lit(False)).alias("blocked"))
    blocked = materialize(classes.join(verdicts.where("blocked and not allowed"), "component").select("node", F.lit("block").alias("by_class")), "blocked")
    judged = judged.join(blocked, "node", "left")
    return judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(own, "by_class", F.lit("allow")).alias("verdict"))
