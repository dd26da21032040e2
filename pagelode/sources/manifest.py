"""Site manifests (llms.txt): a table (origin, path, body) parsed by line, listed, searched and read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.config import DEFAULTS, ManifestConfig
from pagelode.functions import text as T

LINK = r"^[-*]\s*\[([^\]]+)\]\(([^)\s]+)\)\s*(?::\s*(.*))?$"
ORIGIN = r"^([a-zA-Z][\w+.\-]*://[^/?#]*)"


def resolve_url(href: Column, origin: Column) -> Column:
    """A manifest's link as an absolute URL; null where it can't be one."""
    return (
        F.when(href.rlike(r"^[a-zA-Z][\w+.\-]*://"), href)
        .when(href.rlike(r"^[a-zA-Z][\w+.\-]*:"), F.lit(None))
        .when(href.startswith("//"), F.concat(F.regexp_extract(origin, r"^([a-zA-Z][\w+.\-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(origin, F.lit("/"), href))
    )


def lines(bodies: DataFrame) -> DataFrame:
    """(origin, path, ln, line, section) of bodies that are small enough."""
    rows = bodies.select("origin", "path", F.posexplode(F.split("body", r"\r?\n")).alias("ln", "line")).withColumn("line", F.trim("line")).where("line <> ''")

    return rows.withColumn("section", F.expr("last(CASE WHEN line LIKE '## %' THEN trim(substring(line, 4)) END, true) OVER (PARTITION BY origin, path ORDER BY ln)"))


def fetch_status(bodies: DataFrame, cfg: ManifestConfig = DEFAULTS.manifest) -> DataFrame:
    """bodies with status: ok, or too-large; a large one is refused, not cut."""
    return bodies.withColumn("status", F.when(F.octet_length("body") <= cfg.max_bytes, "ok").otherwise("too-large"))


def documents(bodies: DataFrame, cfg: ManifestConfig = DEFAULTS.manifest) -> DataFrame:
    """(origin, path, ord, title, url, section, note, same_origin): the links of every manifest."""
    rows = lines(fetch_status(bodies, cfg).where("status = 'ok'"))
    rows = rows.where(F.col("line").rlike(LINK))
    url = resolve_url(F.regexp_extract("line", LINK, 2), F.col("origin"))
    note = F.trim(F.regexp_extract("line", LINK, 3))
    rows = rows.select("origin", "path", "ln", F.trim(F.regexp_extract("line", LINK, 1)).alias("title"), url.alias("url"), "section", F.when(note != "", note).alias("note"))
    rows = rows.withColumn("same_origin", F.coalesce(F.regexp_extract("url", ORIGIN, 1) == F.col("origin"), F.lit(False)))
    return rows.withColumn("ord", F.expr("row_number() OVER (PARTITION BY origin, path ORDER BY ln) - 1")).drop("ln")


def headers(bodies: DataFrame) -> DataFrame:
    """(origin, path, title, summary): the first title, and all quoted lines joined."""
    rows = lines(bodies)
    first = F.min_by(F.when(F.col("line").startswith("# "), F.trim(F.substring("line", 3, 1 << 30))), F.when(F.col("line").startswith("# "), F.col("ln")))
    quoted = F.when(F.col("line").startswith(">"), F.struct("ln", F.trim(F.regexp_replace("line", r"^>+\s*", "")).alias("t")))
    said = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(quoted)), lambda q: q["t"]), lambda t: t != ""), " ")
    return rows.groupBy("origin", "path").agg(first.alias("title"), F.when(said != "", said).alias("summary"))


def chosen(bodies: DataFrame, cfg: ManifestConfig = DEFAULTS.manifest) -> DataFrame:
    """The documents of each origin's manifest: the first path in order that has a link of its own origin."""
    order = F.array_position(F.array(*[F.lit(p) for p in cfg.paths]), F.col("path"))
    rows = documents(bodies, cfg).withColumn("_at", order).where("_at > 0")
    best = rows.where("same_origin").groupBy("origin").agg(F.min("_at").alias("_at"))
    return rows.join(best, ["origin", "_at"]).drop("_at")


def manifest_list(bodies: DataFrame) -> DataFrame:
    """(origin, documents, dropped, hosts): how many links count, and what was dropped as another origin's."""
    rows = chosen(bodies)
    return rows.groupBy("origin").agg(F.count_if("same_origin").alias("documents"), F.count_if(~F.col("same_origin")).alias("dropped"), F.sort_array(F.collect_set(F.when(~F.col("same_origin"), F.regexp_extract("url", r"://([^/?#]*)", 1)))).alias("hosts"))


def manifest_find(bodies: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """(origin, rank, title, url, coverage): documents by how many of the query's words they have, in order on ties."""
    asked = F.array_distinct(T.tokens(F.lit(query)))
    have = F.array_distinct(T.tokens(F.concat_ws(" ", "title", F.coalesce("note", F.lit("")), F.coalesce("section", F.lit("")))))
    rows = chosen(bodies).where("same_origin").withColumn("coverage", F.size(F.array_intersect(asked, have)) / F.size(asked)).where("coverage > 0")
    rows = rows.withColumn("rank", F.expr("row_number() OVER (PARTITION BY origin ORDER BY coverage DESC, ord)"))
    return rows.where(F.col("rank") <= limit) if limit else rows


def manifest_read(bodies: DataFrame, fetched: DataFrame, cfg: ManifestConfig = DEFAULTS.manifest) -> DataFrame:
    """(origin, url, action, text, truncated) of fetched (origin, url, body) that the manifest lists.

    A page is to be navigated to, anything else is read; a URL that isn't listed is not read.
    """
    listed = chosen(bodies).where("same_origin").select("origin", "url").distinct()
    page = F.col("body").rlike(r"(?is)^\s*(<!doctype\s+html|<html|<head)")
    rows = fetched.join(listed.withColumn("listed", F.lit(True)), ["origin", "url"], "left")
    action = F.when(F.col("listed").isNull(), "refused").when(F.octet_length("body") > cfg.max_bytes, "too-large").when(page, "navigate").otherwise("read")
    rows = rows.withColumn("action", action)
    return rows.select("origin", "url", "action", F.when(F.col("action") == "read", F.substring("body", 1, cfg.max_read_chars)).alias("text"), ((F.col("action") == "read") & (F.length("body") > cfg.max_read_chars)).alias("truncated"))


def match_live_links(docs: DataFrame, links: DataFrame) -> DataFrame:
    """docs (origin, title, url) with the live link (origin, name, href) of the same title, else of the same path."""

    def path(c):
        return F.regexp_replace(F.regexp_extract(c, r"^[a-zA-Z][\w+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")

    names = links.groupBy("origin", T.semantic_key(F.col("name")).alias("_k")).agg(F.min_by("href", "seq").alias("by_name"))
    paths = links.groupBy("origin", path(F.col("href")).alias("_p")).agg(F.min_by("href", "seq").alias("by_path"))
    rows = docs.withColumn("_k", T.semantic_key(F.col("title"))).withColumn("_p", path(F.col("url")))
    rows = rows.join(names, ["origin", "_k"], "left").join(paths, ["origin", "_p"], "left")
    return rows.withColumn("live_href", F.coalesce("by_name", "by_path")).drop("_k", "_p", "by_name", "by_path")
