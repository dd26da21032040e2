"""Durable addresses of nodes: minting, and resolving them against another projection by a ladder of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.sources.aria import INTERACTIVE

ADDRESS = "address_id long, page_id long, role string, name string, landmark string, landmark_name string, heading_path array<string>, row string, ordinal int, peer_count int"
NEAREST, CANDIDATES = 5, 6
_PATH = "array_join({}.heading_path, '\x1f')"


def mint(nodes: DataFrame) -> DataFrame:
    """Addresses of nodes; the address id is the node's place in its page."""
    return nodes.select(F.col("seq").cast("long").alias("address_id"), "page_id", "role", "name", "landmark", "landmark_name", "heading_path", "row", F.col("ordinal").cast("int"), F.col("peer_count").cast("int"))


def resolve(addresses: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, address_id, status, relaxed, seq, candidates, nearest) for each address.

    Role, name and landmark never relax; a null row means any. Exact paths come first, then the heading path alone may
    have changed if a single node is left that shares its first part.
    """
    a = addresses.select("page_id", "address_id", *[F.col(c).alias(f"a_{c}") for c in ("role", "name", "landmark", "landmark_name", "row")], F.coalesce("heading_path", F.array().cast("array<string>")).alias("a_path"), F.coalesce("ordinal", F.lit(0)).alias("a_ordinal"), F.col("peer_count").alias("a_peers"))
    n = nodes.select(F.col("page_id").alias("n_page"), "seq", *[F.col(c).alias(f"n_{c}") for c in ("role", "name", "landmark", "landmark_name", "row")], "heading_path")
    same = (F.col("page_id") == F.col("n_page")) & (F.col("a_role") == F.col("n_role"))
    for c in ("name", "landmark", "landmark_name"):
        same &= F.col(f"a_{c}").eqNullSafe(F.col(f"n_{c}"))
    base = a.join(n, same & (F.col("a_row").isNull() | F.col("a_row").eqNullSafe(F.col("n_row")))).select(*a.columns, "seq", "heading_path")
    base = base.withColumn("exact", F.array_join("a_path", "\x1f").eqNullSafe(F.array_join("heading_path", "\x1f")) & (F.size("a_path") == F.size("heading_path")))
    prefix = ((F.size("a_path") == 0) & (F.size("heading_path") == 0)) | ((F.size("a_path") > 0) & (F.size("heading_path") > 0) & (F.try_element_at("a_path", F.lit(1)) == F.try_element_at("heading_path", F.lit(1))))
    base = base.withColumn("_place", F.expr("row_number() OVER (PARTITION BY page_id, address_id, exact ORDER BY seq) - 1"))
    found = base.groupBy("page_id", "address_id").agg(
        F.count_if("exact").alias("exact"), F.count("*").alias("near"), F.max(F.when(F.col("exact") & (F.col("_place") == F.col("a_ordinal")), F.col("seq"))).alias("picked"),
        F.min("seq").alias("lone"), F.bool_or(prefix).alias("prefix"), F.array_sort(F.slice(F.array_sort(F.collect_list(F.when(F.col("exact") & (F.col("_place") < CANDIDATES), F.col("seq")))), 1, CANDIDATES)).alias("exact_seqs"),
        F.array_sort(F.collect_list(F.when(~F.col("exact") & (F.col("_place") < CANDIDATES), F.col("seq")))).alias("near_seqs"),
    )
    peers = F.coalesce(F.col("a_peers"), F.lit(1))
    rows = a.join(found, ["page_id", "address_id"], "left").withColumn("exact", F.coalesce("exact", F.lit(0))).withColumn("near", F.coalesce("near", F.lit(0)))
    bad = F.col("a_role").isNull()
    one = (F.col("exact") == 1) & (peers <= 1) & (F.col("a_ordinal") == 0)
    counted = (F.col("exact") >= 1) & (F.col("exact") == F.coalesce(F.col("a_peers"), F.col("exact"))) & F.col("picked").isNotNull()
    relaxed = (F.col("exact") == 0) & (F.col("near") == 1) & F.col("prefix")
    status = F.when(bad, "NOT_FOUND").when(one | counted | relaxed, "RESOLVED").when(F.col("near") >= 1, "AMBIGUOUS").otherwise("NOT_FOUND")
    rows = rows.withColumn("status", status).withColumn("relaxed", F.coalesce(relaxed & ~bad, F.lit(False)))
    rows = rows.withColumn("seq", F.when(F.col("status") == "RESOLVED", F.when(relaxed, F.col("lone")).otherwise(F.col("picked"))))
    some = nodes.where("name is not null").withColumn("_n", F.expr("row_number() OVER (PARTITION BY page_id, role ORDER BY seq)")).where(F.col("_n") <= NEAREST)
    near = some.groupBy("page_id", F.col("role").alias("a_role")).agg(F.sort_array(F.collect_list("seq")).alias("nearest"))
    rows = rows.join(near, ["page_id", "a_role"], "left")
    candidates = F.when(F.col("exact") >= 1, F.col("exact_seqs")).otherwise(F.col("near_seqs"))
    hint = F.when((F.col("status") == "NOT_FOUND") & F.col("a_name").isNull() & ~F.col("a_role").isin(*INTERACTIVE), "region-gone").when(F.col("status") == "NOT_FOUND", "control-gone").when((F.col("status") == "AMBIGUOUS") & (F.col("exact") >= 1), "peers-changed").when(F.col("status") == "AMBIGUOUS", "path-changed")
    return rows.select("page_id", "address_id", "status", "relaxed", "seq", F.when(F.col("status") == "AMBIGUOUS", candidates).alias("candidates"), F.when(F.col("status") == "NOT_FOUND", F.col("nearest")).alias("nearest"), hint.alias("hint"))


def region_text(nodes: DataFrame, regions: DataFrame, scope: str = "subtree") -> DataFrame:
    """(page_id, region_id, text, nodes): the text of regions (page_id, region_id, landmark, heading_path).

    subtree: all headings below the path; exact: the path alone; outline: from the heading to the next of its level or above.
    """
    r = regions.select("page_id", "region_id", F.col("landmark").alias("r_landmark"), F.col("heading_path").alias("r_path"))
    rows = nodes.join(r, "page_id").where("visible or collapsed").where("text <> ''")
    path = F.array_join("r_path", "\x1f")
    if scope == "exact":
        rows = rows.where(F.array_join("heading_path", "\x1f") == path)
    elif scope == "subtree":
        rows = rows.where(F.array_join(F.slice("heading_path", F.lit(1), F.size("r_path")), "\x1f") == path).where((F.size("r_path") > 0) | F.col("landmark").eqNullSafe(F.col("r_landmark")))
    elif scope == "outline":
        head = rows.where("is_heading").where(F.array_join("heading_path", "\x1f") == path).groupBy("page_id", "region_id").agg(F.min(F.struct("seq", "level")).alias("h"))
        later = rows.where("is_heading").select("page_id", "region_id", F.col("seq").alias("s"), F.col("level").alias("l")).join(head, ["page_id", "region_id"]).where("s > h.seq and l <= h.level").groupBy("page_id", "region_id").agg(F.min("s").alias("stop"))
        rows = rows.join(head, ["page_id", "region_id"]).join(later, ["page_id", "region_id"], "left").where("seq >= h.seq and (stop is null or seq < stop)")
    else:
        raise ValueError(f"unknown scope: {scope}")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy("page_id", "region_id").agg(joined.alias("text"), F.count("*").alias("nodes"))
