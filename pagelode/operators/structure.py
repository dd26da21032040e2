"""A page's structure: landmarks, outline, trail, views, vocabulary, forms, coverage and quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.config import DEFAULTS, RetrievalConfig
from pagelode.functions import text as T

INFERRED = ("name-pattern", "sole-field")


def landmarks(nodes: DataFrame) -> DataFrame:
    """(page_id, landmark, nodes, place): landmarks in order of their first node."""
    rows = nodes.where("landmark is not null").groupBy("page_id", "landmark").agg(F.count("*").alias("nodes"), F.min("seq").alias("_first"))
    return rows.withColumn("place", F.expr("row_number() OVER (PARTITION BY page_id ORDER BY _first)")).drop("_first")


def trail(nodes: DataFrame) -> DataFrame:
    """(page_id, seq, text): nodes that say they are the current one."""
    return nodes.where(F.col("states")["current"].isNotNull() & (F.col("states")["current"] != "false")).select("page_id", "seq", F.coalesce("name", "text").alias("text")).where("text <> ''")


def views(nodes: DataFrame, cfg: RetrievalConfig = DEFAULTS.retrieval) -> DataFrame:
    """(page_id, name, seq): names of links in page chrome, each at its first."""
    rows = nodes.where("role = 'link' and actionable and not inert and name is not null").where(F.col("landmark").isin(*cfg.nav_landmarks))
    return rows.groupBy("page_id", "name").agg(F.min("seq").alias("seq"))


def vocabulary(nodes: DataFrame) -> DataFrame:
    """(page_id, authored, inferred): distinct affordances by how they are known, sorted."""
    rows = nodes.select("page_id", F.explode("affordance_via").alias("affordance", "via"))
    kind = F.col("via").isin(*INFERRED)
    return rows.groupBy("page_id").agg(F.sort_array(F.collect_set(F.when(~kind, F.col("affordance")))).alias("authored"), F.sort_array(F.collect_set(F.when(kind, F.col("affordance")))).alias("inferred"))


def forms(nodes: DataFrame) -> DataFrame:
    """(page_id, form, fields, required, required_filled, filled, invalid, complete, submit): a row for each form."""
    s = F.col("states")
    field = F.col("role").isin("textbox", "searchbox", "combobox", "listbox", "checkbox", "radio", "spinbutton", "slider", "switch")
    needs, has, wrong = s["required"] == "true", s["valuePresent"] == "true", s["invalid"] == "true"
    sends = F.array_contains("affordances", "submit")
    rows = nodes.where("form is not null and interactive").groupBy("page_id", "form").agg(
        F.count_if(field).alias("fields"), F.count_if(field & needs).alias("required"), F.count_if(field & needs & has).alias("required_filled"),
        F.count_if(field & has).alias("filled"), F.count_if(field & wrong).alias("invalid"), F.min_by(F.when(sends, F.col("name")), F.when(sends, F.col("seq"))).alias("submit"),
    )
    return rows.withColumn("complete", (F.col("required") == F.col("required_filled")) & (F.col("invalid") == 0))


def tree_tokens(nodes: DataFrame, per: float = DEFAULTS.text.chars_per_token) -> DataFrame:
    """(page_id, tree_tokens): what reading all nodes would cost."""
    size = F.length("role") + F.length(F.coalesce("name", F.lit(""))) + F.length(F.coalesce("text", F.lit(""))) + 6
    return nodes.groupBy("page_id").agg(F.ceil(F.sum(size) / per).alias("tree_tokens"))


def chars_per_token(chunks: DataFrame, cfg: RetrievalConfig = DEFAULTS.retrieval) -> DataFrame:
    """(page_id, chars_per_token) from the scripts of the first passages."""
    some = chunks.where(F.col("chunk_id") < cfg.script_sample_chunks)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", F.substring("text", 1, cfg.script_sample_chars).alias("t")))), lambda x: x["t"]), " ")
    return some.groupBy("page_id").agg(T.chars_per_token(T.script_density(joined, cfg.script_sample_chars)).alias("chars_per_token"))


def quality(stats: DataFrame, tokens: DataFrame, cfg: RetrievalConfig = DEFAULTS.retrieval) -> DataFrame:
    """(page_id, structural_pct, structural_quality, tree_tokens, decline): whether searching the page is worth it."""
    band = F.when(F.col("structural_pct") >= cfg.structural_good_pct, "good").when(F.col("structural_pct") >= cfg.structural_mixed_pct, "mixed").otherwise("low")
    rows = stats.join(tokens, "page_id").withColumn("structural_quality", band)
    decline = (F.col("tree_tokens") < cfg.decline_below_tree_tokens) | (F.col("structural_pct") < cfg.decline_below_structural_pct)
    return rows.select("page_id", "structural_pct", "structural_quality", "tree_tokens", decline.alias("decline"))


def coverage_note(coverage: DataFrame) -> DataFrame:
    """(page_id, note): the counters that aren't zero, in words."""
    told = {
        "non_text_opaque": "images or charts without usable text", "unlabelled_controls": "controls without a usable name", "unknown_roots": "components whose inside can't be read",
        "reveal_pending": "blocks that are not shown yet", "unreachable_frames": "frames that can't be read", "hidden_rows": "rows that are declared but not there", "undeclared_rows": "tables of unknown length",
        "excluded": "excluded subtrees", "malformed_structured_data": "blocks of structured data that can't be parsed", "layout_gap": "hidden elements by attributes alone; style sheets are not read",
    }
    return coverage.select("page_id", F.concat_ws("; ", *[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {words}"))) for c, words in told.items()]).alias("note"))


def live_links(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, href, name, seq): same-origin links with a name, each target once; links into the page itself don't count."""
    origin = F.regexp_extract("url", r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    rows = nodes.where("role = 'link' and actionable and name is not null and href is not null").join(pages.select("page_id", origin.alias("origin"), "url"), "page_id")
    rows = rows.where(F.regexp_extract("href", r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1) == F.col("origin")).where(~(F.col("href").contains("#") & (F.regexp_extract("href", "^([^#]*)", 1) == F.regexp_extract("url", "^([^#]*)", 1))))
    return rows.withColumn("_n", F.expr("row_number() OVER (PARTITION BY page_id, href ORDER BY seq)")).where("_n = 1").select("page_id", "href", "name", "seq")
