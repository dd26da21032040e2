"""Controls by description: ranking, filters, confidence and the gates of a recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.functions import text as T
from pagelode.operators import lexical as L
from pagelode.operators.page_index import PageIndex


def rank_controls(index: PageIndex, description: str) -> DataFrame:
    """Every control that a term hits: (page_id, query, control_id, score, rank, coverage)."""
    spark, cfg = index.pages.sparkSession, index.cfg
    terms = L.query_terms(spark, description, stems=False, concat=True)
    hits = L.ranked(L.bm25(index.control_index, terms, cfg.lexical), ("page_id",))
    wanted = L.informative(L.term_shares(index.control_index, terms), cfg.retrieval)
    cov = L.coverage(index.control_index.postings, wanted, ("page_id",))
    rows = hits.join(cov, ["page_id", "query", "doc"], "left").withColumnRenamed("doc", "control_id")
    return rows.withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))


def locate(index: PageIndex, description: str, role: str | None = None, affordance: str | list[str] | None = None, landmark: str | None = None, limit: int = 4, offset: int = 0) -> DataFrame:
    """Candidates of each page, the fuzzy ones only where nothing else is left, with confidence, ambiguity and recommendation."""
    cfg = index.cfg.retrieval
    told = ["page_id", "control_id", "seq", "role", "name", "row", "landmark", "landmark_name", "heading_path", "states", "affordances", "affordance_via", "actionable", "inert", "ordinal", "peer_count"]
    controls = index.keep(index.controls.select(*told, "document"))
    ranked = rank_controls(index, description).join(controls, ["page_id", "control_id"])
    fits = F.lit(True)
    if role:
        fits &= F.col("role") == role
    if affordance:
        fits &= F.arrays_overlap("affordances", F.array(*[F.lit(a) for a in ([affordance] if isinstance(affordance, str) else affordance)]))
    if landmark:
        fits &= F.col("landmark") == landmark
    usable = F.col("actionable") & ~F.col("inert")
    marked = index.keep(ranked.withColumn("_fits", fits))
    counts = marked.groupBy("page_id").agg(F.count_if(~F.col("_fits")).alias("removed_by_filter"), F.count_if(F.col("_fits") & ~usable).alias("latent"))
    kept = marked.where("_fits").where(usable).withColumn("match", F.lit("ranked")).drop("_fits")
    fuzzy = L.fuzzy(controls.where(usable), "control_id", "document", description, ("page_id",), cfg).withColumnRenamed("doc", "control_id").withColumn("coverage", F.lit(0.0)).join(controls, ["page_id", "control_id"])
    rest = fuzzy.join(kept.select("page_id").distinct(), "page_id", "left_anti").withColumn("match", F.lit("fuzzy"))
    rows = kept.drop("first").unionByName(rest.select(*kept.drop("first").columns))
    rows = rows.withColumn("rank", F.expr("row_number() OVER (PARTITION BY page_id ORDER BY rank)"))
    rows = index.keep(rows.withColumn("confidence", L.confidence(F.col("coverage"), cfg)))
    key = T.semantic_key(F.lit(description))
    gates = rows.groupBy("page_id").agg(
        F.count("*").alias("matched"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("_top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("_next"),
        F.max(F.when(F.col("rank") == 1, F.col("coverage"))).alias("_first"), F.max(F.when(F.col("rank") > 1, F.col("coverage"))).alias("_lower"),
        F.bool_or((F.col("rank") == 1) & (T.semantic_key(F.col("name")) == key)).alias("_named"), F.bool_or((F.col("rank") > 1) & (T.semantic_key(F.col("name")) == key)).alias("_other"),
        F.max(F.when(F.col("rank") == 1, F.col("match"))).alias("_match"), F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("_confidence"),
    )
    unsure = (F.col("_next") / F.col("_top") > cfg.ambiguity_ratio) | (F.col("_lower") > F.col("_first")) | (F.col("_other") & ~F.col("_named")) | (F.col("_match") == "fuzzy")
    gates = gates.withColumn("ambiguous", F.coalesce(unsure, F.lit(False)) if offset == 0 else F.lit(False)).withColumn("_sure", ~F.col("ambiguous") & (F.col("_confidence") == "high"))
    rows = rows.join(gates.select("page_id", "matched", "ambiguous", "_sure"), "page_id").join(counts, "page_id", "left")
    rows = rows.withColumn("recommended", F.col("_sure") & (F.col("rank") == 1)).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    return rows.drop("document", "_sure").withColumn("score", F.round("score", 3)).withColumn("coverage", F.round("coverage", 2))


def refinements(found: DataFrame) -> DataFrame:
    """(page_id, roles, affordances, landmarks, names): what tells the candidates apart, where there is more than one."""

    def several(column):
        values = F.sort_array(F.collect_set(column))  # of the few candidates shown
        return F.when(F.size(values) > 1, values)

    wide = found.select("page_id", "role", "landmark", "name", F.explode_outer("affordances").alias("affordance"))
    return wide.groupBy("page_id").agg(several("role").alias("roles"), several("affordance").alias("affordances"), several("landmark").alias("landmarks"), several("name").alias("names"))


def controls_in_region(index: PageIndex, hits: DataFrame, query: str, most: int = 3) -> DataFrame:
    """(page_id, target_id, control_id, hits, rank): the controls inside each hit's region that the query names most."""
    controls = index.controls.where("actionable and not inert").select("page_id", "control_id", F.explode("ancestors").alias("container"), T.tokens(F.col("name")).alias("_tokens"))
    wanted = F.array_distinct(T.tokens(F.lit(query)))
    rows = hits.where("container >= 0").select("page_id", "target_id", "container").join(controls, ["page_id", "container"])
    rows = rows.withColumn("hits", F.size(F.filter("_tokens", lambda t: F.array_contains(wanted, t))) / F.greatest(F.size(wanted), F.lit(1)))
    rows = rows.withColumn("_any", F.expr("max(hits) OVER (PARTITION BY page_id, target_id)")).where("hits > 0 or _any = 0")
    rows = rows.withColumn("rank", F.expr("row_number() OVER (PARTITION BY page_id, target_id ORDER BY hits DESC, control_id)"))
    return rows.where(F.col("rank") <= most).select("page_id", "target_id", "control_id", "hits", "rank")
