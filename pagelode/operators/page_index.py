"""Everything that queries over pages need, built once: nodes, passages, targets, controls and their indexes."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.config import DEFAULTS, EngineConfig
from pagelode.functions.affordances import TERMS
from pagelode.operators.lexical import LexicalIndex, asked_index, build_index, query_terms
from pagelode.operators.segment import segment
from pagelode.sources import html


def outline(nodes: DataFrame) -> DataFrame:
    """(page_id, seq, depth, text, level, landmark, landmark_name, heading_path): each heading path once, at its first."""
    path = F.array_join("heading_path", "\x1f")
    rows = nodes.where("is_heading").withColumn("_n", F.expr("row_number() OVER (PARTITION BY page_id, array_join(heading_path, '\x1f') ORDER BY seq)"))
    del path
    return rows.where("_n = 1").select("page_id", "seq", F.size("heading_path").alias("depth"), F.element_at("heading_path", -1).alias("text"), "level", "landmark", "landmark_name", "heading_path", "is_primary")


def content_document(landmark, path, text, weight: int):
    """A target's text for the index: its landmark and its heading path, weighted, before its own text."""
    heading = F.array_join(path, " ")
    return F.concat_ws(" ", landmark, *[F.when(F.length(heading) > 0, heading)] * weight, text)


def targets(chunks: DataFrame, outlined: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(page_id, target_id, kind, ...): passages in order, then sections in order."""
    weight = cfg.lexical.heading_weight
    passages = chunks.select(
        "page_id", F.col("chunk_id").alias("place"), F.lit("passage").alias("kind"), "chunk_id", F.lit(None).cast("int").alias("seq"), "landmark", "landmark_name", "heading_path", "is_primary",
        F.col("text").alias("raw"), (F.col("non_text_words") / F.col("words")).alias("non_text_share"), "strategy", "collapsed", "container", "spans",
        content_document(F.col("landmark"), F.col("heading_path"), F.col("text"), weight).alias("document"),
    )
    sections = outlined.select(
        "page_id", F.col("seq").alias("place"), F.lit("section").alias("kind"), F.lit(None).cast("int").alias("chunk_id"), "seq", "landmark", "landmark_name", "heading_path", "is_primary",
        F.col("text").alias("raw"), F.lit(0.0).alias("non_text_share"), F.lit(None).cast("string").alias("strategy"), F.lit(False).alias("collapsed"), F.lit(-1).alias("container"),
        F.lit(None).cast("array<struct<seq:int,`start`:int,`end`:int>>").alias("spans"), content_document(F.col("landmark"), F.col("heading_path"), F.lit(None).cast("string"), weight).alias("document"),
    )
    both = passages.unionByName(sections)
    return both.withColumn("target_id", F.expr("row_number() OVER (PARTITION BY page_id ORDER BY kind, place) - 1").cast("long")).drop("place")


def control_document(terms: dict[str, str] = TERMS):
    """The text that a control is found by: name, role, headings, row, affordance words and what it governs."""
    name, row, governs = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("name", "row", "controls_name"))
    words = F.create_map(*[x for k, v in terms.items() for x in (F.lit(k), F.lit(v))])
    afforded = F.array_join(F.transform("affordances", lambda a: F.coalesce(F.try_element_at(words, a), F.lit(""))), " ")

    def unless_repeated(other):
        return F.when((F.length(name) > 0) & (F.length(other) > 0) & (name.contains(other) | other.contains(name)), F.lit("")).otherwise(other)

    joined = F.concat_ws(" ", name, "role", F.array_join("heading_path", " "), unless_repeated(row), afforded, unless_repeated(governs))
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


@dataclass
class PageIndex:
    """Lazily built tables of a set of pages, persisted where several queries read them."""

    pages: DataFrame
    cfg: EngineConfig = DEFAULTS
    #: What is asked of a page: parts, and fields of its nodes. What a query reads once needn't be kept.
    parts: Collection[str] = html.PARTS
    fields: Collection[str] | None = None
    once: bool = False

    @cached_property
    def projected(self) -> DataFrame:
        rows = html.project(self.pages, self.cfg, self.parts, self.fields)
        return rows if self.once else rows.persist()

    @cached_property
    def nodes(self) -> DataFrame:
        return html.node_rows(self.projected, self.cfg)

    @cached_property
    def chunks(self) -> DataFrame:
        return segment(self.projected)

    @cached_property
    def outline(self) -> DataFrame:
        return outline(self.nodes)

    @cached_property
    def targets(self) -> DataFrame:
        return targets(self.chunks, self.outline, self.cfg).persist()

    @cached_property
    def content(self) -> LexicalIndex:
        return self._kept(build_index(self.targets, "target_id", "document", ("page_id",), unique=True))

    def asked(self, query: str) -> LexicalIndex:
        """The index of targets as far as a query's terms need it."""
        known = self.__dict__.setdefault("_asked", {})
        if query not in known:
            known[query] = asked_index(self.targets, "target_id", "document", query_terms(self.pages.sparkSession, query), ("page_id",), unique=True)
        return known[query]

    @cached_property
    def controls(self) -> DataFrame:
        """Interactive nodes with their documents."""
        return self.nodes.where("interactive").withColumn("document", control_document()).withColumn("control_id", F.col("seq").cast("long"))

    @cached_property
    def control_index(self) -> LexicalIndex:
        return self._kept(build_index(self.controls, "control_id", "document", ("page_id",), stems=False, concat=True, unique=True))

    def _kept(self, index: LexicalIndex) -> LexicalIndex:
        """An index whose tables are read by several steps of a query."""
        index.postings, index.lengths = index.postings.persist(), index.lengths.persist()
        index.stats = index.lengths.groupBy(*index.keys).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        self._indexes = [*getattr(self, "_indexes", []), index]
        return index

    @property
    def qa(self) -> DataFrame:
        return html.qa_rows(self.projected)

    @property
    def opaque(self) -> DataFrame:
        return html.opaque_rows(self.projected)

    @property
    def coverage(self) -> DataFrame:
        return html.coverage_rows(self.projected)

    def keep(self, rows: DataFrame) -> DataFrame:
        """Rows that several steps of a query read; dropped by release()."""
        self._rows = [*getattr(self, "_rows", []), rows.persist()]
        return self._rows[-1]

    def release(self) -> None:
        """Drop what was persisted."""
        for name in ("projected", "targets"):
            if name in self.__dict__:
                self.__dict__[name].unpersist()
        for rows in getattr(self, "_rows", []):
            rows.unpersist()
        for index in getattr(self, "_indexes", []):
            index.postings.unpersist()
            index.lengths.unpersist()
        for index in self.__dict__.get("_asked", {}).values():
            index.rows.unpersist()
