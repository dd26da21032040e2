"""The engine's query tools over a set of pages: describe, find, locate, inventory, resolve and manifest.

Every tool answers for all pages at once and returns DataFrames; arguments are checked before anything is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.config import DEFAULTS, EngineConfig
from pagelode.operators import address as A
from pagelode.operators import budget as B
from pagelode.operators import delta as D
from pagelode.operators import find as FIND
from pagelode.operators import locate as LOCATE
from pagelode.operators import structure as S
from pagelode.operators.lexical import fuse, ranked
from pagelode.operators.page_index import PageIndex
from pagelode.operators.segment import segment_stats
from pagelode.sources import manifest as M
from pagelode.sources.html import project_page
from pagelode.sources.tree import Selector, parse

MAX_ARG_CHARS = 16_384
VIEWS = ("actions", "structure", "forms", "scopes")
FIELDS = ("page_id", "seq", "role", "name", "text", "states", "attrs", "landmark", "heading_path", "href", "actionable", "selector")


class InvalidInput(ValueError):
    """An argument of a tool is of the wrong kind."""


def _checked(**given) -> None:
    for name, value in given.items():
        if name in ("query", "description") and (not isinstance(value, str) or not value.strip()):
            raise InvalidInput(f"{name} must be a text that isn't empty")
        if name in ("limit", "offset") and (not isinstance(value, int) or isinstance(value, bool) or value < (name == "limit")):
            raise InvalidInput(f"{name} must be a whole number")
        if isinstance(value, str) and len(value) > MAX_ARG_CHARS:
            raise InvalidInput(f"{name} is too long")


class Engine:
    """Tools over pages (page_id, url, html)."""

    def __init__(self, pages: DataFrame, cfg: EngineConfig = DEFAULTS, manifests: DataFrame | None = None) -> None:
        self.pages, self.cfg, self.manifests = pages, cfg, manifests
        self.index = PageIndex(pages, cfg)

    def describe(self) -> DataFrame:
        """One row for each page: structure, quality, vocabulary, coverage."""
        i = self.index
        outline = i.outline.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "depth", "text"))), lambda x: F.struct(x["depth"].alias("depth"), x["text"].alias("text"))).alias("outline"))
        marks = S.landmarks(i.nodes).groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "landmark"))), lambda x: x["landmark"]).alias("landmarks"))
        rows = i.projected.select("page_id", "url", "lang")
        for part in (marks, outline, segment_stats(i.chunks).drop("structural_pct"), S.quality(segment_stats(i.chunks), S.tree_tokens(i.nodes), self.cfg.retrieval), S.vocabulary(i.nodes), S.coverage_note(i.coverage)):
            rows = rows.join(part, "page_id", "left")
        return rows

    def section(self, heading_path: list[str], scope: str = "subtree") -> DataFrame:
        """The text of the section with this heading path in each page."""
        at = self.pages.select("page_id", F.lit(0).alias("region_id"), F.lit(None).cast("string").alias("landmark"), F.array(*[F.lit(h) for h in heading_path]).alias("heading_path"))
        return A.region_text(self.index.nodes, at, scope)

    def opaque(self) -> DataFrame:
        return self.index.opaque

    def changes(self, before: Engine) -> DataFrame:
        """What changed in each page since another snapshot."""
        return D.semantic_changes((before.index.nodes, before.index.chunks), (self.index.nodes, self.index.chunks), self.cfg.delta.max_semantic_changes)

    def find(self, query: str, limit: int = 5, offset: int = 0, translated: str | None = None) -> DataFrame:
        """Passages for a query; with a translated query both rankings are fused."""
        _checked(query=query, limit=limit, offset=offset)
        if translated is None:
            return FIND.find(self.index, query, limit, offset)
        lists = [FIND.coalesce_regions(FIND.rank_targets(self.index, q)).withColumn("query", F.lit(query)).withColumnRenamed("target_id", "doc") for q in (query, translated)]
        return ranked(fuse(lists, ("page_id",)), ("page_id",)).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))

    def locate(self, description: str, role=None, affordance=None, landmark=None, limit: int = 4, offset: int = 0) -> DataFrame:
        _checked(description=description, limit=limit, offset=offset)
        return LOCATE.locate(self.index, description, role, affordance, landmark, limit, offset)

    def inventory(self, view: str) -> DataFrame:
        """actions, structure, forms or scopes of each page."""
        nodes = self.index.nodes
        if view == "actions":
            return nodes.where("actionable and not inert").select("page_id", "seq", "role", "name", "landmark", "heading_path", "affordances", "states", "ordinal", "peer_count")
        if view == "structure":
            return self.index.outline
        if view == "forms":
            return S.forms(nodes)
        if view == "scopes":
            return self.pages.select("page_id", F.lit("document").alias("scope"), F.col("url").alias("name")).unionByName(
                nodes.where("tag = 'iframe'").select("page_id", F.lit("frame").alias("scope"), F.coalesce("name", F.col("attrs")["src"]).alias("name"))
            )
        raise InvalidInput(f"unknown view: {view}")

    def select_css(self, selector: str, fields: tuple[str, ...] = FIELDS, attributes: tuple[str, ...] = ("aria-", "id", "type", "role", "name", "href")) -> DataFrame:
        """Nodes whose element matches a selector; elements without a node of their own aren't counted."""
        _checked(query=selector)
        unknown = set(fields) - set(FIELDS)
        if unknown:
            raise InvalidInput(f"unknown fields: {sorted(unknown)}")
        try:
            Selector(selector)
        except ValueError as e:
            raise InvalidInput(str(e)) from e

        def matching(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            test = Selector(selector)
            for batch in batches:
                rows = [(p, e.index) for p, html in zip(batch["page_id"], batch["html"], strict=True) for e in parse(html).walk() if test.matches(e)]
                yield pd.DataFrame(rows, columns=["page_id", "el"])

        hits = self.pages.select("page_id", "html").mapInPandas(matching, "page_id long, el int")
        keep = F.map_filter("attrs", lambda k, v: F.lit(False) if not attributes else _any(k, attributes))
        return self.index.nodes.join(hits, ["page_id", "el"]).withColumn("attrs", keep).select(*fields)

    def resolve(self, addresses: DataFrame) -> DataFrame:
        return A.resolve(addresses, self.index.nodes)

    def budgeted(self, rows: DataFrame, tool: str) -> DataFrame:
        """(page_id, budget): the response budget of a tool on each page."""
        fixed = getattr(self.cfg.budget, tool)
        return S.tree_tokens(self.index.nodes).join(rows.select("page_id").distinct(), "page_id").select("page_id", B.cap(fixed, F.col("tree_tokens"), self.cfg.budget).alias("budget"))

    def manifest(self, action: str, query: str | None = None, fetched: DataFrame | None = None) -> DataFrame:
        """list, find or read of the manifests that the engine was given."""
        if self.manifests is None:
            raise InvalidInput("the engine has no manifests")
        if action == "list":
            return M.manifest_list(self.manifests)
        if action == "find":
            _checked(query=query)
            return M.manifest_find(self.manifests, query)
        if action == "read" and fetched is not None:
            return M.manifest_read(self.manifests, fetched)
        raise InvalidInput(f"unknown action: {action}")


def _any(key, attributes: tuple[str, ...]):
    test = F.lit(False)
    for a in attributes:
        test = test | (key.startswith(a) if a.endswith("-") else key == a)
    return test


def verified_answer(region: str, phrase: str | None, fold: Callable[[str], str] = str.lower) -> str | None:
    """A reader's phrase, if the region has it word for word; a reader that doesn't know returns None."""
    if not phrase or not phrase.strip():
        return None
    return phrase.strip() if " ".join(fold(phrase).split()) in " ".join(fold(region).split()) else None


__all__ = ["Engine", "InvalidInput", "project_page", "verified_answer"]
