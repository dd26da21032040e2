"""Segmentation of a page's nodes into passages: a fold in node order, then column work."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.config import DEFAULTS, SegmentConfig

CHUNK = """chunk_id int, is_primary boolean, collapsed boolean, landmark string, landmark_name string,
heading_path array<string>, strategy string, text string, words int, non_text_words int, container int,
spans array<struct<seq:int,`start`:int,`end`:int>>"""
STRATEGIES = ("heading", "landmark", "containment", "window")
_WORD = re.compile(r"[^\W_]+")


def _shared(a: list[int], b: list[int]) -> list[int]:
    """The elements above both, nearest first."""
    inside = set(b)
    return [x for x in a if x in inside]


def segment_nodes(nodes: list, cfg: SegmentConfig = DEFAULTS.segment) -> list[dict]:
    """Passages of a page. A heading opens one; so does a change of place, or a node that is too much for a full one."""
    out: list[dict] = []
    now: dict | None = None
    last = None

    def opened(n, strategy: str, path: list[str]) -> dict:
        nonlocal now
        close()
        now = {"is_primary": n["is_primary"], "collapsed": False, "landmark": n["landmark"], "landmark_name": n["landmark_name"], "heading_path": path, "strategy": strategy, "text": "", "words": 0, "non_text_words": 0, "container": -1, "spans": [], "above": None}
        return now

    def close() -> None:
        if now is not None and now["words"]:
            above = now.pop("above")
            out.append({"chunk_id": len(out)} | now | {"container": above[0] if above else -1})

    for n in nodes:
        if not n["text"] or not n["visible"] and not n["collapsed"]:
            continue
        path = list(n["heading_path"])
        key = (n.get("frame"), n["is_primary"], n["landmark"], tuple(path), None if path else n["parent"])
        if n["is_heading"]:
            opened(n, "heading", path)
            last = key
            continue
        if key != last or now is None:
            opened(n, "containment" if path else "landmark" if n["landmark"] else "window", path)
        last = key
        words = len(_WORD.findall(n["text"]))
        if now["words"] + words > cfg.max_words and now["words"] >= cfg.target_words:
            opened(n, "window", now["heading_path"])
        start = len(now["text"]) + 1 if now["text"] else 0
        now["text"] += (" " if now["text"] else "") + n["text"]
        now["spans"].append({"seq": n["seq"], "start": start, "end": len(now["text"])})
        now["words"] += words
        now["non_text_words"] += words if n["non_text"] else 0
        now["collapsed"] = now["collapsed"] or bool(n["collapsed"])
        mine = [n["el"], *n["ancestors"]]
        now["above"] = mine if now["above"] is None else _shared(now["above"], mine)
    close()
    return out


def segment(projected: DataFrame) -> DataFrame:
    """(page_id, chunk_id, ...): the passages of projected pages."""
    return projected.select("page_id", F.inline("chunks"))


def segment_stats(chunks: DataFrame) -> DataFrame:
    """(page_id, chunks, heading, landmark, containment, window, structural_pct)."""
    counts = [F.count_if(F.col("strategy") == s).alias(s) for s in STRATEGIES]
    rows = chunks.groupBy("page_id").agg(F.count("*").alias("chunks"), *counts)
    return rows.withColumn("structural_pct", F.floor(100 * (F.col("heading") + F.col("containment")) / F.col("chunks") + 0.5).cast("int"))


def split_windows(text: str, most: int) -> list[tuple[int, int]]:
    """Half-open windows of at most `most` characters, cut at a paragraph or a space in the window's second half if one is there."""
    out, at = [], 0
    while at < len(text):
        to = min(len(text), at + most)
        if to < len(text):
            for mark in ("\n\n", " "):
                cut = text.rfind(mark, at, to)
                if cut > at + most // 2:
                    to = cut + len(mark)
                    break
        out.append((at, to))
        at = to
    return out
