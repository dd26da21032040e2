"""What a host says about its pages, and texts made shorter: both are bounded, neither is ever indexed."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pagelode.functions import literal
from pagelode.operators.segment import split_windows
from pagelode.sources.tree import Selector

# Bounds of an orientation and of a summary.
MAX_TOKENS, MAX_TASKS, MAX_PURPOSE, MAX_CONSTRAINT, MAX_LOCATE, MAX_VIEW = 180, 6, 280, 160, 80, 80
SUMMARY_MIN_TOKENS, SUMMARY_MAX_CHUNKS, SUMMARY_MAX_CHARS, SUMMARY_MIN_CHUNK = 64, 12, 1200, 256
CHARS_PER_TOKEN = 4


def _clipped(value: Any, most: int) -> str | None:
    text = " ".join(value.split()) if isinstance(value, str) else ""
    return None if not text else text if len(text) <= most else text[: most - 1].rstrip() + "…"


def orientation(given: Mapping[str, Any] | None) -> dict[str, Any]:
    """purpose, view and tasks within their bounds; a task with a selector that can't be read is left out.

    Tasks go from the end until the whole fits its tokens, then the purpose.
    """
    given = given or {}
    out: dict[str, Any] = {"purpose": _clipped(given.get("purpose"), MAX_PURPOSE), "view": _clipped(given.get("view"), MAX_VIEW), "tasks": []}
    for task in list(given.get("tasks") or [])[:MAX_TASKS]:
        name, selector = _clipped(task.get("locate"), MAX_LOCATE), task.get("selector")
        try:
            if selector is not None:
                Selector(selector)
        except ValueError:
            continue
        if name:
            out["tasks"].append({"locate": name, "selector": selector, "constraint": _clipped(task.get("constraint"), MAX_CONSTRAINT)})
    while len(repr(out)) / CHARS_PER_TOKEN > MAX_TOKENS and (out["tasks"] or out["purpose"]):
        if out["tasks"]:
            out["tasks"].pop()
        else:
            out["purpose"] = None
    return out


def orientation_rows(spark: SparkSession, by_page: Mapping[int, Mapping[str, Any]]) -> DataFrame:
    """(page_id, purpose, view, tasks) for the pages that a host has said something about."""
    rows = [(page, o["purpose"], o["view"], [(t["locate"], t["selector"], t["constraint"]) for t in o["tasks"]]) for page, given in by_page.items() for o in [orientation(given)]]
    return spark.createDataFrame(rows, "page_id long, purpose string, view string, tasks array<struct<locate:string,selector:string,constraint:string>>")


def summarised(text: str, model: Callable[[str], str | None] | None, quota_chars: int = 4000) -> tuple[str, bool]:
    """(text, whether it is a summary): parts are summarised one by one; whatever isn't shorter, or fails, stays raw."""
    if model is None or len(text) / CHARS_PER_TOKEN < SUMMARY_MIN_TOKENS:
        return text, False
    parts = split_windows(text, max(SUMMARY_MIN_CHUNK, quota_chars))
    if len(parts) > SUMMARY_MAX_CHUNKS:
        return text, False
    told = [model(text[a:b]) for a, b in parts]
    if any(t is None or not t.strip() for t in told):
        return text, False
    whole = " ".join(t.strip() for t in told)[:SUMMARY_MAX_CHARS]
    return (whole, True) if len(whole) < len(text) else (text, False)


def fused_terms(query: str, translated: str | None) -> list[str]:
    """The terms of a query and of its translation, each once."""
    return list(dict.fromkeys([*literal.tokens(query), *literal.tokens(translated or "")]))
