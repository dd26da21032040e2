"""Structured data of a page: its prose, and its questions with answers."""

from __future__ import annotations

import html as entities
import re

from pagelode.config import DiscoveryConfig

# The types and keys of the public vocabulary that hold questions, answers and steps.
CONTAINERS = {"FAQPage": "FAQPage", "QAPage": "QAPage", "HowTo": "HowTo", "HowToSection": "HowTo"}
STEP_KEYS = ("step", "itemListElement")
QUESTION_KEYS = ("name", "text", "headline")
ANSWER_KEYS = ("acceptedAnswer", "suggestedAnswer")
ANSWER_TEXT_KEYS = ("text", "name", "description")
STEP_NAME_KEYS = ("name", "headline")
STEP_TEXT_KEYS = ("text", "description")

_METADATA = re.compile(r"^(https?:|/|#|mailto:|tel:)", re.I)
_NUMBERS = re.compile(r"^[\d\s:+\-TZ.]+$")


def clean_html(text: str) -> str:
    """A string that may hold markup as plain text: blocks of code go, tags are spaces, entities are read once."""
    text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", text)
    text = entities.unescape(re.sub(r"(?s)<!--.*?-->|</?[a-zA-Z][^<>]*>", " ", text))
    return re.sub(r"\s+", " ", text).strip()


def prose(data, cfg: DiscoveryConfig) -> str:
    """The sentences among the values: no keys to skip, URLs, numbers or dates; each once."""
    skip, found, size = set(cfg.structured_data_skip_keys), {}, 0
    todo = [(data, "")]
    while todo and size <= cfg.max_structured_data_chars:
        value, key = todo.pop()
        if isinstance(value, str):
            text = clean_html(value)
            if text and key not in skip and not _METADATA.match(text) and not _NUMBERS.match(text):
                found.setdefault(text)
                size += len(text) + 1
        elif isinstance(value, list):
            todo.extend((x, key) for x in reversed(value))
        elif isinstance(value, dict):
            todo.extend((x, k) for k, x in reversed(value.items()) if k not in skip)
    return ". ".join(found)[: cfg.max_structured_data_chars]


def _first(node: dict, keys: tuple[str, ...]) -> str:
    return next((t for k in keys if isinstance(node.get(k), str) and (t := clean_html(node[k]))), "")


def _answer(node: dict) -> str:
    for key in ANSWER_KEYS:
        given = node.get(key)
        for one in given if isinstance(given, list) else [given]:
            text = clean_html(one) if isinstance(one, str) else _first(one, ANSWER_TEXT_KEYS) if isinstance(one, dict) else ""
            if text:
                return text
    return ""


def question_answers(data, most: int, most_chars: int) -> list[tuple[str, str, str]]:
    """(question, answer, source) in order; a question counts once whatever its case."""
    out: dict[str, tuple[str, str, str]] = {}
    todo = [(data, "", False)]
    while todo and len(out) < most:
        value, source, step = todo.pop()
        if isinstance(value, list):
            todo.extend((x, source, step) for x in reversed(value))
        if not isinstance(value, dict):
            continue
        kinds = value.get("@type")
        kinds = [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
        for kind in kinds:
            source = CONTAINERS.get(kind, source)
        pair = None
        if "Question" in kinds:
            pair = _first(value, QUESTION_KEYS), _answer(value), source or "Question"
        elif "HowToStep" in kinds or step:
            pair = _first(value, STEP_NAME_KEYS), _first(value, STEP_TEXT_KEYS), source or "HowTo"
        if pair and pair[0] and (answer := pair[1][:most_chars].strip()):
            out.setdefault(pair[0].lower(), (pair[0], answer, pair[2]))
        todo.extend((x, source, source == "HowTo" and k in STEP_KEYS) for k, x in reversed(value.items()))
    return list(out.values())
