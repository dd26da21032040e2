"""Projection of HTML pages to accessible nodes: one Python pass per page, everything after it is DataFrame work.

A browser's layout, style sheets, focus and live form values are not in a page's text. What depends on them is decided
from attributes, inline styles and the standard's own defaults, and the gap is counted in the coverage row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pagelode.config import DEFAULTS, EngineConfig
from pagelode.functions.affordances import PATTERNS, Signals, affordance_pairs, primary_field, usable
from pagelode.operators.segment import CHUNK, segment_nodes
from pagelode.sources import aria
from pagelode.sources.jsonld import clean_html, prose, question_answers
from pagelode.sources.tree import Element, Selector, parse

NODE = """seq int, el int, tag string, role string, landmark string, landmark_name string, name string, text string,
heading_path array<string>, level int, row string, states map<string,string>, controls_name string, controls array<int>, interactive boolean, inert boolean,
visible boolean, actionable boolean, is_heading boolean, is_primary boolean, in_main boolean, collapsed boolean, non_text string,
parent int, ancestors array<int>, href string, attrs map<string,string>, selector string, form int, frame string"""
OPAQUE = "el int, tag string, role string, src string, filename_hint string, chart_library string, landmark string, heading_path array<string>, reason string, rejected array<struct<text:string,reason:string>>"
QA = "question string, answer string, source string"
COUNTERS = (
    "excluded", "custom_elements", "unknown_roots", "inferred_headings", "non_text", "non_text_decorative",
    "non_text_recovered", "non_text_opaque", "reveal_pending", "reveal_pending_chars", "unlabelled_controls",
    "malformed_structured_data", "unreachable_frames", "undeclared_rows", "hidden_rows", "layout_gap",
)

# Words that stand in for a description, and the marks of chart libraries.
PLACEHOLDERS = frozenset("""
image images img graphic graphics photo photograph picture pic blank spacer untitled alt thumbnail thumb banner icon
logo placeholder decoration decorative null none undefined empty
""".split())
CHART_LIBRARIES = (("highcharts", "highcharts"), ("recharts", "recharts-wrapper"), ("vega", "vega"), ("plotly", "js-plotly-plot"))
FILE_NAME = re.compile(r"\.(jpe?g|png|gif|webp|svgz?|avif|bmp|ico|tiff?)\s*$", re.I)
#: (reason, condition of a description and its bare words), in the order in which they count.
NO_USE = (
    ("EMPTY", lambda told, _: not told),
    ("FILENAME", lambda told, _: bool(FILE_NAME.search(told))),
    ("PLACEHOLDER", lambda _, bare: bare in PLACEHOLDERS),
)
TOO_LITTLE = (("NUMERIC_ONLY", lambda _, bare: bare.isdigit()), ("TOO_SHORT", lambda _, bare: len(bare) < 2))
IGNORE = "data-pagelode-ignore"
MAX_CONTENT_NAME = 200
#: Sizes of headings by default, in multiples of 16 pixels.
HEADING_SIZES = {"h1": 2.0, "h2": 1.5, "h3": 1.17, "h4": 1.0, "h5": 0.83, "h6": 0.67}
BOLD = frozenset("b strong th h1 h2 h3 h4 h5 h6".split())
TEXT_FIELDS = frozenset("text search url tel email password date datetime-local time month week color number range".split())


def squeeze(text: str) -> str:
    return " ".join(text.split())


def bare_words(text: str) -> str:
    """A description in lower case, separators as spaces and without punctuation."""
    return re.sub(r"[^\w ]|_", "", re.sub(r"[_\-\s]+", " ", text.strip().lower())).strip()


@dataclass
class Heading:
    scope: Element
    level: int
    text: str


@dataclass
class Projection:
    nodes: list[dict] = field(default_factory=list)
    opaque: list[dict] = field(default_factory=list)
    qa: list[dict] = field(default_factory=list)
    coverage: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))


class Projector:
    """One page's pass."""

    def __init__(self, html: str | None, url: str | None, cfg: EngineConfig, exclude: list[Selector]) -> None:
        self.document, self.url, self.cfg, self.exclude = parse(html, cfg.project.bare_references), url or "", cfg, exclude
        self.out = Projection()
        self.by_id: dict[str, Element] = {}
        self.labels: dict[str, Element] = {}
        self.pruned: set[int] = set()  # excluded elements
        self.around: set[int] = set()  # and whatever holds them
        for el in self.document.walk():
            if not el.attrs and not self.exclude:
                continue
            if IGNORE in el.attrs or el.attrs.get("aria-hidden") == "true" or any(s.matches(el) for s in self.exclude):
                self.pruned.add(el.index)
                self.around.update(p.index for p in el.ancestors())
            if el.attrs.get("id"):
                self.by_id.setdefault(el.attrs["id"], el)
            if el.tag == "label" and el.attrs.get("for"):
                self.labels.setdefault(el.attrs["for"], el)
        html_el = next((e for e in self.document.walk() if e.tag == "html"), None)
        self.lang = html_el.attrs.get("lang") if html_el is not None else None
        base = next((e for e in self.document.walk() if e.tag == "base" and e.attrs.get("href")), None)
        self.base = urljoin(self.url, base.attrs["href"]) if base is not None else self.url
        self.root = next((e for e in self.document.walk() if e.tag == "body"), self.document)
        self.primary = self._primary_root()
        self.modal = next((e for e in self.root.walk() if e.attrs.get("aria-modal") == "true" and (e.tag != "dialog" or "open" in e.attrs) and self.visible(e)), None)
        self.headings: list[Heading] = []
        self.rows: list[Element] = []
        self.names: dict[int, str] = {}
        self.row_texts: dict[int, str | None] = {}

    # --- reading ----------------------------------------------------------------------------------------------------

    def _primary_root(self) -> Element:
        for test in (lambda e: e.tag == "main", lambda e: e.attrs.get("role") == "main", lambda e: e.attrs.get("id") in ("main", "root", "app"), lambda e: "data-app" in e.attrs):
            found = next((e for e in self.root.walk() if test(e)), None)
            if found is not None:
                return found
        return self.root

    def redacted(self, text: str) -> str:
        return self.cfg.redact(text) if self.cfg.redact and text else text

    def excluded(self, el: Element) -> bool:
        return el.index in self.pruned

    def excluded_deep(self, el: Element) -> bool:
        return self.excluded(el) or any(self.excluded(p) for p in el.ancestors())

    def own_text(self, el: Element) -> str:
        return " ".join(t for c in el.children if isinstance(c, str) and (t := squeeze(c)))

    def reading_text(self, el: Element) -> str:
        parts: list[str] = []
        todo: list[Element | str] = list(reversed(el.children))
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                parts.append(node)
            elif node.tag not in aria.SKIPPED and node.index not in self.pruned:
                todo.extend(reversed(node.children))
        return " ".join(t for p in parts if (t := squeeze(p)))

    @staticmethod
    def only_phrasing(el: Element) -> bool:
        return all(c.tag in aria.PHRASING for c in el.elements())

    def content(self, el: Element) -> str:
        return self.reading_text(el) if self.only_phrasing(el) else self.own_text(el)

    @staticmethod
    def style(el: Element) -> dict[str, str]:
        return {k.strip().lower(): v.strip().lower() for part in (el.attrs.get("style") or "").split(";") if ":" in part for k, v in [part.split(":", 1)]}

    def visible(self, el: Element) -> bool:
        for e in (el, *el.ancestors()):
            style = self.style(e)
            if "hidden" in e.attrs or style.get("display") == "none" or style.get("visibility") in ("hidden", "collapse"):
                return False
            if e.tag == "dialog" and "open" not in e.attrs:
                return False
        return self.collapsed_by(el) is None

    def transparent(self, el: Element) -> bool:
        return any(self.style(e).get("opacity") in ("0", "0.0", "0%") for e in (el, *el.ancestors()))

    @staticmethod
    def collapsed_by(el: Element) -> Element | None:
        below = el
        for p in el.ancestors():
            if p.tag == "details" and "open" not in p.attrs and below.tag != "summary":
                return p
            below = p
        return None

    def font(self, el: Element) -> tuple[float, int]:
        """Size in pixels and weight, from inline styles and defaults."""
        size, weight = None, None
        for e in (el, *el.ancestors()):
            style = self.style(e)
            if weight is None and "font-weight" in style:
                word = {"bold": 700, "bolder": 700, "normal": 400, "lighter": 300}.get(style["font-weight"])
                weight = word or (int(style["font-weight"]) if style["font-weight"].isdigit() else None)
            if weight is None and e.tag in BOLD:
                weight = 700
            if size is None and (m := re.fullmatch(r"([\d.]+)(px|pt|em|rem)?", style.get("font-size", ""))):
                size = float(m[1]) * {"px": 1, "pt": 4 / 3, "em": 16, "rem": 16}.get(m[2] or "px", 1)
            if size is None and e.tag in HEADING_SIZES:
                size = 16 * HEADING_SIZES[e.tag]
        return size if size is not None else 16.0, weight if weight is not None else 400

    def name(self, el: Element) -> str:
        """The accessible name: references, label attributes, native labels, contents, title, placeholder."""
        if el.index not in self.names:
            self.names[el.index] = ""  # against references in a ring
            self.names[el.index] = self.redacted(squeeze(self._name(el)))
        return self.names[el.index]

    def _name(self, el: Element) -> str:
        refs = [self.by_id[i] for i in (el.attrs.get("aria-labelledby") or "").split() if i in self.by_id]
        if any(self.excluded_deep(r) for r in refs):
            return ""
        if refs and (joined := " ".join(r.attrs.get("aria-label") or self.reading_text(r) for r in refs)).strip():
            return joined
        if (label := el.attrs.get("aria-label", "").strip()):
            return label
        tag, kind = el.tag, (el.attrs.get("type") or "").lower()
        if tag in ("input", "select", "textarea"):
            mine = self.labels.get(el.attrs.get("id", ""))
            mine = mine if mine is not None else next((p for p in el.ancestors() if p.tag == "label"), None)
            if mine is not None and not self.excluded_deep(mine) and (text := self.reading_text(mine)):
                return text
            if kind in ("button", "submit", "reset"):
                return el.attrs.get("value") or {"submit": "Submit", "reset": "Reset"}.get(kind, "")
            if kind == "image":
                return el.attrs.get("alt") or ""
        if tag in ("img", "area") and el.attrs.get("alt", "").strip():
            return el.attrs["alt"]
        inner = {"fieldset": "legend", "table": "caption", "figure": "figcaption", "svg": "title"}.get(tag)
        if inner and (child := next((c for c in el.elements() if c.tag == inner), None)) is not None:
            return self.reading_text(child)
        if aria.role_of(el) in aria.NAMED_BY_CONTENT:
            parts = []
            for node in el.walk():
                if node is not el and node.tag == "img" and node.attrs.get("alt"):
                    parts.append(node.attrs["alt"])
            text = self.reading_text(el) or " ".join(parts)
            if text:
                return text[:MAX_CONTENT_NAME]
        return el.attrs.get("title", "").strip() or el.attrs.get("placeholder", "").strip() or el.attrs.get("aria-placeholder", "").strip()

    def states(self, el: Element) -> dict[str, str]:
        out = {k: el.attrs[f"aria-{k}"] for k in ("expanded", "checked", "selected", "current", "invalid", "disabled", "pressed", "busy") if f"aria-{k}" in el.attrs}
        kind = (el.attrs.get("type") or "text").lower()
        if el.tag in ("button", "input", "select", "textarea", "option", "fieldset") and "disabled" in el.attrs:
            out["disabled"] = "true"
        if el.tag == "input" and kind in ("checkbox", "radio"):
            out["checked"] = str("checked" in el.attrs).lower()
        for key, attr in (("required", "required"), ("readOnly", "readonly")):
            if el.attrs.get(f"aria-{attr}") == "true" or (el.tag in ("input", "textarea", "select") and attr in el.attrs):
                out[key] = "true"
        present = None
        if el.tag == "textarea":
            present = bool("".join(el.texts()))
        elif el.tag == "select":
            options = [e for e in el.walk() if e.tag == "option"]
            chosen = next((e for e in options if "selected" in e.attrs), options[0] if options else None)
            present = chosen is not None and bool(chosen.attrs.get("value", self.reading_text(chosen)))
        elif el.tag == "input" and kind in ("checkbox", "radio"):
            present = "checked" in el.attrs
        elif el.tag == "input" and kind not in ("button", "submit", "reset", "image", "file"):
            present = bool(el.attrs.get("value"))
        if present is not None:
            out["valuePresent"] = str(present).lower()
            if not present and out.get("required") == "true" and "disabled" not in out:
                out["invalid"] = "true"
        return out

    def controlled(self, el: Element) -> list[Element]:
        ids = (el.attrs.get("commandfor") or el.attrs.get("popovertarget") or el.attrs.get("aria-controls") or "").split()
        return [self.by_id[i] for i in ids if i in self.by_id and not self.excluded_deep(self.by_id[i])]

    def selector(self, el: Element, depth: int = 6) -> str:
        """A selector of last resort: the nearest id, else places among siblings."""
        parts: list[str] = []
        node = el
        for _ in range(depth):
            if node.parent is None:
                break
            if node.attrs.get("id"):
                return " > ".join([f"#{node.attrs['id']}", *reversed(parts)])
            twins = [c for c in node.parent.elements() if c.tag == node.tag]
            parts.append(f"{node.tag}:nth-of-type({next(n for n, c in enumerate(twins) if c is node) + 1})" if len(twins) > 1 else node.tag)
            node = node.parent
        return " > ".join(reversed(parts))

    # --- headings ---------------------------------------------------------------------------------------------------

    def _scope(self, el: Element) -> Element:
        node = el
        for _ in range(self.cfg.project.max_wrapper_climb):
            p = node.parent
            if p is None or p is self.root or p.tag in aria.SCOPE_BOUNDARY:
                break
            alone = all(c is node or c.tag in aria.PHRASING for c in p.elements()) and not any(isinstance(c, str) and c.strip() for c in p.children)
            if not alone:
                break
            node = p
        return node.parent or self.document

    def _push_heading(self, el: Element, text: str, level: int) -> None:
        scope, above = self._scope(el), set(map(id, el.ancestors()))
        while self.headings and (id(self.headings[-1].scope) not in above or (self.headings[-1].scope is scope and self.headings[-1].level >= level)):
            self.headings.pop()
        self.headings.append(Heading(scope, level, text))

    def _prune(self, el: Element) -> None:
        above = {id(el), *map(id, el.ancestors())}
        while self.headings and id(self.headings[-1].scope) not in above:
            self.headings.pop()

    def path(self) -> list[str]:
        return [h.text for h in self.headings]

    def _looks_like_heading(self, el: Element, text: str) -> bool:
        c = self.cfg.project
        if not c.infer_headings or not self.only_phrasing(el) or not text or len(text) > c.heading_max_chars:
            return False
        size, weight = self.font(el)
        return size >= c.heading_min_font_px or (weight >= c.heading_min_weight and size >= c.heading_min_weight_font_px)

    # --- the walk ---------------------------------------------------------------------------------------------------

    def run(self) -> Projection:
        todo: list[tuple[Element | None, str | None, str | None]] = [(self.root, None, None)]
        while todo:
            el, landmark, label = todo.pop()
            if el is None:
                self.rows.pop()
                continue
            below = self._visit(el, landmark, label)
            if below is None:
                continue
            if below[2]:
                todo.append((None, None, None))
            todo.extend((c, below[0], below[1]) for c in reversed(el.elements()))
        for el in self.document.walk():  # structured data that the walk didn't come by
            if self._is_json_ld(el) and not any(p is self.root for p in el.ancestors()) and not self.excluded_deep(el):
                self._structured(el, None, None, [])
        if self.cfg.project.frames:
            self._frames()
        return self.out

    def _frames(self) -> None:
        """Nodes of inline frames, tagged with their frame; elements are numbered after those of the page."""
        frames = [e for e in self.root.walk() if e.tag == "iframe" and "srcdoc" in e.attrs and not self.excluded_deep(e)]
        for n, frame in enumerate(frames[: self.cfg.project.max_frames]):
            base = 1 + max((x["el"] for x in self.out.nodes), default=0) + sum(1 for _ in self.document.walk())
            for node in Projector(frame.attrs["srcdoc"], self.url, self.cfg, self.exclude).run().nodes[: self.cfg.project.max_frame_nodes]:
                moved = {"seq": len(self.out.nodes), "el": node["el"] + base, "parent": node["parent"] + base, "ancestors": [a + base for a in node["ancestors"]], "frame": str(n), "is_primary": False}
                self.out.nodes.append(node | moved)

    @staticmethod
    def _is_json_ld(el: Element) -> bool:
        return el.tag == "script" and (el.attrs.get("type") or "").lower() == "application/ld+json"

    def _structured(self, el: Element, landmark: str | None, label: str | None, path: list[str]) -> None:
        try:
            data = json.loads("".join(el.texts()))
        except ValueError:
            self.out.coverage["malformed_structured_data"] += 1
            return
        d = self.cfg.discovery
        for question, answer, source in question_answers(data, d.max_qa_pairs - len(self.out.qa), d.max_qa_answer_chars):
            question, answer = self.redacted(question), self.redacted(answer)
            if question and answer:
                self.out.qa.append({"question": question, "answer": answer, "source": source})
        if text := prose(data, d):
            self._node(el, "definition", landmark, label, self.redacted(text), path, visible=True)

    def _node(self, el: Element, role: str, landmark: str | None, label: str | None, text: str, path: list[str], **more) -> dict:
        href = el.attrs.get("href")
        try:
            href = urljoin(self.base, href) if href is not None else None
        except ValueError:
            href = None
        form = next((p for p in el.ancestors() if p.tag == "form"), None)
        node = {
            "seq": len(self.out.nodes), "el": el.index, "tag": el.tag, "role": role, "landmark": landmark, "landmark_name": label,
            "name": None, "text": text, "heading_path": path, "level": None, "row": None, "states": {}, "controls_name": None, "controls": [], "interactive": False, "inert": False, "visible": True,
            "actionable": False, "is_heading": False, "is_primary": el is self.primary or any(p is self.primary for p in el.ancestors()),
            "in_main": any(p.tag == "main" or p.attrs.get("role") == "main" for p in el.ancestors()), "collapsed": False, "non_text": None, "parent": el.parent.index if el.parent is not None else -1,
            "ancestors": [p.index for p in el.ancestors()], "href": href, "attrs": dict(el.attrs), "selector": self.selector(el) if more.get("interactive") else None,
            "form": form.index if form is not None else None, "frame": None,
        } | more
        if (el.attrs.get("type") or "").lower() == "password" or el.tag == "input":
            node["attrs"].pop("value", None)  # values are never shown
        self.out.nodes.append(node)
        return node

    def _visit(self, el: Element, landmark: str | None, label: str | None) -> tuple | None:
        count = self.out.coverage
        if el.tag in aria.SKIPPED:
            if self._is_json_ld(el) and not self.excluded_deep(el):
                self._prune(el)
                self._structured(el, landmark, label, self.path())
            return None
        if el.index and self.excluded(el):
            count["excluded"] += 1
            return None
        if "-" in el.tag:
            count["custom_elements"] += 1
            count["unknown_roots"] += 1
        if el.tag == "iframe" and "srcdoc" not in el.attrs:
            count["unreachable_frames"] += 1
        self._prune(el)
        role = aria.role_of(el)
        self._virtual_rows(el, role)
        if role in aria.LANDMARKS:
            landmark, label = role, self.name(el) or None
        text = self.content(el)
        collapsed = self.collapsed_by(el)
        shown = self.visible(el) or (collapsed is not None and all(self.visible(p) for p in [collapsed]))
        if not shown:
            count["layout_gap"] += 1
        elif text and self.transparent(el):
            count["reveal_pending"] += 1
            count["reveal_pending_chars"] += len(text)
            shown = False
        level = aria.heading_level(el) if role == "heading" else None
        if shown and role == "heading" and text:
            self._push_heading(el, self.redacted(text), level)
        elif shown and text and (landmark or "") not in self.cfg.retrieval.nav_landmarks and el.tag not in HEADING_SIZES and self._looks_like_heading(el, text):
            count["inferred_headings"] += 1
            self._push_heading(el, self.redacted(text), 3)
        is_row = role in aria.ROWS
        if is_row:
            self.rows.append(el)
        row = self._row_text(self.rows[-1]) if self.rows else None

        handled = False
        if el.tag in aria.NON_TEXT or (el.attrs.get("role") or "") in aria.NON_TEXT_ROLES:
            handled = self._non_text(el, role, landmark, label, row, shown)
        interactive = role in aria.INTERACTIVE
        folds = not interactive and role != "heading" and el.tag in aria.PHRASING and el.parent is not None and self.only_phrasing(el.parent)
        if not folds and (interactive or text) and not handled:
            self._content_node(el, role, landmark, label, text, row, shown, level, interactive, collapsed is not None)
        return landmark, label, is_row

    def _content_node(self, el, role, landmark, label, text, row, shown, level, interactive, collapsed) -> None:
        more: dict = {"row": row, "visible": shown, "is_heading": role == "heading" and shown, "level": level, "collapsed": collapsed}
        if interactive:
            governed = self.controlled(el)
            inside = self.modal is None or el is self.modal or any(p is self.modal for p in el.ancestors())
            inert = not inside or "inert" in el.attrs or any("inert" in p.attrs for p in el.ancestors())
            states = self.states(el)
            more |= {
                "name": self.name(el) or None, "states": states, "interactive": True, "inert": inert,
                "controls": [g.index for g in governed],
                "controls_name": " ".join(n for g in governed if (n := self.name(g) or self._first_heading(g))) or None,
                "actionable": shown and not collapsed and not self.transparent(el) and states.get("disabled") != "true",
            }
        text = self.redacted(text)
        if described := (el.attrs.get("aria-description") or "").strip():
            text = f"{text} {self.redacted(described)}".strip()
        node = self._node(el, role, landmark, label, text, self.path(), **more)
        if node["actionable"]:
            seen = node["name"] or node["text"] or ""
            reason = self._poor(seen) or (None if re.sub(r"[\W_]+", "", seen) else "SYMBOL_ONLY")
            if reason:
                self.out.coverage["unlabelled_controls"] += 1
                rejected = [{"text": seen[:60], "reason": "NAME_NOT_USABLE"}] if seen else []
                self._opaque(el, role, landmark, "UNLABELLED_CONTROL", rejected, None)

    def _first_heading(self, el: Element) -> str:
        return next((self.reading_text(e) for e in el.walk() if aria.role_of(e) == "heading"), "")

    def _row_text(self, el: Element) -> str | None:
        if el.index not in self.row_texts:
            text = "" if el.index in self.around else self.reading_text(el)
            self.row_texts[el.index] = self.redacted(text) if text and len(text) <= self.cfg.project.max_row_chars else None
        return self.row_texts[el.index]

    def _virtual_rows(self, el: Element, role: str) -> None:
        declared = (el.attrs.get("aria-rowcount") or "").strip()
        if role in ("table", "grid", "treegrid") and re.fullmatch(r"-?\d+", declared):
            total = int(declared)
            if total == -1:
                self.out.coverage["undeclared_rows"] += 1
            elif total > 0:
                self.out.coverage["hidden_rows"] += max(0, total - sum(aria.role_of(e) == "row" for e in el.walk()))
        if (el.attrs.get("aria-posinset") or "").strip() == "1" and re.fullmatch(r"\d+", (el.attrs.get("aria-setsize") or "").strip()) and el.parent is not None:
            mates = [e for e in el.parent.elements() if "aria-setsize" in e.attrs and aria.role_of(e) == role]
            self.out.coverage["hidden_rows"] += max(0, int(el.attrs["aria-setsize"]) - len(mates))

    # --- what isn't text --------------------------------------------------------------------------------------------

    def _poor(self, text: str) -> str | None:
        """Why a description is no use whatever it stands by, if it isn't."""
        return next((reason for reason, holds in NO_USE if holds(text.strip(), bare_words(text))), None)

    def _rejects(self, text: str, el: Element) -> str | None:
        """Why a description is no use for an element: the first reason that holds."""
        told, bare = text.strip(), bare_words(text)
        alone = next((reason for reason, holds in (*NO_USE, *TOO_LITTLE) if holds(told, bare)), None)
        beside = (reason for reason, said in (("REDUNDANT_WITH_LINK_TEXT", self._pressed_text), ("REDUNDANT_WITH_ADJACENT_IMAGE", self._image_before)) if said(el) == told.lower())
        return alone or next(beside, None)

    @staticmethod
    def _pressed_text(el: Element) -> str | None:
        """What the link or button around an element says in text."""
        return next((squeeze("".join(p.texts())).lower() for p in el.ancestors() if p.tag in ("a", "button")), None)

    @staticmethod
    def _image_before(el: Element) -> str | None:
        """The description of the image just before an element."""
        last = None
        for mate in el.parent.elements() if el.parent is not None else ():
            if mate is el:
                break
            last = mate
        return (last.attrs.get("alt") or "").strip().lower() if last is not None and last.tag == "img" else None

    def _chart(self, el: Element) -> tuple[str | None, str]:
        near = [el, *el.ancestors()][:4]
        for library, mark in CHART_LIBRARIES:
            for e in near:
                if mark in (e.attrs.get("class") or ""):
                    table = next((t for t in e.walk() if t.tag == "table"), None)
                    lines = []
                    for tr in [r for r in (table.walk() if table is not None else ()) if r.tag == "tr"][:40]:
                        cells = [self.reading_text(c) for c in tr.elements() if c.tag in ("td", "th")]
                        if cells:
                            lines.append(": ".join(cells) if len(cells) < 3 else f"{cells[0]}: {', '.join(cells[1:])}")
                    return library, "; ".join(lines)[:1200]
        return None, ""

    def _candidates(self, el: Element) -> Iterator[tuple[str, str]]:
        library, told = self._chart(el)
        if told:
            yield told, f"chart:{library}"
        yield self.name(el), "accessible-name"
        if el.tag == "svg":
            for child in ("title", "desc"):
                found = next((c for c in el.elements() if c.tag == child), None)
                if found is not None:
                    yield self.reading_text(found), f"svg-{child}"
            yield " ".join(self.reading_text(t) for t in el.walk() if t.tag == "text"), "svg-text-nodes"
        figure = next((p for p in el.ancestors() if p.tag == "figure"), None)
        caption = next((c for c in figure.walk() if c.tag == "figcaption"), None) if figure is not None else None
        if caption is not None and not self.excluded_deep(caption):
            yield self.reading_text(caption), "figcaption"
        for attr in ("aria-describedby", "aria-details"):
            for i in (el.attrs.get(attr) or "").split():
                if i in self.by_id and not self.excluded_deep(self.by_id[i]):
                    yield self.reading_text(self.by_id[i]), attr
        if el.tag == "canvas":
            yield self.reading_text(el), "canvas-fallback"
        if el.tag == "iframe":
            yield el.attrs.get("title") or "", "iframe-title"

    def _non_text(self, el, role, landmark, label, row, shown) -> bool:
        count = self.out.coverage
        count["non_text"] += 1
        if (el.tag == "img" and el.attrs.get("alt") == "") or el.attrs.get("role") in ("presentation", "none"):
            count["non_text_decorative"] += 1
            return False
        rejected = []
        for text, source in self._candidates(el):
            if not text.strip():
                continue
            reason = self._rejects(text, el)
            if reason is None:
                count["non_text_recovered"] += 1
                self._node(el, role, landmark, label, self.redacted(text.strip()), self.path(), row=row, visible=shown, non_text=source)
                return True
            rejected.append({"text": self.redacted(text.strip())[:60], "reason": reason})
        count["non_text_opaque"] += 1
        self._opaque(el, role, landmark, "ALL_CANDIDATES_REJECTED" if rejected else "NO_TEXT_AVAILABLE", rejected, self._chart(el)[0])
        return False

    def _opaque(self, el, role, landmark, reason, rejected, library) -> None:
        src = el.attrs.get("src") or el.attrs.get("data")
        stem = None
        if src:
            last = urlsplit(src).path.rsplit("/", 1)[-1]
            stem = re.sub(r"\d{3,}", "", re.sub(r"[-_]+", " ", FILE_NAME.sub("", last))).strip() or None
        self.out.opaque.append({"el": el.index, "tag": el.tag, "role": role, "src": src, "filename_hint": stem, "chart_library": library, "landmark": landmark, "heading_path": self.path(), "reason": reason, "rejected": rejected})


def project_page(html: str | None, url: str | None = None, cfg: EngineConfig = DEFAULTS) -> Projection:
    """The projection of one page. Selectors that can't be read raise ValueError before the page is."""
    return Projector(html, url, cfg, [Selector(s) for s in cfg.project.exclude]).run()


#: What a pass over pages can give, and how many pages it holds at once.
PARTS = ("nodes", "opaque", "qa", "coverage", "chunks")
PAGES = 32


def _arrays(rows: list[list[dict]], kind: pa.DataType, only: Collection[str] | None = None) -> pa.Array:
    """Lists of rows as an array, column by column; columns that aren't asked for are null."""
    flat, columns = [r for some in rows for r in some], []
    for f in kind.value_type:
        if only is not None and f.name not in only:
            columns.append(pa.nulls(len(flat), f.type))
        else:
            values = [r[f.name] for r in flat]
            columns.append(pa.array([None if v is None else list(v.items()) for v in values] if pa.types.is_map(f.type) else values, f.type))
    ends = list(accumulate(map(len, rows), initial=0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind.value_type)), type=kind)


def project(pages: DataFrame, cfg: EngineConfig = DEFAULTS, parts: Collection[str] = PARTS, fields: Collection[str] | None = None) -> DataFrame:
    """(page_id, url, lang, nodes, opaque, qa, coverage, chunks): one row for each page; a null page has no nodes.

    Parts that aren't asked for are null, and so are nodes' fields other than the asked ones. Passages are folded in the
    same pass, so nodes aren't read again; a pass holds a few pages' rows at once, and writes them column by column.
    """
    for s in cfg.project.exclude:
        Selector(s)
    schema = T._parse_datatype_string(f"page_id long, url string, lang string, nodes array<struct<{_struct(NODE)}>>, opaque array<struct<{_struct(OPAQUE)}>>, qa array<struct<{_struct(QA)}>>, coverage map<string,int>, chunks array<struct<{_struct(CHUNK)}>>")
    kinds = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        selectors = [Selector(s) for s in cfg.project.exclude]
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                langs, found = [], []
                for url, html in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    p = Projector(html, url, cfg, selectors)
                    out = p.run()
                    langs.append(p.lang)
                    found.append({"nodes": out.nodes, "opaque": out.opaque, "qa": out.qa, "coverage": list(out.coverage.items()), "chunks": segment_nodes(out.nodes, cfg.segment) if "chunks" in parts else None})
                columns = []
                for name in PARTS:
                    kind, rows = kinds.field(name).type, [f[name] for f in found]
                    if name not in parts:
                        columns.append(pa.nulls(len(rows), kind))
                    else:
                        columns.append(pa.array(rows, kind) if name == "coverage" else _arrays(rows, kind, fields if name == "nodes" else None))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs, pa.string()), *columns], schema=kinds)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(each, schema)


def _struct(columns: str) -> str:
    parts = [p.strip() for p in re.split(r",(?![^<]*>)", columns.replace("\n", " "))]
    return ", ".join(f"{p.split(' ', 1)[0]}: {p.split(' ', 1)[1].strip()}" for p in parts)


def node_rows(projected: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(page_id, seq, ...): a row for each node, with what it affords and its place among nodes of the same identity."""
    told = projected.select("page_id", F.col("url").alias("_url"), F.col("lang").alias("_lang"), primary_field(F.col("nodes")).alias("_first"), "nodes")
    rows = told.select("page_id", "_url", "_lang", "_first", F.inline("nodes"))
    signals = Signals(usable(PATTERNS if cfg.patterns is None else cfg.patterns), F.col("_url"), F.col("_lang"), F.col("_first"))
    rows = rows.withColumn("_pairs", affordance_pairs(signals))
    # the last of several ways to the same affordance is told
    rows = rows.withColumn("affordances", F.col("_pairs.affordance")).withColumn("affordance_via", F.aggregate("_pairs", F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["affordance"]), F.create_map(p["affordance"], p["via"]))))
    rows = rows.drop("_url", "_lang", "_first", "_pairs")
    identity = "page_id, frame, role, name, landmark, landmark_name, array_join(heading_path, '\x1f'), row"
    rows = rows.withColumn("ordinal", F.expr(f"row_number() OVER (PARTITION BY {identity} ORDER BY seq) - 1"))
    return rows.withColumn("peer_count", F.expr(f"count(*) OVER (PARTITION BY {identity})"))


def opaque_rows(projected: DataFrame) -> DataFrame:
    return projected.select("page_id", F.inline("opaque"))


def qa_rows(projected: DataFrame) -> DataFrame:
    return projected.select("page_id", F.posexplode("qa").alias("seq", "p")).select("page_id", "seq", "p.*")


def coverage_rows(projected: DataFrame) -> DataFrame:
    return projected.select("page_id", *[F.coalesce(F.col("coverage")[c], F.lit(0)).alias(c) for c in COUNTERS])


__all__ = ["clean_html", "coverage_rows", "node_rows", "opaque_rows", "project", "project_page", "qa_rows"]
