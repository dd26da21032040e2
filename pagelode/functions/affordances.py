"""What a control affords, as columns over projected nodes.

A rule is a row of RULES: the kind of signal it reads, what it affords, how that is known, and its condition as a function
of the signals. Of the rules with the same kind the first that holds counts; a control can have one affordance of each
kind. Conditions are columns, so all of it runs inside one projection, and the vocabulary is open: a page's patterns can be
replaced, and commands that authors name are affordances of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from pagelode.functions import literal
from pagelode.functions import text as T

# Name patterns, and the words that an affordance adds to its control's document.
PATTERNS = {
    "pagination-next": r"^(more|next|older|newer|next page|show more|load more|see more|continue|»|›|→|>>)$",
    "pagination-prev": r"^(prev|previous|back|newer|earlier|«|‹|←|<<)$",
    "language-switcher": r"\b\d+\s+languages?\b|^languages?$|^language\b|\btranslate\b|\bidioma\b|\bsprache\b",
    "search": r"\bsearch\b|\bfind\b|^q$",
    "submit": r"\b(submit|send|save|confirm|checkout|pay|apply|place order|sign up|register)\b",
    "add-to-cart": r"\badd to (bag|cart|basket)\b|\bbuy now\b",
    "destructive": r"\b(delete|remove|clear|discard|unsubscribe|deactivate)\b",
}
TERMS = {
    "pagination-next": "next page pagination forward more",
    "pagination-prev": "previous page pagination back",
    "language-switcher": "language translate locale",
    "primary-input": "input field type enter primary",
    "search": "search find query",
    "submit": "submit send confirm",
    "add-to-cart": "add cart bag basket buy",
    "toggle": "toggle tick mark switch",
    "destructive": "delete remove clear",
    "external": "external new window",
    "discloses": "expand open reveal show disclose collapse details",
}
MAX_PATTERN_CHARS = MAX_LABEL_CHARS = 200
MAX_LANGUAGE_CHARS = 40
#: Languages of pages in whose words the names of languages are known, beside each language's name in itself.
PAGE_LANGUAGES = ("en", "de", "fr", "es")
NO_TEXT = ("hidden", "checkbox", "radio", "submit", "button")
PRESSED = ("link", "button", "menuitem")


def usable(patterns: Mapping[str, str]) -> dict[str, str]:
    """Patterns of an open vocabulary; those that are too long or can't be read are left out."""

    def readable(text: str) -> bool:
        try:
            return len(text) <= MAX_PATTERN_CHARS and re.compile(text) is not None
        except re.error:
            return False

    return {name: text for name, text in patterns.items() if readable(text)}


@lru_cache(maxsize=8)
def _names(languages: tuple[str, ...]) -> frozenset[str]:
    """"page language|name" for the ISO 639-1 languages, and "|name" for their names in themselves, folded."""
    locale = SparkSession.getActiveSession().sparkContext._jvm.java.util.Locale
    names = set()
    for code in locale.getISOLanguages():
        own = locale.forLanguageTag(code)
        for key, seen_in in [("", own), *((x, locale.forLanguageTag(x)) for x in languages)]:
            if (name := own.getDisplayLanguage(seen_in)) and name != code:
                names.add(f"{key}|{literal.fold(name).strip()}")
    return frozenset(names)


def is_language_name(label: Column, page_lang: Column, languages: tuple[str, ...] = PAGE_LANGUAGES) -> Column:
    """Whether the whole label is a language's name, in the page's language or in itself."""
    folded = F.trim(T.fold(label))
    known = sorted(_names(languages))
    page = F.lower(F.substring_index(F.coalesce(page_lang, F.lit("en")), "-", 1))
    named = F.concat(F.lit("|"), folded).isin(known) | F.concat(page, F.lit("|"), folded).isin(known)
    return (F.length(folded) > 0) & (F.length(folded) <= MAX_LANGUAGE_CHARS) & named


@dataclass(frozen=True)
class Signals:
    """What rules read of a node (role, name, landmark, tag, attrs, href, controls) and its page (url, lang, first_field)."""

    patterns: Mapping[str, str]
    page_url: Column
    page_lang: Column
    first_field: Column

    def attr(self, name: str) -> Column:
        return F.nullif(F.try_element_at(F.col("attrs"), F.lit(name)), F.lit(""))

    def role(self, *roles: str) -> Column:
        return F.col("role").isin(*roles)

    @property
    def label(self) -> Column:
        told = F.coalesce(F.nullif(F.col("name"), F.lit("")), self.attr("aria-label"), self.attr("title"), F.lit(""))
        return F.substring(F.trim(told), 1, MAX_LABEL_CHARS)

    def says(self, pattern: str, text: Column | None = None) -> Column:
        text = self.label if text is None else F.substring(text, 1, MAX_LABEL_CHARS)
        if pattern not in self.patterns:
            return F.lit(False)
        return (F.length(text) > 0) & text.rlike(f"(?iU){self.patterns[pattern]}")

    def rel(self, word: str) -> Column:
        return self.attr("rel").rlike(rf"(?i)\b{word}\b")

    @property
    def elsewhere(self) -> Column:
        """Whether the link leads to another origin than the page's."""
        origin = lambda url: F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?)", 1))
        return (F.regexp_extract(self.page_url, "://([^/?#]*)", 1) != "") & (origin(F.col("href")) != origin(self.page_url))

    @property
    def asks_to_search(self) -> Column:
        told = [self.says("search", self.attr(a)) for a in ("name", "id", "placeholder", "aria-placeholder", "title")]
        typed = self.role("textbox") & F.greatest(*[F.coalesce(x, F.lit(False)) for x in told])
        return typed | (self.role(*PRESSED) & self.says("search"))


def _pressed(pattern: str) -> Callable[[Signals], Column]:
    return lambda s: s.role(*PRESSED) & s.says(pattern)


#: (kind, affordance, how it is known, condition)
RULES: tuple[tuple[str, str, str, Callable[[Signals], Column]], ...] = (
    ("page", "pagination-next", "rel=next", lambda s: s.role(*PRESSED) & s.rel("next")),
    ("page", "pagination-prev", "rel=prev", lambda s: s.role(*PRESSED) & (s.rel("prev") | s.rel("previous"))),
    ("page", "pagination-next", "name-pattern", _pressed("pagination-next")),
    ("page", "pagination-prev", "name-pattern", _pressed("pagination-prev")),
    ("language", "language-switcher", "hreflang", lambda s: s.role(*PRESSED) & s.attr("hreflang").isNotNull()),
    ("language", "language-switcher", "lang", lambda s: s.role(*PRESSED) & (s.attr("lang") != s.page_lang)),
    ("language", "language-switcher", "language-name", lambda s: s.role(*PRESSED) & is_language_name(s.label, s.page_lang)),
    ("language", "language-switcher", "name-pattern", _pressed("language-switcher")),
    ("window", "external", "target=_blank", lambda s: s.role(*PRESSED) & (F.col("tag") == "a") & (s.attr("target") == "_blank")),
    ("window", "external", "cross-origin", lambda s: s.role(*PRESSED) & (F.col("tag") == "a") & s.elsewhere),
    ("search", "search", "role", lambda s: s.role("searchbox")),
    ("search", "search", "landmark", lambda s: F.col("landmark") == "search"),
    ("search", "search", "name-pattern", lambda s: s.asks_to_search),
    ("input", "primary-input", "autofocus", lambda s: s.role("textbox", "searchbox", "combobox") & F.map_contains_key("attrs", "autofocus")),
    ("input", "primary-input", "sole-field", lambda s: s.role("textbox", "searchbox", "combobox") & (F.col("seq") == s.first_field)),
    ("submit", "submit", "type=submit", lambda s: s.role("button") & (F.lower(s.attr("type")) == "submit")),
    ("submit", "submit", "name-pattern", lambda s: s.role("button") & s.says("submit")),
    ("cart", "add-to-cart", "name-pattern", _pressed("add-to-cart")),
    ("toggle", "toggle", "role", lambda s: s.role("checkbox", "switch")),
    ("loss", "destructive", "name-pattern", _pressed("destructive")),
    ("reveal", "discloses", "aria-controls", lambda s: s.role(*PRESSED, "tab", "combobox") & (F.size("controls") > 0)),
)


def affordance_pairs(signals: Signals) -> Column:
    """An array of (affordance, via) structs of an interactive node; empty for others."""
    kinds: dict[str, list[Column]] = {}
    for kind, what, via, holds in RULES:
        kinds.setdefault(kind, []).append(F.when(holds(signals), F.struct(F.lit(what).alias("affordance"), F.lit(via).alias("via"))))
    command = F.substring(signals.attr("command"), 1, MAX_PATTERN_CHARS)
    own = [F.when(_pressed(name)(signals), F.struct(F.lit(name).alias("affordance"), F.lit("name-pattern").alias("via"))) for name in signals.patterns if name not in PATTERNS]
    told = [
        *[F.coalesce(*rules) for rules in kinds.values()],
        *own,
        F.when(command.isNotNull(), F.struct(F.regexp_replace(command, "^--", "").alias("affordance"), F.lit("command").alias("via"))),
        F.when(F.map_contains_key("attrs", "popovertarget"), F.struct(F.lit("discloses").alias("affordance"), F.lit("popovertarget").alias("via"))),
    ]
    return F.when(F.col("interactive"), F.array_compact(F.array(*told))).otherwise(F.array_compact(F.array(F.lit(None).cast("struct<affordance:string,via:string>"))))


def primary_field(nodes: Column) -> Column:
    """The place of the field that a visitor would type in first, of a page's array of nodes; null where there is none.

    Priorities: autofocus, inside the main part, the only field of its form (or of those outside any), the first.
    """
    kind = lambda n: F.lower(F.coalesce(F.nullif(F.try_element_at(n["attrs"], F.lit("type")), F.lit("")), F.lit("text")))
    fields = F.filter(nodes, lambda n: n["visible"] & ((n["tag"] == "textarea") | ((n["tag"] == "input") & ~kind(n).isin(*NO_TEXT))))
    mates = lambda n: F.size(F.filter(fields, lambda m: m["form"].eqNullSafe(n["form"])))
    priority = lambda n: F.when(F.map_contains_key(n["attrs"], "autofocus"), 0).when(n["in_main"], 1).when(mates(n) == 1, 2).otherwise(3)
    return F.array_min(F.transform(fields, lambda n: F.struct(priority(n).alias("priority"), n["seq"].alias("seq"))))["seq"]
