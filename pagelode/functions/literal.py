"""The text functions for single literals, such as a query: the same rules as the columns', on the driver or in a kernel."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection
from functools import cache

from pagelode.config import DEFAULTS, AnswerConfig, TextConfig
from pagelode.functions.text import BOUNDARY, ENDINGS, HUMP, fold_table

_WORD = re.compile(r"[^\W_]+")
_HUMP, _BOUNDARY = re.compile(HUMP), re.compile(BOUNDARY)
#: The endings by their last letter, in the rules' order.
_BY_LAST = {last: tuple((e, rest, len(e)) for e, rest in ENDINGS if e[-1] == last) for last in {e[-1] for e, _ in ENDINGS}}


@cache
def _table() -> dict[int, str | None]:
    source, target = fold_table()
    return {ord(c): target[n] if n < len(target) else None for n, c in enumerate(source)}


def fold(text: str) -> str:
    return text.lower() if text.isascii() else text.lower().translate(_table())


def tokens(text: str, cfg: TextConfig = DEFAULTS.text) -> list[str]:
    out = []
    for word in _WORD.findall(text or ""):
        out.append(fold(word))
        if len(word) >= cfg.identifier_min_length and _HUMP.search(word):
            parts = [p for p in _BOUNDARY.split(word) if len(p) >= cfg.identifier_min_part]
            out.extend(fold(p) for p in parts if len(parts) > 1)
    return out


def stem(word: str) -> str:
    if len(word) < 5:
        return word
    for ending, rest, size in _BY_LAST.get(word[-1], ()):
        if word.endswith(ending) and len(word) >= size + 3:
            word = word[:-size] + rest
            break
    return word[:-1] if len(word) > 4 and word.endswith("e") else word


def with_stems(found: list[str]) -> list[str]:
    return found + [s for t in found if (s := stem(t)) != t]


def expand(found: list[str], cfg: TextConfig = DEFAULTS.text) -> list[str]:
    most = cfg.max_concat_token_length
    return found + [a + b for a, b in zip(found, found[1:], strict=False) if len(a) <= most and len(b) <= most and len(a + b) >= cfg.min_concat_length]


#: Words whose terms a pass remembers, and characters of a text that are cut into words at once.
REMEMBERED, PIECE = 100_000, 1 << 20


class Terms(dict):
    """The terms of words: folded, with their identifier parts and stems. So many are remembered that memory stays bounded.

    With a set of wanted terms, how many terms a word has and the wanted ones of them.
    """

    def __init__(self, stems: bool = True, wanted: Collection[str] | None = None) -> None:
        super().__init__()
        self.stems, self.wanted = stems, wanted

    def __missing__(self, word: str) -> tuple:
        if len(self) >= REMEMBERED:
            self.clear()
        # humps need a capital after the first letter
        found = tokens(word) if (rest := word[1:]) != rest.lower() else [fold(word)]
        found = tuple(with_stems(found) if self.stems else found)  # tuples of texts are not traced for rings
        if self.wanted is not None:
            found = len(found), tuple(t for t in found if t in self.wanted)
        self[word] = found
        return found


def word_counts(text: str | None) -> Counter[str]:
    """How often a text has each word, as it stands."""
    text, out, at = text or "", Counter(), 0
    while at < len(text):
        to = at + PIECE
        while to < len(text) and text[to - 1].isalnum():
            to += 1
        out.update(_WORD.findall(text if to - at >= len(text) else text[at:to]))
        at = to
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    cuts = [m.end() for m in re.finditer(r"(?<=[.!?])\s+", text)]
    return [(a, b) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True) if a < b]


def best_sentence(text: str, wanted: set[str], cfg: AnswerConfig = DEFAULTS.answer) -> tuple[float, int, int, str] | None:
    """(coverage, start, end, text): the earliest sentence that holds most of the terms, if it holds enough.

    A fragment takes in what follows; a span that is too long ends at a space.
    """
    spans = sentences(text)
    shares = [len(wanted & set(tokens(text[a:b]))) / len(wanted) for a, b in spans] if wanted else []
    if not shares or max(shares) <= 0 or max(shares) < cfg.min_coverage:
        return None
    at = shares.index(max(shares))
    start, end = spans[at]
    for _, to in spans[at + 1 :]:
        if len(text[start:end].strip()) >= cfg.min_sentence_chars or to - start > cfg.max_answer_chars:
            break
        end = to
    if end - start > cfg.max_answer_chars:
        hard = start + cfg.max_answer_chars
        end = hard
        if hard < len(text) and not text[hard].isspace():
            end = next((k for k in range(hard - 1, start, -1) if text[k].isspace()), hard)
    raw = text[start:end]
    start += len(raw) - len(raw.lstrip())
    raw = raw.strip()
    return (max(shares), start, start + len(raw), raw) if raw else None
