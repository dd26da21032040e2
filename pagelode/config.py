"""Defaults of the engine and the rules for overriding them."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class SegmentConfig:
    target_words: int = 90
    max_words: int = 200


@dataclass(frozen=True)
class TextConfig:
    chars_per_token: float = 4
    max_concat_token_length: int = 6
    min_concat_length: int = 4
    identifier_min_length: int = 6
    identifier_min_part: int = 3
    stemming: str = "auto"


@dataclass(frozen=True)
class LexicalConfig:
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    heading_weight: int = 3


# The landmarks of page chrome and the headings of citation sections.
NAV_LANDMARKS = ("navigation", "banner", "contentinfo")
CITATION_HEADINGS = (
    "references", "reference", "bibliography", "citations", "citation", "notes", "footnotes", "sources",
    "external links", "further reading", "see also", "works cited",
)


@dataclass(frozen=True)
class RetrievalConfig:
    nav_landmarks: tuple[str, ...] = NAV_LANDMARKS
    citation_headings: tuple[str, ...] = CITATION_HEADINGS
    snippet_chars: int = 400
    ambiguity_ratio: float = 0.85
    common_term_share: float = 0.5
    content_term_share: float = 0.25
    confidence_high: float = 0.6
    confidence_medium: float = 0.34
    fuzzy_floor: float = 0.12
    fuzzy_count: int = 3
    chrome_penalty: float = 0.35
    image_alt_penalty: float = 0.4
    citation_penalty: float = 0.5
    actionable_per_result: int = 3
    script_sample_chunks: int = 40
    script_sample_chars: int = 4000
    structural_good_pct: int = 60
    structural_mixed_pct: int = 25
    decline_below_tree_tokens: int = 2000
    decline_below_structural_pct: int = 25
    max_region_climb: int = 3


@dataclass(frozen=True)
class AnswerConfig:
    min_coverage: float = 0.5
    min_sentence_chars: int = 25
    max_answer_chars: int = 400
    qa_min_coverage: float = 0.75


@dataclass(frozen=True)
class ProjectConfig:
    max_row_chars: int = 80
    heading_min_font_px: float = 19
    heading_min_weight: int = 600
    heading_min_weight_font_px: float = 16
    heading_max_chars: int = 90
    max_wrapper_climb: int = 3
    infer_headings: bool = True
    frames: bool = False
    max_frames: int = 6
    max_frame_nodes: int = 3000
    bare_references: bool = True
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class BudgetConfig:
    describe_app: int = 900
    find_on_page: int = 1200
    locate_control: int = 600
    resolve_address: int = 500
    read_region: int = 2000
    list_opaque_regions: int = 700
    agentic_content: int = 2000
    query_selector: int = 1200
    adaptive: bool = True
    share: float = 0.4
    floor: int = 350
    max_shrink_steps: int = 24
    text_keep_ratio: float = 0.6
    region_text_floor: int = 200
    fetched_text_floor: int = 400


@dataclass(frozen=True)
class DeltaConfig:
    history: int = 4
    max_tracked_keys: int = 64
    semantic_history: int = 4
    max_semantic_changes: int = 32
    settle_quiet_ms: int = 250


@dataclass(frozen=True)
class ManifestConfig:
    paths: tuple[str, ...] = ("/llms.txt", "/llms-full.txt")
    max_bytes: int = 512 * 1024
    max_read_chars: int = 20_000


@dataclass(frozen=True)
class DiscoveryConfig:
    # Keys of structured data that hold no prose.
    structured_data_skip_keys: tuple[str, ...] = ("@context", "@id", "@type", "url", "sameAs", "image", "logo", "contentUrl", "thumbnailUrl", "identifier")
    max_structured_data_chars: int = 2000
    max_qa_pairs: int = 50
    max_qa_answer_chars: int = 600


@dataclass(frozen=True)
class EngineConfig:
    segment: SegmentConfig = field(default_factory=SegmentConfig)
    text: TextConfig = field(default_factory=TextConfig)
    lexical: LexicalConfig = field(default_factory=LexicalConfig)
    retrieval: RetrievalConfig = field(default_factory=RetrievalConfig)
    answer: AnswerConfig = field(default_factory=AnswerConfig)
    project: ProjectConfig = field(default_factory=ProjectConfig)
    budget: BudgetConfig = field(default_factory=BudgetConfig)
    delta: DeltaConfig = field(default_factory=DeltaConfig)
    manifest: ManifestConfig = field(default_factory=ManifestConfig)
    discovery: DiscoveryConfig = field(default_factory=DiscoveryConfig)
    redact: Callable[[str], str] | None = None
    #: Name patterns by what they afford, in place of the built-in ones; unreadable and long ones are left out.
    patterns: Mapping[str, str] | None = None


def _sane(default: Any, value: Any) -> Any:
    """value where it is of default's kind and a finite number of at least zero; else default."""
    if isinstance(default, bool):
        return value if isinstance(value, bool) else default
    if isinstance(default, (int, float)):
        ok = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value) and value >= 0
        return type(default)(value) if ok else default
    if isinstance(default, tuple):
        if callable(value):  # composes the default; one that fails leaves it
            try:
                value = value(list(default))
            except Exception:  # noqa: BLE001
                return default
        return tuple(value) if isinstance(value, (list, tuple)) else default
    return value


def configure(overrides: Mapping[str, Any] | None = None, base: Any = None) -> EngineConfig:
    """The defaults with overrides merged in: nested mappings merge, lists replace or compose, odd numbers are refused."""
    base = EngineConfig() if base is None else base
    changed = {}
    for f in fields(base):
        if overrides and f.name in overrides:
            now, new = getattr(base, f.name), overrides[f.name]
            changed[f.name] = configure(new, now) if is_dataclass(now) else _sane(now, new)
    return replace(base, **changed)


DEFAULTS = EngineConfig()
