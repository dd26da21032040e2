"""Roles of elements: fixed vocabularies of the accessibility standards, and the rules that choose among them."""

from __future__ import annotations

# Role vocabularies.
LANDMARKS = frozenset("""
banner complementary contentinfo doc-acknowledgments doc-afterword doc-appendix doc-bibliography doc-chapter
doc-conclusion doc-credits doc-endnotes doc-epilogue doc-errata doc-foreword doc-glossary doc-index doc-introduction
doc-pagelist doc-part doc-preface doc-prologue doc-toc form main navigation region search
""".split())
WIDGETS = frozenset("""
button checkbox columnheader combobox doc-backlink doc-biblioref doc-glossref doc-noteref grid gridcell link listbox
menu menubar menuitem menuitemcheckbox menuitemradio option progressbar radio radiogroup row rowheader scrollbar
searchbox slider spinbutton switch tab tablist textbox tree treegrid treeitem
""".split())
ROWS = frozenset("article doc-biblioentry doc-endnote gridcell listitem option row treeitem".split())
NAMED_BY_CONTENT = frozenset("""
button cell checkbox columnheader doc-backlink doc-biblioref doc-glossref doc-noteref graphics-object gridcell heading
link menuitem menuitemcheckbox menuitemradio option radio row rowgroup rowheader switch tab tooltip treeitem
""".split())
OTHER_ROLES = frozenset("""
alert alertdialog application blockquote caption cell code definition deletion dialog directory doc-abstract
doc-colophon doc-cover doc-credit doc-dedication doc-endnote doc-epigraph doc-example doc-footnote doc-notice
doc-pagebreak doc-pagefooter doc-pageheader doc-pullquote doc-qna doc-subtitle doc-tip document emphasis feed figure
generic graphics-document graphics-object graphics-symbol group heading img insertion list log mark marquee math meter
none note paragraph presentation rowgroup separator status strong subscript superscript table tabpanel term time timer
toolbar tooltip
""".split())
VALID = LANDMARKS | WIDGETS | ROWS | NAMED_BY_CONTENT | OTHER_ROLES
#: Widgets that an agent acts in, not on.
CONTAINERS = frozenset("gridcell row columnheader rowheader grid menu menubar tablist tree treegrid radiogroup progressbar".split())
INTERACTIVE = WIDGETS - CONTAINERS
GLOBAL_ARIA = frozenset(
    f"aria-{x}"
    for x in """atomic busy controls current describedby description details disabled dropeffect errormessage flowto
    grabbed haspopup hidden invalid keyshortcuts label labelledby live owns relevant roledescription""".split()
)
SECTIONING = frozenset("article aside main nav section".split())
SECTIONING_ROLES = frozenset("article complementary main navigation region".split())
SCOPE_BOUNDARY = frozenset("section article aside nav main body dialog form".split())
REGION_BOUNDARY = SCOPE_BOUNDARY | {"li", "tr"}
PHRASING = frozenset("a abbr b bdi bdo br cite code data del dfn em i ins kbd mark q s samp small span strong sub sup time u var wbr".split())
SKIPPED = frozenset("script style noscript template head meta link".split())
NON_TEXT = frozenset("img svg canvas object embed video audio iframe".split())
NON_TEXT_ROLES = frozenset("img image graphics-document graphics-symbol graphics-object".split())

BY_TAG = {
    "article": "article", "aside": "complementary", "button": "button", "dd": "definition", "dt": "term", "dfn": "term",
    "dialog": "dialog", "details": "group", "fieldset": "group", "figure": "figure", "form": "form", "hr": "separator",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "li": "listitem", "main": "main", "nav": "navigation", "ol": "list", "ul": "list", "option": "option",
    "output": "status", "p": "paragraph", "progress": "progressbar", "summary": "button", "table": "table",
    "tbody": "rowgroup", "thead": "rowgroup", "tfoot": "rowgroup", "td": "cell", "textarea": "textbox", "tr": "row",
    "search": "search",
}
BY_INPUT = {
    "button": "button", "submit": "button", "reset": "button", "image": "button", "file": "button", "hidden": "generic",
    "checkbox": "checkbox", "radio": "radio", "range": "slider", "number": "spinbutton", "search": "searchbox",
}
LIST_INPUTS = frozenset("text search tel url email".split())


def implicit_role(el) -> str:
    """The role of the tag, whatever its role attribute says."""
    tag = el.tag
    if tag == "input":
        kind = (el.attrs.get("type") or "text").lower()
        return "combobox" if "list" in el.attrs and kind in LIST_INPUTS else BY_INPUT.get(kind, "textbox")
    if tag == "a":
        return "link" if "href" in el.attrs else "generic"
    if tag == "img":
        return "presentation" if el.attrs.get("alt") == "" else "img"
    if tag in ("header", "footer"):
        inside = any(p.tag in SECTIONING or explicit_role(p) in SECTIONING_ROLES for p in el.ancestors())
        return "generic" if inside else {"header": "banner", "footer": "contentinfo"}[tag]
    if tag == "section":
        return "region" if any(el.attrs.get(a) for a in ("aria-label", "aria-labelledby", "title")) else "generic"
    if tag == "select":
        size = el.attrs.get("size") or "1"
        return "listbox" if "multiple" in el.attrs or (size.isdigit() and int(size) > 1) else "combobox"
    if tag == "th":
        return _header_cell(el)
    return BY_TAG.get(tag, "generic")


def _header_cell(el) -> str:
    scope = (el.attrs.get("scope") or "").lower()
    if scope in ("row", "rowgroup"):
        return "rowheader"
    if scope in ("col", "colgroup"):
        return "columnheader"
    cells = el.parent.elements() if el.parent is not None and el.parent.tag == "tr" else []
    return "rowheader" if cells and cells[0] is el and any(c.tag == "td" for c in cells) else "columnheader"


def explicit_role(el) -> str | None:
    """The first valid token of the role attribute that isn't overruled."""
    for token in (el.attrs.get("role") or "").split():
        if token in VALID:
            presentational = token in ("none", "presentation")
            if not (presentational and (implicit_role(el) in INTERACTIVE or {"tabindex", "contenteditable"} & el.attrs.keys() or GLOBAL_ARIA & el.attrs.keys())):
                return token
    return None


def role_of(el) -> str:
    return explicit_role(el) or implicit_role(el)


def heading_level(el) -> int:
    if len(el.tag) == 2 and el.tag[0] == "h" and el.tag[1] in "123456":
        return int(el.tag[1])
    try:
        level = int(float(el.attrs.get("aria-level") or 0))
    except (ValueError, OverflowError):
        level = 0
    return level if level >= 1 else 2
