"""DuckDB twins of the text functions, as pieces of SQL."""

from __future__ import annotations

from pagelode.functions.text import STEM_RULES


def words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '[\\p{{L}}\\p{{N}}]+')"


def fold(text: str) -> str:
    return f"strip_accents(lower({text}))"


def parts(word: str) -> str:
    split = f"list_filter(string_split(regexp_replace(regexp_replace({word}, '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '_'), lambda p: length(p) >= 3)"
    return f"CASE WHEN length({word}) >= 6 AND regexp_matches({word}, '[a-z0-9][A-Z]|[A-Z][A-Z][a-z]') AND len({split}) > 1 THEN {split} ELSE [] END"


def tokens(text: str) -> str:
    return f"list_transform(flatten(list_transform({words(text)}, lambda w: list_prepend(w, {parts('w')}))), lambda t: {fold('t')})"


def stem(word: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({word}, '^(.{{3,}}){suffix}$') THEN regexp_replace({word}, '^(.{{3,}}){suffix}$', '\\1{rest}')" for suffix, rest in STEM_RULES)
    return f"CASE WHEN length({word}) < 5 THEN {word} ELSE regexp_replace(CASE {cases} ELSE {word} END, '^(.{{4,}})e$', '\\1') END"


def trigrams(text: str) -> str:
    padded = f"(' ' || regexp_replace({fold(text)}, '\\s+', ' ', 'g') || ' ')"
    return f"list_distinct(list_transform(range(1, length({padded}) - 1), lambda i: substr({padded}, i, 3)))"


def term_table(source: str, doc: str = "doc_id", text: str = "text", stems: bool = True) -> str:
    """CTEs tok(doc, term) and tf(doc, term, tf) over a table."""
    plain = f"tok AS (SELECT {doc} AS doc, unnest({tokens(text)}) AS term FROM {source}), raw AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY ALL)"
    if not stems:
        return f"{plain}, tf AS (SELECT * FROM raw)"
    return f"{plain}, stemmed AS (SELECT * FROM raw UNION ALL SELECT doc, {stem('term')} AS term, tf FROM raw WHERE {stem('term')} <> term), tf AS (SELECT doc, term, CAST(sum(tf) AS BIGINT) AS tf FROM stemmed GROUP BY ALL)"


def bm25(source: str, query_terms: str, doc: str = "doc_id", text: str = "text") -> str:
    """CTEs up to hits(query, doc, score, first); query_terms is a CTE body of (query, pos, term)."""
    return f"""{term_table(source, doc, text)},
    len AS (SELECT d.{doc} AS doc, greatest(coalesce(s.dl, 0), 1) AS dl FROM {source} d LEFT JOIN (SELECT doc, sum(tf) AS dl FROM tf GROUP BY doc) s ON s.doc = d.{doc}),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), q AS ({query_terms}),
    hits AS (SELECT q.query, tf.doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf.tf * 2.5) / (tf.tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score, min(q.pos) AS first
             FROM q JOIN df USING (term) JOIN tf USING (term) JOIN len ON len.doc = tf.doc CROSS JOIN st GROUP BY q.query, tf.doc)"""


def query_terms(rows: list[tuple[str, int, str]]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{q}', {n}, '{t}')" for q, n, t in rows) + ") v(query, pos, term)"


def unescaped(text: str) -> str:
    """The entities that the pages have."""
    out = text
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{char}')"
    return out
