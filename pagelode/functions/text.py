"""Text functions as Column builders: they stay in the JVM, and most have a DuckDB twin in pagelode.plans.sql."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from pagelode.config import DEFAULTS, TextConfig

WORD = r"([\p{L}\p{N}]+)"
HUMP = r"[a-z0-9][A-Z]|[A-Z][A-Z][a-z]|[_.\-]"
BOUNDARY = r"[_.\-]+|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"

# Suffix rules in their order; the first that fits a word of five letters or more applies, and then a
# final e goes from words of more than four letters.
STEM_RULES = (
    ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("ities", "ity"),
    ("ements?", ""), ("ness", ""), ("tions?", "te"), ("sions?", "se"), ("(?:ingly|edly)", ""), ("ing", ""), ("ed", ""),
    ("ies", "y"), ("es", ""), ("s", ""), ("ly", ""), ("(?:able|ible)", ""),
)


def endings(suffix: str) -> list[str]:
    """The endings that a rule's suffix stands for: alternatives, each with and without an optional last letter."""
    alternatives = suffix.removeprefix("(?:").removesuffix(")").split("|")
    return [e for a in alternatives for e in ((a[:-1], a[:-2]) if a.endswith("?") else (a,))]


#: (ending, what takes its place), the rules one by one.
ENDINGS = tuple((e, rest) for suffix, rest in STEM_RULES for e in endings(suffix))


@cache
def fold_table() -> tuple[str, str]:
    """From and to of every character whose decomposition, less its marks, is one character; marks themselves go."""
    source, target, gone = [], [], []
    for code in (*range(0xA0, 0x2C00), *range(0xFF00, 0xFFF0)):
        char = chr(code)
        if unicodedata.category(char) == "Mn":
            gone.append(char)
            continue
        bare = "".join(c for c in unicodedata.normalize("NFKD", char) if unicodedata.category(c) != "Mn")
        if len(bare) == 1 and bare != char:
            source.append(char)
            target.append(bare)
    return "".join(source + gone), "".join(target)


def fold(text: Column, locale: str = "en") -> Column:
    """Lower case without diacritics, one character for one. Turkish keeps its dotless i."""
    if locale.split("-")[0] in ("tr", "az"):
        text = F.translate(text, "Iİ", "ıi")
    return F.translate(F.lower(text), *fold_table())


@F.pandas_udf(StringType())
def fold_exact(text: pd.Series) -> pd.Series:
    """fold() with decompositions of several characters too, such as ligatures; outside the JVM."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if unicodedata.category(c) != "Mn"))


def words(text: Column) -> Column:
    """Runs of letters and digits, as they stand."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD))


def identifier_parts(word: Column, cfg: TextConfig = DEFAULTS.text) -> Column:
    """Parts of a word with humps or separators, if there are two or more that are long enough; else none."""
    parts = F.filter(F.split(word, BOUNDARY), lambda p: F.length(p) >= cfg.identifier_min_part)
    fits = (F.length(word) >= cfg.identifier_min_length) & word.rlike(HUMP) & (F.size(parts) > 1)
    return F.when(fits, parts).otherwise(F.array().cast("array<string>"))


def tokens(text: Column, locale: str = "en", cfg: TextConfig = DEFAULTS.text) -> Column:
    """Folded words, each followed by its identifier parts."""
    each = F.flatten(F.transform(words(text), lambda w: F.concat(F.array(w), identifier_parts(w, cfg))))
    return F.transform(each, lambda w: fold(w, locale))


def stem(word: Column) -> Column:
    """English suffix rules. Endings are compared as they are: a regular expression for each would be too much to compile."""
    cut = F.coalesce(*[F.when(F.endswith(word, F.lit(e)) & (F.length(word) >= len(e) + 3), F.concat(F.substring(word, F.lit(1), F.length(word) - len(e)), F.lit(rest))) for e, rest in ENDINGS], word)
    whole = F.transform(F.array(cut), lambda w: F.when(F.endswith(w, F.lit("e")) & (F.length(w) > 4), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.when(F.length(word) < 5, word).otherwise(whole[0])


def with_stems(found: Column) -> Column:
    """Tokens with the stems that differ from them appended."""
    return F.concat(found, F.array_compact(F.zip_with(found, F.transform(found, stem), lambda t, s: F.nullif(s, t))))


def expand_tokens(found: Column, cfg: TextConfig = DEFAULTS.text) -> Column:
    """Tokens with concatenations of short neighbours appended."""
    n, most = F.size(found), cfg.max_concat_token_length
    pairs = F.zip_with(F.slice(found, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(found, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.when((F.length(a) <= most) & (F.length(b) <= most) & (F.length(a) + F.length(b) >= cfg.min_concat_length), F.concat(a, b)))
    return F.when(n > 1, F.concat(found, F.array_compact(pairs))).otherwise(found)


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def semantic_key(text: Column, locale: str = "en") -> Column:
    """A key for equality of names: folded, white space collapsed and trimmed."""
    return F.trim(collapse(fold(F.coalesce(text, F.lit("")), locale)))


def trigrams(text: Column, locale: str = "en") -> Column:
    """The distinct trigrams of the folded, collapsed text with a space at either end."""
    padded = F.concat(F.lit(" "), collapse(fold(F.coalesce(text, F.lit("")), locale)), F.lit(" "))
    return F.when(F.length(padded) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))))


def dice(a: Column, b: Column) -> Column:
    return 2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def estimate_tokens(text: Column, per: float | Column = DEFAULTS.text.chars_per_token) -> Column:
    """Characters over characters per token, rounded up."""
    return F.ceil(F.length(text) / per)


def script_density(text: Column, most: int = DEFAULTS.retrieval.script_sample_chars) -> Column:
    """The share of dense-script characters in the first `most`."""
    part = F.substring(F.coalesce(text, F.lit("")), 1, most)
    other = F.regexp_replace(part, r"[\x{2e80}-\x{9fff}\x{ac00}-\x{d7af}\x{f900}-\x{faff}\x{0e00}-\x{0e7f}]", "")
    return F.when(F.length(part) == 0, F.lit(0.0)).otherwise((F.length(part) - F.length(other)) / F.length(part))


def chars_per_token(density: Column) -> Column:
    return F.round(4 - 2.5 * density, 2)


def sentences(text: Column) -> Column:
    """(start, end) of the sentences: a terminator and the white space after it end one; offsets are half-open."""
    parts = F.filter(F.split(F.regexp_replace(text, r"([.!?])(\s+)", "$1$2\x1f"), "\x1f"), lambda p: F.length(p) > 0)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda acc, p: acc + F.length(p)))
    return F.when(F.size(parts) > 0, F.zip_with(parts, ends, lambda p, e: F.struct((e - F.length(p)).alias("start"), e.alias("end"), p.alias("text"))))


def sentence_rows(docs, keys: list[str], text: str):
    """(keys, n, start, end, sentence) of long texts: offsets are running sums, not a fold within the row."""
    parts = F.split(F.regexp_replace(text, r"([.!?])(\s+)", "$1$2\x1f"), "\x1f")
    rows = docs.select(*keys, F.posexplode(parts).alias("n", "sentence")).where("sentence <> ''")
    by = Window.partitionBy(*keys).orderBy("n")
    rows = rows.withColumn("end", F.sum(F.length("sentence")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select(*keys, (F.row_number().over(by) - 1).alias("n"), (F.col("end") - F.length("sentence")).alias("start"), "end", "sentence")


def clip(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def cut_on_word(text: Column, most: int) -> Column:
    """At most `most` characters, backing off to white space where there is any."""
    window = F.substring(text, 1, most)
    fits = (F.length(text) <= most) | F.substring(text, most + 1, 1).rlike(r"\s")
    back = F.regexp_extract(window, r"(?s)^(.+)\s\S*$", 1)
    return F.when(fits, window).when(F.length(back) > 0, back).otherwise(window)


def shrink(length: Column, keep: float, floor: int) -> Column:
    """The next size of a text that is over its budget."""
    return F.greatest(F.floor(length * keep), F.least(F.lit(floor), length))


def halve(count: Column) -> Column:
    return F.greatest(F.floor(count / 2), F.lit(1))


def etag(text: Column) -> Column:
    """A change mark of a text."""
    return F.lower(F.conv(F.hex(F.xxhash64(text)), 16, 36))


@F.pandas_udf(StringType())
def etag_fnv(text: pd.Series) -> pd.Series:
    """FNV-1a over UTF-16 units in base 36, where marks must equal those of other clients."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"

    def one(s: str) -> str:
        h = 0x811C9DC5
        raw = s.encode("utf-16-le")
        for k in range(0, len(raw), 2):
            h = ((h ^ (raw[k] | raw[k + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
        out = ""
        while h:
            h, d = divmod(h, 36)
            out = digits[d] + out
        return out or "0"

    return text.map(lambda s: None if s is None else one(s))
