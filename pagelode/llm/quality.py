"""Quality rules from tokeniser fertility, beside plain counts over words and lines.

Method. Each word of a text is encoded by a public vocabulary with byte fallback (distinct words once for each
worker's cache). From the tokens of the whole text come characters per token, the share of byte-fallback tokens
and the entropy of the token distribution relative to the largest that the number of tokens allows (2048 at most). A text is
rejected if one of them lies outside its band. The bands come from the corpus itself: over all texts that pass the counts,
the exact median and upper quartile of each measure (to three decimals) by language and length (octaves of the number of
tokens, as entropy and its noise follow the length), and fences some of their distances from the median. Junk lies low in
characters and entropy, so the upper half is moved little by it. Where a language has fewer than MIN_GROUP
texts of a length, its band over all lengths holds, else its script's band of that length; a script mixes languages, so there
the lower quartile's distance counts too. BANDS are outer limits for every text, and all there is where neither group is large enough; there, a text with few tokens is judged by
the byte share alone.

The texts are encoded once; the measures are written and read twice, for the quartiles and for the verdicts.

Defined cases. Null or empty text: no words, all counts zero, base_failed (fewer than ten words). Null language:
the script's band. Null ids and repeated rows are kept as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm import kernels as K
from pagelode.llm.scratch import materialize
from pagelode.llm.tokens import SpanCache

SLICE_BYTES = 2 << 20
MIN_WORDS, MAX_REPEATED_PERCENT, REPEAT_WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
#: Tokens from which the outer limits of characters per token and entropy hold.
MIN_TOKENS = 50
#: Distinct tokens that a long text is measured against: its entropy no longer grows with its length.
MAX_TYPES = 2048
#: (least, most) characters per token, most byte share, least relative entropy: by language, script, or default.
BANDS = {
    "en": (1.2, 8.0, 0.20, 0.30),
    "de": (1.2, 8.0, 0.20, 0.30),
    "fr": (1.2, 8.0, 0.20, 0.30),
    "es": (1.2, 8.0, 0.20, 0.30),
    "latin": (1.1, 9.0, 0.25, 0.30),
    "other": (0.3, 9.0, 0.80, 0.20),
}
#: Texts from which a language's or script's texts of one length have a band of their own.
MIN_GROUP = 100
#: Distances from median to upper quartile (SPREAD_LEAST at least) between median and fence; chosen on sf0.1's labels.
FENCES = {"least_chars": 5.0, "most_chars": 7.0, "most_bytes": 7.0, "least_entropy": 3.0}
SPREAD_LEAST, BYTES_SLACK = 0.005, 0.05
#: The groups a text is in, the one whose band holds first.
LEVELS = ("_lang_octave", "_lang", "_script_octave")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens")
MEASURES = ("chars_per_token", "byte_share", "token_entropy")

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_CACHES: dict[str, tuple[SpanCache, np.ndarray]] = {}


def vocabulary(path: str) -> tuple[SpanCache, np.ndarray]:
    """The cached encoder of single words, and which ids are byte fallback."""
    if path not in _CACHES:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
        _CACHES[path] = SpanCache(lambda spans: model.encode([x.decode("utf-8", "replace") for x in spans], num_threads=1)), is_byte
    return _CACHES[path]


def repeated_in_row(keys: list[np.ndarray], row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, whether its key occurs twice or more in its row, and whether it occurred before."""
    if not len(row):
        return np.zeros(0, bool), np.zeros(0, bool)
    key = K.mix(keys[0] + K.mix(row.astype(K.U64) + K.U64(1)))
    code, _ = pd.factorize(key)
    first = np.zeros(len(code), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return np.bincount(code)[code] > 1, first[code] != np.arange(len(code))


def measure(column: pa.Array, path: str) -> dict[str, np.ndarray]:
    """The counts and measures of each text."""
    data, offsets = K.text_buffer(column)
    rows = len(offsets) - 1
    starts, ends, before = K.word_spans(data, offsets)
    out = {"n_words": np.diff(before)}
    leading = K.LEADING[data]
    out["word_chars"] = K.row_sums(leading & ~K.SEPARATOR[data], offsets)
    out["n_symbols"] = K.row_sums(_IS_SYMBOL[data], offsets)

    line_start = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 0x0A) + 1]))
    line_start = line_start[line_start < len(data)]
    line_row = np.searchsorted(offsets, line_start, side="right") - 1
    next_start = np.append(line_start[1:], len(data))
    line_end = next_start - (data[next_start - 1] == 0x0A) if len(line_start) else next_start[:0]
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_row = line_start[has_word], line_end[has_word], line_row[has_word]
    _, again = repeated_in_row(K.hash_spans(data, line_start, line_end), line_row)
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=rows)

    word = K.hash_spans(data, starts, ends)[0]
    first, row = K.window_rows(before, REPEAT_WINDOW)
    often, _ = repeated_in_row([K.rolling(word, REPEAT_WINDOW, 0x9E3779B97F4A7C15)[first]], row)
    depth = np.zeros(len(starts) + 1, np.int64)
    np.add.at(depth, first[often], 1)
    np.add.at(depth, first[often] + REPEAT_WINDOW, -1)
    out["n_repeat_words"] = K.row_sums(np.cumsum(depth)[:-1] > 0, before)

    cache, is_byte = vocabulary(path)
    ids, edge = cache.spread(cache.lookup(data, starts, ends))
    edge = edge[before]
    out["n_tokens"] = np.diff(edge)
    out["n_byte_tokens"] = K.row_sums(is_byte[ids], edge)
    token_row = np.repeat(np.arange(rows), np.diff(edge))
    pair, count = np.unique(token_row << 20 | ids.astype(np.int64), return_counts=True)
    part = np.bincount(pair >> 20, count * np.log2(count), minlength=rows)
    tokens = np.maximum(out["n_tokens"], 1)
    out["chars_per_token"] = out["word_chars"] / tokens
    out["byte_share"] = out["n_byte_tokens"] / tokens
    out["token_entropy"] = np.where(out["n_tokens"] > 1, np.log2(tokens) - part / tokens, 0.0)
    latin = K.row_sums(leading & (data < 0xCE) & ~K.SEPARATOR[data], offsets)
    out["latin"] = 2 * latin >= out["word_chars"]
    return out


def corpus_bands(rows: DataFrame) -> DataFrame:
    """(group, least_chars, most_chars, most_bytes, least_entropy) of the groups with enough texts that pass the counts."""
    some = rows.where("not base_failed and n_tokens > 0").select(F.explode(F.array_compact(F.array(*LEVELS))).alias("group"), "_chars", "_bytes", "_entropy")
    quartiles = [F.percentile(c, [0.25, 0.5, 0.75]).alias(c) for c in ("_chars", "_bytes", "_entropy")]
    found = some.groupBy("group").agg(F.count("*").alias("n"), *quartiles).where(F.col("n") >= MIN_GROUP)
    fences = []
    for name, k in FENCES.items():
        q = F.col({"chars": "_chars", "bytes": "_bytes", "entropy": "_entropy"}[name.split("_")[1]])
        below = F.when(F.col("group").startswith("script"), q[1] - q[0]).otherwise(F.lit(0.0))
        reach = k * F.greatest(q[2] - q[1], below, F.lit(SPREAD_LEAST))
        fences.append((q[1] - reach if name.startswith("least") else q[1] + reach).alias(name))
    return found.select("group", *fences)


def quality(docs: DataFrame, model_path: str, text_col: str = "text", lang_col: str = "lang", bands: dict = BANDS, with_text: bool = True) -> DataFrame:
    """docs with the counts, the measures, base_failed and kept. Columns of these names are replaced.

    with_text: whether the text is among the columns returned, and so in the table written between.
    """
    added = [*[T.StructField(c, T.LongType()) for c in COUNTS], *[T.StructField(c, T.DoubleType()) for c in MEASURES], T.StructField("latin_script", T.BooleanType())]
    docs = docs.select(*[c for c in docs.columns if c not in {f.name for f in added} | {"base_failed", "kept"}])
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    stay = [f for f in docs.schema.fields if with_text or f.name != text_col]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text_col, SLICE_BYTES):
                m = measure(part.column(text_col), model_path)
                columns = [*[pa.array(m[c], pa.int64()) for c in COUNTS], *[pa.array(m[c], pa.float64()) for c in MEASURES], pa.array(m["latin"])]
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in stay], *columns], names=[f.name for f in [*stay, *added]])

    rows = materialize(docs.mapInArrow(K.frugal(each), T.StructType([*stay, *added])), "quality")
    given = rows.columns
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    script = F.when(F.col("latin_script"), F.lit("latin")).otherwise(F.lit("other"))
    relative = F.col("token_entropy") / F.log2(F.least(F.greatest(F.col("n_tokens"), F.lit(2)), F.lit(MAX_TYPES)))
    rows = rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))
    octave = F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("string")
    rows = rows.withColumns({
        "_lang_octave": F.concat(F.lit("lang "), octave, F.lit(" "), lang), "_lang": F.concat(F.lit("lang all "), lang), "_script_octave": F.concat(F.lit("script "), octave, F.lit(" "), script),
        "_chars": F.round("chars_per_token", 3), "_bytes": F.round("byte_share", 3), "_entropy": F.round(relative, 3),
    })
    found = materialize(corpus_bands(rows), "bands", 1)
    for key in LEVELS:
        rows = rows.join(found.select(F.col("group").alias(key), F.struct(*FENCES).alias(f"{key}_band")), key, "left")
    own = F.coalesce(*[f"{key}_band" for key in LEVELS])
    out = (F.col("_chars") < own["least_chars"]) | (F.col("_chars") > own["most_chars"]) | (F.col("_bytes") > own["most_bytes"] + BYTES_SLACK) | (F.col("_entropy") < own["least_entropy"])

    table = F.create_map(*[x for k, v in bands.items() for x in (F.lit(k), F.array(*[F.lit(float(y)) for y in v]))])
    band = F.coalesce(F.try_element_at(table, lang), F.element_at(table, script))
    many = F.col("n_tokens") >= MIN_TOKENS
    outside = (F.col("byte_share") > band[2]) | (many & ((F.col("chars_per_token") < band[0]) | (F.col("chars_per_token") > band[1]) | (relative < band[3])))
    rows = rows.withColumn("kept", ~(F.col("base_failed") | outside | F.coalesce(out, F.lit(False))))
    return rows.select(*given, "base_failed", "kept")
