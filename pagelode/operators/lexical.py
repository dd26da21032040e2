"""Inverted index and lexical ranking. A corpus is a page (or any other key); one key list serves all functions.

The index is three narrow tables, postings (keys, doc, term, tf), lengths (keys, doc, dl) and stats (keys, n, avgdl).
Queries are tables (query, pos, term), so a batch of queries is one join against the postings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagelode.config import DEFAULTS, LexicalConfig, RetrievalConfig
from pagelode.functions import literal
from pagelode.functions import text as T


@dataclass
class LexicalIndex:
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    keys: tuple[str, ...] = ()
    #: One row for each document with the terms that it has, where the index is one of asked terms.
    rows: DataFrame | None = None

    def document_frequency(self) -> DataFrame:
        return self.postings.groupBy(*self.keys, "term").agg(F.count("*").alias("df"))


#: Documents that a pass counts before it gives rows, and terms that it holds at most.
SLICE, MOST_HELD = 256, 200_000
#: Distinct query terms up to which their set is given to the pass over the documents; more are joined to all postings.
MOST_TERMS = 100_000


def _passed(docs: DataFrame, names: list[str], text: str, schema: str, each: Callable[[list], tuple]) -> DataFrame:
    """One pass over texts, each counted on its own: nothing is dealt out or sorted, and memory is that of a slice.

    each(texts) gives indexes of the texts (None for each once) and further columns.
    """

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows, *columns = each(part.column(len(names)).to_pylist())
                kept = [c if rows is None else c.take(pa.array(rows, pa.int32())) for c in part.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*names, *[str(n) for n in range(len(columns))]])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    more = [c.strip().split(" ")[0] for c in schema.split(";")]
    told = docs.select(*names, text).mapInArrow(passed, ", ".join([kinds, *[f"`{n}` {c.strip().split(' ', 1)[1]}" for n, c in enumerate(schema.split(";"))]]))
    return told.toDF(*names, *more)


def _counter(stems: bool, concat: bool) -> Callable[[str | None], dict[str, int]]:
    """What counts a text's terms."""
    known = literal.Terms(stems and not concat)

    def count(text: str | None) -> dict[str, int]:
        out: dict[str, int] = {}
        if concat:  # neighbours matter, so the tokens stay in order
            for term, n in Counter(literal.expand(literal.tokens(text or ""))).items():
                for t in literal.with_stems([term]) if stems else (term,):
                    out[t] = out.get(t, 0) + n
            return out
        for word, n in literal.word_counts(text).items():
            for term in known[word]:
                out[term] = out.get(term, 0) + n
        return out

    return count


def _asked_counter(wanted: Collection[str], stems: bool, concat: bool) -> Callable[[str | None], tuple[int, dict[str, int]]]:
    """What counts all of a text's terms as one, and each of the wanted ones that it has."""
    known, every = literal.Terms(stems, wanted), _counter(stems, True) if concat else None

    def count(text: str | None) -> tuple[int, dict[str, int]]:
        if every:
            found = every(text)
            return sum(found.values()), {t: n for t, n in found.items() if t in wanted}
        size, out = 0, {}
        for word, n in literal.word_counts(text).items():
            terms, mine = known[word]
            size += n * terms
            for term in mine:
                out[term] = out.get(term, 0) + n
        return size, out

    return count


def alike(docs: DataFrame, doc: str, keys: tuple[str, ...] = ()) -> bool:
    """Whether several rows have the same document's name; reads nothing else of them."""
    return not docs.groupBy(*keys, doc).count().where("count > 1").isEmpty()


def term_rows(docs: DataFrame, doc: str, text: str, keys: tuple[str, ...] = (), stems: bool = True, concat: bool = False, unique: bool = False) -> DataFrame:
    """(keys, doc, term, tf). Rows of the same document count together; unique says that there are none."""
    unique = unique or not alike(docs, doc, keys)

    def each(texts: list) -> tuple:
        told[:] = told or [_counter(stems, concat)]
        rows, terms, times = [], [], []
        for n, one in enumerate(texts):
            found = told[0](one)
            rows.extend([n] * len(found))
            terms.extend(found)
            times.extend(found.values())
        return rows, pa.array(terms, pa.string()), pa.array(times, pa.int64())

    told: list = []  # the worker's counter
    rows = _passed(docs.select(*keys, F.col(doc).alias("doc"), F.col(text).alias("_text")), [*keys, "doc"], "_text", "term string; tf bigint", each)
    return rows if unique else rows.groupBy(*keys, "doc", "term").agg(F.sum("tf").alias("tf"))


def length_rows(docs: DataFrame, doc: str, text: str, keys: tuple[str, ...] = (), stems: bool = True, concat: bool = False, unique: bool = False) -> DataFrame:
    """(keys, doc, dl): a row for each document; those without terms count with length one."""
    unique = unique or not alike(docs, doc, keys)

    def each(texts: list) -> tuple:
        told[:] = told or [_asked_counter((), stems, concat)]
        return None, pa.array([told[0](one)[0] for one in texts], pa.int64())

    told: list = []  # the worker's counter
    rows = _passed(docs.select(*keys, F.col(doc).alias("doc"), F.col(text).alias("_text")), [*keys, "doc"], "_text", "dl bigint", each)
    if not unique:  # each of its rows has the length of the document
        rows = docs.select(*keys, F.col(doc).alias("doc")).join(rows.groupBy(*keys, "doc").agg(F.sum("dl").alias("dl")), [*keys, "doc"], "left")
    return rows.withColumn("dl", F.greatest(F.coalesce("dl", F.lit(0)), F.lit(1)))


def frequency_rows(docs: DataFrame, doc: str, text: str, stems: bool = True) -> tuple[DataFrame, DataFrame]:
    """(term, df) and (n, avgdl). Documents are counted together before their terms are dealt out, and read once for both."""
    if alike(docs, doc):
        lengths = length_rows(docs, doc, text, stems=stems)
        return term_rows(docs, doc, text, stems=stems).groupBy("term").agg(F.count("*").alias("df")), lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, held, names = _counter(stems, False), Counter(), ["term", "df", "dl"]
        documents = size = 0

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64()), pa.array([0] * len(held), pa.int64())], names=names)
            held.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for one in batch.column(0).slice(at, SLICE).to_pylist():
                    found = count(one)
                    documents, size = documents + 1, size + max(1, sum(found.values()))
                    held.update(found.keys())
                    if len(held) >= MOST_HELD:
                        yield told()
        yield told()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([documents], pa.int64()), pa.array([size], pa.int64())], names=names)

    # the lengths come as a term without a name; conditions on sums stay above the exchange, so that both sides share it
    sums = docs.select(text).mapInArrow(counted, "term string, df bigint, dl bigint").groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl"))
    stats = sums.where("dl > 0").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("avgdl"))
    return sums.where("dl = 0 and df > 0").select("term", "df"), stats.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.max("avgdl").alias("avgdl"))


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """(term): the distinct tokens of all texts. A pass gives a word's again only where it has forgotten the word."""

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[str] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                fresh: set[str] = set()
                for one in batch.column(0).slice(at, SLICE).to_pylist():
                    fresh.update(literal.word_counts(one).keys() - known)
                if len(known) + len(fresh) > MOST_HELD:
                    known.clear()
                known |= fresh
                terms = {term for word in fresh for term in literal.tokens(word)}
                yield pa.RecordBatch.from_arrays([pa.array(list(terms), pa.string())], names=["term"])

    return docs.select(text).mapInArrow(seen, "term string").distinct()


def build_index(docs: DataFrame, doc: str, text: str, keys: tuple[str, ...] = (), stems: bool = True, concat: bool = False, unique: bool = False) -> LexicalIndex:
    """The index of a table of documents; documents without terms count with length one."""
    postings = term_rows(docs, doc, text, keys, stems, concat, unique)
    totals = postings.groupBy(*keys, "doc").agg(F.sum("tf").alias("dl"))
    lengths = docs.select(*keys, F.col(doc).alias("doc")).join(totals, [*keys, "doc"], "left").withColumn("dl", F.greatest(F.coalesce("dl", F.lit(0)), F.lit(1)))
    stats = lengths.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return LexicalIndex(postings, lengths, stats, keys)


def asked_rows(docs: DataFrame, doc: str, text: str, terms: DataFrame, keys: tuple[str, ...] = (), stems: bool = True, concat: bool = False, unique: bool = False) -> DataFrame:
    """(keys, doc, dl, found): of each document its length and those of the given terms (query, pos, term) that it has."""
    few = [r[0] for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    unique = unique or not alike(docs, doc, keys)
    if len(few) > MOST_TERMS:
        rows = term_rows(docs, doc, text, keys, stems, concat, unique).join(terms.select("term").distinct().withColumn("_asked", F.lit(True)), "term", "left")
        found = rows.groupBy(*keys, "doc").agg(F.sum("tf").alias("dl"), F.collect_list(F.when(F.col("_asked"), F.struct("term", "tf"))).alias("found"))
        rows = docs.select(*keys, F.col(doc).alias("doc")).distinct().join(found, [*keys, "doc"], "left")
        return rows.select(*keys, "doc", F.greatest(F.coalesce("dl", F.lit(0)), F.lit(1)).alias("dl"), F.coalesce("found", F.array().cast("array<struct<term:string,tf:bigint>>")).alias("found"))
    wanted, kind = frozenset(few), pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int64())]))

    def each(texts: list) -> tuple:
        told[:] = told or [_asked_counter(wanted, stems, concat)]
        counts = [told[0](one) for one in texts]
        found = [[{"term": t, "tf": n} for t, n in c.items()] for _, c in counts]
        return None, pa.array([dl for dl, _ in counts], pa.int64()), pa.array(found, kind)

    told: list = []  # the worker's counter
    rows = _passed(docs.select(*keys, F.col(doc).alias("doc"), F.col(text).alias("_text")), [*keys, "doc"], "_text", "dl bigint; found array<struct<term:string,tf:bigint>>", each)
    if not unique:
        same = rows.select(*keys, "doc", F.explode_outer("found").alias("f")).groupBy(*keys, "doc", "f.term").agg(F.sum("f.tf").alias("tf")).groupBy(*keys, "doc").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("found"))
        rows = rows.groupBy(*keys, "doc").agg(F.sum("dl").alias("dl")).join(same, [*keys, "doc"])
    return rows.select(*keys, "doc", F.greatest("dl", F.lit(1)).alias("dl"), "found")


def asked_index(docs: DataFrame, doc: str, text: str, terms: DataFrame, keys: tuple[str, ...] = (), stems: bool = True, concat: bool = False, unique: bool = False) -> LexicalIndex:
    """The index as far as the given terms (query, pos, term) need it: their postings, all lengths, and the statistics.

    A document gives one row with its length and the asked terms that it has; these rows are kept, and nothing else is.
    """
    rows = asked_rows(docs, doc, text, terms, keys, stems, concat, unique).persist()
    lengths = rows.select(*keys, "doc", "dl")
    stats = lengths.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return LexicalIndex(rows.select(*keys, "doc", "dl", F.inline("found")), lengths, stats, keys, rows)


def query_terms(spark: SparkSession, query: str, stems: bool = True, concat: bool = False, name: str = "q") -> DataFrame:
    """(query, pos, term): the distinct terms of one query, in order; a literal is tokenised where the plan is made."""
    found = literal.tokens(query)
    found = literal.with_stems(found) if stems else found
    found = literal.expand(found) if concat else found
    rows = [(name, n, term) for n, term in enumerate(dict.fromkeys(found))]
    return spark.createDataFrame(rows, "query string, pos int, term string")


def batch_terms(queries: DataFrame, query: str, text: str, stems: bool = True, concat: bool = False) -> DataFrame:
    """(query, pos, term) of a table of queries."""
    found = T.tokens(F.col(text))
    found = T.with_stems(found) if stems else found
    found = T.expand_tokens(found) if concat else found
    rows = queries.select(F.col(query).alias("query"), F.posexplode(found).alias("pos", "term"))
    return rows.groupBy("query", "term").agg(F.min("pos").alias("pos")).select("query", "pos", "term")


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def bm25(index: LexicalIndex, terms: DataFrame, cfg: LexicalConfig = DEFAULTS.lexical) -> DataFrame:
    """(keys, query, doc, score, first) for every document that has a term; first is the first term's place."""
    keys = list(index.keys)
    wanted = terms.join(index.document_frequency(), "term")
    stats = F.broadcast(index.stats) if not keys else index.stats
    wanted = (wanted.join(stats, keys) if keys else wanted.crossJoin(stats)).withColumn("idf", idf(F.col("n"), F.col("df")))
    rows = index.postings.join(wanted, [*keys, "term"])
    rows = rows if "dl" in rows.columns else rows.join(index.lengths, [*keys, "doc"])
    saturation = F.col("tf") * (cfg.k1 + 1) / (F.col("tf") + cfg.k1 * (1 - cfg.b + cfg.b * F.col("dl") / F.col("avgdl")))
    return rows.groupBy(*keys, "query", "doc").agg(F.sum(F.col("idf") * saturation).alias("score"), F.min("pos").alias("first"))


#: Documents whose scores are held at once, and most entries of a matrix of scores.
BLOCK, CELLS = 256, 1 << 21


def bm25_best(index: LexicalIndex, terms: DataFrame, k: int, cfg: LexicalConfig = DEFAULTS.lexical) -> DataFrame:
    """bm25's rows as far as the best k of each query need them, of an index of asked terms without keys.

    Each document's row is scored for all queries where it is, as a product of matrices, and a task gives only what may
    be among the best k of those that it has seen, with all that rounding or ties may put beside them.
    """
    wanted = terms.join(index.document_frequency(), "term").crossJoin(F.broadcast(index.stats))
    told = [tuple(r) for r in wanted.select("query", "pos", "term", "avgdl", idf(F.col("n"), F.col("df"))).collect()]
    names = list(dict.fromkeys(r[0] for r in told))
    place, number = {q: n for n, q in enumerate(names)}, {t: n for n, t in enumerate(dict.fromkeys(r[2] for r in told))}
    entries = sorted((number[t], place[q], weight, pos) for q, pos, t, _, weight in told)
    starts = np.searchsorted([e[0] for e in entries], np.arange(len(number) + 1))
    columns, weights, places = (np.array([e[n] for e in entries], kind) for n, kind in ((1, np.int64), (2, float), (3, np.int64)))
    average = told[0][3] if told else 1.0

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, tops = np.zeros(len(names)), np.zeros((len(names), k))
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found, sizes = part.column(2), pc.fill_null(pc.list_value_length(part.column(2)), 0).to_numpy(zero_copy_only=False)
                flat = found.flatten()
                terms_of = np.array([number.get(t, -1) for t in flat.field("term").to_pylist()], np.int64)
                docs, keep = np.repeat(np.arange(len(sizes)), sizes), terms_of >= 0
                tf, dl = flat.field("tf").to_numpy()[keep].astype(float), part.column(1).to_numpy().astype(float)
                docs, (mine, col) = docs[keep], np.unique(terms_of[keep], return_inverse=True)
                if not len(mine):
                    continue
                part_tf = tf * (cfg.k1 + 1) / (tf + cfg.k1 * (1 - cfg.b + cfg.b * dl[docs] / average))
                parts = np.zeros((len(sizes), len(mine)))
                parts[docs, col] = part_tf
                step = max(1, CELLS // max(len(mine), len(sizes)))
                for first in range(0, len(names), step):
                    last = min(len(names), first + step)
                    idfs, pos = np.zeros((len(mine), last - first)), np.full((len(mine), last - first), 1 << 30)
                    for row, term in enumerate(mine):
                        span = slice(starts[term], starts[term + 1])
                        inside = (columns[span] >= first) & (columns[span] < last)
                        idfs[row, columns[span][inside] - first], pos[row, columns[span][inside] - first] = weights[span][inside], places[span][inside]
                    scores = parts @ idfs
                    both = np.concatenate([tops[first:last], scores.T], axis=1)
                    tops[first:last] = np.partition(both, -k, axis=1)[:, -k:]
                    cuts[first:last] = tops[first:last].min(axis=1) - 2e-6
                    d, q = np.nonzero((scores > 0) & (scores >= cuts[first:last]))
                    earliest = [int(pos[parts[x] > 0, y].min()) for x, y in zip(d, q, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([names[first + y] for y in q], pa.string()), part.column(0).take(pa.array(d)), pa.array(scores[d, q]), pa.array(earliest, pa.int32())], names=["query", "doc", "score", "first"])

    kind = index.rows.schema["doc"].dataType.simpleString()
    return index.rows.select("doc", "dl", "found").mapInArrow(best, f"query string, doc {kind}, score double, first int")


def ranked(hits: DataFrame, keys: tuple[str, ...] = (), k: int | None = None, ties: tuple[str, ...] = ("first", "doc"), digits: int = 6) -> DataFrame:
    """hits with rank from 1 within (keys, query): best score, then earliest first term, then document."""
    by = Window.partitionBy(*keys, "query").orderBy(F.desc("score"), *ties)
    hits = hits.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(by))
    return hits.where(F.col("rank") <= k) if k else hits


def exact_matches(docs: DataFrame, doc: str, text: str, literal: str, keys: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """(keys, doc, start, end): the first place where the folded text holds the folded literal, in order of doc."""
    rows = docs.withColumn("_folded", T.fold(F.col(text))).withColumn("_needle", T.fold(F.lit(literal.strip())))
    at = F.position(F.col("_needle"), F.col("_folded"))
    rows = rows.where((F.length("_needle") > 0) & (at > 0)).select(*keys, F.col(doc).alias("doc"), (at - 1).alias("start"), (at - 1 + F.length("_needle")).alias("end"))
    if limit:
        order = Window.partitionBy(*keys).orderBy("doc") if keys else None
        rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n") if keys else rows.orderBy("doc").limit(limit)
    return rows


def fuse(lists: list[DataFrame], keys: tuple[str, ...] = (), k: int = DEFAULTS.lexical.rrf_k) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (keys, query, doc, rank): (keys, query, doc, score, first)."""
    union = None
    for n, hits in enumerate(lists):
        one = hits.select(*keys, "query", "doc", (1 / (k + F.col("rank"))).alias("part"), F.struct(F.lit(n).alias("list"), F.col("rank").alias("rank")).alias("seen"))
        union = one if union is None else union.unionByName(one)
    return union.groupBy(*keys, "query", "doc").agg(F.sum("part").alias("score"), F.min("seen").alias("first"))


def fuzzy(docs: DataFrame, doc: str, text: str, query: str, keys: tuple[str, ...] = (), cfg: RetrievalConfig = DEFAULTS.retrieval, k: int | None = None) -> DataFrame:
    """(keys, query, doc, score): trigram likeness of at least the floor; the best k of each corpus."""
    score = T.dice(T.trigrams(F.lit(query)), T.trigrams(F.col(text)))
    rows = docs.select(*keys, F.lit(query).alias("query"), F.col(doc).alias("doc"), score.alias("score")).where(F.col("score") >= cfg.fuzzy_floor)
    return ranked(rows, keys, k or cfg.fuzzy_count, ("doc",))


# --- what a query's terms can tell --------------------------------------------------------------------------------


def term_shares(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """(keys, query, pos, term, df, n, share) for every corpus and term; df is null for a term that is absent."""
    keys = list(index.keys)
    wide = terms.crossJoin(F.broadcast(index.stats)) if not keys else index.stats.crossJoin(F.broadcast(terms))
    return wide.join(index.document_frequency(), [*keys, "term"], "left").withColumn("share", F.col("df") / F.greatest(F.col("n"), F.lit(1)))


def informative(shares: DataFrame, cfg: RetrievalConfig = DEFAULTS.retrieval) -> DataFrame:
    """Absent terms, and those in at most a part of the documents (one at least)."""
    return shares.where(F.col("df").isNull() | (F.col("df") <= F.greatest(F.lit(1.0), F.greatest(F.col("n"), F.lit(1)) * cfg.common_term_share)))


def reachable(shares: DataFrame) -> DataFrame:
    """Terms that the corpus holds, with their document share."""
    return shares.where(F.col("df").isNotNull())


def discriminates(shares: DataFrame, keys: tuple[str, ...] = (), cfg: RetrievalConfig = DEFAULTS.retrieval) -> DataFrame:
    """(keys, query, discriminates): whether any term is rare enough to tell documents apart."""
    return shares.groupBy(*keys, "query").agg(F.coalesce(F.bool_or(F.col("share") <= cfg.content_term_share), F.lit(False)).alias("discriminates"))


def coverage(doc_tokens: DataFrame, wanted: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, query, doc, coverage): distinct wanted terms that a document's tokens (keys, doc, term) hold, over all."""
    total = wanted.groupBy(*keys, "query").agg(F.count("*").alias("_all"))
    hit = doc_tokens.select(*keys, "doc", "term").distinct().join(wanted.select(*keys, "query", "term"), [*keys, "term"])
    rows = hit.groupBy(*keys, "query", "doc").agg(F.count("*").alias("_hit")).join(total, [*keys, "query"])
    return rows.select(*keys, "query", "doc", (F.col("_hit") / F.col("_all")).alias("coverage"))


def confidence(value: Column, cfg: RetrievalConfig = DEFAULTS.retrieval) -> Column:
    return F.when(value >= cfg.confidence_high, "high").when(value >= cfg.confidence_medium, "medium").otherwise("low")


def ambiguity(hits: DataFrame, keys: tuple[str, ...] = (), cfg: RetrievalConfig = DEFAULTS.retrieval) -> DataFrame:
    """(keys, query, top, runner_up, ambiguous): whether the second score comes near the first."""
    rows = hits.where("rank <= 2").groupBy(*keys, "query").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("runner_up"))
    return rows.withColumn("ambiguous", F.coalesce(F.col("runner_up") / F.col("top") > cfg.ambiguity_ratio, F.lit(False)))
