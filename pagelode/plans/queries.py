"""The registered queries of the retrieval engine over the given tables, each over whole tables, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.config import DEFAULTS, EngineConfig, configure
from pagelode.functions import literal
from pagelode.functions import text as T
from pagelode.operators import address as A
from pagelode.operators import delta as D
from pagelode.operators import dense as V
from pagelode.operators import find as FIND
from pagelode.operators import lexical as L
from pagelode.operators import locate as LOCATE
from pagelode.operators import structure as S
from pagelode.operators.page_index import PageIndex
from pagelode.operators.segment import segment_stats
from pagelode.plans import sql as Q
from pagelode.sources import manifest as M
from pagelode.sources.html import PARTS, project_page
from pagelode.streaming.changes import settled

QUERY = "thinor ertion onheer entreation scum"
LITERAL = "Onther the"
CONTROL = "the attion ener"
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin where SQL has one."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", "text")


def dealt(rows: DataFrame) -> DataFrame:
    """A table as it is read, dealt out where a small file would leave all work to one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(documents(spark, sf))


def doc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """(n, avgdl) of all documents."""
    return L.length_rows(texts(spark, sf), "doc_id", "text").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def asked_index(spark: SparkSession, sf: str, terms: DataFrame) -> L.LexicalIndex:
    """What the index of all documents tells of these terms."""
    return L.asked_index(texts(spark, sf), "doc_id", "text", terms)


def asked_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that the query's terms reach, with their scores."""
    terms = L.query_terms(spark, QUERY)
    return L.bm25(asked_index(spark, sf, terms), terms)


def page_index(spark: SparkSession, sf: str, cfg: EngineConfig = DEFAULTS, parts: tuple[str, ...] = PARTS, fields: str | None = None, once: bool = False) -> PageIndex:
    """The index of all pages: parts, and fields of nodes, that a query reads; once, where it reads them once."""
    return PageIndex(dealt(read(spark, sf, "pages")), cfg, parts, fields and fields.split(), once)


#: How the SQL twins read texts: of character references only those with a semicolon count. Browsers know some without.
TWIN = configure({"project": {"bare_references": False}})


_found = literal.with_stems(literal.tokens(QUERY))
TERMS = [("q", n, t) for n, t in enumerate(dict.fromkeys(_found))]
TERMS_SQL = Q.query_terms(TERMS)
BM25 = Q.bm25("documents", TERMS_SQL)


# --- text ---------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len({Q.tokens('text')}) AS INT) AS n_tokens, md5(array_to_string({Q.tokens('text')}, ' ')) AS tokens_md5 FROM documents")
def tokenize_docs(spark, sf):
    found = documents(spark, sf).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(f"SELECT doc_id, CAST(len({Q.words('text')}) AS INT) AS n_words FROM documents")
def word_counts(spark, sf):
    return documents(spark, sf).select("doc_id", T.word_count(F.col("text")).alias("n_words"))


@query(f"WITH w AS (SELECT unnest({Q.words('text')}) AS word FROM documents) SELECT word, {Q.fold('word')} AS folded, count(*) AS n FROM w GROUP BY ALL")
def fold_terms(spark, sf):
    found = documents(spark, sf).select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return found.select("word", T.fold(F.col("word")).alias("folded"), "n")


@query(f"WITH t AS (SELECT DISTINCT unnest({Q.tokens('text')}) AS term FROM documents) SELECT term, {Q.stem('term')} AS stem FROM t WHERE {Q.stem('term')} <> term")
def stem_terms(spark, sf):
    return L.vocabulary(texts(spark, sf), "text").withColumn("stem", T.stem(F.col("term"))).where("stem <> term")


@query(f"WITH w AS (SELECT DISTINCT unnest({Q.words('text')}) AS word FROM documents) SELECT word, array_to_string({Q.parts('word')}, ' ') AS parts FROM w WHERE len({Q.parts('word')}) > 0")
def identifier_parts(spark, sf):
    found = documents(spark, sf).select(F.explode(T.words(F.col("text"))).alias("word")).distinct()
    return found.select("word", F.array_join(T.identifier_parts(F.col("word")), " ").alias("parts")).where("parts <> ''")


_PAIR = "list_transform(range(1, len(t)), lambda i: CASE WHEN length(t[i]) <= 6 AND length(t[i + 1]) <= 6 AND length(t[i]) + length(t[i + 1]) >= 4 THEN t[i] || t[i + 1] END)"


@query(f"WITH b AS (SELECT item_id, {Q.tokens('text')} AS t FROM benchmark) SELECT item_id, array_to_string(list_concat(t, list_filter({_PAIR}, lambda x: x IS NOT NULL)), ' ') AS expanded FROM b")
def concat_expand(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", F.array_join(T.expand_tokens(T.tokens(F.col("text"))), " ").alias("expanded"))


@query("SELECT doc_id, round(coalesce((length(s) - length(regexp_replace(s, '[\\x{2e80}-\\x{9fff}\\x{ac00}-\\x{d7af}\\x{f900}-\\x{faff}\\x{0e00}-\\x{0e7f}]', '', 'g'))) / nullif(length(s), 0), 0), 6) AS density FROM (SELECT doc_id, substr(coalesce(text, ''), 1, 4000) AS s FROM documents)")
def script_density(spark, sf):
    return documents(spark, sf).select("doc_id", F.round(T.script_density(F.col("text")), 6).alias("density"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf):
    return documents(spark, sf).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT item_id, CAST(len({Q.trigrams('text')}) AS INT) AS n_trigrams, array_to_string(list_sort({Q.trigrams('text')}), '|') AS grams FROM benchmark")
def trigram_sets(spark, sf):
    grams = T.trigrams(F.col("text"))
    return read(spark, sf, "benchmark").select("item_id", F.size(grams).alias("n_trigrams"), F.array_join(F.sort_array(grams), "|").alias("grams"))


@query("""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])(\\s+)', '\\1\\2' || chr(31), 'g'), chr(31)) AS parts FROM documents),
x AS (SELECT doc_id, unnest(parts) AS sentence, unnest(range(len(parts))) AS i FROM s), y AS (SELECT * FROM x WHERE sentence <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS n, CAST(sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS "end", md5(sentence) AS sentence_md5 FROM y""")
def sentence_split(spark, sf):
    return T.sentence_rows(documents(spark, sf), ["doc_id"], "text").select("doc_id", F.col("n").cast("long").alias("n"), "end", F.md5("sentence").alias("sentence_md5"))


# --- index and ranking --------------------------------------------------------------------------------------------


@query(f"WITH {Q.term_table('documents')} SELECT doc AS doc_id, term, tf FROM tf")
def postings(spark, sf):
    return L.term_rows(texts(spark, sf), "doc_id", "text").withColumnRenamed("doc", "doc_id")


@query(f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def doc_stats(spark, sf):
    return doc_lengths(spark, sf).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN st")
def idf_table(spark, sf):
    df, stats = L.frequency_rows(texts(spark, sf), "doc_id", "text")
    return df.crossJoin(F.broadcast(stats)).select("term", "df", F.round(L.idf(F.col("n"), F.col("df")), 6).alias("idf"))


_RANKED = "SELECT query, doc, round(score, 6) AS score, first, row_number() OVER (PARTITION BY query ORDER BY round(score, 6) DESC, first, doc) AS rank FROM hits"


@query(f"WITH {BM25}, r AS ({_RANKED}) SELECT doc AS doc_id, score, rank FROM r WHERE rank <= 20")
def bm25_topk(spark, sf):
    hits = L.ranked(asked_hits(spark, sf), (), 20)
    return hits.select(F.col("doc").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


_BATCH = Q.bm25("documents", f"SELECT CAST(item_id AS VARCHAR) AS query, min(pos) AS pos, term FROM (SELECT item_id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT item_id, list_concat(x, list_filter(list_transform(x, lambda y: CASE WHEN {Q.stem('y')} <> y THEN {Q.stem('y')} END), lambda z: z IS NOT NULL)) AS t FROM (SELECT item_id, {Q.tokens('text')} AS x FROM benchmark))) GROUP BY item_id, term")


@query(f"WITH {_BATCH}, r AS ({_RANKED}) SELECT query, doc AS doc_id, score, rank FROM r WHERE rank <= 10")
def bm25_benchmark_batch(spark, sf):
    asked = L.batch_terms(read(spark, sf, "benchmark").withColumn("item_id", F.col("item_id").cast("string")), "item_id", "text")
    hits = L.ranked(L.bm25_best(asked_index(spark, sf, asked), asked, 10), (), 10)
    return hits.select("query", F.col("doc").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


_EXACT = f"SELECT doc_id, CAST(strpos({Q.fold('text')}, {Q.fold(repr(LITERAL))}) - 1 AS INT) AS start FROM documents WHERE strpos({Q.fold('text')}, {Q.fold(repr(LITERAL))}) > 0"


@query(f'SELECT doc_id, start, CAST(start + {len(LITERAL)} AS INT) AS "end" FROM ({_EXACT})')
def exact_literal(spark, sf):
    return L.exact_matches(documents(spark, sf), "doc_id", "text", LITERAL).withColumnRenamed("doc", "doc_id")


@query(f"WITH {BM25}, r AS ({_RANKED}), e AS ({_EXACT}), top AS (SELECT count(*) AS n FROM r) SELECT doc AS doc_id, score, rank, 'ranked' AS match FROM r UNION ALL SELECT doc_id, 0.0, n + row_number() OVER (ORDER BY doc_id), 'exact' FROM e CROSS JOIN top WHERE doc_id NOT IN (SELECT doc FROM r)")
def exact_overlay(spark, sf):
    hits = L.ranked(asked_hits(spark, sf)).select(F.col("doc").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"), F.lit("ranked").alias("match"))
    exact = L.exact_matches(documents(spark, sf), "doc_id", "text", LITERAL).withColumnRenamed("doc", "doc_id")
    more = exact.join(hits.select("doc_id"), "doc_id", "left_anti").crossJoin(F.broadcast(hits.agg(F.count("*").alias("n"))))
    # literal hits that no term reaches; they are ranked after all others, in order
    return hits.unionByName(more.select("doc_id", F.lit(0.0).alias("score"), (F.col("n") + F.expr("row_number() OVER (ORDER BY doc_id)")).alias("rank"), F.lit("exact").alias("match")))


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
_DENSE = f"SELECT CAST(b.vec_id AS VARCHAR) AS query, a.vec_id AS doc, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({_COS}, 6) DESC, a.vec_id) AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 AND {_COS} > 0"


def _asked(spark, sf):
    # a stated query set: every twentieth vector
    return read(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query"), F.col("embedding").alias("vector"))


@query(f"SELECT query, doc AS vec_id, score, rank FROM ({_DENSE}) WHERE rank <= 10")
def dense_topk(spark, sf):
    hits = V.cosine_topk(read(spark, sf, "embeddings"), _asked(spark, sf), 10)
    return hits.select("query", F.col("doc").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


@query("WITH s AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) / 127 AS scale FROM embeddings) SELECT vec_id, round(scale, 9) AS scale, array_to_string(list_transform(e, lambda x: CAST(floor(x / scale + 0.5) AS INT)), ',') AS q FROM s")
def int8_quantize(spark, sf):
    found = V.quantise(read(spark, sf, "embeddings"))
    return found.select("vec_id", F.round("scale", 9).alias("scale"), F.array_join(F.col("q").cast("array<string>"), ",").alias("q"))


@query(f"""WITH {BM25}, r AS (SELECT doc, rank FROM ({_RANKED}) WHERE rank <= 50), d AS (SELECT doc, rank FROM ({_DENSE}) WHERE query = '0' AND rank <= 50),
u AS (SELECT doc, 1.0 / (60 + rank) AS part, 0 AS list, rank FROM r UNION ALL SELECT doc, 1.0 / (60 + rank), 1, rank FROM d),
f AS (SELECT doc, round(sum(part), 6) AS score, min(list * 1000 + rank) AS first FROM u GROUP BY doc)
SELECT doc AS doc_id, score, row_number() OVER (ORDER BY score DESC, first, doc) AS rank FROM f""")
def hybrid_search(spark, sf):
    lexical = L.ranked(asked_hits(spark, sf), (), 50)
    dense = V.cosine_topk(read(spark, sf, "embeddings"), _asked(spark, sf).where("query = '0'"), 50).withColumn("query", F.lit("q"))
    return V.hybrid(lexical, dense, k=None).select(F.col("doc").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(_SQL["hybrid_search"].replace(_DENSE, _RANKED.replace("FROM hits", "FROM (SELECT '0' AS query, doc, score, first FROM hits WHERE doc % 2 = 1)")))
def rrf_fusion(spark, sf):
    """The ranking fused with that of every other document."""
    hits = asked_hits(spark, sf)
    return L.ranked(L.fuse([L.ranked(hits, (), 50), L.ranked(hits.where("doc % 2 = 1"), (), 50)])).select(F.col("doc").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


PART = "smal rings"
_DICE = f"2.0 * len(list_intersect({Q.trigrams('p_name')}, {Q.trigrams(repr(PART))})) / (len({Q.trigrams('p_name')}) + len({Q.trigrams(repr(PART))}))"


@query(f"SELECT p_partkey, score, rank FROM (SELECT p_partkey, score, row_number() OVER (ORDER BY score DESC, p_partkey) AS rank FROM (SELECT p_partkey, round({_DICE}, 6) AS score FROM part WHERE {_DICE} >= 0.12)) WHERE rank <= 20")
def fuzzy_dice(spark, sf):
    """Misspelt names: the fuzzy fallback's best, at its floor."""
    found = L.fuzzy(read(spark, sf, "part"), "p_partkey", "p_name", PART, k=20)
    return found.select(F.col("doc").alias("p_partkey"), "score", F.col("rank").cast("long").alias("rank"))


# --- what terms tell ----------------------------------------------------------------------------------------------

_SHARES = f"{BM25}, sh AS (SELECT q.term, q.pos, df.df, n, df.df / n AS share FROM q CROSS JOIN st LEFT JOIN df USING (term)), inf AS (SELECT * FROM sh WHERE df IS NULL OR df <= greatest(1, n * 0.5)), reach AS (SELECT * FROM sh WHERE df IS NOT NULL)"


def _shares(spark, sf):
    terms = L.query_terms(spark, QUERY)
    return L.term_shares(asked_index(spark, sf, terms), terms)


@query(f"WITH {_SHARES} SELECT term, pos, df FROM inf")
def informative_terms(spark, sf):
    return L.informative(_shares(spark, sf)).select("term", "pos", "df")


@query(f"WITH {_SHARES} SELECT term, df, round(share, 6) AS share FROM reach")
def reachable_terms(spark, sf):
    return L.reachable(_shares(spark, sf)).select("term", "df", F.round("share", 6).alias("share"))


@query(f"WITH {_SHARES} SELECT coalesce(bool_or(share <= 0.25), false) AS discriminates FROM reach")
def discriminates(spark, sf):
    return L.discriminates(L.reachable(_shares(spark, sf))).select("discriminates")


_COVER = f"{_SHARES}, cov AS (SELECT doc, count(DISTINCT term) / (SELECT count(*) FROM inf) AS coverage FROM tok JOIN inf USING (term) GROUP BY doc)"


def _coverage(spark, sf):
    terms = L.query_terms(spark, QUERY)
    plain = L.asked_rows(texts(spark, sf), "doc_id", "text", terms, stems=False).select("doc", F.inline("found"))
    return L.coverage(plain, L.informative(L.term_shares(asked_index(spark, sf, terms), terms)))


@query(f"WITH {_COVER} SELECT doc AS doc_id, round(coverage, 6) AS coverage FROM cov")
def query_coverage(spark, sf):
    return _coverage(spark, sf).select(F.col("doc").alias("doc_id"), F.round("coverage", 6).alias("coverage"))


@query(f"WITH {_COVER} SELECT CASE WHEN coverage >= 0.6 THEN 'high' WHEN coverage >= 0.34 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS documents FROM cov GROUP BY 1")
def confidence_bands(spark, sf):
    return _coverage(spark, sf).groupBy(L.confidence(F.col("coverage")).alias("confidence")).agg(F.count("*").alias("documents"))


@query(f"WITH {_BATCH}, r AS ({_RANKED}) SELECT query, max(CASE WHEN rank = 1 THEN score END) AS top, max(CASE WHEN rank = 2 THEN score END) AS runner_up, coalesce(max(CASE WHEN rank = 2 THEN score END) / max(CASE WHEN rank = 1 THEN score END) > 0.85, false) AS ambiguous FROM r WHERE rank <= 2 GROUP BY query")
def ambiguity_gate(spark, sf):
    asked = L.batch_terms(read(spark, sf, "benchmark").withColumn("item_id", F.col("item_id").cast("string")), "item_id", "text")
    return L.ambiguity(L.ranked(L.bm25_best(asked_index(spark, sf, asked), asked, 2), (), 2))


@query(f"WITH {BM25}, p AS (SELECT doc, round(score * CASE WHEN source IN ('src1', 'src2', 'src3') THEN 0.35 ELSE 1 END * CASE WHEN lang = 'de' THEN 0.5 ELSE 1 END, 6) AS score FROM hits JOIN documents ON doc = doc_id) SELECT doc AS doc_id, score, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM p")
def structural_prior(spark, sf):
    """The prior with sources as landmarks and a language as a citation section."""
    hits = asked_hits(spark, sf).join(read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "source", "lang"), "doc")
    mark = F.when(F.col("source").isin("src1", "src2", "src3"), "navigation").otherwise("")
    score = FIND.structural_prior(F.col("score"), mark, F.lit(0.0), F.when(F.col("lang") == "de", F.array(F.lit("References"))).otherwise(F.array(F.lit("Text"))))
    found = hits.select(F.col("doc").alias("doc_id"), F.round(score, 6).alias("score"))
    return found.withColumn("rank", F.expr("row_number() OVER (ORDER BY score DESC, doc_id)").cast("long"))


@query(f"WITH {BM25}, r AS ({_RANKED}), g AS (SELECT r.*, row_number() OVER (PARTITION BY source, lang ORDER BY rank) AS n FROM r JOIN documents ON doc = doc_id) SELECT doc AS doc_id, score, row_number() OVER (ORDER BY rank) AS rank FROM g WHERE n = 1")
def region_coalesce(spark, sf):
    """The first hit of each region, a document's region being its source and language."""
    hits = L.ranked(asked_hits(spark, sf))
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("landmark"), F.array("lang").alias("heading_path"))
    rows = hits.withColumnRenamed("doc", "target_id").join(d.withColumnRenamed("doc_id", "target_id"), "target_id")
    rows = rows.select("*", F.lit(0).alias("page_id"), F.lit("passage").alias("kind"), F.lit(True).alias("is_primary"), F.lit(None).cast("string").alias("landmark_name"))
    return FIND.coalesce_regions(rows).select(F.col("target_id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {BM25}, r AS ({_RANKED}) SELECT doc AS doc_id, score, rank, (SELECT count(*) FROM r) AS matched, (SELECT count(*) FROM r) > 15 AS truncated FROM r WHERE rank > 10 AND rank <= 15")
def paginate_window(spark, sf):
    from pagelode.operators.budget import paginate

    page = paginate(L.ranked(asked_hits(spark, sf)), "rank", ("doc", "score"), 5, 10)
    return page.rows.select(F.col("doc").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"), F.lit(page.matched).cast("long").alias("matched"), F.lit(page.truncated).alias("truncated"))


@query(f"""WITH {_SHARES}, useful AS (SELECT term FROM inf WHERE df IS NOT NULL), d AS (SELECT doc FROM ({_RANKED}) WHERE rank <= 20),
s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])(\\s+)', '\\1\\2' || chr(31), 'g'), chr(31)) AS parts FROM documents WHERE doc_id IN (SELECT doc FROM d)),
x AS (SELECT doc_id, unnest(parts) AS sentence, unnest(range(len(parts))) AS n FROM s),
c AS (SELECT doc_id, n, trim(sentence, ' ' || chr(10)) AS sentence, len(list_intersect(list_distinct({Q.tokens('sentence')}), (SELECT list(term) FROM useful))) / (SELECT count(*) FROM useful) AS coverage FROM x)
SELECT doc_id, round(max(coverage), 6) AS coverage, md5(arg_max(sentence, coverage * 1000000 - n)) AS sentence_md5 FROM c GROUP BY doc_id HAVING max(coverage) > 0""")
def best_sentence(spark, sf):
    """The sentence of each of the first twenty documents that holds most of the query; the earliest of equal ones."""
    terms = L.query_terms(spark, QUERY)
    index = asked_index(spark, sf, terms)
    useful = L.reachable(L.informative(L.term_shares(index, terms))).select("term").distinct()
    top = [r[0] for r in L.ranked(L.bm25_best(index, terms, 20), (), 20).select("doc").collect()]
    rows = T.sentence_rows(documents(spark, sf).where(F.col("doc_id").isin(top)), ["doc_id"], "text")
    hit = rows.select("doc_id", "n", F.explode(F.array_distinct(T.tokens(F.col("sentence")))).alias("term")).join(useful, "term").groupBy("doc_id", "n").agg(F.count("*").alias("hit"))
    best = hit.groupBy("doc_id").agg(F.max(F.struct("hit", (-F.col("n")).alias("early"))).alias("b")).select("doc_id", "b.hit", (-F.col("b.early")).alias("n"))
    total = useful.agg(F.count("*").alias("all"))
    rows = rows.join(best, ["doc_id", "n"]).crossJoin(F.broadcast(total))
    return rows.select("doc_id", F.round(F.col("hit") / F.col("all"), 6).alias("coverage"), F.md5(F.trim(F.col("sentence"), F.lit(" \n"))).alias("sentence_md5"))


# --- pages --------------------------------------------------------------------------------------------------------

_TITLE = Q.unescaped("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
_H1 = f"trim(regexp_replace({Q.unescaped(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?s)<h1>(.*?)</h1>' + chr(39) + ', 1)')}, '\\s+', ' ', 'g'))"
_LINKS = f"""SELECT page_id, n, {Q.unescaped("regexp_extract(a, '(?s)>(.*?)</a>', 1)")} AS name, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || {Q.unescaped("regexp_extract(a, 'href=\"([^\"]*)\"', 1)")} AS href
FROM (SELECT page_id, url, unnest(l) AS a, unnest(range(1, len(l) + 1)) AS n FROM (SELECT page_id, url, regexp_extract_all(html, '(?s)<a href=\"[^\"]*\">.*?</a>') AS l FROM pages))"""


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_titles(spark, sf):
    raw = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return read(spark, sf, "pages").select("page_id", raw.alias("title"))


@query(f"SELECT page_id, n, name, href FROM ({_LINKS})")
def page_links(spark, sf):
    links = page_index(spark, sf, TWIN, ("nodes",), "seq role name href", once=True).nodes.where("role = 'link'")
    return links.select("page_id", F.expr("row_number() OVER (PARTITION BY page_id ORDER BY seq)").cast("long").alias("n"), "name", "href")


@query(f"SELECT page_id, href, name FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY n) AS k FROM ({_LINKS})) WHERE k = 1")
def live_links(spark, sf):
    index = page_index(spark, sf, TWIN)
    return S.live_links(index.nodes, index.pages).select("page_id", "href", "name")


@query(f"SELECT page_id, 'navigation' AS landmark, count(*) AS controls, count(DISTINCT name) AS names FROM ({_LINKS}) GROUP BY page_id")
def nav_controls(spark, sf):
    rows = page_index(spark, sf, TWIN, ("nodes",), "interactive landmark name", once=True).nodes.where("interactive and landmark = 'navigation'")
    return rows.groupBy("page_id", "landmark").agg(F.count("*").alias("controls"), F.count_distinct("name").alias("names"))


@query(f"SELECT page_id, {_H1} AS text, CAST(1 AS INT) AS depth FROM pages WHERE {_H1} <> ''")
def page_outline(spark, sf):
    return page_index(spark, sf, TWIN, ("nodes",), "seq is_heading heading_path level text landmark landmark_name is_primary", once=True).outline.select("page_id", "text", "depth")


@query(f"SELECT page_id, n - 1 AS ordinal, peers AS peer_count, name FROM (SELECT page_id, name, row_number() OVER w AS n, count(*) OVER (PARTITION BY page_id, name) AS peers FROM ({_LINKS}) WINDOW w AS (PARTITION BY page_id, name ORDER BY n))")
def address_ordinals(spark, sf):
    rows = page_index(spark, sf, TWIN, ("nodes",), "seq frame role name landmark landmark_name heading_path row", once=True).nodes.where("role = 'link'")
    return rows.select("page_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("peer_count").cast("long").alias("peer_count"), "name")


@query(f"SELECT page_id, trim(regexp_replace(CASE WHEN contains(name, name) THEN name || ' link ' END, '\\s+', ' ', 'g')) AS document, n FROM ({_LINKS})")
def control_docs(spark, sf):
    """The documents that links are found by."""
    rows = page_index(spark, sf, TWIN).controls.where("role = 'link'")
    return rows.select("page_id", "document", F.expr("row_number() OVER (PARTITION BY page_id ORDER BY seq)").cast("long").alias("n"))


@query()
def affordances(spark, sf):
    return page_index(spark, sf).nodes.select("page_id", "seq", F.explode("affordance_via").alias("affordance", "via"))


@query()
def landmark_counts(spark, sf):
    return S.landmarks(page_index(spark, sf, parts=("nodes",), fields="seq landmark", once=True).nodes).select("page_id", "landmark", "nodes")


@query()
def segment_strategies(spark, sf):
    return segment_stats(page_index(spark, sf, parts=("chunks",), once=True).chunks)


@query()
def coverage_counts(spark, sf):
    return page_index(spark, sf, parts=("coverage",), once=True).coverage


@query()
def structural_quality(spark, sf):
    index = page_index(spark, sf)
    return S.quality(segment_stats(index.chunks), S.tree_tokens(index.nodes))


@query()
def find_on_pages(spark, sf):
    return FIND.find(page_index(spark, sf, parts=("nodes", "qa", "chunks"), fields="seq is_heading heading_path level text landmark landmark_name is_primary"), QUERY).drop("heading_path")


@query()
def locate_control(spark, sf):
    return LOCATE.locate(page_index(spark, sf), CONTROL).select("page_id", "control_id", "role", "name", "score", "coverage", "confidence", "rank", "matched", "ambiguous", "recommended")


@query(f"SELECT page_id, count(*) AS addresses, count(*) AS resolved FROM ({_LINKS}) GROUP BY page_id")
def resolve_ladder(spark, sf):
    """Every link's address resolves against the projection that it comes from."""
    nodes = page_index(spark, sf, TWIN).nodes.where("role = 'link'")
    return A.resolve(A.mint(nodes), nodes).groupBy("page_id").agg(F.count("*").alias("addresses"), F.count_if(F.col("status") == "RESOLVED").alias("resolved"))


@query("SELECT page_id, 'region-content' AS kind, CAST(1 AS BIGINT) AS changes FROM pages WHERE contains(html, '<footer>')")
def snapshot_diff(spark, sf):
    """What a new last word in the footer changes."""
    told = ("nodes", "chunks"), "seq frame interactive attrs role name landmark landmark_name row heading_path states actionable".split()
    before = page_index(spark, sf)
    after = before.pages.withColumn("html", F.replace("html", F.lit("</footer>"), F.lit(" changed</footer>")))
    before, after = (PageIndex(pages, DEFAULTS, *told) for pages in (before.pages, after))
    return D.change_summary(D.semantic_changes((before.nodes, before.chunks), (after.nodes, after.chunks))).select("page_id", "kind", "changes")


# --- manifests, versions, bursts ----------------------------------------------------------------------------------

BODIES = [
    ("https://a.example", "/llms.txt", "# Guide\n> All of it\n## Start\n- [Install](/install.md): how to set it up\n- [Other](https://b.example/x)\n## API\n* [Tools](tools.md)\n"),
    ("https://c.example", "/llms-full.txt", "# C\n- [Pricing plans](https://c.example/pricing): cost and plans\n"),
]
_BODIES_SQL = "bodies AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in b) + ")" for b in BODIES) + ") v(origin, path, body))"
_DOCS_SQL = f"""WITH {_BODIES_SQL}, l AS (SELECT origin, path, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS ln FROM bodies),
s AS (SELECT *, last_value(CASE WHEN line LIKE '## %' THEN trim(substr(line, 4)) END IGNORE NULLS) OVER (PARTITION BY origin, path ORDER BY ln) AS section FROM l WHERE trim(line) <> ''),
d AS (SELECT origin, path, ln, regexp_extract(line, '\\[([^\\]]+)\\]', 1) AS title, regexp_extract(line, '\\(([^)\\s]+)\\)', 1) AS href, section, nullif(trim(regexp_extract(line, '\\)\\s*:\\s*(.*)$', 1)), '') AS note FROM s WHERE regexp_matches(line, '^[-*]\\s*\\[[^\\]]+\\]\\([^)\\s]+\\)')),
e AS (SELECT *, CASE WHEN contains(href, '://') THEN href WHEN href LIKE '/%' THEN origin || href ELSE origin || '/' || href END AS url FROM d),
docs AS (SELECT *, starts_with(url, origin || '/') AS same_origin, row_number() OVER (PARTITION BY origin, path ORDER BY ln) - 1 AS ord FROM e)"""


def _bodies(spark):
    return spark.createDataFrame(BODIES, "origin string, path string, body string")


@query(f"{_DOCS_SQL} SELECT origin, path, title, url, section, note, same_origin, ord FROM docs")
def manifest_documents(spark, sf):
    return M.documents(_bodies(spark)).withColumn("ord", F.col("ord").cast("long"))


@query(f"{_DOCS_SQL} SELECT origin, count(*) FILTER (same_origin) AS documents, count(*) FILTER (NOT same_origin) AS dropped FROM docs GROUP BY origin")
def manifest_list(spark, sf):
    return M.manifest_list(_bodies(spark)).drop("hosts")


@query(f"{_DOCS_SQL}, c AS (SELECT *, len(list_intersect(['install', 'cost', 'tools'], list_distinct({Q.tokens(chr(34) + 'title' + chr(34) + chr(32) + '|| chr(32) || coalesce(note, chr(32)) || chr(32) || coalesce(section, chr(32))')}))) / 3 AS coverage FROM docs WHERE same_origin) SELECT origin, title, url, round(coverage, 6) AS coverage, row_number() OVER (PARTITION BY origin ORDER BY coverage DESC, ord) AS rank FROM c WHERE coverage > 0")
def manifest_find(spark, sf):
    found = M.manifest_find(_bodies(spark), "install cost tools")
    return found.select("origin", "title", "url", F.round("coverage", 6).alias("coverage"), F.col("rank").cast("long").alias("rank"))


@query("SELECT conv_id, turn, md5(coalesce(text, '')) AS etag, coalesce(lag(md5(coalesce(text, ''))) OVER w <> md5(coalesce(text, '')), true) AS changed FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def etag_changes(spark, sf):
    return D.version_changes(read(spark, sf, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "etag", "changed")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, count(*) AS events, epoch_us(min(ts)) AS started_us FROM s GROUP BY user_id, burst""")
def settle_sessions(spark, sf):
    """Bursts of a user's events that an hour's quiet ends."""
    return settled(read(spark, sf, "events"), quiet="1 hour").select("user_id", "events", F.unix_micros("start").alias("started_us"))


# --- fixtures: what the given pages have nothing of ---------------------------------------------------------------

FIXTURE = """<html lang="en"><body><header><nav aria-label="Site"><a href="/a" rel="next">More</a><a href="/de" hreflang="de">Deutsch</a></nav></header>
<main><h1>Parking permits</h1><p>A parking permit costs 40 euro a year. It is <b>not</b> refundable.</p>
<h2>Apply</h2><form id="f"><label for="n">Name</label><input id="n" required><label for="m">Mail</label><input id="m" type="email" value="x@y.z" required>
<button type="submit">Send request</button></form><img src="map_2024.png"><img src="m.png" alt="Map of the zones"><div role="dialog" hidden>Later</div>
<script type="application/ld+json">{"@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "What does a permit cost?", "acceptedAnswer": {"@type": "Answer", "text": "<p>40 euro.</p>"}}]}</script></main>
<footer>Town hall</footer></body></html>"""


def fixture_index(spark) -> PageIndex:
    return PageIndex(spark.createDataFrame([(1, "https://town.example/permits", FIXTURE)], "page_id long, url string, html string"))


@query("SELECT CAST(1 AS BIGINT) AS page_id, 'What does a permit cost?' AS question, '40 euro.' AS answer, 'FAQPage' AS source")
def jsonld_qa(spark, sf):
    return fixture_index(spark).qa.drop("seq")


@query("SELECT CAST(1 AS BIGINT) AS page_id, CAST(2 AS BIGINT) AS fields, CAST(2 AS BIGINT) AS required, CAST(1 AS BIGINT) AS required_filled, CAST(1 AS BIGINT) AS filled, CAST(1 AS BIGINT) AS invalid, 'Send request' AS submit, false AS complete")
def forms_rollup(spark, sf):
    return S.forms(fixture_index(spark).nodes).drop("form")


@query("SELECT CAST(1 AS BIGINT) AS page_id, 'img' AS tag, 'NO_TEXT_AVAILABLE' AS reason, 'map' AS filename_hint")
def opaque_regions(spark, sf):
    return fixture_index(spark).opaque.select("page_id", "tag", "reason", "filename_hint")


@query("SELECT CAST(1 AS BIGINT) AS page_id, 'language-switcher,pagination-next,submit' AS authored, 'primary-input' AS inferred")
def vocabulary(spark, sf):
    return S.vocabulary(fixture_index(spark).nodes).select("page_id", F.array_join("authored", ",").alias("authored"), F.array_join("inferred", ",").alias("inferred"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of every page for a query, with an answer."""
    return find_on_pages(spark, sf)


__all__ = ["flagship", "oracle_sql", "project_page", "queries"]
