"""Counting of terms, held against the text columns and against documents counted one by one."""

import pytest
from pyspark.sql import functions as F

from pagelode.functions import literal
from pagelode.functions import text as T
from pagelode.operators import lexical as L

ROWS = [(1, "Running runs HTTPServer getURLFor_x Straße Été rings running"), (2, "The tions ations relational 9ables able"), (3, ""), (4, None), (5, "ﬁne İstanbul ΣΑΣ ½ x₂ the the"), (6, "rings in the running")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def by_columns(docs):
    raw = docs.select(F.col("doc_id").alias("doc"), F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    more = raw.withColumn("stem", T.stem(F.col("term"))).where("stem <> term").select("doc", F.col("stem").alias("term"), "tf")
    return sorted(map(tuple, raw.unionByName(more).groupBy("doc", "term").agg(F.sum("tf")).collect()))


def test_one_pass_counts_what_the_columns_count_without_dealing_documents_out(docs):
    rows = L.term_rows(docs, "doc_id", "text", unique=True)
    assert sorted(map(tuple, rows.collect())) == by_columns(docs)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_frequencies_and_lengths_come_of_one_reading(docs):
    df, stats = L.frequency_rows(docs.repartition(3), "doc_id", "text")
    want = by_columns(docs)
    assert {r["term"]: r["df"] for r in df.collect()} == {t: sum(1 for _, x, _ in want if x == t) for _, t, _ in want}
    sizes = [max(1, sum(n for d, _, n in want if d == doc)) for doc, _ in ROWS]
    assert tuple(stats.first()) == (6, sum(sizes) / 6)
    both = df.crossJoin(F.broadcast(stats))
    both.collect()
    assert both._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Reused") > 0


def test_rows_of_the_same_document_count_together(spark):
    docs = spark.createDataFrame([(1, "rings the"), (1, "rings"), (2, "the")], "doc_id long, text string")
    assert sorted(map(tuple, L.term_rows(docs, "doc_id", "text", stems=False).collect())) == [(1, "rings", 2), (1, "the", 1), (2, "the", 1)]
    df, stats = L.frequency_rows(docs, "doc_id", "text", stems=False)
    assert {r["term"]: r["df"] for r in df.collect()} == {"rings": 1, "the": 2} and tuple(stats.first()) == (3, 7 / 3)
    asked = L.asked_rows(docs, "doc_id", "text", L.query_terms(spark, "rings absent", stems=False), stems=False)
    assert sorted((r["doc"], r["dl"], [tuple(f) for f in r["found"]]) for r in asked.collect()) == [(1, 3, [("rings", 2)]), (2, 1, [])]


def test_many_asked_terms_are_joined(spark, docs, monkeypatch):
    terms = L.query_terms(spark, "running the rings")
    few = sorted(map(str, L.bm25(L.asked_index(docs, "doc_id", "text", terms), terms).collect()))
    monkeypatch.setattr(L, "MOST_TERMS", 1)
    assert sorted(map(str, L.bm25(L.asked_index(docs, "doc_id", "text", terms), terms).collect())) == few


def test_best_of_each_query_without_dealing_pairs_out(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 7)
    monkeypatch.setattr(L, "CELLS", 64)
    docs = spark.createDataFrame([(n, " ".join(f"w{k}" for k in range(1 + n % 5)) + " w0" * (n % 3) + (" rare" if n % 40 == 7 else "")) for n in range(200)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(str(n), f"w{n % 6} rare w{(n * 7) % 5}") for n in range(30)] + [("none", "absent")], "id string, text string")
    terms = L.batch_terms(queries, "id", "text")
    index = L.asked_index(docs, "doc_id", "text", terms)
    shown = lambda hits: sorted((r["query"], r["rank"], r["doc"], r["score"], r["first"]) for r in L.ranked(hits, (), 4).collect())
    found = L.bm25_best(index, terms, 4)
    assert shown(found) == shown(L.bm25(index, terms))
    assert found.count() < L.bm25(index, terms).count() / 2


def test_words_beyond_what_is_remembered_or_cut_at_once(monkeypatch):
    text = " ".join(f"word{n % 7}s Running" for n in range(50))
    whole = literal.word_counts(text)
    monkeypatch.setattr(literal, "PIECE", 11)
    monkeypatch.setattr(literal, "REMEMBERED", 3)
    known = literal.Terms()
    assert literal.word_counts(text) == whole
    assert {w: known[w] for w in whole} == {w: tuple(literal.with_stems(literal.tokens(w))) for w in whole} and len(known) <= 3
