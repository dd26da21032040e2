"""The pipeline stage by stage against brute force on a small corpus."""

import numpy as np
import pytest

import corpus_pipeline as P

WORDS = [f"word{n}" for n in range(3000)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    text = lambda n: " ".join(rng.choice(WORDS, n))
    passage = text(70)
    rows = [(n, text(120)) for n in range(120)]
    rows += [(200 + n, rows[n][1].upper()) for n in range(5)]  # exact copies but for case
    rows += [(300 + n, " ".join([*rows[10 + n][1].split()[:-1], "edited"])) for n in range(5)]  # near copies
    rows += [(400 + n, f"{text(60)} {passage} {text(60)}") for n in range(4)]  # a passage in common
    rows += [(500 + n, f"{text(80)} you idiot {text(10)}") for n in range(60)]
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i >= 500)) for i, _ in rows], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return f"{folder}"


def test_stages_take_effect(spark, corpus):
    docs = P.read(spark, corpus, "documents")
    columns = docs.columns
    kept = P.drop_toxic(spark, docs, corpus)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == columns and len(ids & set(range(500, 560))) <= 3 and ids >= set(range(120))
    kept = P.drop_exact_copies(spark, docs.where("doc_id < 500").unionByName(docs.where("doc_id = 7")), corpus)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*range(5, 120), *range(200, 205), *range(300, 305), *range(400, 404)})
    near = P.drop_near_copies(spark, kept, corpus)
    assert {r.doc_id for r in kept.collect()} - {r.doc_id for r in near.collect()} == set(range(300, 305)) and near.columns == columns
    cut = P.cut_repeated_passages(spark, near, corpus)
    assert cut.columns == columns
    lengths = {r.doc_id: len(r.text.split()) for r in cut.collect()}
    assert lengths[400] == 190 and {lengths[n] for n in (401, 402, 403)} == {120} and lengths[50] == 120
    packed = P.pack_sequences(spark, cut, corpus)
    assert {r.doc_id for r in packed.collect()} == set(lengths)


def test_the_run_equals_its_stages(spark, corpus):
    docs = P.read(spark, corpus, "documents")
    for _, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, corpus), "test")
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(tuple(r[k] for k in key) for r in P.run(spark, corpus).collect()) == sorted(tuple(r[k] for k in key) for r in docs.collect())
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact dedup", "SimHash near-dedup", "substring dedup", "packing"] and P.ORACLE_SQL is None


def test_an_empty_corpus_passes_all_stages(spark, corpus):
    docs = P.read(spark, corpus, "documents").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, corpus)
    assert docs.count() == 0
