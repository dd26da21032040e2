"""The ten operators against brute force, exact round trips or held-out accuracy, and their odd inputs."""

import hashlib
import re
import struct
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pagelode.llm import chat, kernels, near_dedup, packing, queries, simhash, substring_dedup, tokens
from pagelode.llm import exact_dedup as ED
from pagelode.llm import sentencepiece_bpe as SP
from pagelode.llm import toxicity as TOX
from pagelode.llm import url_filter as URL
from pagelode.llm.components import connected_components
from pagelode.llm.quality import measure, quality
from pagelode.llm.sharding import ConflictError, ShardStore
from tests.oracle import same_rows, tables

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BPE = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
PIECES = f"{queries.TOKENIZERS}/piece_bpe_32k.model"
LONG = " ".join(f"w{n % 977}x{n % 13}" for n in range(60_000))
PASSAGE = " ".join(f"common{n}" for n in range(60))
#: Nulls, empty and very long texts, ties, repeated rows and ids, and columns with clashing names.
ODD = [
    (1, "Alpha beta " + PASSAGE, "en", "s", 7), (2, "gamma " + PASSAGE + " delta", None, "s", 7), (3, None, "en", None, None), (4, "", "en", "s", 7),
    (None, PASSAGE, "en", "s", 7), (5, LONG, "en", "s", 7), (6, LONG.upper(), "en", "s", 7), (7, "dup row", "en", "s", 7), (7, "dup row", "en", "s", 7), (7, "Dup Row", "en", "s", 7),
    (8, " \t\n ", "en", "s", 7), (9, PASSAGE + " " + PASSAGE, "en", "s", 7), (10, "a▁b 中文 \U0001f600 it's ###", "zh", "s", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, kept long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    same_rows(queries.queries()[name](spark, sf), tables(sf), queries.oracle_sql()[name])


# --- 1 ------------------------------------------------------------------------------------------------------------


def brute_substring(rows, width):
    words = [(r.doc_id, WORD.findall(r.text or "")) for r in rows]
    own = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            if i is not None:
                own[tuple(w[k : k + width])] = min(i, own.get(tuple(w[k : k + width]), i))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and own[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((str(i), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("sketch_bytes", [1 << 16, 128 << 20])
def test_substring_dedup_equals_brute_force_whatever_the_sketch(odd, sketch_bytes):
    found = substring_dedup.substring_dedup(odd.withColumn("n_words", F.lit("clash")), block_bytes=1 << 10, sketch_bytes=sketch_bytes).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in found) == brute_substring(odd.collect(), 13)


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_joining_the_words_of_a_block_holds_few_numbers_for_each_byte():
    texts = [" ".join(f"w{n * k % 9973}" for n in range(3000)) for k in range(1, 251)]
    data, offsets = kernels.text_buffer(pa.array(texts))
    starts, ends, before = kernels.word_spans(data, offsets)
    tracemalloc.start()
    out, at = kernels.joined(data, starts, ends, before)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kernels.string_array(out, at).to_pylist() == texts and most < 16 * len(data)


# --- 2 ------------------------------------------------------------------------------------------------------------


def test_toxicity_finds_held_out_labels(spark):
    rows, marks = [], []
    for n in range(900):
        toxic = n % 7 == 0
        rows.append((n, " ".join(f"w{(n * k) % 113}" for k in range(1, 40)) + (" you moron" if toxic else " you friend")))
        marks.append((n, int(toxic)))
    found = TOX.toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {n for n in range(900) if zlib.crc32(str(n).encode()) % 4 == 2}
    assert np.mean([r.predicted == (r.doc_id % 7 == 0) for r in held]) > 0.97


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    found = TOX.toxicity(odd.withColumn("score", F.lit("clash")), labels).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    assert TOX.toxicity(empty, labels.limit(0)).count() == 0
    assert {r.score for r in TOX.toxicity(odd, labels.limit(0)).collect()} == {0.0}


# --- 3 ------------------------------------------------------------------------------------------------------------


def test_escape_undoes_itself_and_leaves_no_control_string():
    rng = np.random.default_rng(1)
    pieces = ["\\", "#", "##", "###", " ", "</turn>", "<", "/turn>", "<turn>", "a", "\n", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(0, 14)))
        assert chat.unescape(chat.escape(text)) == text and not chat._CONTROL.search(chat.escape(text))


def test_chat_reads_back_what_went_in(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 1, "assistant", None), (2, None, None, "x"), (2, 5, "assistant", "é😀\n"), (None, 0, "user", ""), (3, 0, "system", "a"), (3, 0, "system", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    found = {r.conv_id: r for r in chat.digests(turns, BPE).collect()}
    assert {k: v.n_turns for k, v in found.items()} == {1: 3, 2: 2, None: 1, 3: 2}
    assert found[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and found[1].loss_chars == len(said)
    assert found[2].turns_sha256 == hashlib.sha256("\nx\nassistant\né😀\n\n".encode()).hexdigest()
    parts = chat.assemble(turns.where("conv_id = 1"), BPE).orderBy("place").collect()
    assert [p.token_start for p in parts] == [0, *np.cumsum([len(p.ids) for p in parts])[:-1].tolist()]
    assert chat.digests(turns.limit(0), BPE).count() == 0


# --- 4 ------------------------------------------------------------------------------------------------------------


def test_chunk_hashes_combine_in_any_grouping():
    data = np.frombuffer(LONG.encode(), np.uint8)
    offsets = np.array([0, 0, 5, len(data)])
    for a, b in zip(ED.fingerprints(data, offsets, 7), ED.fingerprints(data, offsets, 1 << 16), strict=True):
        assert a.tolist() == b.tolist()


def test_chunk_hashes_are_the_polynomial():
    data = np.frombuffer(LONG.encode()[:1000], np.uint8)
    for base, found in zip(ED.BASES, ED.fingerprints(data, np.array([0, 0, 1000]), 64), strict=True):
        assert found.tolist() == [0, sum((int(b) + 1) * pow(base, k, ED.PRIME) for k, b in enumerate(data)) % ED.PRIME]


def test_huge_texts_have_the_fingerprints_of_small_ones(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "Abc " * 900), (2, "abc " * 900), (3, "abc " * 901), (4, "x"), (5, None)], "doc_id long, text string")
    want = sorted((r.id, r.h1, r.h2, r.n) for r in ED.fingerprint_rows(rows, "doc_id", "text").collect())
    monkeypatch.setattr(ED, "HUGE_BYTES", 1000)
    monkeypatch.setattr(ED, "SLICE_BYTES", 100)
    monkeypatch.setattr(ED, "PIECE_BYTES", 700)
    assert sorted((r.id, r.h1, r.h2, r.n) for r in ED.fingerprint_rows(rows, "doc_id", "text").collect()) == want
    assert sorted((r.id, r.keep_id, r.group_size) for r in ED.exact_dedup(rows).collect()) == [(1, 2, 2), (2, 2, 2), (3, 3, 1), (4, 4, 1), (5, 5, 1)]


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(LOWER)].append(r.doc_id)
    return sorted((str(i), str(max((x for x in v if x is not None), default=None)), len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for i in v)


def test_exact_dedup_equals_brute_force(odd, empty):
    found = ED.exact_dedup(odd).collect()
    assert sorted((str(r.id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == brute_exact(odd.collect())
    kept = Counter(r.text_sha256 for r in found if r.kept)
    assert set(kept.values()) == {1} and set(kept) == {r.text_sha256 for r in found} and all(r.id == r.keep_id for r in found if r.kept)
    assert ED.exact_dedup(empty).count() == 0


def test_equal_fingerprints_of_other_texts_are_told_apart(monkeypatch, spark, docs):
    some = docs.limit(60).unionByName(docs.limit(30))
    one = {"h1": F.lit(1).cast("long"), "h2": F.lit(1).cast("long"), "n": F.lit(1).cast("long")}
    monkeypatch.setattr(ED, "fingerprint_rows", lambda d, i, t: ORIGINAL(d, i, t).withColumns(one))
    monkeypatch.setattr(ED, "collided", lambda *a: spark.createDataFrame([(1, 1, 1)], "h1 long, h2 long, n long"))
    assert sorted((str(r.id), str(r.keep_id), r.group_size, r.text_sha256) for r in ED.exact_dedup(some).collect()) == brute_exact(some.collect())


ORIGINAL = ED.fingerprint_rows


def test_collided_finds_texts_that_share_a_fingerprint(spark, docs):
    groups = ORIGINAL(docs, "doc_id", "text").groupBy("h1", "h2", "n").agg(F.count("*").alias("size")).where("size > 1")
    assert ED.collided(docs, "doc_id", "text", groups, docs.count()).count() == 0
    assert ED.equal_in_chunks(b"abc", b"abc", 2) and not ED.equal_in_chunks(b"abc", b"abd", 2)


# --- 5 ------------------------------------------------------------------------------------------------------------


def test_shards_keep_all_rows_and_reach_their_size(spark, docs, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target=60_000)
    assert store.append(docs.where("doc_id % 2 = 0"), 10) == 1 and store.append(docs.where("doc_id % 2 = 1"), 7) == 2
    before = store.manifest().count()
    version = store.compact()
    shards = store.manifest().collect()
    assert version > 2 and len(shards) < before / 2 and sum(r.rows for r in shards) == docs.count()
    columns = docs.columns
    assert store.read().select(*columns).exceptAll(docs).count() == 0 and docs.exceptAll(store.read().select(*columns)).count() == 0
    plan = store.plan(store.manifest()).where("run is not null")
    assert plan.count() == 0
    assert store.read(1).count() + docs.where("doc_id % 2 = 1").count() == docs.count()  # versions stay readable
    with pytest.raises(ConflictError):
        store._commit(store.manifest(), version - 1, "{}")
    store.vacuum()
    assert store.versions() == [version] and store.read().count() == docs.count()


def test_of_two_writers_one_wins_and_the_other_leaves_nothing(spark, docs, tmp_path):
    one, two = (ShardStore(spark, f"file://{tmp_path}/w") for _ in range(2))
    two.version = lambda: 0  # both saw the empty store
    assert one.append(docs) == 1
    files = {str(p) for p in tmp_path.rglob("*.parquet")}
    with pytest.raises(ConflictError):
        two.append(docs.limit(3))
    assert {str(p) for p in tmp_path.rglob("*.parquet")} == files and one.read().count() == docs.count()


def test_a_store_without_rows_reads_as_an_empty_table(spark, empty, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/e")
    with pytest.raises(ValueError, match="appended"):
        store.read()
    store.append(empty)
    assert store.compact() == 1 and store.read().columns == ["shard", *empty.columns, "shard_rows", "shard_bytes"] and store.read().count() == 0
    with pytest.raises(ValueError, match="reserved"):
        store.append(empty.withColumn("shard_rows", F.lit(1)))


def test_the_plan_equals_a_plain_tiering(spark, tmp_path):
    rng = np.random.default_rng(3)
    shards = [(f"p{n:03d}", 1, int(b)) for n, b in enumerate(rng.integers(1, 9000, 200))]
    store = ShardStore(spark, f"file://{tmp_path}/p", target=8000)
    want = {}
    for tier in range(20):
        mine, before = sorted((b, p) for p, _, b in shards if b < 6000 and 4**tier <= b < 4 ** (tier + 1)), 0
        runs = defaultdict(list)
        for b, p in mine:
            runs[before // 8000].append(p)
            before += b
        want |= {p: f"{tier}-{run}" for run, ps in runs.items() if len(ps) > 1 for p in ps}
    found = store.plan(spark.createDataFrame(shards, "path string, rows long, bytes long")).collect()
    assert {r.path: r.run for r in found if r.run} == want and len(found) == 200


def test_shards_of_odd_rows(spark, odd, empty, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/o", target=1 << 12)
    store.append(empty)
    store.append(odd, 2)
    store.compact()
    assert store.read().count() == len(ODD)


# --- 6 ------------------------------------------------------------------------------------------------------------


def check_packing(rows, found, size):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    want = Counter()
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), size):
            piece = ids[at : at + size]
            want[(r.doc_id, at, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)), len(ids))] += 1
    assert Counter((r.id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == want
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return sum(k[2] * n for k, n in want.items()) / (size * len(by))


def test_packing_places_every_id_once(docs, odd, empty):
    assert check_packing(docs.collect(), packing.pack(docs, BPE).collect(), 2048) > 0.97
    check_packing(odd.collect(), packing.pack(odd, BPE, size=64).collect(), 64)
    assert packing.pack(empty, BPE).count() == 0
    whole = packing.sequences(packing.pack(odd, BPE, size=64, with_ids=True), 64).collect()
    assert {len(r.ids) for r in whole} == {64}


def test_patterns_hold_the_histogram():
    rng = np.random.default_rng(3)
    histogram = dict(Counter(rng.integers(1, 101, 5000).tolist()))
    patterns = packing.pack_histogram(histogram, 100)
    held = Counter()
    for pattern, count in patterns:
        assert sum(pattern) <= 100
        for length in pattern:
            held[length] += count
    assert held == histogram and sum(k * v for k, v in held.items()) / (100 * sum(c for _, c in patterns)) > 0.97


def test_byte_bpe_equals_the_library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    rng = np.random.default_rng(4)
    pieces = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "é", "1", "½", "!", "中", "a", "B", "'ve", "😀", "<|endoftext|>", "̀", " "]
    texts = ["".join(rng.choice(pieces, rng.integers(0, 30))) for _ in range(3000)]
    ids, edge = tokens.encoder(BPE).encode(pa.array(texts))
    for n, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[edge[n] : edge[n + 1]].tolist() == e.ids


# --- 7 ------------------------------------------------------------------------------------------------------------


def test_url_verdicts_follow_rules_and_aliases(spark):
    rows = [
        (1, "http://a.example.com/en/x", '<link rel="canonical" href="http://b.org/p">'), (2, "http://b.org/p#f", ""), (3, "https://c.org/z", "<LINK href='//www.example.com/en/q' rel=canonical>"),
        (4, None, None), (5, "no url", ""), (6, "HTTP://X.ORG/k?x=1", '<meta http-equiv="refresh" content="0; url=/m">'), (7, "http://x.org/m", "<link rel=canonical href=http://b.org/p>"), (8, "http://NET/fr/1?q", ""),
        (9, "http://d.org/a", '<link rel=canonical href="http://e.net/es/1">'), (10, "http://d.org/a", '<link rel=canonical href="http://www.example.com/en/1">'), (2, "http://b.org/p#f", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    found = sorted({(r.page_id, r.host, r.path, r.rule, r.verdict) for r in URL.url_filter(pages).collect()})
    assert found == [
        (1, "a.example.com", "/en/x", "example.com/en/", "block"), (2, "b.org", "/p", None, "block"), (3, "c.org", "/z", None, "allow"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
        (6, "x.org", "/k", None, "block"), (7, "x.org", "/m", None, "block"), (8, "net", "/fr/1", "net/fr/", "block"), (9, "d.org", "/a", None, "allow"), (10, "d.org", "/a", None, "allow"),
    ]
    redirects = spark.createDataFrame([("http://q.org/1", "http://t.net/es/")], "a string, b string")
    q = spark.createDataFrame([(1, "http://q.org/1", None)], "page_id long, url string, html string")
    assert URL.url_filter(q, redirects=redirects).first().verdict == "block"
    assert URL.url_filter(pages.limit(0)).count() == 0


def test_all_links_of_a_page_make_aliases(spark):
    from pagelode.llm.url_filter import alias_edges

    heads = {
        1: '<link rel=canonical href="https://a.net/x"><link rel="canonical" href=/y>', 2: """<meta http-equiv="refresh" content="0; url='https://a.net/fr/x'">""",
        3: "<meta http-equiv=refresh content=0;url=https://a.net/z>", 4: '<meta http-equiv="refresh" content="5"><p>canonical', 5: None,
    }
    rows = spark.createDataFrame([(n, f"https://p.org/{n}", h) for n, h in heads.items()], "page_id long, url string, html string")
    assert sorted((r.a, r.b) for r in alias_edges(rows).collect()) == [
        ("https://p.org/1", "https://a.net/x"), ("https://p.org/1", "https://p.org/y"), ("https://p.org/2", "https://a.net/fr/x"), ("https://p.org/3", "https://a.net/z"),
    ]


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(5)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + n, 1001 + n) for n in range(60)] + [(None, 1), (5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    found = connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {x: root(x) for x in parent} and len(found) == len(parent)


# --- 8 ------------------------------------------------------------------------------------------------------------


def test_quality_counts_equal_brute_force(docs, odd):
    texts = [r.text for r in docs.collect()] + [r.text for r in odd.collect() if r.text != LONG]
    found = measure(pa.array(texts, pa.string()), PIECES)
    for n, text in enumerate(texts):
        text = text or ""
        w = WORD.findall(text)
        seen, dup, windows, covered = set(), 0, Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set()
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        for k in range(len(w) - 4):
            if windows[tuple(w[k : k + 5])] > 1:
                covered.update(range(k, k + 5))
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
        assert tuple(found[k][n] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_quality_rejects_what_no_language_looks_like(spark, odd, empty):
    prose = "The committee met on Tuesday and agreed that the new bridge would be built before the winter, although several members had doubts about its cost and its place in the plan for the whole valley and the towns around it."
    rows = [(1, prose, "en"), (2, prose, None), (3, " ".join("%02x" % (n * 37 % 256) * 9 for n in range(60)), "en"), (4, " ".join(chr(0x13000 + n % 900) * 3 for n in range(80)), "en"), (5, prose, "xx")]
    found = {r.doc_id: (r.base_failed, r.kept) for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES).collect()}
    assert found[1] == found[2] == found[5] == (False, True) and not found[4][1]
    assert quality(odd, PIECES).count() == len(ODD) and quality(empty, PIECES).count() == 0


def test_quality_bands_of_the_corpus_reject_junk_and_keep_clean_text(spark):
    rng = np.random.default_rng(12)
    common = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through".split()
    rows = []
    for n in range(1500):
        words = rng.choice(common, int(rng.integers(20, 400))).tolist()
        junk = 1 if n % 20 == 0 else 2 if n % 20 == 10 else 0
        if junk:
            words = [w + "#*$%&"[int(k)] * 3 for w, k in zip(words, rng.integers(0, 5, len(words)), strict=True)] if junk == 1 else " | ".join(words).split(" ")
        rows.append((n, " ".join(words), "en" if n % 3 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality(docs.repartition(5), PIECES).collect()
    junk, clean = [r for r in found if r.doc_id % 10 == 0], [r for r in found if r.doc_id % 10]
    assert not any(r.base_failed for r in found)
    assert np.mean([not r.kept for r in junk]) > 0.8 and np.mean([r.kept for r in clean]) > 0.95
    again = quality(docs.coalesce(1), PIECES, with_text=False)
    assert "text" not in again.columns and {(r.doc_id, r.kept) for r in again.collect()} == {(r.doc_id, r.kept) for r in found}


# --- 9 ------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_equal_brute_force(spark, docs, odd, empty):
    both = docs.select("doc_id", "text").unionByName(odd.select(F.col("doc_id") + 100_000, "text").toDF("doc_id", "text"))
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in both.collect()]
    fps = np.array([f for _, f in rows], np.uint64)
    label = np.arange(len(rows))
    for i in range(len(rows)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)
        label[np.isin(label, label[near])] = label[near].min()
    low = {}
    for (i, _), c in zip(rows, label, strict=True):
        low[c] = min((x for x in (low.get(c), i) if x is not None), default=None)
    want = sorted((str(i), f, str(low[c])) for (i, f), c in zip(rows, label, strict=True))
    assert sorted((str(r.id), r.fp % (1 << 64), str(r.component_id)) for r in simhash.simhash_components(both).collect()) == want
    assert simhash.simhash_components(empty).count() == 0


def test_documents_without_words_may_fill_a_partition(spark):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate([None, "", " ", "\n\t"])], "doc_id long, text string").repartition(4)
    found = simhash.simhash_components(rows).collect()
    assert sorted((r.id, r.fp, r.component_id) for r in found) == [(n, 0, 0) for n in range(4)]
    assert {r.id for r in near_dedup.near_duplicates(rows).collect()} == {1, 2, 3}


def test_bk_trees_find_every_link():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for _ in range(20)]]))
    tree = simhash.BKTree(fps)
    want = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(tree.fps ^ tree.fps[i]) <= 4)
        want[np.isin(want, want[near])] = want[near].min()
    assert tree.linked(4).tolist() == want.tolist() and sorted(tree.fps.tolist()) == fps.tolist()


def test_near_copies_go_and_other_texts_stay(spark, odd, empty):
    rng = np.random.default_rng(7)
    rows = []
    for n in range(40):
        words = [f"t{x}" for x in rng.integers(0, 5000, 300)]
        rows.append((n, " ".join(words)))
        words[150] = "changed"
        rows.append((1000 + n, " ".join(words)))
    dropped = {r.id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert dropped == {1000 + n for n in range(40)}
    assert {r.id for r in near_dedup.near_duplicates(odd).collect()} == {2, 4, 6, 8, 9}
    assert near_dedup.near_duplicates(empty).count() == 0


def brute_near(sets):
    """All similar pairs, and what goes in order of id."""
    pairs = {(a, b) for a in sets for b in sets if a > b and near_dedup.similar(sets[a], sets[b], 0.8)}
    return pairs


def check_near(found, sets):
    pairs = brute_near(sets)
    kept = set(sets) - found
    assert not [p for p in pairs if p[0] in kept and p[1] in kept]
    assert all(any((max(i, k), min(i, k)) in pairs for k in kept) for i in found)
    return pairs


def test_near_copies_at_every_similarity_are_found(spark):
    rng = np.random.default_rng(13)
    rows, line = [], "this line is common to every one of these documents and says nothing"
    for n in range(60):
        words = [f"t{x}" for x in rng.integers(0, 50_000, 300)]
        rows.append((n, " ".join(words) + " " + line))
        for k in rng.choice(300, 4 + n % 6, replace=False):
            words[k] = "changed"
        rows.append((1000 + n, " ".join(words) + " " + line))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = dict(zip([i for i, _ in rows], near_dedup.shingle_sets(pa.array([t for _, t in rows]), 5), strict=True))
    pairs = check_near({r.id for r in near_dedup.near_duplicates(docs).collect()}, sets)
    both = [len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) for a, b in pairs]
    assert len(both) > 20 and min(both) < 0.83 and max(both) > 0.85


def test_a_chain_is_decided_alike_on_any_number_of_partitions(spark):
    rng = np.random.default_rng(14)
    words, rows = [f"t{x}" for x in rng.integers(0, 50_000, 200)], []
    for n, i in enumerate(rng.permutation(120).tolist()):  # each is similar to its neighbours only
        words[(n * 37) % 200] = f"new{n}"
        words[(n * 53) % 200] = f"more{n}"
        rows.append((i, " ".join(words)))
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for partitions in (2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        try:
            found.append({r.id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)).collect()})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
    check_near(found[0], dict(zip([i for i, _ in rows], near_dedup.shingle_sets(pa.array([t for _, t in rows]), 5), strict=True)))


def test_hashes_that_many_sets_share_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(15)
    passage = [f"p{x}" for x in range(150)]
    rows = []
    for n in range(90):  # two thirds of every text are one passage; each third text has a near copy
        own = [f"t{x}" for x in rng.integers(0, 50_000, 80)]
        rows.append((n, " ".join([*passage, *own])))
        if n % 3 == 0:
            own[40:44] = ["a", "b", "c", "d"]
            rows.append((1000 + n, " ".join([*own, *passage])))
    monkeypatch.setattr(near_dedup, "MOST_SHARED", 5)
    found = {r.id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    pairs = check_near(found, dict(zip([i for i, _ in rows], near_dedup.shingle_sets(pa.array([t for _, t in rows]), 5), strict=True)))
    assert len(pairs) == len(found) == 30


def test_a_group_of_near_copies_doesnt_meet_pair_by_pair(spark, monkeypatch):
    rng = np.random.default_rng(21)
    template = [f"t{n}" for n in range(300)]
    written, met = near_dedup.materialize, []

    def counted(df, label, *most):
        out = written(df, label, *most)
        if label == "meetings":
            met[-1] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    for size in (60, 240):
        texts = []
        for n in range(size):
            words = list(template)
            for k, at in enumerate(rng.choice(300, 3 + n % 5, replace=False)):
                words[at] = f"e{n}x{k}"
            texts.append(" ".join(words))
        met.append(0)
        found = {r.id for r in near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), id_col="id").collect()}
        assert check_near(found, dict(enumerate(near_dedup.shingle_sets(pa.array(texts), near_dedup.SHINGLE))))
    assert met[1] <= 8 * met[0] + 1000


def test_signatures_side_by_side_differ_as_alone():
    rng = np.random.default_rng(22)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (5, 30, 40, 100, 140, 700)]
    held = np.array([near_dedup.signature(x) for x in sets] + [None], object)
    i, j = np.triu_indices(len(sets), 1)
    assert near_dedup.Signatures(held).apart(i, j).tolist() == [near_dedup.cells_apart(held[x], held[y]) for x, y in zip(i, j, strict=True)]
    assert near_dedup.Signatures(held).apart(np.array([6, 2]), np.array([1, 6])).tolist() == [0, 0]


def test_signatures_bound_the_difference_of_sets():
    rng = np.random.default_rng(16)
    for n in (1, 3, 64, 65, 700, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: n // 2 + 1], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)]))
        apart = near_dedup.cells_apart(near_dedup.signature(a), near_dedup.signature(b))
        assert apart <= len(np.setxor1d(a, b)) and near_dedup.cells_apart(near_dedup.signature(a), near_dedup.signature(a)) == 0


# --- 10 -----------------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library_and_decode_whatever_is_dropped(docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    v = SP.vocabulary(PIECES)
    rng = np.random.default_rng(8)
    parts = ["the ", "in", "g", " ", "  ", "\n", "\t", "é", "1", "½", "!", "中", "ation", "😀", "<s>", "<0x41>", "̀"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 60))) for _ in range(400)] + ["", None, " ", "a" * 300] + [r.text for r in docs.limit(40).collect()]
    ids, edge = SP.encode(v, pa.array(texts), np.arange(len(texts)), 0.0, 1, 8)
    assert [ids[edge[n] : edge[n + 1]].tolist() for n in range(len(texts))] == library.encode([t or "" for t in texts])
    texts.append("mark ▁ stays▁")
    seen = set()
    for rate, seed in ((0.1, 1), (0.1, 2), (0.9, 1), (1.0, 1)):
        ids, edge = SP.encode(v, pa.array(texts), np.arange(len(texts)), rate, seed, 8)
        again, _ = SP.encode(v, pa.array(texts), np.arange(len(texts)), rate, seed, 8)
        data, offsets = SP.decode(v, ids, edge)
        assert [data[offsets[n] : offsets[n + 1]].tobytes().decode() for n in range(len(texts))] == [t or "" for t in texts]
        assert again.tolist() == ids.tolist()
        seen.add(tuple(ids.tolist()))
    assert len(seen) == 4


def test_long_spans_follow_the_same_agenda(monkeypatch):
    v = SP.vocabulary(PIECES)
    texts = pa.array(["internationalization " * 5, "x" * 200])
    want = SP.encode(v, texts, np.arange(2), 0.3, 1, 8)[0].tolist()
    monkeypatch.setattr(SP, "LONG_SPAN", 3)
    assert SP.encode(v, texts, np.arange(2), 0.3, 1, 8)[0].tolist() == want


def test_encoding_of_odd_rows_doesnt_depend_on_partitions(odd, empty):
    one = {(str(r.id), r.ids_crc32, r.lossless) for r in SP.encode_documents(odd, PIECES).collect()}
    two = {(str(r.id), r.ids_crc32, r.lossless) for r in SP.encode_documents(odd.coalesce(1), PIECES).collect()}
    assert one == two and all(x[2] for x in one) and SP.encode_documents(empty, PIECES).count() == 0
    back = SP.decode_documents(SP.encode_documents(odd, PIECES, with_ids=True), PIECES).collect()
    assert Counter(r.text for r in back) == Counter(r.text or "" for r in odd.collect())


def test_every_occurrence_of_a_word_is_drawn_anew(spark):
    v = SP.vocabulary(PIECES)
    texts, docs = pa.array(["internationalization the"] * 4000), np.arange(4000)
    ids, edge = SP.encode(v, texts, docs, 0.3, 1, SP.VARIANTS)
    found = [tuple(ids[edge[n] : edge[n + 1]].tolist()) for n in range(4000)]
    assert len(set(found)) > 64
    plain = tuple(SP.encode(v, texts.slice(0, 1), docs[:1], 0.0, 1, SP.VARIANTS)[0].tolist())
    assert 0 < found.count(plain) < 4000
    # a result that is shared equals one of its own
    key = SP.K.mix(SP.K.mix(docs.view(np.uint64)) + SP.K.U64(0))
    data = np.frombuffer(b" internationalization" * 4000, np.uint8)
    starts = np.arange(4000) * 21
    apart, at = SP._merged(v, data, starts, starts + 21, SP.K.mix(key + SP.K.U64(1)), 0.3)
    assert [f[: at[n + 1] - at[n]] for n, f in enumerate(found)] == [tuple(apart[at[n] : at[n + 1]].tolist()) for n in range(4000)]
    one = spark.createDataFrame([(n, "the") for n in range(4000)], "doc_id long, text string")
    assert len({r.ids_crc32 for r in SP.encode_documents(one, PIECES).collect()}) > 1


# --- kernels ------------------------------------------------------------------------------------------------------


def test_words_and_hashes_of_spans():
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("ab é\n\t "), rng.integers(0, 30))) for _ in range(300)] + ["", None, "x" * 2000 + " y"]
    data, offsets = kernels.text_buffer(pa.array(texts))
    starts, ends, before = kernels.word_spans(data, offsets)
    words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert [words[before[n] : before[n + 1]] for n in range(len(texts))] == [WORD.findall(t or "") for t in texts]
    hashes = kernels.hash_spans(data, starts, ends)[0].tolist()
    assert len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes))
    assert simhash.xxh64_spans(data, starts, ends, 42).tolist() == [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words]


def test_links_found_in_two_phases_span_the_same_sets(spark, monkeypatch):
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 62, 60, dtype=np.uint64)
    flips = [base ^ np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 63, len(base)).astype(np.uint64) for _ in range(k)]) for k in (2, 4, 6, 9, 12)]
    fps = np.unique(np.concatenate([base, *flips]))
    want = np.arange(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4)
        want[np.isin(want, want[near])] = want[near].min()
    nodes = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    monkeypatch.setattr(simhash, "FEW_CHOICES", 1)
    monkeypatch.setattr(simhash, "blocks_for", lambda count, radius: 6)
    found = {r.node: r.component for r in connected_components(simhash.linked_fingerprints(nodes, 4)).collect()}
    sets = defaultdict(set)
    for f, label in zip(fps.view(np.int64).tolist(), want.tolist(), strict=True):
        sets[label].add(found.get(f, f))
    assert all(len(v) == 1 for v in sets.values()) and len({next(iter(v)) for v in sets.values()}) == len(sets)
