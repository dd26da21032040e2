"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm import chat
from pagelode.llm.exact_dedup import exact_dedup
from pagelode.llm.packing import pack
from pagelode.llm.quality import COUNTS, MEASURES, quality
from pagelode.llm.scratch import new_path
from pagelode.llm.sentencepiece_bpe import encode_documents
from pagelode.llm.sharding import ShardStore
from pagelode.llm.simhash import simhash_components
from pagelode.llm.substring_dedup import substring_dedup
from pagelode.llm.toxicity import toxicity
from pagelode.llm.url_filter import url_filter

#: Where the public tokenizers' files are; a parameter of every operator that needs one.
TOKENIZERS = "/opt/tokenizers"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    turns = turns.unionByName(spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema))
    return chat.digests(turns, f"{TOKENIZERS}/byte_bpe_50k.json").drop("n_tokens")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ShardStore(spark, new_path(spark, "shards"))
    store.append(read(spark, sf_dir, "documents"))
    version = store.compact()
    store.vacuum()
    return store.read(version).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "shard", "shard_rows", "shard_bytes", F.lit(version).cast("long").alias("version"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json").withColumnRenamed("id", "doc_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), f"{TOKENIZERS}/piece_bpe_32k.model", with_text=False)
    return found.select("doc_id", *COUNTS, *MEASURES, "base_failed", "kept")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model").withColumnRenamed("id", "doc_id")


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k FROM w, unnest(range(1, len(ws) - 11)) AS t(i)),
own AS (SELECT k, min(doc_id) AS o FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM win JOIN own USING (k), unnest(range(0, 13)) AS t(j) WHERE doc_id > o),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP4_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


OP3_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
           UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
-- escaping adds a character for each backslash and for each place where a control string begins
e AS (SELECT *, role || chr(10) || text AS s FROM t),
n AS (SELECT *, length(role) + length(text) + 15 + length(s) - length(replace(s, '\', ''))
        + coalesce(list_sum(list_transform(regexp_extract_all(s, '#{3,}'), lambda x: length(x) - 2)), 0)
        + len(regexp_extract_all(s, '</turn>|<turn>|<[|]endoftext[|]>')) AS shown FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""

#: The given pages name no canonical links or refreshes, so no class decides there; aliases have tests of their own.
OP7_SQL = r"""
WITH u AS (SELECT page_id, url, html, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
p AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS r(verdict, rhost, rpath)),
fit AS (SELECT p.page_id, url, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict
        FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY p.page_id, url)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict
FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND p.url = fit.url
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_chat": op3_chat,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_sharding": op5_sharding,
        "op6_packing": op6_packing,
        "op7_url_filter": op7_url_filter,
        "op8_quality": op8_quality,
        "op9_simhash": op9_simhash,
        "op10_sentencepiece": op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op3_chat": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op7_url_filter": OP7_SQL}
