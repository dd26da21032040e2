"""A corpus pipeline: toxicity, exact dedup, SimHash near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame. All but
the last return the columns of documents; the last returns the packed pieces. A stage's decisions take effect: toxic
documents go, of equal texts the one with the largest doc_id stays, of near copies (five words, Jaccard 0.8) one stays
for every one that goes, words of repeated passages are cut from all documents but the first, and the rest is packed.

Defined cases, in every stage: a null or empty text is an empty text, whatever its length a text is read whole; no rows
give no rows. Null doc_ids: scored and packed like others; of equal texts they go before any other; near copies and
passages aren't sought among them, so they stay whole there. Rows that repeat an id and its text are copies, one stays;
rows of one id with other texts are other documents for toxicity, exact copies, passages and packing, and one document of
the union of their shingles for near copies. Ties: the order of doc_ids decides, and among equal rows any one stays. Extra
columns are carried along under reserved names, so names that the operators use (score, kept_text, ...) come back unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelode.llm.exact_dedup import exact_dedup
from pagelode.llm.near_dedup import near_duplicates
from pagelode.llm.packing import pack
from pagelode.llm.queries import TOKENIZERS, read
from pagelode.llm.scratch import drop_table, materialize
from pagelode.llm.substring_dedup import substring_dedup
from pagelode.llm.toxicity import toxicity
from pagelode.session import ship

def _carried(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with every column but doc_id and text under a name that no operator uses, and those names in order."""
    names = [c if c in ("doc_id", "text") else f"carried_{n}_" for n, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't predict as toxic."""
    ship(spark)
    mine, names = _carried(docs)
    return toxicity(mine, read(spark, sf_dir, "labels")).where("predicted = 0").select(*names).toDF(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, equal after lower-casing A-Z."""
    ship(spark)
    mine, names = _carried(docs)
    found = materialize(exact_dedup(mine), "found").select(F.col("id").alias("lost_id"), "kept", F.col("text_sha256").alias("lost_sha256"))
    lost = materialize(found.where("not kept").select("lost_id", "lost_sha256").distinct(), "lost")
    # rows that repeat an id and its text: any one of them
    often = materialize(found.where("kept").select("lost_id", "lost_sha256").intersect(lost), "often")
    same_id = mine["doc_id"].eqNullSafe(F.col("lost_id"))
    ids = lost.select("lost_id").distinct()
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = mine.join(ids, same_id, "left_semi").withColumn("digest_", F.sha2(lowered, 256))
    same = asked["doc_id"].eqNullSafe(F.col("lost_id")) & (asked["digest_"] == F.col("lost_sha256"))
    rows = mine.join(ids, same_id, "left_anti").unionByName(asked.join(lost, same, "left_anti").select(*names))
    if not often.isEmpty():
        rows = rows.unionByName(asked.join(often, same, "left_semi").dropDuplicates(["doc_id", "digest_"]).select(*names))
    return rows.toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    dropped = materialize(near_duplicates(docs), "dropped")
    return docs.join(dropped, docs["doc_id"] == dropped["id"], "left_anti")


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that a smaller doc_id has; untouched texts stay as they are."""
    ship(spark)
    mine, names = _carried(docs)
    found = substring_dedup(mine)
    cut = F.col("n_removed") > 0
    if "n_chars" in docs.columns:
        chars = names[docs.columns.index("n_chars")]
        found = found.withColumn(chars, F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col(chars)))
    return found.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text"))).select(*names).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of training sequences."""
    ship(spark)
    return pack(docs, f"{TOKENIZERS}/byte_bpe_50k.json").withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: The toxicity model, fingerprints of seeded hashes and the tokenizer are beyond SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are written to the shared folder and read again."""
    docs, before = read(spark, sf_dir, "documents"), None
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
            if before is not None:
                drop_table(before)
            before = docs
    return docs
