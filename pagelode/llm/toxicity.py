"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Method. Words are lower-cased runs of letters, digits and non-ASCII bytes. Single words, pairs of neighbours and
pairs with one word between are hashed into 2^bits features, each present or absent in a text. The model is fitted
by FTRL-proximal: every coordinate has its own learning rate, and L1 leaves few weights, which are broadcast.

The fit takes a bounded sample of the labelled rows outside the held-out part: at most `max_rows`, those with the
smallest hashes of their ids, and only texts of at most `max_row_chars`. It runs in one task, bounded by these two
numbers. All texts are scored whole, wherever they come from.

Defined cases. Null or empty text: no features, so the score is the intercept's. Null id: scored, not held out, never
fitted on. Several labels for an id: the largest holds. Null labels are no labels. No labelled rows: every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm import kernels as K
from pagelode.llm.scratch import materialize

BITS = 20
MAX_ROWS = 16_000
MAX_ROW_CHARS = 50_000
THRESHOLD = 0.3
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.1
SLICE_BYTES = 2 << 20

#: Everything of ASCII but letters and digits separates words here.
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def held_out(doc_id: Column) -> Column:
    """The part of the ids that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram and skip-gram, repeats included."""
    data, offsets = K.text_buffer(column)
    data = K.LOWER[data]
    starts, ends, before = K.word_spans(data, offsets, _BREAK)
    word = K.hash_spans(data, starts, ends)[0]
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    rows, found = [row], [word]
    for gap, salt in ((1, 0x8EBC6AF09C88C6E3), (2, 0x589965CC75374CC3)):
        if len(word) > gap:
            near = row[gap:] == row[:-gap]
            rows.append(row[:-gap][near])
            found.append(K.mix((word[:-gap] * K.U64(salt) + word[gap:])[near]))
    return np.concatenate(rows), (np.concatenate(found) >> K.U64(64 - bits)).astype(np.int64)


class FTRL:
    """Logistic regression over present features, fitted one example at a time."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias = [0.0, 0.0]  # z and n of the intercept, which L1 leaves alone

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def intercept(self) -> float:
        return -self.bias[0] / ((self.beta + self.bias[1] ** 0.5) / self.alpha)

    def learn(self, present: np.ndarray, label: int) -> None:
        w, b = self.weights(present), self.intercept()
        g = sigmoid(w.sum() + b) - label
        root = np.sqrt(self.n[present])
        self.n[present] += g * g
        self.z[present] += g - (np.sqrt(self.n[present]) - root) / self.alpha * w
        root = self.bias[1] ** 0.5
        self.bias[1] += g * g
        self.bias[0] += g - (self.bias[1] ** 0.5 - root) / self.alpha * b


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, max_row_chars: int) -> DataFrame:
    """(order, label, text): the bounded sample of labelled rows that the model is fitted on."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    # the ids' bound is the broadcast's bound: max_rows rows of three numbers
    chosen = materialize(known.select("id", "label", F.xxhash64("id").alias("order")).orderBy("order", "id").limit(max_rows), "sample")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.where(F.coalesce(F.length("text") <= max_row_chars, F.lit(True)))
    return rows.join(F.broadcast(chosen), "id").select("order", "label", "text")


def fit(rows: DataFrame, bits: int = BITS, epochs: int = EPOCHS, max_rows: int = MAX_ROWS) -> DataFrame:
    """(feature, weight) of the fitted model's weights that are not zero; the intercept has feature -1."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text", SLICE_BYTES):
                row, feature = features(part.column("text"), bits)
                pair = np.unique(row << bits | feature)
                edge = np.searchsorted(pair, np.arange(part.num_rows + 1) << bits)
                one = (pair & ((1 << bits) - 1)).astype("<u4")
                held = [one[a:b].tobytes() for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("order"), part.column("label"), pa.array(held, pa.binary())], names=["order", "label", "present"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, label, present = [], [], []
        for batch in batches:
            order += batch.column("order").to_pylist()
            label += batch.column("label").to_pylist()
            present += batch.column("present").to_pylist()
        turn = sorted(range(len(order)), key=lambda i: (order[i], present[i]))[:max_rows]
        if not turn:
            return
        model = FTRL(1 << bits)
        for _ in range(epochs):
            for i in turn:
                model.learn(np.frombuffer(present[i], "<u4"), label[i])
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], model.intercept()))], names=["feature", "weight"])

    return rows.mapInArrow(K.frugal(extract), "order long, label int, present binary").repartition(1).mapInArrow(K.frugal(learn), "feature long, weight double")


def score(docs: DataFrame, model: DataFrame, text_col: str = "text", bits: int = BITS) -> DataFrame:
    """docs with a score column, by the model's weights (at most 2^bits of them)."""
    spark = docs.sparkSession
    dense, intercept = np.zeros(1 << bits, np.float32), -50.0
    for feature, weight in model.collect():
        if feature < 0:
            intercept = weight
        else:
            dense[feature] = weight
    weights = spark.sparkContext.broadcast(dense)
    docs = docs.select(*[c for c in docs.columns if c != "score"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, text_col, SLICE_BYTES):
                row, feature = features(part.column(text_col), bits)
                used = np.flatnonzero(weights.value[feature])
                pair = np.unique(row[used] << bits | feature[used])
                total = np.bincount(pair >> bits, weights.value[pair & ((1 << bits) - 1)].astype(float), part.num_rows) + intercept
                value = sigmoid(total) if intercept > -50 else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(value)], names=[*part.schema.names, "score"])

    return docs.mapInArrow(K.frugal(each), docs.withColumn("score", F.lit(0.0)).schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted (1 from the threshold on)."""
    model = materialize(fit(sample(docs, labels, id_col, text_col, label_col, MAX_ROWS, MAX_ROW_CHARS)), "weights")
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    scored = score(docs, model, text_col)
    return scored.withColumn("held_out", held_out(F.col(id_col))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
