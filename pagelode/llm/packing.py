"""Packing token sequences: shortest-pack-first over the histogram of lengths.

Method. A document's ids and one end id are cut into full pieces and a rest. The histogram of piece lengths (at
most `size` numbers) goes to the driver, where lengths are placed longest first, each onto the pack that is
shortest so far if it fits there; only the counts of packing patterns are kept and split, never single packs.
Pieces get a rank among those of their length and find their sequence and offset in the patterns' slots by rank.

Scale. The driver sees the histogram; the broadcast slots are bounded by the number of patterns. Ranks come from
counts of (length, part) and a row number within each, so a length that a third of all pieces share is numbered
in many tasks. Ids are packed into the pieces only on request.

Defined cases. Null or empty text: the document is the end id alone. Null ids and repeated rows are packed like any
other row. No rows: no pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm import kernels as K
from pagelode.llm.scratch import materialize
from pagelode.llm.tokens import encoder

SIZE = 2048
END_ID = 1
SLICE_BYTES = 4 << 20
PIECE = "id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, size: int, end_id: int, with_ids: bool) -> DataFrame:
    """The pieces of all documents: (id, start, length, ids_crc32, doc_tokens) and, if asked for, ids."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for part in K.slices(batch, "text", SLICE_BYTES):
                got, edge = bpe.encode(part.column("text"))
                rows = part.num_rows
                tokens = np.diff(edge) + 1
                ids = np.insert(got, edge[1:], end_id).astype("<u4")
                edge = edge + np.arange(rows + 1)
                cuts = -(-tokens // size)
                row = np.repeat(np.arange(rows), cuts)
                start = size * (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
                length = np.minimum(size, tokens[row] - start)
                view = memoryview(ids)
                at = edge[:-1][row] + start
                crc = [zlib.crc32(view[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [part.column("id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(tokens[row])]
                names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(K.frugal(each), PIECE + (", ids array<int>" if with_ids else ""))


def pack_histogram(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths, longest first) and how many packs follow each."""
    room: list[tuple[int, tuple[int, ...]]] = []  # a heap: most room first
    packs: dict[tuple[int, ...], int] = {}

    def add(pattern: tuple[int, ...], count: int) -> None:
        if pattern not in packs:
            packs[pattern] = 0
            heapq.heappush(room, (sum(pattern) - size, pattern))
        packs[pattern] += count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not room or -room[0][0] < length:
                each = size // length
                if left >= each:
                    add((length,) * each, left // each)
                if left % each:
                    add((length,) * (left % each), 1)
                left = 0
                break
            _, pattern = room[0]
            taken = min(left, packs[pattern])
            if taken == packs[pattern]:
                heapq.heappop(room)
                del packs[pattern]
            else:
                packs[pattern] -= taken
            add((*pattern, length), taken)
            left -= taken
    return list(packs.items())


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """(length, first rank, first sequence, offset) of each slot, in order of length and rank."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + count
            offset += length
        sequence += count
    return np.array(sorted(out), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, vocabulary, id_col, text_col, size, end_id, with_ids), "pieces")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbered = cut.withColumn("part", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(parts)))
    counts = materialize(numbered.groupBy("length", "part").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(pack_histogram(histogram, size)))
    counts = counts.selectExpr("length", "part", "sum(count) OVER (PARTITION BY length ORDER BY part) - count AS before")
    ranked = numbered.selectExpr("*", "row_number() OVER (PARTITION BY length, part ORDER BY id, start, ids_crc32) - 1 AS within")
    ranked = ranked.join(counts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("within"))
    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        lead = np.searchsorted(rows[:, 0], np.arange(size + 2))
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            slot = np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                slot[mine] = lead[n] + np.searchsorted(rows[lead[n] : lead[n + 1], 1], rank[mine], side="right") - 1
            sequence = rows[slot, 2] + rank - rows[slot, 1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(rows[slot, 3])], names=[*names, "sequence_id", "offset"])

    schema = PIECE + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(K.frugal(place), schema)


def sequences(packed: DataFrame, size: int = SIZE, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids): each sequence's pieces joined by offset and padded; needs pieces with their ids."""
    whole = packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    return whole.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(size) - F.size("ids"))))
