"""Substring deduplication: words of windows that an earlier document also holds are removed.

Method. The documents are packed into blocks of a few MB, written once to the shared folder, so that every later
pass sees the same blocks. Pass one builds a count-min sketch of all windows: each task emits its partition's
sketch as sparse cell lists, these are merged cell range by cell range (counts saturate at two), and the driver
gets one bit for each cell: "counted twice or more". The sketch overestimates, so a window whose bits are not all
set is certainly unique. Pass two takes only the windows estimated repeated, pre-aggregates them within each block
(distinct key, smallest document), deals them to buckets by key and finds the smallest document of each key over
all blocks. A bucket answers each block with one bit for each key. The last pass reads the blocks again, removes
the words covered by windows that a smaller document starts, and returns the rows.

Keys have 96 bits, which suffices for 10^13 repeated windows; the sketch only decides which windows are keyed.

Scale. The shuffles carry cell lists (about a byte for each window and sketch row), 14 bytes for each distinct
candidate of a block, one bit back, and the compressed blocks once. A window that a third of all documents share
appears once for each block, never once for each document. The broadcast is the sketch: two bits for each window
or more, at most `sketch_bytes`; beyond that bound estimates get coarser, more windows are keyed and none is lost.

Defined cases. Null or empty text: no words, nothing removed, kept text empty. Null id: the row has no place in
the order, so it neither owns windows nor loses words. Equal ids: neither row is smaller, both are judged by the
other ids alone. Input columns named like an output column are replaced; others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelode.llm import kernels as K
from pagelode.llm.scratch import materialize

WINDOW = 13
BLOCK_BYTES = 4 << 20
SKETCH_BYTES = 128 << 20
#: Bytes of text in a batch of the result.
OUT_BYTES = 1 << 20
KEYS_PER_BUCKET = 1 << 20
OUTPUTS = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_text": T.StringType()}

_BASE = 0x9E3779B97F4A7C15
_BASE2 = 0xC2B2AE3D27D4EB4F
_REGION_BITS = 20
_FLUSH = 4 << 20


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    sketch_bytes: int = SKETCH_BYTES,
) -> DataFrame:
    """docs with n_words, n_removed and kept_text added; see the module's text for method and defined cases."""
    spark = docs.sparkSession
    docs = docs.select(*[c for c in docs.columns if c not in OUTPUTS])
    docs = docs.withColumn(id_col, F.col(id_col).cast("long")).withColumn(text_col, F.col(text_col).cast("string"))
    blocks = materialize(pack_blocks(docs, text_col, window, block_bytes), "blocks")
    windows = blocks.agg(F.sum("n_windows")).first()[0] or 0
    bits = sketch_bits(windows, sketch_bytes)
    sketch = spark.sparkContext.broadcast(load_sketch(build_sketch(blocks, id_col, text_col, window, bits), bits))
    buckets = max(1, -(-windows // KEYS_PER_BUCKET))
    replies = earlier_owners(candidate_keys(blocks, sketch, id_col, text_col, window, buckets))
    out = T.StructType([*docs.schema.fields, *[T.StructField(k, v) for k, v in OUTPUTS.items()]])

    def strip(left: pa.Table, right: pa.Table) -> pa.Table:
        flags = {b: np.frombuffer(x, np.uint8) for b, x in zip(right.column("bucket").to_pylist(), right.column("bits").to_pylist(), strict=True)}
        found = [remove_words(_open(x.as_py()), sketch.value, flags, id_col, text_col, window, buckets) for x in left.column("payload")]
        K.give_back()
        return pa.Table.from_batches([part for x in found for part in K.slices(x, text_col, OUT_BYTES)], found[0].schema if found else None)

    return blocks.select("block", "payload").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(strip, out)


def pack_blocks(docs: DataFrame, text_col: str, window: int, block_bytes: int) -> DataFrame:
    """Rows (block, n_windows, payload): runs of whole rows, as compressed Arrow streams."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in K.slices(batch, text_col, block_bytes):
                _, _, before = K.word_spans(*K.text_buffer(part.column(text_col)))
                count = int(np.maximum(np.diff(before) - window + 1, 0).sum())
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(part)
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "n_windows": pa.array([count], pa.int64()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
                block += 1

    return docs.mapInArrow(K.frugal(pack), "block long, n_windows long, payload binary")


def _open(payload: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(payload) as reader:
        return reader.read_next_batch()


# --- the sketch ---------------------------------------------------------------------------------------------------


def sketch_bits(windows: int, most_bytes: int) -> int:
    """log2 of the cells in each of the two rows: two cells or more for each window, as far as the bound allows."""
    most = (most_bytes * 8 // 2).bit_length() - 1
    return min(max(16, (2 * max(windows, 1) - 1).bit_length()), most, 30)


def cells(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The cell of each window in one row and then the other; the rows use different bits of the hash."""
    low = np.uint32((1 << bits) - 1)
    yield hashes.astype(np.uint32) & low
    yield (hashes >> K.U64(34)).astype(np.uint32) & low


def build_sketch(blocks: DataFrame, id_col: str, text_col: str, window: int, bits: int) -> DataFrame:
    """Rows (part, bits): for each range of cells, which of them were counted twice or more."""
    region = min(bits, _REGION_BITS)
    regions = 1 << (bits - region)

    def lists(hashes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        together = np.concatenate(hashes)
        hashes.clear()
        for row, cell in enumerate(cells(together, bits)):
            cell.sort()
            cell = cell[np.concatenate([np.ones(min(2, len(cell)), bool), cell[2:] != cell[:-2]])]
            edge = np.searchsorted(cell, np.arange(regions + 1, dtype=np.uint64) << K.U64(region))
            for n in np.flatnonzero(np.diff(edge)):
                step = np.diff(cell[edge[n] : edge[n + 1]] - np.uint32(int(n) << region), prepend=np.uint32(0)).astype("<u4")
                planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4)[:, :3].T).tobytes()
                yield pa.RecordBatch.from_pydict({"part": pa.array([row * regions + int(n)], pa.int32()), "n": pa.array([len(step)], pa.int32()), "cells": pa.array([pa.compress(planes, codec="zstd", asbytes=True)], pa.binary())})

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for payload in batch.column(0):
                got = _hashes(_open(payload.as_py()), id_col, text_col, window)
                held.append(got)
                size += len(got)
                if size >= _FLUSH:
                    yield from lists(held)
                    size = 0
        if size:
            yield from lists(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = None, np.zeros(1 << region, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([np.packbits(counts >= 2, bitorder="little").tobytes()], pa.binary())})

        for batch in batches:
            for p, n, data in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if p != part:
                    if part is not None:
                        yield done()
                    part, counts = p, np.zeros(1 << region, np.uint8)
                planes = np.frombuffer(pa.decompress(data, 3 * n, codec="zstd"), np.uint8).reshape(3, n).astype(np.uint32)
                at = np.cumsum(planes[0] | planes[1] << 8 | planes[2] << 16)
                twice = np.flatnonzero(at[1:] == at[:-1])
                counts[at[twice]] = 2
                once = np.delete(at, [*twice, *(twice + 1)]) if len(twice) else at
                counts[once] = np.minimum(counts[once] + 1, 2)
        if part is not None:
            yield done()

    pieces = blocks.select("payload").mapInArrow(K.frugal(emit), "part int, n int, cells binary")
    return materialize(pieces.repartition("part").sortWithinPartitions("part").mapInArrow(K.frugal(merge), "part int, bits binary"), "sketch")


def load_sketch(merged: DataFrame, bits: int) -> np.ndarray:
    """The sketch as two rows of packed bits. Its size is bounded by sketch_bits()."""
    region = min(bits, _REGION_BITS)
    out = np.zeros((2 << (bits - region), (1 << region) // 8), np.uint8)
    for part, data in merged.collect():
        out[part] = np.frombuffer(data, np.uint8)
    return out.reshape(2, -1)


def estimated_repeated(hashes: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Whether the sketch counts each window twice or more."""
    found = np.ones(len(hashes), bool)
    for row, cell in enumerate(cells(hashes, (sketch.shape[1] * 8).bit_length() - 1)):
        found &= (sketch[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
    return found


def _hashes(part: pa.RecordBatch, id_col: str, text_col: str, window: int) -> np.ndarray:
    data, offsets = K.text_buffer(part.column(text_col))
    starts, ends, before = K.word_spans(data, offsets)
    first, row = K.window_rows(before, window)
    known = part.column(id_col).is_valid().to_numpy(zero_copy_only=False)
    rolled = K.rolling(K.hash_spans(data, starts, ends)[0], window, _BASE)
    return rolled[first[known[row]]]


# --- the exact pass -----------------------------------------------------------------------------------------------


def _block_keys(part: pa.RecordBatch, sketch: np.ndarray, id_col: str, text_col: str, window: int) -> dict:
    """The block's candidate windows, and its distinct keys in order with the smallest document of each."""
    data, offsets = K.text_buffer(part.column(text_col))
    starts, ends, before = K.word_spans(data, offsets)
    one, two = K.hash_spans(data, starts, ends, (1, 2))
    first, row = K.window_rows(before, window)
    valid = part.column(id_col).is_valid().to_numpy(zero_copy_only=False)
    ids = part.column(id_col).fill_null(0).to_numpy(zero_copy_only=False)
    first, row = first[valid[row]], row[valid[row]]
    key = K.rolling(one, window, _BASE)[first]
    keep = estimated_repeated(key, sketch)
    first, row, key = first[keep], row[keep], key[keep]
    second = np.zeros(len(first), K.U64)
    for k in range(window):
        second = second * K.U64(_BASE2) + two[first + k]
    second = (K.mix(second) >> K.U64(32)).astype(np.uint32)
    order = np.lexsort((second, key))
    first, doc, key, second = first[order], ids[row[order]], key[order], second[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (second[1:] != second[:-1])
    lead = np.flatnonzero(new)
    least = np.minimum.reduceat(doc, lead) if len(lead) else doc
    return {"data": data, "starts": starts, "ends": ends, "before": before, "first": first, "doc": doc, "key": np.cumsum(new) - 1, "one": key[lead], "two": second[lead], "least": least}


def _bucket_edges(one: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that the sorted keys fall in, and where each begins and ends."""
    bucket = ((one >> K.U64(32)) * K.U64(buckets)) >> K.U64(32)
    lead = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    return bucket[lead].astype(np.int64), np.append(lead, len(bucket))


def candidate_keys(blocks: DataFrame, sketch, id_col: str, text_col: str, window: int, buckets: int) -> DataFrame:
    """Rows (bucket, block, one, two, base, least): the distinct candidate keys of a block that fall in a bucket."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = _block_keys(_open(payload.as_py()), sketch.value, id_col, text_col, window)
                got, edge = _bucket_edges(b["one"], buckets)
                if not len(got):
                    continue
                base = int(b["least"].min())
                least = (b["least"].astype(np.uint64) - np.uint64(base % (1 << 64)))
                width = next(w for w in (2, 4, 8) if int(least.max()) < 1 << (8 * w))
                columns = {"one": b["one"], "two": b["two"], "least": least.astype(f"<u{width}")}
                yield pa.RecordBatch.from_pydict(
                    {"bucket": pa.array(got, pa.int64()), "block": pa.array([block] * len(got), pa.int64())}
                    | {k: pa.array([v[i:j].tobytes() for i, j in zip(edge, edge[1:], strict=False)], pa.binary()) for k, v in columns.items()}
                    | {"base": pa.array([base] * len(got), pa.int64())}
                )

    return blocks.select("block", "payload").mapInArrow(K.frugal(emit), "bucket long, block long, one binary, two binary, least binary, base long")


def earlier_owners(keys: DataFrame) -> DataFrame:
    """Rows (block, bucket, bits): for the keys that the block sent, whether a smaller document is elsewhere."""

    def answer(rows: pa.Table) -> pa.Table:
        one = [np.frombuffer(x, np.uint64) for x in rows.column("one").to_pylist()]
        two = [np.frombuffer(x, np.uint32) for x in rows.column("two").to_pylist()]
        least = []
        for keys_of, data, base in zip(one, rows.column("least").to_pylist(), rows.column("base").to_pylist(), strict=True):
            least.append((np.frombuffer(data, f"<u{len(data) // len(keys_of)}").astype(np.uint64) + np.uint64(base % (1 << 64))).view(np.int64))
        sizes = [len(x) for x in one]
        one, two, least = np.concatenate(one), np.concatenate(two), np.concatenate(least)
        order = np.lexsort((two, one))
        new = np.ones(len(one), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        low = np.minimum.reduceat(least[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        earlier = np.empty(len(one), bool)
        earlier[order] = low < least[order]
        out, at = [], 0
        for block, bucket, n in zip(rows.column("block").to_pylist(), rows.column("bucket").to_pylist(), sizes, strict=True):
            if earlier[at : at + n].any():
                out.append((block, bucket, np.packbits(earlier[at : at + n], bitorder="little").tobytes()))
            at += n
        K.give_back()
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "bucket": pa.array([x[1] for x in out], pa.int64()), "bits": pa.array([x[2] for x in out], pa.binary())})

    return keys.groupBy("bucket").applyInArrow(answer, "block long, bucket long, bits binary")


def remove_words(part: pa.RecordBatch, sketch: np.ndarray, flags: dict, id_col: str, text_col: str, window: int, buckets: int) -> pa.RecordBatch:
    """The block's rows with n_words, n_removed and kept_text."""
    b = _block_keys(part, sketch, id_col, text_col, window)
    earlier = np.zeros(len(b["one"]), bool)
    got, edge = _bucket_edges(b["one"], buckets)
    for n, bucket in enumerate(got.tolist()):
        if bucket in flags:
            earlier[edge[n] : edge[n + 1]] = np.unpackbits(flags[bucket], count=edge[n + 1] - edge[n], bitorder="little")
    gone = b["first"][earlier[b["key"]] | (b["doc"] > b["least"][b["key"]])]
    depth = np.zeros(len(b["starts"]) + 1, np.int64)
    np.add.at(depth, gone, 1)
    np.add.at(depth, gone + window, -1)
    keep = np.cumsum(depth)[:-1] <= 0
    left = np.concatenate([[0], np.cumsum(keep)])[b["before"]]
    text = K.string_array(*K.joined(b["data"], b["starts"][keep], b["ends"][keep], left))
    words = np.diff(b["before"])
    return pa.RecordBatch.from_arrays([*part.columns, pa.array(words, pa.int64()), pa.array(words - np.diff(left), pa.int64()), text.cast(pa.string())], names=[*part.schema.names, *OUTPUTS])
