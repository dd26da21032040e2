"""Exact deduplication by composable polynomial fingerprints.

Method. A text is cut into chunks of fixed length; each has a polynomial hash on its own (two bases, modulo the prime
2^61 - 1), from one small table of powers. Chunk hashes combine by length-shifted arithmetic: the
hash of AB is hash(A) + base^len(A) * hash(B). So the chunks of a text of over HUGE_BYTES are dealt to other tasks, hashed
there in any order, and summed, each shifted by the length before it. Texts with equal fingerprints
(both hashes and the length) are then compared chunk by chunk in a stream; a fingerprint that stands for more than
one text is told apart by the texts' digests.

Scale. Memory is that of a slice or of the text at hand, whatever the lengths. Only fingerprints, digests and ids of all rows are shuffled. Texts travel only if a bitmap of the repeated
fingerprints (bounded, broadcast) has them. A fingerprint that holds more than a thousandth of all rows is salted
over all partitions, and the salts' first texts are compared among themselves. Groups are counted by partial
aggregation; the join that hands the group back to its rows has two exchanges, so a hot group can be split.

Defined cases. Null text counts as empty. Equal after lower-casing A-Z only. Of equal texts the row with the
largest id stays; of equal rows exactly one; null ids come before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm import kernels as K
from pagelode.llm.scratch import materialize

CHUNK_BYTES = 1 << 10
SLICE_BYTES = 1 << 20
#: Texts from which chunks are hashed in tasks of their own, and what such a task is given at once.
HUGE_BYTES, PIECE_BYTES = 8 << 20, 1 << 20
BITMAP_BITS = 28
HOT_SHARE = 1000
PRIME = (1 << 61) - 1
BASES = (0x1234567_89ABCDE5, 0x0FEDCBA9_87654321)
_KEY = ["h1", "h2", "n"]
_LIMB = 21
_TABLES: dict[int, tuple[np.ndarray, list[list[int]], list[list[int]]]] = {}


def _tables(chunk: int) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
    """For chunks of a length: the powers of both bases in limbs of 21 bits, the sums of the first powers, and shifts by whole chunks."""
    if chunk not in _TABLES:
        limbs, sums, shifts = [], [], []
        for base in BASES:
            power = [1]
            for _ in range(chunk):
                power.append(power[-1] * base % PRIME)
            limbs += [[x >> (_LIMB * k) & ((1 << _LIMB) - 1) for x in power[:chunk]] for k in range(3)]
            total, shift = [0], [1]
            for x in power[:chunk]:
                total.append((total[-1] + x) % PRIME)
            while len(shift) <= PIECE_BYTES // chunk + 1:
                shift.append(shift[-1] * power[chunk] % PRIME)
            sums.append(total)
            shifts.append(shift)
        _TABLES[chunk] = (np.array(limbs, float).T, sums, shifts)
    return _TABLES[chunk]


def chunk_hashes(data: np.ndarray, offsets: np.ndarray, chunk: int) -> tuple[np.ndarray, list[list[int]]]:
    """How many chunks each row has (one at least), and for each base the hashes of all chunks.

    A chunk's hash is the sum of (byte + 1) * base^(place in the chunk), modulo PRIME. A byte times 21 bits, summed over a
    chunk, stays below 2^53, so products of floats are exact.
    """
    limbs, sums, _ = _tables(chunk)
    sizes = np.diff(offsets)
    parts = np.maximum(-(-sizes // chunk), 1)
    lead = np.concatenate([[0], np.cumsum(parts)])
    padded = np.zeros(int(lead[-1]) * chunk, np.uint8)
    for at, a, b in zip((lead[:-1] * chunk).tolist(), offsets.tolist(), offsets[1:].tolist(), strict=False):
        padded[at : at + b - a] = data[a:b]
    got = (padded.reshape(-1, chunk).astype(float) @ limbs).astype(np.int64).tolist()
    last = np.full(int(lead[-1]), chunk)
    last[lead[1:] - 1] = sizes - (parts - 1) * chunk
    size = last.tolist()
    return parts, [[(x[3 * n] + (x[3 * n + 1] << _LIMB) + (x[3 * n + 2] << 2 * _LIMB) + sums[n][k]) % PRIME for x, k in zip(got, size, strict=True)] for n in range(len(BASES))]


def combine(left: int, left_bytes: int, right: int, base: int) -> int:
    """The hash of two adjoining pieces, from theirs."""
    return (left + pow(base, left_bytes, PRIME) * right) % PRIME


def fingerprints(data: np.ndarray, offsets: np.ndarray, chunk: int = CHUNK_BYTES) -> list[np.ndarray]:
    """For each base, the fingerprint of each row; chunks are hashed on their own and combined."""
    if len(offsets) == 2 and len(data) > PIECE_BYTES:  # a long text by itself: piece by piece, to bound the memory
        whole = [0] * len(BASES)
        for at in range(0, len(data), PIECE_BYTES):
            piece = data[at : at + PIECE_BYTES]
            for n, found in enumerate(fingerprints(piece, np.array([0, len(piece)]), chunk)):
                whole[n] = combine(whole[n], at, int(found[0]), BASES[n])
        return [np.array([x], np.int64) for x in whole]
    parts, hashes = chunk_hashes(data, offsets, chunk)
    lead = np.cumsum(parts) - parts
    out = []
    for shift, found in zip(_tables(chunk)[2], hashes, strict=True):
        whole = np.array(found, np.int64)[lead]
        for row in np.flatnonzero(parts > 1).tolist():
            mine = found[lead[row] : lead[row] + parts[row]]
            whole[row] = sum(map(int.__mul__, mine, shift)) % PRIME
        out.append(whole)
    return out


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _sliced(batches: Iterator[pa.RecordBatch], defer: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, list[np.ndarray]]]:
    for batch in batches:
        for part in K.slices(batch, "text", SLICE_BYTES):
            data, offsets = K.text_buffer(part.column("text"))
            data = K.LOWER[data]
            whole = defer and part.num_rows == 1 and len(data) > HUGE_BYTES  # hashed by its pieces elsewhere
            yield part, data, offsets, [np.zeros(1, np.int64)] * 2 if whole else fingerprints(data, offsets)


def huge_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(sha, h1, h2) of the texts of over HUGE_BYTES: pieces are dealt out, hashed where they land, shifted and summed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, _ = K.text_buffer(batch.column("text").slice(k, 1))
                data = K.LOWER[data]
                sha = hashlib.sha256(data).digest()
                for at in range(0, len(data), PIECE_BYTES):
                    yield pa.RecordBatch.from_arrays([pa.array([sha], pa.binary()), pa.array([at], pa.int64()), pa.array([data[at : at + PIECE_BYTES].tobytes()], pa.binary())], names=["sha", "at", "piece"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shifted = [[], []]
            for at, piece in zip(batch.column("at").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                data = np.frombuffer(piece, np.uint8)
                for n, (base, found) in enumerate(zip(BASES, fingerprints(data, np.array([0, len(data)])), strict=True)):
                    shifted[n].append(pow(base, at, PRIME) * int(found[0]) % PRIME)
            yield pa.RecordBatch.from_arrays([batch.column("sha"), batch.column("at"), *[pa.array(x, pa.int64()) for x in shifted]], names=["sha", "at", "h1", "h2"])

    pieces = _normalised(docs, id_col, text_col).where(F.octet_length("text") > HUGE_BYTES).mapInArrow(K.frugal(cut), "sha binary, at long, piece binary")
    hashed = pieces.repartition("sha", "at").mapInArrow(K.frugal(each), "sha binary, at long, h1 long, h2 long").distinct()  # equal texts: once
    total = [(F.sum(F.col(c).cast("decimal(20,0)")) % F.lit(PRIME)).cast("long").alias(c) for c in ("h1", "h2")]
    return hashed.groupBy("sha").agg(*total)


def fingerprint_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h1, h2, n, sha): both hashes, the length in bytes and the digest of each row's normalised text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets, (h1, h2) in _sliced(batches, defer=True):
            view = memoryview(np.ascontiguousarray(data))
            sha = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(h1), pa.array(h2), pa.array(np.diff(offsets)), pa.array(sha, pa.binary())], names=["id", *_KEY, "sha"])

    rows = materialize(_normalised(docs, id_col, text_col).mapInArrow(K.frugal(each), "id long, h1 long, h2 long, n long, sha binary"), "hashed")
    huge = rows.where(F.col("n") > HUGE_BYTES)
    if huge.isEmpty():
        return rows
    told = materialize(huge_fingerprints(docs, id_col, text_col), "huge")
    return rows.where(F.col("n") <= HUGE_BYTES).unionByName(huge.drop("h1", "h2").join(told, "sha").select(*rows.columns))


def repeated_bitmap(groups: DataFrame, bits: int) -> np.ndarray:
    """One bit for each value of the low bits of h1: whether a repeated fingerprint has it. 2^bits / 8 bytes."""
    low = min(bits, 16)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        flags = np.zeros(1 << low, bool)
        flags[rows.column("cell").to_numpy() & ((1 << low) - 1)] = True
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    cell = F.col("h1").bitwiseAND(F.lit((1 << bits) - 1)).alias("cell")
    parts = groups.select(cell).distinct().groupBy(F.shiftright("cell", low).alias("part")).applyInArrow(pack, "part long, bits binary")
    out = np.zeros((1 << (bits - low), (1 << low) // 8), np.uint8)
    for part, data in parts.collect():
        out[part] = np.frombuffer(data, np.uint8)
    return out.reshape(-1)


def collided(docs: DataFrame, id_col: str, text_col: str, groups: DataFrame, rows: int) -> DataFrame:
    """(h1, h2, n) of the repeated fingerprints that stand for more than one text, by comparing the texts."""
    spark = docs.sparkSession
    count = groups.count()
    bits = min(max(16, (8 * count).bit_length()), BITMAP_BITS)
    bitmap = spark.sparkContext.broadcast(repeated_bitmap(groups, bits))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = {(r.h1, r.h2, r.n) for r in groups.where(F.col("size") > max(salts, rows // HOT_SHARE)).select(*_KEY).collect()}

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for _, data, offsets, (h1, h2) in _sliced(batches):
            cell = h1 & ((1 << bits) - 1)
            rows_in = np.flatnonzero((bitmap.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
            if not len(rows_in):
                continue
            size = np.diff(offsets)[rows_in]
            keys = list(zip(h1[rows_in].tolist(), h2[rows_in].tolist(), size.tolist(), strict=True))
            salt = [(turn + k) % salts + 1 if key in hot else 0 for k, key in enumerate(keys)]
            turn += len(keys)
            view = memoryview(np.ascontiguousarray(data))
            held = [bytes(view[offsets[i] : offsets[i + 1]]) for i in rows_in.tolist()]
            yield pa.RecordBatch.from_arrays([*[pa.array([k[n] for k in keys], pa.int64()) for n in range(3)], pa.array(salt, pa.int32()), pa.array(held, pa.binary())], names=[*_KEY, "salt", "text"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, first, differs = None, b"", False

        def done() -> pa.RecordBatch:
            kept = first if run[3] else None
            return pa.RecordBatch.from_arrays([*[pa.array([x], pa.int64()) for x in run[:3]], pa.array([kept], pa.binary()), pa.array([differs])], names=[*_KEY, "text", "differs"])

        for batch in batches:
            for *key, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != run:
                    if run is not None and (differs or run[3]):
                        yield done()
                    run, first, differs = key, text, False
                elif not equal_in_chunks(first, text):
                    differs = True
        if run is not None and (differs or run[3]):
            yield done()

    dealt = _normalised(docs, id_col, text_col).mapInArrow(K.frugal(texts), "h1 long, h2 long, n long, salt int, text binary").repartition(*_KEY, "salt").sortWithinPartitions(*_KEY, "salt")
    firsts = materialize(dealt.mapInArrow(K.frugal(compare), "h1 long, h2 long, n long, text binary, differs boolean"), "compared")
    among = firsts.where("text is not null").select(*_KEY, F.lit(0).alias("salt"), "text").repartition(*_KEY).sortWithinPartitions(*_KEY)
    again = among.mapInArrow(K.frugal(compare), "h1 long, h2 long, n long, text binary, differs boolean")
    return firsts.where("differs").select(*_KEY).unionByName(again.where("differs").select(*_KEY)).distinct()


def equal_in_chunks(a: bytes, b: bytes, chunk: int = PIECE_BYTES) -> bool:
    """Whether two texts are equal, chunk by chunk up to the first difference."""
    x, y = memoryview(a), memoryview(b)
    return len(x) == len(y) and all(x[k : k + chunk] == y[k : k + chunk] for k in range(0, len(x), chunk))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (id, keep_id, group_size, kept, text_sha256); see the module's text."""
    rows = materialize(fingerprint_rows(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    groups = rows.groupBy(*_KEY).agg(F.count("*").alias("size"))
    apart = materialize(collided(docs, id_col, text_col, materialize(groups.where("size > 1"), "repeated"), rows.count()), "collided")
    if apart.count():
        mark = apart.withColumn("apart", F.lit(True))
        rows = rows.join(mark, _KEY, "left").withColumn("extra", F.when(F.col("apart"), F.col("sha"))).drop("apart")
    else:
        rows = rows.withColumn("extra", F.lit(None).cast("binary"))
    rows = rows.withColumn("extra", F.coalesce("extra", F.lit(b"")))
    key = [*_KEY, "extra"]
    classes = rows.groupBy(*key).agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("keep"))
    classes = materialize(classes, "classes")
    return rows.join(classes, key).select("id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
