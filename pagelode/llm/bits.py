"""Bounded membership bitmaps: a prefilter that lets rows be left out of a shuffle, and never decides alone.

A bitmap has a bit for each value of some bits of a hash of the members, sixteen cells a member up to MOST_BITS. It
says yes for every member and for a few others; beyond the bound it says yes more often. So what it lets through is
joined with the members themselves, and where it only ranks (the order of hashes) any answer will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm import kernels as K
from pagelode.llm.scratch import materialize

MOST_BITS = 28
#: Members up to which their cells are sent as they are; both ways give the same bits.
FEW = 1 << 19
_PART_BITS = 16


def cells(values: np.ndarray, bits: int) -> np.ndarray:
    """The cell of each value."""
    return (K.mix(values.view(K.U64) + K.U64(0x9E3779B97F4A7C15)) >> K.U64(64 - bits)).astype(np.int64)


class Bits:
    """A broadcast bitmap of the distinct values of one long column; nulls are no members."""

    def __init__(self, values: DataFrame, column: str) -> None:
        spark = values.sparkSession
        values = values.select(F.col(column).alias("value")).where("value is not null")
        count = values.count()
        self.bits = bits = min(max(16, (16 * count).bit_length()), MOST_BITS)
        table = np.zeros((1 << (bits - _PART_BITS), (1 << _PART_BITS) // 8), np.uint8)

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = [np.unique(cells(batch.column(0).to_numpy(), bits)).astype("<u4") for batch in batches]
            yield pa.RecordBatch.from_pydict({"cells": pa.array([np.unique(np.concatenate([*found, np.zeros(0, "<u4")])).tobytes()], pa.binary())})

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.unique(cells(batch.column(0).to_numpy(), bits))
                yield pa.RecordBatch.from_arrays([pa.array((at >> _PART_BITS).astype(np.int32)), pa.array((at & ((1 << _PART_BITS) - 1)).astype(np.int32))], names=["part", "cell"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                part, cell = (batch.column(k).to_numpy() for k in range(2))
                for p in np.unique(part).tolist():
                    held.setdefault(p, np.zeros(1 << _PART_BITS, bool))[cell[part == p]] = True
            yield pa.RecordBatch.from_pydict({"part": pa.array(list(held), pa.int32()), "data": pa.array([np.packbits(x, bitorder="little").tobytes() for x in held.values()], pa.binary())})

        if count <= FEW:  # four bytes a member to the driver
            flags = np.zeros(1 << bits, bool)
            for row in values.mapInArrow(sent, "cells binary").collect():
                flags[np.frombuffer(row.cells, "<u4")] = True
            table = np.packbits(flags, bitorder="little")
        else:
            for part, data in values.mapInArrow(dealt, "part int, cell int").distinct().repartition("part").mapInArrow(pack, "part int, data binary").collect():
                table[part] = np.frombuffer(data, np.uint8)
        self._held = spark.sparkContext.broadcast(table.reshape(-1))

    def has(self, values: np.ndarray) -> np.ndarray:
        """Whether each 64-bit value may be a member."""
        if not len(values):
            return np.zeros(0, bool)
        at = cells(values, self.bits)
        return (self._held.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def free(self) -> None:
        """Take the bitmap from the driver and all executors; nothing may ask it any more."""
        self._held.destroy()


def semi(rows: DataFrame, keys: DataFrame, label: str, key: str = "id") -> DataFrame:
    """The rows whose key is among keys, written; only rows that the bitmap lets through are shuffled."""
    keys = keys.select(key)
    held = Bits(keys, key)
    at = rows.columns.index(key)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(at)
            yield batch.filter(pa.array(held.has(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)))

    found = materialize(rows.mapInArrow(K.frugal(near), rows.schema).join(keys, key, "left_semi").select(*rows.columns), label)
    held.free()
    return found
