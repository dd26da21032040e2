"""SimHash near-duplicates: BK-trees over 64-bit fingerprints of word shingles.

Method. A document's fingerprint has a bit where over half of its shingles' hashes have it. Distinct fingerprints
are dealt to shards and each shard is a BK-tree: a node's children are keyed by their Hamming distance to it, and
a search for all fingerprints within the radius follows only edges whose key differs from the query's distance by
the radius or less. Following all shards' trees from all fingerprints would be quadratic, as 64 random bits lie
32 +- 4 from each other and a radius of 4 follows two thirds of the edges. So a shard holds the fingerprints that
agree in a choice of blocks of bits: with k blocks, two fingerprints within radius r agree in k - r of them, hence
meet in a shard of one of the C(k, r) choices, and no link is lost. k follows the number of fingerprints so that
unrelated ones rarely meet. The trees are built where their shard is and not broadcast: a broadcast would need
all fingerprints on the driver.

A shard returns a spanning star for each of its linked sets, never all pairs: a subtree whose nodes already belong
to the query's set is not entered. Stars of all shards are united by distributed connected components, and each
document gets the least id of its component.

Defined cases. Fewer words than a shingle: the whole sequence is the only shingle. No words, null or empty text:
fingerprint zero, linked like any other. Null ids: the row gets its fingerprint and component; they are never the
least unless no other id is in the component. Repeated ids and rows: each row is returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelode.llm import kernels as K
from pagelode.llm.components import connected_components
from pagelode.llm.scratch import materialize

SHINGLE = 4
RADIUS = 4
SEED = 42
SLICE_BYTES = 4 << 20
#: Choices of blocks up to which all are asked at once.
FEW_CHOICES = 20

#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (K.U64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << K.U64(n)) | (x >> K.U64(64 - n))


def _round(x: np.ndarray) -> np.ndarray:
    return _rotl(x * P2, 31) * P1


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of each span of bytes. Spans of one length are hashed together."""
    view = K.lanes(data)
    size = ends - starts
    out = np.zeros(len(starts), K.U64)
    if not len(size):
        return out
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(size[order]) > 0]))
    seed64 = K.U64(seed)
    with np.errstate(over="ignore"):
        for at, to in zip(edges, [*edges[1:], len(order)], strict=True):
            rows = order[at:to]
            length, p, k = int(size[rows[0]]), starts[rows], 0
            if length >= 32:
                v = [np.full(len(rows), x, K.U64) for x in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
                while k + 32 <= length:
                    v = [_rotl(x + view[p + k + 8 * n] * P2, 31) * P1 for n, x in enumerate(v)]
                    k += 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    h = (h ^ _round(x)) * P1 + P4
            else:
                h = np.full(len(rows), seed64 + P5, K.U64)
            h = h + K.U64(length)
            while k + 8 <= length:
                h = _rotl(h ^ _round(view[p + k]), 27) * P1 + P4
                k += 8
            if k + 4 <= length:
                h = _rotl(h ^ ((view[p + k] & K.U64(0xFFFFFFFF)) * P1), 23) * P2 + P3
                k += 4
            while k < length:
                h = _rotl(h ^ (data[p + k].astype(K.U64) * P5), 11) * P1
                k += 1
            h = (h ^ (h >> K.U64(33))) * P2
            h = (h ^ (h >> K.U64(29))) * P3
            out[rows] = h ^ (h >> K.U64(32))
    return out


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The fingerprint of each text."""
    data, offsets = K.text_buffer(column)
    data = K.LOWER[data]
    data, offsets = K.joined(data, *K.word_spans(data, offsets))
    starts, ends, before = K.word_spans(data, offsets)
    words = np.diff(before)
    first, row = K.window_rows(before, shingle)
    last = first + shingle - 1
    short = np.flatnonzero((words > 0) & (words < shingle))
    if len(short):
        first, last = np.concatenate([first, before[short]]), np.concatenate([last, before[short + 1] - 1])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        first, last, row = first[order], last[order], row[order]
    hashes = xxh64_spans(data, starts[first], ends[last], seed)
    return majority_bits(hashes, np.bincount(row, minlength=len(words)))


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits that over half of them have; an empty run gives zero."""
    out = np.zeros(len(counts), K.U64)
    if not len(hashes):
        return out
    at = np.concatenate([[0], np.cumsum(counts)])
    parts = -(-counts // 255)  # a byte counts 255 at most
    lead = np.concatenate([[0], np.cumsum(parts)])
    step = np.arange(lead[-1]) - np.repeat(lead[:-1], parts)
    cut = np.repeat(at[:-1], parts) + 255 * step
    full = np.flatnonzero(counts)
    for k in range(8):
        sums = np.add.reduceat((hashes >> K.U64(k)) & K.U64(0x0101010101010101), cut)
        each = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), lead[:-1][full], axis=0)
        for n in range(8):
            out[full] |= (2 * each[:, n] > counts[full]).astype(K.U64) << K.U64(8 * n + k)
    return out


def fingerprint_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, seed: int) -> DataFrame:
    """(id, fp) of each row; fp is the fingerprint as a signed number."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text", SLICE_BYTES):
                fps = fingerprints_of(part.column("text"), shingle, seed)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(K.frugal(each), "id long, fp long")


# --- shards and their trees ---------------------------------------------------------------------------------------


def blocks_for(count: int, radius: int) -> int:
    """How many blocks to cut 64 bits into: fewest such that unrelated fingerprints rarely share a shard."""
    k = radius + 1
    while k < 3 * radius + 2 and 64 * (k - radius) // k < max(count, 1).bit_length() - 1:
        k += 1
    return k


def shard_keys(fp: Column, blocks: int, radius: int) -> Column:
    """An array of (choice, key): for each choice of blocks that must agree, the fingerprint's bits there."""
    edge = [64 * n // blocks for n in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edge[c + 1]) - (1 << edge[c])) for c in chosen)
        keys.append(F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return F.array(*keys)


class BKTree:
    """A BK-tree over distinct fingerprints, held in preorder: a subtree is a run of positions."""

    def __init__(self, fps: np.ndarray) -> None:
        self.order, self.end = np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64)
        self.children: list[list[tuple[int, int]]] = [[] for _ in range(len(fps))]
        todo, at = [(np.arange(len(fps)), -1, 0)], 0
        while todo:
            members, parent, distance = todo.pop()
            root = at
            at += 1
            self.order[root], self.end[root] = members[0], root + len(members)
            if parent >= 0:
                self.children[parent].append((distance, root))
            if len(members) > 1:
                away = np.bitwise_count(fps[members[1:]] ^ fps[members[0]])
                order = np.argsort(away, kind="stable")
                rest, away = members[1:][order], away[order]
                lead = np.flatnonzero(np.concatenate([[True], np.diff(away.astype(np.int16)) != 0]))
                for i, j in zip(lead, [*lead[1:], len(rest)], strict=True):
                    todo.append((rest[i:j], root, int(away[i])))
        self.fps = fps[self.order]

    def linked(self, radius: int, label: np.ndarray | None = None) -> np.ndarray:
        """For each position, the least position of its set: sets are joined by links within the radius.

        label: the sets known so far, in the same form; each position for itself by default.
        """
        label = np.arange(len(self.fps)) if label is None else label.copy()
        todo = [(0, np.arange(len(self.fps)))]
        while todo:
            node, asked = todo.pop()
            low, high = label[node : self.end[node]].min(), label[node : self.end[node]].max()
            if low == high:  # all one set: only others need to look
                asked = asked[label[asked] != low]
                if not len(asked):
                    continue
            away = np.bitwise_count(self.fps[asked] ^ self.fps[node]).astype(np.int16)
            sets = np.unique(label[np.append(asked[away <= radius], node)])
            if len(sets) > 1:
                label[np.isin(label, sets)] = sets[0]
            for distance, child in self.children[node]:
                near = asked[np.abs(away - distance) <= radius]
                if len(near):
                    todo.append((child, near))
        return label


def shard_links(shards: DataFrame, radius: int) -> DataFrame:
    """(a, b): what joins the known sets (column known) in each shard, a star for each new set.

    The input (choice, key, fp, known) lies together and sorted by shard.
    """

    def runs(choice: np.ndarray, key: np.ndarray, fp: np.ndarray, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        new = np.concatenate([[True], (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])])
        lead = np.flatnonzero(new)
        size = np.diff(np.append(lead, len(fp)))
        two = lead[size == 2]  # a root with one child: its key is the distance
        near = (np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius) & (known[two] != known[two + 1])
        yield known[two][near], known[two + 1][near]
        for at, n in zip(lead[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            mine = known[at : at + n]
            if (mine == mine[0]).all():
                continue
            tree = BKTree(fp[at : at + n])
            sets = mine[tree.order]
            _, first, back = np.unique(sets, return_index=True, return_inverse=True)
            start = first[back]
            label = tree.linked(radius, start)
            other = np.flatnonzero((start == np.arange(n)) & (label != start))
            yield sets[other], sets[label[other]]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * 3]
        for batch in batches:
            now = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            if not len(now[0]):
                continue
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            held = [x[cut:] for x in now]
            yield from pack([x[:cut] for x in now])
        yield from pack(held)

    def pack(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            got = list(runs(columns[0], columns[1], columns[2].view(np.uint64), columns[3]))
            a, b = (np.concatenate(x) for x in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return shards.mapInArrow(K.frugal(each), "a long, b long")


def linked_fingerprints(nodes: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that span the sets of nodes' distinct fingerprints (fp) within the radius of each other.

    Where there are many choices of blocks, a dense set would be told anew by each. So the first few choices are
    united before the others are asked, and those only tell what joins sets that are still apart.
    """
    blocks = blocks_for(nodes.count(), radius)
    choices = math.comb(blocks, radius)
    early = choices if choices <= FEW_CHOICES else choices // 8

    def links(known: DataFrame, some) -> DataFrame:
        shards = known.select("fp", "known", F.explode(F.filter(shard_keys(F.col("fp"), blocks, radius), some)).alias("s")).select("s.choice", "s.key", "fp", "known")
        return shard_links(shards.repartition("choice", "key").sortWithinPartitions("choice", "key", "fp"), radius)

    first = links(nodes.select("fp", F.col("fp").alias("known")), lambda s: s["choice"] < early)
    if early == choices:
        return first
    sets = materialize(connected_components(first), "sets")
    known = nodes.join(sets, nodes.fp == sets.node, "left").select("fp", F.coalesce("component", "fp").alias("known"))
    rest = links(known, lambda s: s["choice"] >= early)
    return sets.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)


def linked_rows(rows: DataFrame, radius: int) -> DataFrame:
    """(id, fp, component_id) of rows (id, fp): the least id that links of fingerprints within the radius lead to."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes", rows.count())
    count = nodes.count()
    found = connected_components(linked_fingerprints(nodes, radius))
    nodes = materialize(nodes.join(found, nodes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "nodes", count)
    roots = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    answer = materialize(nodes.join(roots, "root").select("fp", "component_id"), "components", count)
    return rows.join(answer, "fp").select("id", "fp", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row for each document: (id, fp, component_id); see the module's text."""
    return linked_rows(materialize(fingerprint_rows(docs, id_col, text_col, shingle, seed), "fingerprints"), radius)
