"""Near-duplicate removal on top of SimHash: linked sets by fingerprints, decisions by shingle sets.

A document is dropped if its shingle set has the similarity with one that stays, and of those that stay no two have it.
A 64-bit fingerprint of five-word shingles differs in ten bits or so between texts whose shingle sets have a Jaccard
similarity of 0.8, so fingerprints and a small radius find dense groups cheaply but miss pairs. So there are three steps.

1. One pass over the texts takes each one's shingle set and fingerprint. The BK-tree shards of the SimHash operator link
the fingerprints, and linked components are candidate groups. Every group, whatever its size, is dealt over SALTS parts
by id; within a part, in order of id, a document is dropped for the first kept one found similar, else it is kept. The
ones kept in a group's parts then meet once more, and those that went for one that went there are compared with the
group's kept ones; without a similar one they are left to the second step.
2. All similar pairs of those that are left are found exactly: two sets of similarity t share one of their first
n - ceil(t n) + 1 hashes in any common order. One pass counts in how many sets the hashes occur; those in more than
MOST_SHARED come later in the order, those in many times more later still. Sets whose first hashes come to such widely
shared ones are near copies that fingerprints miss, or texts of common passages: they are settled like the groups of step 1,
by the least widely shared hash that they have, before pairs are sought, so that a group doesn't meet pair by pair. Places in
the order (two sets have in common at most what the shorter one has from the first common hash on), then signatures
(the parity of the hashes in each of 2 n cells or more: two of them can't differ in more cells than the sets differ in
hashes; beside widely shared hashes already where sets meet) rule pairs out before sets are compared. Along the pairs, in
order of id, a document goes if a smaller one that stays is similar.
3. Documents that went for one that has gone itself are compared with all that stay, and those without a similar one are
decided among themselves by steps 2 and 3. So no document goes without a kept copy.

None of this depends on the number of partitions or on the size of the corpus.

Scale. The sets are written once (8 bytes a word); what is shuffled is a fifth of them as (hash, id, size), all hashes as
compressed cells (one or two bytes each), the members of groups, and the sets of pairs that the signatures leave. Bitmaps
are bounded (bits.py). Quadratic work remains only among sets of which four fifths are widely shared hashes, which no group
of fingerprints united and which differ nonetheless.

Defined cases. Fewer words than a shingle: the whole sequence is the only shingle. No words: all such texts are
copies of each other. Null ids stay, as nothing tells which row to keep. Rows of one id are one document, of the union
of their shingles, and stay or go together. Ties cannot arise, as the order is that of distinct ids. Other columns of docs
aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm import kernels as K
from pagelode.llm import simhash as S
from pagelode.llm.bits import Bits, semi
from pagelode.llm.components import connected_components
from pagelode.llm.scratch import drop_table, materialize

SHINGLE, RADIUS, SIMILARITY = 5, S.RADIUS, 0.8
#: Parts that a group is dealt over.
SALTS = 64
#: Parts of a group that are each given all of its kept sets.
ASKING_SALTS = 8
#: Sets that a hash may occur in without coming late in the order, and how many times more for each further step.
MOST_SHARED, STEP, STEPS = 16, 16, 3
#: Cells of the counting pass for each hash, and hashes counted together, as powers of two.
CELLS, COUNTED_AT_ONCE = 4, 21
SLICE_BYTES = 2 << 20
ROWS_AT_ONCE = 1000
PREFIXES_AT_ONCE = 1 << 16
#: Bytes of signatures compared at once.
COMPARED_BYTES = 1 << 22
_FLUSH = 1 << 20
_BASE = 0x9E3779B97F4A7C15
SETS = "id long, fp long, n int, signature binary, hashes binary"


# --- sets ---------------------------------------------------------------------------------------------------------


def shingle_hashes(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, repeats included, and how many each text has."""
    data, offsets = K.text_buffer(column)
    data = K.LOWER[data]
    starts, ends, before = K.word_spans(data, offsets)
    word = K.hash_spans(data, starts, ends)[0]
    first, row = K.window_rows(before, shingle)
    rolled = K.rolling(word, shingle, _BASE)[first]
    words = np.diff(before)
    count = np.maximum(words - shingle + 1, 0)
    for size in range(1, shingle):  # texts of fewer words
        short = np.flatnonzero(words == size)
        if len(short):
            at = np.cumsum(count)[short]
            total = np.zeros(len(short), K.U64)
            for k in range(size):
                total = total * K.U64(_BASE) + word[before[short] + k]
            rolled = np.insert(rolled, at, K.mix(total))
            count[short] = 1
    return rolled, count


def shingle_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order."""
    rolled, count = shingle_hashes(column, shingle)
    edge = np.concatenate([[0], np.cumsum(count)])
    return [_distinct(rolled[a:b]) for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)]


def _distinct(hashes: np.ndarray) -> np.ndarray:
    hashes = np.sort(hashes)
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    return hashes if new.all() else hashes[new]


def signature(hashes: np.ndarray) -> bytes:
    """For each of 2 n cells or more (a power of two), whether an odd number of the hashes falls there."""
    size = max(64, 2 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & K.U64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def cells_apart(a: bytes, b: bytes) -> int:
    """In how many cells two signatures differ; the larger is folded to the size of the smaller."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    p, q = len(a), len(b)
    while p > q:
        p //= 2
        x = (x >> (8 * p)) ^ (x & ((1 << (8 * p)) - 1))
    while q > p:
        q //= 2
        y = (y >> (8 * q)) ^ (y & ((1 << (8 * q)) - 1))
    return (x ^ y).bit_count()


def prefix_size(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - 1e-9)) + 1


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    both = int(np.count_nonzero(both[1:] == both[:-1]))
    return both >= similarity * (len(a) + len(b) - both)


def set_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp, n, signature, hashes): fingerprint and shingle set of each id, written."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch, "text", SLICE_BYTES):
                rolled, count = shingle_hashes(part.column("text"), shingle)
                edge = np.concatenate([[0], np.cumsum(count)])
                held = [_distinct(rolled[a:b]) for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
                yield _set_batch(part.column("id"), S.majority_bits(rolled, count), held)

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [_distinct(np.frombuffer(b"".join(x), np.uint64)) for x in batch.column("hashes").to_pylist()]
            yield _set_batch(batch.column("id"), batch.column("fp").to_numpy(), held)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    rows = materialize(texts.mapInArrow(K.frugal(each), SETS), "sets")
    often = materialize(rows.groupBy("id").count().where("count > 1").select("id"), "repeated")
    if often.isEmpty():
        return rows
    many = rows.join(often, "id").groupBy("id").agg(F.min("fp").alias("fp"), F.collect_set("hashes").alias("hashes")).mapInArrow(united, SETS)
    one = materialize(rows.join(often, "id", "left_anti").select(*rows.columns).unionByName(many), "sets")
    drop_table(rows)
    return one


def _set_batch(ids: pa.Array, fps: np.ndarray, held: list[np.ndarray]) -> pa.RecordBatch:
    columns = [ids, pa.array(fps.view(np.int64)), pa.array([len(x) for x in held], pa.int32()), pa.array([signature(x) for x in held], pa.binary()), pa.array([x.tobytes() for x in held], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["id", "fp", "n", "signature", "hashes"])


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts, as what they turn into is held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


# --- groups of fingerprints ---------------------------------------------------------------------------------------


class Keeper:
    """The sets kept so far in a group, and their ids."""

    def __init__(self, similarity: float) -> None:
        self.similarity, self.sets, self.ids, self.at, self.empty = similarity, [], [], {}, None

    def copied(self, mine: np.ndarray, of: int, keep: bool = True) -> int | None:
        """The id of a kept set that is similar; if none is, this one is kept, unless keep says no."""
        n = len(mine)
        if not n:
            known, self.empty = self.empty, of if self.empty is None and keep else self.empty
            return known
        head = mine[: prefix_size(n, self.similarity)].tolist()
        seen = set()
        for h in head:
            for k in self.at.get(h, ()):
                if k not in seen:
                    seen.add(k)
                    if similar(mine, self.sets[k], self.similarity):
                        return self.ids[k]
        if not keep:
            return None
        for h in head:
            self.at.setdefault(h, []).append(len(self.sets))
        self.sets.append(mine)
        self.ids.append(of)
        return None


def _decided(members: DataFrame, similarity: float, *keys: str) -> DataFrame:
    """members (component, salt, id, hashes) with the id before them under the same keys that they are similar to (by)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keeper = None, Keeper(similarity)
        for batch in _small(batches):
            groups = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            by, held = [], []
            for group, i, data in zip(groups, batch.column("id").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                if group != now:
                    now, keeper = group, Keeper(similarity)
                by.append(keeper.copied(np.frombuffer(data, np.uint64), i))
                held.append(data if by[-1] is None else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("component", "salt", "id")], pa.array(held, pa.binary()), pa.array(by, pa.int64())], names=["component", "salt", "id", "hashes", "by"])

    return members.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(K.frugal(each), "component long, salt int, id long, hashes binary, by long")


def grouped_copies(rows: DataFrame, radius: int, similarity: float, total: int) -> DataFrame:
    """(id, by): documents of linked fingerprints that are similar to a smaller one (by) of their group, written."""
    known = materialize(S.linked_rows(rows.select("id", "fp"), radius).select("id", F.col("component_id").alias("component")), "grouped", total)
    lost = settled(rows, known.join(known.where("id <> component").select("component").distinct(), "component", "left_semi"), similarity, total)
    drop_table(known)
    return lost


def settled(rows: DataFrame, groups: DataFrame, similarity: float, total: int) -> DataFrame:
    """(id, by): documents of the groups (id, component) that are similar to another one (by) of their group, written."""
    groups = materialize(groups.select("id", "component", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")), "groups", total)
    held = members = semi(rows.select("id", "hashes"), groups, "members")
    first = materialize(_decided(members.join(groups, "id").select("component", "salt", "id", "hashes"), similarity, "component", "salt"), "decided")
    again = materialize(_decided(first.where("by is null").drop("by"), similarity, "component").select("id", "by"), "decided")
    gone = again.where("by is not null")
    told = first.where("by is not null").select("component", "salt", "id", "by")
    # those that went for one that went among the kept ones of other parts
    fewer = F.pmod(F.col("salt"), F.lit(ASKING_SALTS)).alias("salt")
    asked = materialize(told.join(gone.select(F.col("id").alias("by")), "by", "left_semi").select("component", fewer, "id"), "asked", total)
    still = told.join(asked.select("id"), "id", "left_anti").select("id", "by")
    kept = first.join(again.where("by is null").select("id"), "id", "left_semi").select("component", "id", "hashes")
    kept = asked.select("component", "salt").distinct().join(kept, "component").select("component", "salt", "id", "hashes", F.lit(0).alias("asks"))
    members = members.join(asked, "id").select("component", "salt", "id", "hashes", F.lit(1).alias("asks"))
    lost = materialize(still.unionByName(gone).unionByName(_copies_of_kept(kept.unionByName(members), similarity)), "lost", total)
    drop_table(groups, held, first, again, asked)
    return lost


def _copies_of_kept(rows: DataFrame, similarity: float) -> DataFrame:
    """(id, by): rows that ask and are similar to one that doesn't, of the same component and part."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keeper = None, Keeper(similarity)
        for batch in _small(batches):
            found = []
            for component, salt, i, data, asks in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (component, salt) != now:
                    now, keeper = (component, salt), Keeper(similarity)
                by = keeper.copied(np.frombuffer(data, np.uint64), i, keep=not asks)
                if asks and by is not None and by != i:
                    found.append((i, by))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["id", "by"])

    return rows.repartition("component", "salt").sortWithinPartitions("component", "salt", "asks", "id").mapInArrow(K.frugal(each), "id long, by long")


# --- all similar pairs --------------------------------------------------------------------------------------------


class Order:
    """The common order of hashes: by how many of the bitmaps of frequent ones have them, then by value.

    bits: leading bits of a hash that tell its cell; often: bitmaps of cells; more: bitmaps of whole hashes.
    """

    def __init__(self, bits: int = 64, often: list[Bits] | None = None, more: list[Bits] | None = None) -> None:
        self.bits, self.often, self.more = bits, often or [], more or []

    def late(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        cells = hashes >> K.U64(64 - self.bits)
        for held in self.often:
            out += held.has(cells)
        for held in self.more:
            out += held.has(hashes)
        return out

    def free(self) -> None:
        for held in self.often + self.more:
            held.free()

    def _ranked(self, column: pa.Array, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All hashes and how late they come, the sets' sizes, and how many first hashes each has."""
        held = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
        size = np.array([len(x) for x in held], np.int64)
        take = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
        hashes = np.concatenate([*held, np.zeros(0, np.uint64)])
        return hashes, self.late(hashes), size, take

    def prefixes(self, column: pa.Array, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The first hashes of all sets, whether they come late, how many hashes their set has from each on, how many each set gave, and the sets' sizes."""
        hashes, off, size, take = self._ranked(column, similarity)
        row = np.repeat(np.arange(len(size)), size)
        order = np.argsort((len(self.often) + len(self.more) + 1) * row + off, kind="stable")
        rest = np.repeat(np.cumsum(size), size) - np.arange(len(hashes))
        first = np.repeat(size, size) - rest < np.repeat(take, size)
        mine = order[first]
        return hashes[mine], off[mine] > 0, rest[first], take, size

    def shared(self, column: pa.Array, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Whether late hashes are among the first ones of a set, and the least of its late hashes."""
        hashes, off, size, take = self._ranked(column, similarity)
        row, late = np.repeat(np.arange(len(size)), size), off > 0
        least = np.full(len(size), ~K.U64(0))
        np.minimum.at(least, row[late], hashes[late])
        return size - np.bincount(row[late], minlength=len(size)) < take, least


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin, and how long they are."""
    lead = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return lead, np.diff(np.append(lead, len(keys)))


def _filtered(batches: Iterator[pa.RecordBatch], lost: Bits | None) -> Iterator[pa.RecordBatch]:
    """The rows whose id can't be in lost."""
    for batch in batches:
        if lost is not None:
            batch = batch.filter(pa.array(~lost.has(batch.column("id").to_numpy())))
        if batch.num_rows:
            yield batch


def cell_block(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted cells (32 bits) and their counts, packed: gaps and counts by bytes of equal rank."""
    gaps = np.diff(cells, prepend=cells[:1] * 0).astype("<u4")
    planes = np.concatenate([gaps.view(np.uint8).reshape(-1, 4).T.ravel(), counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()])
    return pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def block_cells(block: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells and counts of a block of so many."""
    planes = np.frombuffer(pa.Codec("zstd").decompress(block, decompressed_size=8 * size, asbytes=True), np.uint8)
    gaps, counts = (np.ascontiguousarray(planes[k * 4 * size : (k + 1) * 4 * size].reshape(4, size).T).view("<u4").ravel() for k in range(2))
    return np.cumsum(gaps, dtype=np.int64), counts.astype(np.int64)


def _counted(cells: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, with the sums of their counts."""
    at = np.argsort(cells, kind="stable")
    lead, _ = _runs(cells[at])
    return cells[at][lead], np.add.reduceat(counts[at], lead) if len(lead) else counts


def frequency_order(parts: list[tuple[DataFrame, Bits | None]]) -> Order:
    """The order that puts hashes of few sets first: one pass counts the cells of all hashes of the sets.

    parts: rows (id, n, hashes), and ids to leave out. A cell counts at least what each of its hashes does, so every hash in
    more than MOST_SHARED sets comes late; a few others may too, which changes the order and no result.
    """
    total = max(int(part.agg(F.sum("n")).first()[0] or 0) for part, _ in parts) or 1
    part_bits = max(total.bit_length() - COUNTED_AT_ONCE, 0)
    bits = part_bits + min(total.bit_length(), COUNTED_AT_ONCE) + CELLS
    rest = bits - part_bits
    steps = [MOST_SHARED * STEP**k for k in range(STEPS)]

    def counting(without: Bits | None):
        def told(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cells, counts = np.unique(np.concatenate(held) >> K.U64(64 - bits), return_counts=True)
            part = (cells >> K.U64(rest)).astype(np.int64)
            lead, size = _runs(part)
            inner = cells & K.U64((1 << rest) - 1)
            blocks = [cell_block(inner[a : a + n], counts[a : a + n]) for a, n in zip(lead.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[lead]), pa.array(size.astype(np.int32)), pa.array(blocks, pa.binary())], names=["part", "size", "block"])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, count = [], 0
            for batch in _small(_filtered(batches, without)):
                held.append(np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64))
                count += len(held[-1])
                if count >= 4 * _FLUSH:
                    yield from told(held)
                    held, count = [], 0
            if count:
                yield from told(held)

        return each

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, count = None, [], 0

        def often() -> pa.RecordBatch:
            cells, counts = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            cells, counts = cells[counts > steps[0]], counts[counts > steps[0]]
            return pa.RecordBatch.from_arrays([pa.array(cells + (now << rest)), pa.array(np.searchsorted(steps, counts).astype(np.int32))], names=["cell", "steps"])

        for batch in batches:
            for part, size, block in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if part != now and held:
                    yield often()
                    held, count = [], 0
                now = part
                held.append(block_cells(block, size))
                count += size
                if count >= 8 * _FLUSH:
                    held = [_counted(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    count = 0
        if held:
            yield often()

    blocks = _union([part.select("id", "hashes").mapInArrow(K.frugal(counting(without)), "part long, size int, block binary") for part, without in parts])
    common = materialize(blocks.repartition("part").sortWithinPartitions("part").mapInArrow(K.frugal(summed), "cell long, steps int"), "common")
    often = [Bits(common.where(F.col("steps") > k), "cell") for k in range(STEPS)]
    drop_table(common)
    return Order(bits, often)


def prefix_rows(rows: DataFrame, similarity: float, order: Order, lost: Bits | None = None, among: Bits | None = None) -> DataFrame:
    """(hash, late, id, n, rest, signature): the first hashes of the sets of rows (id, signature, hashes).

    rest: how many hashes the set has from this one on. signature: the set's beside late hashes, else null.
    lost: ids to leave out. among: only hashes that may be members.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(_filtered(batches, lost)):
            hashes, late, rest, take, size = order.prefixes(batch.column("hashes"), similarity)
            row = np.repeat(np.arange(len(take)), take)
            if among is not None:
                may = among.has(hashes)
                hashes, late, rest, row = hashes[may], late[may], rest[may], row[may]
            ids, size = batch.column("id").to_numpy()[row], size[row]
            for at in range(0, len(row), PREFIXES_AT_ONCE):
                part = slice(at, at + PREFIXES_AT_ONCE)
                told = batch.column("signature").take(pa.array(row[part], mask=~late[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[part].view(np.int64)), pa.array(late[part]), pa.array(ids[part]), pa.array(size[part].astype(np.int32)), pa.array(rest[part].astype(np.int32)), told],
                    names=["hash", "late", "id", "n", "rest", "signature"],
                )

    return rows.select("id", "signature", "hashes").mapInArrow(K.frugal(each), "hash long, late boolean, id long, n int, rest int, signature binary")


def shared_groups(parts: list[tuple[DataFrame, Bits | None]], similarity: float, order: Order) -> DataFrame:
    """(id, component), written: sets whose first hashes come to widely shared ones, by the least of those that they have.

    Similar sets mostly have the same least one. Only such sets can meet in runs that grow with the corpus.
    """

    def asked(without: Bits | None):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _small(_filtered(batches, without)):
                may, least = order.shared(batch.column("hashes"), similarity)
                yield pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(may)), pa.array(least[may].view(np.int64))], names=["id", "component"])

        return each

    known = materialize(_union([part.select("id", "hashes").mapInArrow(K.frugal(asked(without)), "id long, component long") for part, without in parts]), "shared")
    found = materialize(known.join(known.groupBy("component").count().where("count > 1").select("component"), "component", "left_semi").select("id", "component"), "shared")
    drop_table(known)
    return found


class Signatures:
    """Signatures (or nulls) side by side, for counting the cells in which pairs of them differ."""

    def __init__(self, held: np.ndarray) -> None:
        self.size = np.array([0 if x is None else len(x) for x in held], np.int64)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sizes = np.unique(self.size[self.size > 0]).tolist()
        for least in sizes:  # the larger ones folded
            at, words, count = np.zeros(len(held), np.int64), [], 0
            for size in sizes:
                if size >= least:
                    rows = np.flatnonzero(self.size == size)
                    at[rows] = count + np.arange(len(rows))
                    count += len(rows)
                    words.append(np.bitwise_xor.reduce(np.frombuffer(b"".join(held[rows]), np.uint64).reshape(len(rows), size // least, -1), axis=1))
            self.known[least] = at, np.concatenate(words)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many cells the signatures differ at least; none where one isn't known."""
        out, least = np.zeros(len(i), np.int64), np.minimum(self.size[i], self.size[j])
        for size, (at, words) in self.known.items():
            some = np.flatnonzero(least == size)
            for k in range(0, len(some), max(1, COMPARED_BYTES // size)):
                part = some[k : k + max(1, COMPARED_BYTES // size)]
                out[part] = np.bitwise_count(words[at[i[part]]] ^ words[at[j[part]]]).sum(axis=1)
        return out


def _pairs_in_runs(ids: np.ndarray, n: np.ndarray, rest: np.ndarray, held: Signatures, hashes: np.ndarray, similarity: float, side: np.ndarray | None) -> Iterator[np.ndarray]:
    """(pairs, 2): larger and smaller id of each two rows of a run that may be similar; side: or one of either side.

    Two sets have in common at most what the shorter rest holds from their first common hash on, and similar ones have
    t / (1 + t) of both sizes in common; so they meet in that hash. Signatures rule out pairs of runs that may be long.
    """

    def fit(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        both = n[i] + n[j]
        ok = (np.minimum(rest[i], rest[j]) >= similarity / (1 + similarity) * both - 1e-6) & (ids[i] != ids[j])
        if side is not None:
            ok &= side[i] != side[j]
        i, j, both = i[ok], j[ok], both[ok]
        ok = held.apart(i, j) <= (1 - similarity) / (1 + similarity) * both + 1e-6
        i, j = i[ok], j[ok]
        if side is None:
            return np.stack([np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])], axis=1)
        return np.stack([np.where(side[i], ids[i], ids[j]), np.where(side[i], ids[j], ids[i])], axis=1)

    lead, size = _runs(hashes)
    for s in np.unique(size[size > 1]).tolist():
        at = lead[size == s]
        if s <= 256:
            i, j = np.triu_indices(s, 1)
            for k in range(0, len(at), max(1, (1 << 18) // len(i))):
                some = at[k : k + max(1, (1 << 18) // len(i)), None]
                yield fit((some + i).ravel(), (some + j).ravel())
        else:
            for start in at.tolist():
                for k in range(1, s):
                    yield fit(np.full(k, start + k), start + np.arange(k))


def meetings(prefixes: DataFrame, similarity: float, sides: bool = False) -> DataFrame:
    """(a, b): pairs that meet in a hash, a > b (sides: a of the side that is marked)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            lead, _ = _runs(held[0])
            if len(lead) > 1:
                cut = lead[-1]
                yield from out([x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if held is not None:
            yield from out(held)

    def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes, ids, n, rest, told = columns[:5]
        found, count = [], 0
        for pairs in _pairs_in_runs(ids, n, rest, Signatures(told), hashes, similarity, columns[5] if sides else None):
            found.append(pairs)
            count += len(pairs)
            if count >= _FLUSH:
                yield batch(found)
                found, count = [], 0
        if count:
            yield batch(found)

    def batch(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = _unique_pairs(found)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in range(2)], names=["a", "b"])

    keys = ["hash", "id", "n", "rest", "signature", *["asks"] * sides]
    return prefixes.select(*keys).repartition("hash").sortWithinPartitions("hash", "id").mapInArrow(K.frugal(each), "a long, b long")


def _unique_pairs(found: list[np.ndarray]) -> np.ndarray:
    pairs = np.concatenate(found)
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    return pairs[new]


def verified(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar, written: by signatures first, then by the sets themselves."""
    most = (1 - similarity) / (1 + similarity)

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            na, nb, sa, sb = (batch.column(k).to_pylist() for k in ("na", "nb", "sa", "sb"))
            keep = [cells_apart(x, y) <= most * (m + n) + 1e-6 for m, n, x, y in zip(na, nb, sa, sb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def are(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            both = zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in both], pa.bool_()))

    def beside(left: DataFrame, told: DataFrame, **columns: str) -> DataFrame:
        for k in ("a", "b"):
            left = left.join(told.select(F.col("id").alias(k), *[F.col(c).alias(f"{short}{k}") for short, c in columns.items()]), k)
        return left

    likely = materialize(beside(pairs.distinct(), rows, n="n", s="signature").mapInArrow(K.frugal(may), "a long, b long"), "likely")
    asked = semi(rows.select("id", "hashes"), likely.select(F.explode(F.array("a", "b")).alias("id")), "asked")
    found = materialize(beside(likely, asked, h="hashes").mapInArrow(K.frugal(are), "a long, b long"), "pairs")
    drop_table(likely, asked)
    return found


def similar_pairs(rows: DataFrame, similarity: float, lost: DataFrame | None, total: int) -> tuple[DataFrame, DataFrame | None, Order]:
    """(a, b), a > b: all similar pairs among rows whose id isn't lost, written; those lost by then; the order of the hashes.

    lost: (id, by). Sets of widely shared hashes are settled in groups first and join the lost ones, so that a group
    of near copies doesn't meet pair by pair.
    """
    parts, gone, doubtful = _left(rows, lost)
    order = frequency_order(parts)
    groups = shared_groups(parts, similarity, order)
    if not groups.isEmpty():
        more = settled(rows, groups, similarity, total)
        if not more.isEmpty():
            _free(gone, doubtful)
            lost = materialize(more if lost is None else lost.unionByName(more), "lost", total)
            parts, gone, doubtful = _left(rows, lost)
        drop_table(more)
    met = materialize(meetings(_union([prefix_rows(part, similarity, order, without) for part, without in parts]), similarity), "meetings")
    found = verified(met, rows, similarity)
    drop_table(met, groups)
    _free(gone, doubtful)
    return found, lost, order


def _left(rows: DataFrame, lost: DataFrame | None) -> tuple[list[tuple[DataFrame, Bits | None]], Bits | None, DataFrame | None]:
    """The rows that aren't lost, in parts with bitmaps of ids to leave out; and what is to be freed after use."""
    if lost is None:
        return [(rows, None)], None, None
    gone = Bits(lost, "id")
    doubtful = _kept_of(rows, gone, lost)
    return [(rows, gone), (doubtful, None)], gone, doubtful


def _free(gone: Bits | None, doubtful: DataFrame | None) -> None:
    if gone is not None:
        drop_table(doubtful)
        gone.free()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _kept_of(rows: DataFrame, gone: Bits, lost: DataFrame) -> DataFrame:
    """The rows that the bitmap of lost ids lets through though they aren't lost, written."""

    def doubtful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(gone.has(batch.column("id").to_numpy())))

    held = rows.select("id", "n", "signature", "hashes").mapInArrow(K.frugal(doubtful), "id long, n int, signature binary, hashes binary")
    return materialize(held.join(lost.select("id").distinct(), "id", "left_anti"), "doubtful")


def pairs_between(asked: DataFrame, rows: DataFrame, lost: DataFrame, similarity: float, order: Order) -> DataFrame:
    """(a, b): all similar pairs of a row of asked and one of rows that isn't lost, written."""
    firsts = prefix_rows(asked, similarity, order)
    order = Order(order.bits, order.often, [Bits(firsts.where("not late").groupBy("hash").count().where(F.col("count") > MOST_SHARED), "hash")])
    mine = materialize(prefix_rows(asked, similarity, order), "asking")
    among, gone = Bits(mine, "hash"), Bits(lost, "id")
    doubtful = _kept_of(rows, gone, lost)
    theirs = prefix_rows(rows, similarity, order, lost=gone, among=among).unionByName(prefix_rows(doubtful, similarity, order, among=among))
    both = mine.withColumn("asks", F.lit(True)).unionByName(theirs.withColumn("asks", F.lit(False)))
    found = verified(meetings(both, similarity, sides=True).select("a", "b"), rows, similarity)
    drop_table(mine, doubtful)
    among.free()
    gone.free()
    order.more[0].free()
    return found


# --- who stays ----------------------------------------------------------------------------------------------------


def _gone(pairs: DataFrame) -> DataFrame:
    """(id, by) that go along similar pairs (a > b), in order of id: those with a smaller one that stays."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gone = None, set()
        for batch in batches:
            out = []
            for component, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if component != now:
                    now, gone = component, set()
                if a not in gone and b not in gone:
                    gone.add(a)
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["id", "by"])

    told = pairs.join(connected_components(pairs).withColumnRenamed("node", "a"), "a").select("component", "a", "b")
    return materialize(told.repartition("component").sortWithinPartitions("component", "a", "b").mapInArrow(each, "id long, by long"), "gone")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """(id) of the documents to drop: each is a near copy of one that stays."""
    rows = set_rows(docs, id_col, text_col, shingle)
    total = rows.count()
    dropped = _dropped(rows, grouped_copies(rows, radius, similarity, total), similarity, total)
    drop_table(rows)
    return dropped


def _dropped(rows: DataFrame, lost: DataFrame | None, similarity: float, total: int) -> DataFrame:
    """(id) of the rows to drop, written; lost: (id, by) that have gone for a similar one before."""
    pairs, lost, order = similar_pairs(rows, similarity, lost, total)
    gone = _gone(pairs)
    dropped = materialize(gone if lost is None else lost.unionByName(gone), "dropped", total)
    # those that went for one that has gone
    orphans = materialize(dropped.join(dropped.select(F.col("id").alias("by")).distinct(), "by", "left_semi").select("id").distinct(), "orphans", total)
    if orphans.isEmpty():
        order.free()
        return dropped.select("id")
    asked = semi(rows, orphans, "orphans")
    had = pairs_between(asked.select("id", "signature", "hashes"), rows, dropped, similarity, order)
    order.free()
    back = materialize(asked.join(had.select(F.col("a").alias("id")).distinct(), "id", "left_anti").select(*asked.columns), "back")
    drop_table(asked, had)
    if back.isEmpty():
        return dropped.select("id")
    # decided among themselves, as the rows were; they are fewer, as the least id never goes
    returned = back.select("id").join(_dropped(back, None, similarity, total), "id", "left_anti")
    found = materialize(dropped.select("id").distinct().join(returned, "id", "left_anti"), "dropped", total)
    drop_table(back, dropped)
    return found
