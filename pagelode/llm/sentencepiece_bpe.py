"""SentencePiece merge-type encoding and decoding, with seeded merge-dropout.

Method. A text gets a leading space, spaces become the vocabulary's space mark, and the agenda merges neighbouring
symbols: always the best-ranked candidate, leftmost on ties. With dropout a candidate is skipped if a keyed hash of
(seed, document, span, place, symbols) falls below the rate, so the same key always gives the same segmentation and other
keys give others. Characters outside the vocabulary become byte tokens, also the space mark itself where a text has
it, so that every segmentation decodes to the very same text. Without dropout ids equal the sentencepiece library's.

No piece has a space mark after another character, so spans that begin with spaces never merge with each other:
all spans of a batch are merged in step. A span of over 128 symbols has its own agenda. A span's key comes from its
document's key and its place, so it doesn't depend on partitions and every occurrence of a word is drawn anew. Distinct spans
are merged once without dropout; an occurrence whose key skips none of the candidates met there shares the result, as its
agenda is the same, and all others are merged apart.

Defined cases. Null or empty text: no tokens, lossless. Null id: key 0. Repeated rows give equal ids.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelode.llm import kernels as K
from pagelode.llm.tokens import spread

RATE = 0.1
SEED = 20_240_607
#: Keys a span can have; 0: every occurrence its own.
VARIANTS = 0
SLICE_BYTES = 4 << 20
LONG_SPAN = 128
MARK = 0x2581


class Vocabulary:
    """Pieces, the merges they allow, and their bytes, read from a public model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        text = {model.id_to_piece(i): i for i in normal}
        if any(chr(MARK) in t.lstrip(chr(MARK)) for t in text):
            raise ValueError("a piece has a space mark after another character")
        rank = {i: n for n, i in enumerate(sorted(normal, key=lambda i: (-model.get_score(i), i)))}
        self.rank = np.zeros(size, np.int64)
        self.rank[list(rank)] = list(rank.values())
        self.by_rank = np.array(sorted(rank, key=rank.get))
        self.char = np.full(0x110000, -1, np.int32)
        for t, i in text.items():
            if len(t) == 1:
                self.char[ord(t)] = i
        merges = {}
        for t, i in text.items():
            for k in range(1, len(t)):
                if t[:k] in text and t[k:] in text:
                    merges[text[t[:k]] << 20 | text[t[k:]]] = rank[i]
        self.shift = 64 - 20
        self._table(merges)
        byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte = np.array([byte[b] for b in range(256)])
        shown = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(chr(MARK), " ").encode() if rank.get(i) is not None else b"" for i in range(size)]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_edge = np.concatenate([[0], np.cumsum([len(x) for x in shown])])

    def _table(self, merges: dict[int, int]) -> None:
        """An open-addressed table from pair to rank, probed a fixed number of times."""
        keys, ranks = np.array(list(merges), np.int64), np.array(list(merges.values()), np.int64)
        size = 1 << self.bits(len(keys))
        self.shift = 64 - self.bits(len(keys))
        self.keys, self.ranks, self.probes = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int64), 0
        home = self._home(keys)
        left = np.arange(len(keys))
        while len(left):
            spot = home[left] + self.probes
            free = self.keys[spot] < 0
            _, one = np.unique(spot[free], return_index=True)
            take = np.flatnonzero(free)[one]
            self.keys[spot[take]], self.ranks[spot[take]] = keys[left[take]], ranks[left[take]]
            left = np.delete(left, take)
            self.probes += 1

    @staticmethod
    def bits(count: int) -> int:
        return max(8, (8 * count).bit_length())

    def _home(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)) >> K.U64(self.shift)).astype(np.int64)

    def merge_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that two symbols merge to, or a large number."""
        pair = left.astype(np.int64) << 20 | right
        home = self._home(pair)
        out = np.full(len(pair), NEVER, np.int64)
        rest = np.flatnonzero((left >= 0) & (right >= 0))
        for probe in range(self.probes):
            at = home[rest] + probe
            found = self.keys[at]
            hit = found == pair[rest]
            out[rest[hit]] = self.ranks[at[hit]]
            rest = rest[~hit & (found >= 0)]
            if not len(rest):
                break
        return out


NEVER = 1 << 40
_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each file and worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _skipped(key: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: int) -> np.ndarray:
    """Whether the keyed hash skips a candidate."""
    about = (place.astype(K.U64) << K.U64(40)) ^ (left.astype(K.U64) << K.U64(20)) ^ right.astype(K.U64)
    return (K.mix(key ^ K.mix(about + K.U64(0xA0761D6478BD642F))) >> K.U64(11)) < K.U64(threshold)


def merge_spans(v: Vocabulary, symbols: np.ndarray, edge: np.ndarray, key: np.ndarray, rate: float, offered: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run the agenda in every span: (span, place, symbol) of what is left, in order.

    offered: gets (span, place, symbol, symbol) of the candidates met, but for spans of over LONG_SPAN symbols.
    """
    threshold = int(rate * (1 << 53))
    size = np.diff(edge)
    span = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(symbols)) - np.repeat(edge[:-1], size)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in np.flatnonzero(size > LONG_SPAN).tolist():
        done.append(_long_span(v, symbols[edge[s] : edge[s + 1]], s, key[s], threshold))
    ids = np.flatnonzero((size <= LONG_SPAN) & (size > 0))  # the spans that still merge
    count = size[ids]
    small = size[span] <= LONG_SPAN
    place, symbol = place[small], symbols[small].astype(np.int64)

    def candidates(at: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Rank and place of merging the symbols at `at` with their successors, which the spans `of` have."""
        left, right = symbol[at], symbol[at + 1]
        found = v.merge_rank(left, right)
        if threshold or offered is not None:
            can = np.flatnonzero(found < NEVER)
            about = of[can], place[at[can]], left[can], right[can]
            if offered is not None:
                offered.append(about)
            if threshold:
                found[can[_skipped(key[about[0]], *about[1:], threshold)]] = NEVER
        return found << 8 | place[at]

    score = np.full(len(place), NEVER << 8)
    last = np.zeros(len(place), bool)
    last[np.cumsum(count) - 1] = True
    pairs = np.flatnonzero(~last)
    score[pairs] = candidates(pairs, span[small][pairs])
    while len(ids):
        best = np.minimum.reduceat(score, np.cumsum(count) - count)
        live = best < NEVER << 8
        if not live.all():
            stay = np.repeat(live, count)
            done.append((np.repeat(ids[~live], count[~live]), place[~stay], symbol[~stay]))
            place, symbol, score, ids, count, best = place[stay], symbol[stay], score[stay], ids[live], count[live], best[live]
            if not len(ids):
                break
        # every span merges one pair, its best and leftmost
        at = np.flatnonzero(score == np.repeat(best, count))
        symbol[at] = v.by_rank[best >> 8]
        keep = np.ones(len(place), bool)
        keep[at + 1] = False
        place, symbol, score = place[keep], symbol[keep], score[keep]
        at -= np.arange(len(at))
        count -= 1
        end = np.cumsum(count)
        score[at] = NEVER << 8
        after, before = np.flatnonzero(at + 1 < end), np.flatnonzero(at > end - count)
        touched = np.concatenate([at[after], at[before] - 1])
        score[touched] = candidates(touched, np.concatenate([ids[after], ids[before]]))
    if not done:
        none = np.zeros(0, np.int64)
        return none, none, none
    span, place, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.lexsort((place, span))
    return span[order], place[order], symbol[order]


def _long_span(v: Vocabulary, symbols: np.ndarray, span: int, key, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same agenda as a heap over a linked list."""
    n = len(symbols)
    symbol = symbols.astype(np.int64).tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda: list[tuple[int, int, int, int]] = []

    def offer(places: list[int]) -> None:
        places = [p for p in places if p >= 0 and after[p] < n]
        if not places:
            return
        a = np.array([symbol[p] for p in places])
        b = np.array([symbol[after[p]] for p in places])
        rank = v.merge_rank(a, b)
        if threshold:
            rank[_skipped(np.full(len(a), key, K.U64), np.array(places), a, b, threshold)] = NEVER
        for p, r, x, y in zip(places, rank.tolist(), a.tolist(), b.tolist(), strict=True):
            if r < NEVER:
                heapq.heappush(agenda, (r, p, x, y))

    offer(list(range(n)))
    gone = bytearray(n)
    while agenda:
        rank, p, a, b = heapq.heappop(agenda)
        q = after[p]
        if gone[p] or q >= n or symbol[p] != a or symbol[q] != b:
            continue
        symbol[p], gone[q] = int(v.by_rank[rank]), 1
        after[p] = after[q]
        if after[q] < n:
            before[after[q]] = p
        offer([p, before[p]])
    left = np.flatnonzero(np.frombuffer(gone, np.uint8) == 0)
    return np.full(len(left), span), left, np.array(symbol, np.int64)[left]


def encode(v: Vocabulary, column: pa.Array, keys: np.ndarray, rate: float, seed: int, variants: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, and where each text's begin."""
    data, offsets = K.text_buffer(column)
    rows = len(offsets) - 1
    full = np.diff(offsets) > 0
    shift = np.concatenate([[0], np.cumsum(full)])
    spaced = np.insert(data, offsets[:-1][full], 0x20)  # the leading space
    offsets = offsets + shift
    if not len(spaced):
        return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
    space, line = spaced == 0x20, spaced == 0x0A
    begin = np.zeros(len(spaced), bool)
    begin[offsets[:-1][full]] = True
    begin[1:] |= (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(spaced))
    before = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(rows), np.diff(before))
    code = K.hash_spans(spaced, starts, ends)[0]
    key = np.zeros(len(starts), K.U64)
    if rate > 0:
        place = np.arange(len(starts)) - before[row]
        key = K.mix(K.mix(keys.astype(np.int64).view(K.U64))[row] + place.astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
        if variants:
            key = key % K.U64(variants)
    shared = rate <= 0 or bool(variants)
    back, distinct = pd.factorize(code ^ K.mix(key + K.U64(1)) if shared else code)
    first = np.zeros(len(distinct), np.int64)
    first[back[::-1]] = np.arange(len(back) - 1, -1, -1)
    key = K.mix(key + K.U64(seed))
    if shared:
        ids, edge = _merged(v, spaced, starts[first], ends[first], key[first], rate)
    else:
        offered: list[tuple[np.ndarray, ...]] = []
        ids, edge = _merged(v, spaced, starts[first], ends[first], key[first], 0.0, offered)
        apart = np.flatnonzero(_differs(offered, back, len(first), key, int(rate * (1 << 53))) | (ends - starts > LONG_SPAN))
        more, more_edge = _merged(v, spaced, starts[apart], ends[apart], key[apart], rate)
        back[apart] = len(first) + np.arange(len(apart))
        ids, edge = np.concatenate([ids, more]), np.concatenate([edge, edge[-1] + more_edge[1:]])
    ids, total = spread(ids, edge, back)
    return ids, total[before]


def _differs(offered: list[tuple[np.ndarray, ...]], back: np.ndarray, count: int, key: np.ndarray, threshold: int) -> np.ndarray:
    """For each occurrence, whether its key skips one of the candidates offered in its distinct span."""
    span, place, left, right = (np.concatenate(x) for x in zip(*offered, strict=True))
    order = np.argsort(span, kind="stable")
    edge = np.concatenate([[0], np.cumsum(np.bincount(span, minlength=count))])
    at, total = spread(order, edge, back)
    skip = _skipped(np.repeat(key, np.diff(total)), place[at], left[at], right[at], threshold)
    return K.row_sums(skip, total) > 0


def _merged(v: Vocabulary, spaced: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: np.ndarray, rate: float, offered: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the given spans one after another, and where each span's begin."""
    size = ends - starts
    edge = np.concatenate([[0], np.cumsum(size)])
    if not len(starts):
        return np.zeros(0, np.uint32), edge
    source = np.arange(edge[-1]) + np.repeat(starts - edge[:-1], size)
    piece = spaced[source]
    at = np.flatnonzero(K.LEADING[piece])
    points = np.frombuffer(piece.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    symbol = np.where(points == MARK, -1, v.char[np.where(points == 0x20, MARK, points)])
    point_edge = np.searchsorted(at, edge)
    span, place, symbol = merge_spans(v, symbol, point_edge, key, rate, offered)
    # unknown characters turn into their bytes
    where = point_edge[span] + place
    width = np.where(symbol >= 0, 1, np.append(at, len(piece))[where + 1] - at[where])
    total = np.concatenate([[0], np.cumsum(width)])
    ids = np.repeat(symbol, width)
    unknown = np.repeat(symbol < 0, width)
    ids[unknown] = v.byte[piece[(np.arange(total[-1]) - np.repeat(total[:-1] - at[where], width))[unknown]]]
    return ids.astype(np.uint32), total[np.searchsorted(span, np.arange(len(starts) + 1))]


def decode(v: Vocabulary, ids: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, and where each begins."""
    data, total = spread(v.shown, v.shown_edge, ids.astype(np.int64))
    offsets = total[edge]
    full = np.diff(offsets) > 0
    keep = np.ones(len(data), bool)
    keep[offsets[:-1][full]] = False  # the leading space
    return data[keep], offsets - np.concatenate([[0], np.cumsum(full)])


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, seed: int = SEED, variants: int = VARIANTS, with_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_crc32, lossless, text_sha256[, ids]): the encoding, and what it decodes to."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in batches:
            for part in K.slices(batch, "text", SLICE_BYTES):
                keys = part.column("id").fill_null(0).to_numpy(zero_copy_only=False)
                ids, edge = encode(v, part.column("text"), keys, rate, seed, variants)
                text, offsets = decode(v, ids, edge)
                data, origin = K.text_buffer(part.column("text"))
                words, back, given = memoryview(ids.astype("<u4")), memoryview(text), memoryview(np.ascontiguousarray(data))
                spans = list(zip(edge.tolist(), edge[1:].tolist(), strict=False))
                views = [back[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
                columns = [
                    part.column("id"),
                    pa.array(np.diff(edge), pa.int64()),
                    pa.array([zlib.crc32(words[a:b]) for a, b in spans], pa.int64()),
                    pa.array([x == given[a:b] for x, a, b in zip(views, origin.tolist(), origin[1:].tolist(), strict=False)], pa.bool_()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in views], pa.string()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_crc32", "lossless", "text_sha256", *["ids"] * with_ids])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(K.frugal(each), "id long, n_tokens long, ids_crc32 long, lossless boolean, text_sha256 string" + (", ids array<int>" if with_ids else ""))


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): what rows of ids decode to. Null ids give an empty text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path)
        for batch in batches:
            held = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            edge = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int64)
            text, offsets = decode(v, np.concatenate([*held, np.zeros(0, np.int64)]), edge)
            yield pa.RecordBatch.from_arrays([batch.column("id"), K.string_array(text, offsets).cast(pa.string())], names=["id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(K.frugal(each), "id long, text string")
