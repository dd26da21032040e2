"""Byte-level BPE over whole batches: pretokens are found with array operations and each distinct one is encoded once.

The pretokeniser follows the public pattern of this vocabulary family: a contraction, an optional space before
letters, before digits or before other characters, and runs of white space that leave their last character to
what follows. Ids equal those of the tokenizers library with add_special_tokens=False, special strings being text.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa

from pagelode.llm import kernels as K

#: The contractions of the pattern, and the code points that count as white space.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
OTHER, LETTER, NUMBER, SPACE = range(4)

_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """For each code point, whether it is a letter, number, white space or something else."""
    if not _CLASSES:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[list(SPACES)] = SPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 bytes, and the byte at which each begins."""
    at = np.flatnonzero(K.LEADING[data])
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4")
    return points, at


def pretokens(points: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """Positions at which a pretoken begins. row_at: the first position of each row, and the end."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[row_at] = True
    begin = opens[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    ends_run = space.copy()  # last of a run of white space that something follows in the row
    ends_run[:-1] &= ~space[1:]
    ends_run &= ~opens[1:]
    begin |= ends_run
    lent = np.flatnonzero(ends_run & (points == 0x20)) + 1  # the space goes with what follows
    begin[lent] = False
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        before = kind[quote - 1]
        free = opens[quote] | (before == LETTER) | (before == NUMBER) | ((before == SPACE) & (points[quote - 1] != 0x20))
        quote = quote[free]
        row_end = row_at[np.searchsorted(row_at, quote, side="right")]
        for text in CONTRACTIONS:
            size = len(text)
            hit = quote[quote + size <= row_end]
            for k in range(1, size):
                hit = hit[points[hit + k] == ord(text[k])]
            for k in range(1, size):
                begin[hit + k] = False
            after = hit + size
            after = after[after < n]
            begin[after] = True
    return np.flatnonzero(begin)


class SpanCache:
    """Token ids of byte spans: distinct spans are encoded once and kept until there are too many."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 1 << 20) -> None:
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, K.U64)
        self.index = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.edge = np.zeros(1, np.int64)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The cache's entry for each span; unknown ones are encoded first."""
        back, key = pd.factorize(K.hash_spans(data, starts, ends)[0])
        first = np.zeros(len(key), np.int64)
        first[back[::-1]] = np.arange(len(back) - 1, -1, -1)
        if len(self.known) > self.most:
            self.clear()
        spot = np.searchsorted(self.known, key)
        hit = spot < len(self.known)
        hit[hit] = self.known[spot[hit]] == key[hit]
        new = np.flatnonzero(~hit)
        if len(new):
            view = memoryview(np.ascontiguousarray(data))
            got = self.encode([bytes(view[a:b]) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            entry = len(self.edge) - 1 + np.arange(len(new))
            self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum([len(x) for x in got])])
            self.ids = np.concatenate([self.ids, np.fromiter((i for x in got for i in x), np.uint32)])
            order = np.argsort(key[new])
            self.known = np.insert(self.known, spot[new][order], key[new][order])
            self.index = np.insert(self.index, spot[new][order], entry[order])
            spot = np.searchsorted(self.known, key)
        return self.index[spot][back]

    def spread(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the given entries one after another, and where each entry's begin (entries + 1 numbers)."""
        return spread(self.ids, self.edge, which)


def spread(ids: np.ndarray, edge: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids that `which` names, one after another, and where each begins."""
    sizes = (edge[1:] - edge[:-1])[which]
    total = np.concatenate([[0], np.cumsum(sizes)])
    return ids[np.arange(total[-1]) + np.repeat(edge[which] - total[:-1], sizes)], total


class ByteBPE:
    """Byte-level BPE of whole columns."""

    def __init__(self, path: str) -> None:
        from tiktoken import _tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        bpe = _tiktoken.CoreBPE(dict(_byte_ranks(vocabulary)), {}, r"(?s).+")
        self.cache = SpanCache(lambda spans: [bpe.encode_single_piece(x) for x in spans])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin."""
        data, offsets = K.text_buffer(column)
        points, at = code_points(data)
        row_at = np.searchsorted(at, offsets)
        begin = pretokens(points, row_at)
        starts = at[begin]
        ids, total = self.cache.spread(self.cache.lookup(data, starts, np.append(starts[1:], len(data))))
        return ids, total[np.searchsorted(begin, row_at)]


def _byte_ranks(vocabulary: dict[str, int]):
    """The bytes of each entry, whose text shows byte values as printable characters."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
    for text, i in vocabulary.items():
        if all(c in byte_of for c in text):
            yield bytes(byte_of[c] for c in text), i


_ENCODERS: dict[str, ByteBPE] = {}


def encoder(path: str) -> ByteBPE:
    """One encoder for each vocabulary file and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBPE(path)
    return _ENCODERS[path]


