"""Ids of words, encoded once each: what makes a subword tokenizer cheap on a corpus.

A text is cut where its tokenizer can never join, each distinct piece is
encoded once and remembered, and a text's ids are gathered from the store.
The store is emptied when it holds ``limit`` pieces or ``limit_bytes`` of them
and their ids, which bounds its memory and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The spans ``flat[s : s + n]``, one after the other."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])]


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct pieces that lie one after the other in ``data``, and of each piece which it is."""
    column = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    coded = column.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


class WordStore:
    def __init__(self, encode: Callable[[list[str]], Iterable[Sequence[int]]], limit: int = 300_000, limit_bytes: int = 64 << 20):
        self.encode, self.limit, self.limit_bytes = encode, limit, limit_bytes
        self.clear()

    def clear(self) -> None:
        self.index: dict[str | bytes, int] = {}
        self.held = 0
        self.flat, self.starts, self.lengths = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _room(self) -> None:
        if len(self.index) > self.limit or self.held > self.limit_bytes:
            self.clear()

    def _add(self, new: list) -> None:
        found = self.encode(new)
        if isinstance(found, tuple):  # ids, where each piece's lie in them, how many they are
            flat, starts, lengths = found
        else:
            found = list(found)
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            flat, starts = np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum())), np.cumsum(lengths) - lengths
        self.held += sum(map(len, new)) + flat.nbytes
        starts = len(self.flat) + starts
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        self.flat, self.starts, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.starts, starts]), np.concatenate([self.lengths, lengths])

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces that lie one after the other in ``data``, and each piece's offsets into them."""
        return self.coded(*distinct(data, offsets))

    def coded(self, pieces: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``spans``, of pieces given as indexes into distinct ones, which Python sees once each."""
        self._room()
        _, ends, held = pieces.buffers()
        ends, held = np.frombuffer(ends, np.int32, len(pieces) + 1).tolist(), held.to_pybytes() if held else b""
        names = [held[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        new = [p for p in names if p not in self.index]
        if new:
            self._add(new)
        at = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))[codes]
        lengths = self.lengths[at]
        return gather(self.flat, self.starts[at], lengths), np.concatenate([[0], np.cumsum(lengths)])

    def ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts given as pieces, and each text's offsets into them."""
        self._room()
        new = list(set().union(*texts) - self.index.keys())
        if new:
            new.sort()
            self._add(new)
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(texts)), np.int64, int(counts.sum()))
        lengths = self.lengths[at]
        pieces = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return gather(self.flat, self.starts[at], lengths), ends[pieces]


def batches_of(texts: list[str], size: int = 1 << 22) -> Iterable[tuple[int, int]]:
    """Row ranges of about ``size`` characters."""
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= size:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
