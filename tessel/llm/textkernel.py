"""Vectorised word and shingle hashes over Arrow string columns.

A column's bytes are hashed where they lie: prefix sums of a polynomial over
the bytes, modulo 2**64, give the hash of any span as a difference. Byte
values are replaced by fixed random 64-bit numbers first and the result is
mixed, so short words do not meet. Long texts are worked off in pieces cut at
word boundaries; memory is bounded by a piece and one text's word hashes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at once: ten arrays of 64-bit values of this length are held.
PIECE = 1 << 18
_RNG = np.random.default_rng(20240607)
_VALUE = _RNG.integers(1, 1 << 64, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_STEP = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Kinds of bytes: of characters other than white space, ASCII letters and digits, marks, the space, a line's end.
SOLID, WORD, MARK, SPACE, LINE = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = SOLID
_KIND[0x80:] = SOLID
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] |= WORD
_KIND[np.frombuffer(b".,;:!?", np.uint8)] |= MARK
_KIND[0x20], _KIND[0x0A] = SPACE, LINE
_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    n = max(PIECE * 2, 1 << (n - 1).bit_length() if n else 1)  # few lengths, so that the cache holds them
    return _powers(int(_P), n), _powers(int(_INV), n)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its row offsets into them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return held, at - at[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a column, lower-cased A-Z, and each row's offsets into them."""
    data, rows = raw(column)
    hashes, counts, at, n = [], np.zeros(len(rows) - 1, np.int64), 0, len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[rows] = True
    while at < n:
        to = min(at + PIECE, n)
        while to < n and not (first[to] or _BLANK[data[to]]):
            ahead = data[to : to + 4096]
            stop = np.flatnonzero(_BLANK[ahead] | first[to : to + len(ahead)])
            to += int(stop[0]) if len(stop) else len(ahead)
        part = data[at:to]
        full = ~_BLANK[part]
        edge = first[at:to]
        before = np.empty_like(full)
        before[0], before[1:] = False, full[:-1]
        starts = np.flatnonzero(full & (~before | edge))
        after = np.empty_like(full)
        after[-1], after[:-1] = False, full[1:] & ~edge[1:]
        ends = np.flatnonzero(full & ~after) + 1
        up, down = powers(len(part))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_VALUE[_LOWER[part]] * up[: len(part)], out=sums[1:])
        spans = (sums[ends] - sums[starts]) * down[starts]
        hashes.append(mix(spans + (ends - starts).astype(np.uint64)))
        owner = np.searchsorted(rows, starts + at, side="right") - 1
        counts += np.bincount(owner, minlength=len(counts))
        at = to
    out = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    return out, np.concatenate([[0], np.cumsum(counts)])


def shingle_hashes(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles (repeats included) and row offsets; a shorter text is one shingle."""
    found, rows = word_hashes(column)
    n = np.diff(rows)
    counts = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    owner = np.repeat(np.arange(len(n)), counts)
    start = rows[owner] + np.arange(offsets[-1]) - offsets[owner]
    total = np.full(len(start), np.uint64(0))
    padded = np.concatenate([found, np.zeros(width, np.uint64)])
    length = np.minimum(n, width)[owner]
    for k in range(width):
        total += np.where(k < length, padded[start + k] * _STEP[k], np.uint64(0))
    return mix(total + length.astype(np.uint64)), offsets


def kinds(data: np.ndarray) -> np.ndarray:
    """Kind of each byte of UTF-8; those of characters that are, or may be, white space beyond ASCII have none."""
    kind = _KIND[data]
    at = np.flatnonzero(_LEADS[data])
    if len(at):
        ahead = np.concatenate([data, np.zeros(2, np.uint8)])
        lead, second, third = data[at], ahead[at + 1], ahead[at + 2]
        two = at[(lead == 0xC2) & ((second == 0x85) | (second == 0xA0))]
        three = at[((lead == 0xE1) & ((second == 0x9A) | (second == 0xA0))) | ((lead == 0xE2) & (second <= 0x81)) | ((lead == 0xE3) & (second == 0x80) & (third == 0x80))]
        for k in (two, two + 1, three, three + 1, three + 2):
            kind[k] = 0
    return kind
