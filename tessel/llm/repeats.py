"""Removal of repeated byte strings, by prefix-free parsing.

A byte is removed when a string of ``WIDTH`` bytes that covers it also starts
earlier in the corpus (documents in id order, matches within documents).

1. Parse. A rolling hash triggers at the k-gram that is smallest among those
   of some 100-byte string: a phrase boundary that depends on content alone.
   Every such string belongs to its one trigger, and the strings of a trigger
   occurrence, which start side by side, make a phrase: the text from the
   first string's start to the last one's end.
2. Dictionary. Phrases are named by hashes. A trigger that occurs once in the
   corpus has no repeated string; a later copy of a whole phrase repeats all
   its strings; a trigger all of whose phrases are equal needs nothing more.
   What is left are the phrases at the edges of repeats: triggers with
   different phrases, first copies alone.
3. Suffix arrays. Equal strings have one trigger, so the dictionary is divided
   by triggers' hashes: each range gets its phrases' bytes in order of the
   parse, and sorts the suffixes that begin in a phrase by their first
   ``WIDTH`` bytes, by doubling. Neighbours that agree so far are one string;
   their places in the parse give its first start, and the later ones go. As
   strings have one length, no suffix is compared beyond it.
4. A trigger with over ``HOT`` phrases, in a line that half the corpus has, say,
   would fill one range. Its strings are dealt one by one, by their own hashes,
   and sorted in the same way, each distinct one of a block once.

Blocks of consecutive documents are stored once in a bucketed table. Each step
reads the blocks where they lie, sends sorted arrays of hashes (in the last
step, phrases), one of each kind per block and range, and gets back those that
count; a hash that a block holds a thousand times is sent once, so common
lines make no hot task. Triggers and phrases are equal when 64 bits and the
bits that choose the range agree; strings are compared byte by byte, but for
those of a hot trigger within a block, which 128 bits tell apart. Long texts
are worked off in overlapping pieces.

Defined results: null is an empty text; a text of under ``WIDTH`` bytes loses
nothing; rows that share an id follow each other in order of their texts, null
ids come last; an empty table gives an empty result. Ids are whole numbers, or
text that reads as such. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import bucketed, stash
from tessel.llm.textkernel import _VALUE, mix, powers, raw
from tessel.llm.wordstore import gather

WIDTH, GRAM = 100, 32
#: Bytes of text in a block, in a piece of it, and for each hash range.
BLOCK, PIECE, RANGE = 4 << 20, 1 << 20, 32 << 20
_LOW = np.uint64((1 << 24) - 1)
_OTHER = np.random.default_rng(9).integers(1, 1 << 64, 256, dtype=np.uint64)
#: Phrases of a trigger from which on its strings are dealt one by one; strings that are sorted at once.
HOT, SORTED = 4096, 1 << 21
_KEY, _MIXED, _PHRASE, _EDGE, _SPREAD, _STRING = range(6)


class Sums:
    """Prefix sums of one piece; ``spans`` hashes substrings of it."""

    def __init__(self, part: np.ndarray, values: np.ndarray = _VALUE):
        up, self.down = powers(len(part))
        self.sums = np.empty(len(part) + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(values[part] * up[: len(part)], out=self.sums[1:])

    def spans(self, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[at + n] - self.sums[at]) * self.down[at] + np.asarray(n).astype(np.uint64))


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


class Parse:
    """Phrases of one block: start, number of strings, trigger hash, phrase hash and range bits."""

    def __init__(self, data: np.ndarray, rows: np.ndarray):
        self.data, self.rows = data, rows
        n = len(data)
        marks = np.zeros(n + 1, np.int32)
        long = np.flatnonzero(np.diff(rows) >= WIDTH)
        np.add.at(marks, rows[long], 1)
        np.add.at(marks, rows[long + 1] - WIDTH + 1, -1)
        self.valid = np.cumsum(marks)[:n] > 0
        found = [self._piece(lo, min(lo + PIECE, n)) for lo in range(0, n, PIECE)]
        join = lambda k, kind: np.concatenate([f[k] for f in found]) if found else np.empty(0, kind)
        self.start, self.count = join(0, np.int64), join(1, np.int64)
        self.key, self.phrase, self.other = join(2, np.uint64), join(3, np.uint64), join(4, np.uint64)

    def _piece(self, lo: int, hi: int) -> tuple[np.ndarray, ...]:
        part = self.data[lo : hi + WIDTH - 1]
        at = np.flatnonzero(self.valid[lo:hi])
        if not len(at):
            return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 3
        first = Sums(part)
        grams = first.spans(np.arange(len(part) - GRAM + 1), GRAM)
        ranked = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        trigger = (smallest(ranked, WIDTH - GRAM + 1)[at] & _LOW).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(trigger) != 0) | (np.diff(at) != 1)]))
        start, count = at[new], np.diff(np.append(new, len(at)))
        size = count + WIDTH - 1
        return start + lo, count, grams[trigger[new]], first.spans(start, size), Sums(part, _OTHER).spans(start, size)

    def firsts(self) -> np.ndarray:
        """Which phrases are the block's first copy."""
        out = np.zeros(len(self.phrase), bool)
        out[np.unique(self.phrase, return_index=True)[1]] = True
        return out

    def strings(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, hash and range bits of the strings of some phrases, in order."""
        starts, counts = self.start[phrases], self.count[phrases]
        ends = np.cumsum(counts)
        at = np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        hashes, other = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
        for lo in range(0, len(self.data), PIECE):
            a, b = np.searchsorted(at, [lo, lo + PIECE])
            if a < b:
                part = self.data[lo : lo + PIECE + WIDTH - 1]
                hashes[a:b], other[a:b] = Sums(part).spans(at[a:b] - lo, WIDTH), Sums(part, _OTHER).spans(at[a:b] - lo, WIDTH)
        return at, hashes, other


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def sort_prefixes(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Ranks of the suffixes of ``data`` that start at ``at``, by their first ``width`` bytes (at least 8): equal ones share a rank."""
    n = len(data)
    word = np.zeros(max(0, n - 7), np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | data[k : n - 7 + k]
    have, rank = 8, _ranks(word)
    while have * 2 <= width:
        rank = _ranks((rank[:-have] << np.uint64(32)) | rank[have:])
        have *= 2
    rest = width - have
    return _ranks((rank[at] << np.uint64(32)) | rank[at + rest]) if rest else rank[at]


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    held = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]])) if len(keys) else 0
    return out


def later_copies(data: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of phrases in order of the parse (bytes one after the other, strings of each), a mask of strings that start earlier too."""
    ends = np.cumsum(counts)
    at = np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
    rank = sort_prefixes(data, at)
    first = np.full(int(rank.max()) + 1 if len(rank) else 0, len(rank), np.int64)
    np.minimum.at(first, rank.astype(np.int64), np.arange(len(rank)))
    return first[rank.astype(np.int64)] < np.arange(len(rank))


_SENT = "kind int, range int, block long, items binary, extra binary, flags binary"
_BACK = "block long, kind int, items binary"


def _range_of(other: np.ndarray, ranges: int) -> np.ndarray:
    """Hash ranges, chosen by the top bits of ``other``."""
    return (other >> np.uint64(64 - ranges.bit_length() + 1)).astype(np.int64) if ranges > 1 else np.zeros(len(other), np.int64)


def _send(kind: int, block: int, items: np.ndarray, other: np.ndarray, ranges: int, extra: np.ndarray | None = None, flags: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of one kind: items sorted within hash ranges."""
    to = _range_of(other, ranges)
    order = np.lexsort((items, to))
    items, to = items[order], to[order]
    cuts = np.searchsorted(to, np.arange(ranges + 1))
    for r in range(ranges):
        a, b = cuts[r], cuts[r + 1]
        if a < b:
            pick = order[a:b]
            yield kind, r, block, items[a:b].tobytes(), extra[pick].tobytes() if extra is not None else b"", flags[pick].tobytes() if flags is not None else b""


def _settle(table: pa.Table) -> pa.Table:
    """Which items of one kind and hash range count, per block."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "kind", "items", "extra", "flags")), strict=True))
    kind = rows[0][1] if rows else _KEY
    out = _settle_strings(rows, kind) if kind in (_EDGE, _SPREAD) else _settle_hashes(rows, kind)
    columns = list(zip(*out, strict=True)) if out else [(), (), ()]
    return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["block", "kind", "items"])


def _settle_hashes(rows: list[tuple], kind: int) -> list[tuple]:
    """Triggers that occur twice; of those, the ones with different phrases (hot ones apart); phrases that occur earlier."""
    read = lambda k, t: np.concatenate([np.frombuffer(r[k], t) for r in rows]) if rows else np.empty(0, t)
    items = read(2, np.uint64)
    sizes = np.array([len(r[2]) // 8 for r in rows], np.int64)
    order = np.argsort(items, kind="stable")  # equal items stay in order of their blocks
    held = items[order]
    new = np.concatenate([[True], held[1:] != held[:-1]]) if len(held) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(held)))
    named = np.zeros(len(items), np.int32)  # the kind under which an item goes back, 0 for none
    if kind == _PHRASE:
        named[order] = np.where(new, 0, _PHRASE + 1)
    elif len(starts):
        seen = np.add.reduceat(read(4, np.uint32)[order].astype(np.int64), starts)
        if kind == _KEY:
            named[order] = np.repeat(np.where(seen > 1, _KEY + 1, 0), counts)
        else:
            extra = read(3, np.uint64)[order]
            most = np.maximum.reduceat(read(4, np.uint32)[order], starts)
            mixed = (most > 1) | (np.minimum.reduceat(extra, starts) != np.maximum.reduceat(extra, starts))
            named[order] = np.repeat(np.where(mixed, np.where(seen > HOT, _SPREAD + 1, _MIXED + 1), 0), counts)
    out, at = [], 0
    for row, n in zip(rows, sizes, strict=True):
        mine, told = items[at : at + n], named[at : at + n]
        at += n
        out += [(row[0], int(k) - 1, mine[told == k].tobytes()) for k in np.unique(told) if k]
    return out


def _settle_strings(rows: list[tuple], kind: int) -> list[tuple]:
    """Starts of the strings that start earlier too, of edge phrases or of a hot trigger's single strings."""
    size, blocks = WIDTH, np.repeat(np.arange(len(rows)), [len(r[3]) // 8 for r in rows])
    keys = np.concatenate([np.frombuffer(r[3], np.uint64) for r in rows])
    places = np.concatenate([np.frombuffer(r[4], np.int64).reshape(-1, 2) for r in rows])
    lengths = places[:, 1] + size - 1
    data = np.concatenate([np.frombuffer(r[2], np.uint8) for r in rows])
    begins = np.cumsum(lengths) - lengths
    # equal strings have one key, so parts of the keys are sorted one after the other
    parts = max(1, -(-int(lengths.sum()) // SORTED))
    part = (mix(keys ^ np.uint64(0x5BD1E995)) % np.uint64(parts)).astype(np.int64)
    gone: list[list[np.ndarray]] = [[] for _ in rows]
    for k in range(parts):
        pick = np.flatnonzero(part == k)  # in order of blocks, and of starts within
        if len(pick):
            n = lengths[pick]
            counts = places[pick, 1]
            later = later_copies(gather(data, begins[pick], n), np.cumsum(n) - n, counts)
            ends = np.cumsum(counts)
            start = np.repeat(places[pick, 0] - (ends - counts), counts) + np.arange(ends[-1])
            owner = np.repeat(blocks[pick], counts)[later]
            for r in np.unique(owner):
                gone[r].append(start[later][owner == r])
    return [(row[0], _STRING, np.concatenate(g).astype(np.uint64).tobytes()) for row, g in zip(rows, gone, strict=True) if g]


def _replies(column: pa.Scalar) -> dict[int, np.ndarray]:
    """Sorted items by kind."""
    held: dict[int, list] = {}
    for r in column.as_py() or []:
        held.setdefault(r["kind"], []).append(np.frombuffer(r["items"], np.uint64))
    return {k: np.unique(np.concatenate(v)) for k, v in held.items()}


_NONE = np.empty(0, np.uint64)


def _keys(block: int, p: Parse, told: dict, ranges: int) -> Iterator[tuple]:
    keys, counts = np.unique(p.key, return_counts=True)
    yield from _send(_KEY, block, keys, mix(keys), ranges, flags=counts.astype(np.uint32))


def _phrases(block: int, p: Parse, told: dict, ranges: int) -> Iterator[tuple]:
    on = np.flatnonzero(_among(p.key, told.get(_KEY, _NONE)))
    phrases, at = np.unique(p.phrase[on], return_index=True)
    yield from _send(_PHRASE, block, phrases, p.other[on][at], ranges)
    keys, one, counts = np.unique(p.key[on][at], return_index=True, return_counts=True)  # of the distinct phrases
    yield from _send(_MIXED, block, keys, mix(keys), ranges, phrases[one], counts.astype(np.uint32))


def _edges(p: Parse, told: dict, kind: int) -> np.ndarray:
    """Phrases whose strings are compared: first copies, of triggers with different phrases."""
    return np.flatnonzero(_among(p.key, told.get(kind, _NONE)) & ~_among(p.phrase, told.get(_PHRASE, _NONE)) & p.firsts())


def _spread(p: Parse, told: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of hot triggers: starts, hashes, range bits, and the start of the block's first equal string."""
    at, hashes, other = p.strings(_edges(p, told, _SPREAD))
    order = np.lexsort((at, other, hashes))
    new = np.ones(len(at), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (other[order][1:] != other[order][:-1])
    first = np.empty(len(at), np.int64)
    if len(at):
        first[order] = at[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return at, hashes, other, first


def _strings(block: int, p: Parse, told: dict, ranges: int) -> Iterator[tuple]:
    edges = _edges(p, told, _MIXED)
    yield from _bytes(_EDGE, block, p, p.start[edges], p.count[edges], p.key[edges], mix(p.key[edges]), ranges)
    at, hashes, other, first = _spread(p, told)
    one = np.flatnonzero(first == at)
    yield from _bytes(_SPREAD, block, p, at[one], np.ones(len(one), np.int64), hashes[one], other[one], ranges)


def _bytes(kind: int, block: int, p: Parse, starts: np.ndarray, counts: np.ndarray, keys: np.ndarray, bits: np.ndarray, ranges: int) -> Iterator[tuple]:
    """Phrases' bytes, keys, and (start, strings), in order of their starts within each range."""
    to = _range_of(bits, ranges)
    for r in np.unique(to):
        pick = np.flatnonzero(to == r)
        data = gather(p.data, starts[pick], counts[pick] + WIDTH - 1)
        yield kind, int(r), block, data.tobytes(), keys[pick].tobytes(), np.stack([starts[pick], counts[pick]], axis=1).astype(np.int64).tobytes()


def _removed(p: Parse, told: dict) -> np.ndarray:
    """Mask of the bytes that go."""
    change = np.zeros(len(p.data) + 1, np.int64)
    later = np.flatnonzero(_among(p.phrase, told.get(_PHRASE, _NONE)) | ~p.firsts())
    np.add.at(change, p.start[later], 1)
    np.add.at(change, p.start[later] + p.count[later] + WIDTH - 1, -1)
    gone = told.get(_STRING, _NONE)
    at, _, _, first = _spread(p, told)
    again = at[(first != at) | _among(first.astype(np.uint64), gone)]
    for starts in (gone.astype(np.int64), again):
        np.add.at(change, starts, 1)
        np.add.at(change, starts + WIDTH, -1)
    return np.cumsum(change[:-1]) > 0


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, dict, pa.Scalar]]:
    for batch in batches:
        for i in range(len(batch)):
            block, ids, rows, data = (batch.column(k)[i] for k in range(4))
            told = _replies(batch.column(4)[i]) if batch.num_columns > 4 else {}
            yield block.as_py(), ids, np.frombuffer(rows.as_buffer(), np.int64), np.frombuffer(data.as_buffer(), np.uint8), told


class Blocks:
    """The corpus in id order as blocks of documents, in a table bucketed by block."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.spark = docs.sparkSession
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
        self.ranges = 1 << max(0, -(-total // RANGE) - 1).bit_length()
        buckets = max(1, -(-total // (2 * BLOCK)))
        ordered = rows.repartitionByRange(max(1, -(-total // (4 * BLOCK))), F.col("doc_id").asc_nulls_last()).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text")
        packed = ordered.mapInArrow(_pack, "block long, ids array<long>, offsets binary, data binary")
        self.table = bucketed(packed, "blocks", buckets, "block")

    def rows(self) -> DataFrame:
        return self.table

    def with_replies(self, replies: list[DataFrame]) -> DataFrame:
        told = replies[0]
        for r in replies[1:]:
            told = told.unionByName(r)
        lists = told.groupBy("block").agg(F.collect_list(F.struct("kind", "items")).alias("told"))
        # the blocks stay where they are; the replies come to them
        return self.rows().join(lists.hint("shuffle_hash"), "block", "left")

    def exchange(self, make: Callable, replies: list[DataFrame]) -> DataFrame:
        ranges = self.ranges

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, _, rows, data, told in _each(batches):
                sent = list(make(block, Parse(data, rows), told, ranges))
                if sent:
                    columns = list(zip(*sent, strict=True))
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "range", "block", "items", "extra", "flags"])

        source = self.with_replies(replies) if replies else self.rows()
        sent = source.mapInArrow(run, _SENT).repartition(max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 2 * ranges), "kind", "range")
        return stash(sent.groupBy("kind", "range").applyInArrow(_settle, _BACK))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, ids, sizes, texts, held = TaskContext.get().partitionId() << 24, [], [], [], 0

    def block() -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([offsets.tobytes()], pa.binary()), pa.array([b"".join(texts)], pa.binary())], ["block", "ids", "offsets", "data"])

    for batch in batches:
        data, rows = raw(batch.column(1))
        for i, doc in enumerate(batch.column(0).to_pylist()):
            text = data[rows[i] : rows[i + 1]].tobytes()
            ids.append(doc)
            sizes.append(len(text))
            texts.append(text)
            held += len(text) + 16
            if held >= BLOCK:
                yield block()
                number, ids, sizes, texts, held = number + 1, [], [], [], 0
    if ids:
        yield block()


def _results(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for _, ids, rows, data, told in _each(batches):
        gone = _removed(Parse(data, rows), told)
        sums = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        begins[rows[:-1][np.diff(rows) > 0]] |= gone[rows[:-1][np.diff(rows) > 0]]
        spans = np.concatenate([[0], np.cumsum(begins)])
        kept = [data[a:b][~gone[a:b]] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        columns = [pa.array(ids.as_py(), pa.int64()), pa.array(np.diff(rows)), pa.array(np.diff(sums[rows]), pa.int64()), pa.array(np.diff(spans[rows]), pa.int64()), pa.array([hashlib.sha256(k.tobytes()).hexdigest() for k in kept])]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns, names = [*columns, pa.array([k.tobytes() for k in kept], pa.binary())], [*names, "kept"]
        yield pa.RecordBatch.from_arrays(columns, names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes of every row."""
    blocks = Blocks(docs, id_col, text_col)
    keys = blocks.exchange(_keys, [])
    phrases = blocks.exchange(_phrases, [keys])
    strings = blocks.exchange(_strings, [phrases])
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return blocks.with_replies([phrases, strings]).mapInArrow(lambda b: _results(b, with_text), schema)
