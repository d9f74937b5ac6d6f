"""Alignment of two tokenizers over the same bytes.

A is a byte-level BPE of the tokenizers library, B a SentencePiece model. A
text is read with a space in front. An array over its bytes holds the token of
A that owns each byte (``np.repeat`` of token numbers by token lengths), another
the token of B. Where the pair of owners changes an overlap begins; where both
change at once a cut lies, and the tokens between two cuts are a group. Tokens
of A and B that share a group are linked.

Neither tokenizer joins across a space between two characters other than white
space, so groups never cross such a place: each distinct piece between two of
them is encoded and aligned once per store, and a text's figures are gathered
from its pieces. The store is emptied when it holds ``limit`` pieces or
``limit_bytes`` of them, which bounds its memory and changes no result.

An id pair's count is how many documents hold it linked. Each task counts the
pairs of a block of documents, the counts of all blocks are summed by pair,
and each block gets back the sums of its own pairs alone: nothing that grows
with the corpus is broadcast, and a block is bounded by ``BLOCK`` links (or
one document). Within a group, equal ids are one with a number of times, so
that a long group costs its distinct ids, not its pairs of tokens.

Defined results: a null or empty text, and one whose joined token bytes of A or
B are not the text with its space, has no tokens: zeros and an empty digest.
Rows are worked off one by one, so repeated ids, null ids and equal texts are
rows like others, each a document of its own in the counts; an empty table gives
an empty result. A text of any length is one row's work, whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import stash
from tessel.llm.subwords import default_model
from tessel.llm.token_files import Tokens, default_tokenizer
from tessel.llm.wordstore import batches_of, gather

#: Links that a block of documents has before it ends, and characters read at once.
BLOCK, READ = 3 << 19, 1 << 21
MARK = "▁"


def byte_values() -> dict[str, int]:
    """The characters of byte-level vocabularies: printable Latin-1 stands for itself, the rest is numbered from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Bytes:
    """The bytes of each id, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.lengths = np.fromiter(map(len, entries), np.int64, len(entries))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[ids], self.lengths[ids])


def _ends(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def owners(lengths: np.ndarray) -> np.ndarray:
    """For each byte, the number of the token that it lies in."""
    return np.repeat(np.arange(len(lengths)), lengths)


def changes(owner: np.ndarray) -> np.ndarray:
    """Where a byte's owner is not the one before's; true at the first byte."""
    out = np.ones(len(owner), bool)
    out[1:] = owner[1:] != owner[:-1]
    return out


class Aligner:
    """Encodes with both tokenizers and aligns, each distinct piece once."""

    def __init__(self, model_a: str, model_b: str, limit: int = 400_000, limit_bytes: int = 128 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(model_a), sentencepiece.SentencePieceProcessor(model_file=model_b)
        self.a.encode_special_tokens = True
        value = byte_values()
        vocabulary = sorted(self.a.get_vocab().items(), key=lambda entry: entry[1])
        self.bytes_a = Bytes([bytes(value[c] for c in entry) for entry, _ in vocabulary])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = Bytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)])
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this model crosses words")
        self.size_b = len(pieces)
        self.decimal = list(map(str, range(max(len(vocabulary), len(pieces)))))
        self.limit, self.limit_bytes = limit, limit_bytes
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.said: dict[str, str] = {}
        self.held = 0
        #: Of each piece: tokens of A and B, groups, overlaps, links, whether its bytes are the text's.
        self.figures = np.empty((0, 6), np.int64)
        self.codes, self.times = np.empty(0, np.int64), np.empty(0, np.int64)
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    @staticmethod
    def pieces(text: str) -> list[str]:
        """The text with its space, cut where neither tokenizer joins. A last space stays with the piece before it, as B adds a space to no empty text."""
        cut = [p for p in Tokens.pieces(" " + text) if p] if text else []
        return [*cut[:-2], cut[-2] + " "] if len(cut) > 1 and cut[-1] == " " else cut

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and their number for each piece, ids of B and theirs."""
        many = getattr(self.a, "encode_batch_fast", self.a.encode_batch)
        a = [e.ids for lo in range(0, len(pieces), 20_000) for e in many(pieces[lo : lo + 20_000], add_special_tokens=False)]
        b = self.b.encode([p[1:] for p in pieces], num_threads=1)
        flat = lambda found: np.fromiter(chain.from_iterable(found), np.int64)
        count = lambda found: np.fromiter(map(len, found), np.int64, len(found))
        return flat(a), count(a), flat(b), count(b)

    def add(self, pieces: list[str]) -> None:
        """Aligns pieces that are not in the store."""
        raw = [p.encode() for p in pieces]
        a, n_a, b, n_b = self.encode(pieces)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        of_a, of_b = np.repeat(np.arange(len(raw)), n_a), np.repeat(np.arange(len(raw)), n_b)
        good = np.bincount(of_a, self.bytes_a.lengths[a], len(raw)) == sizes
        good &= np.bincount(of_b, self.bytes_b.lengths[b], len(raw)) == sizes
        # those of the right size are compared byte by byte
        text, where = np.frombuffer(b"".join(r for r, g in zip(raw, good, strict=True) if g), np.uint8), np.repeat(np.flatnonzero(good), sizes[good])
        wrong = (self.bytes_a.of(a[good[of_a]]) != text) | (self.bytes_b.of(b[good[of_b]]) != text)
        good[where[wrong]] = False
        in_a, in_b = good[of_a], good[of_b]
        a, b, of_a, of_b, n_a, n_b = a[in_a], b[in_b], of_a[in_a], of_b[in_b], n_a * good, n_b * good

        long_a, long_b = self.bytes_a.lengths[a], self.bytes_b.lengths[b]
        new_a, new_b = changes(owners(long_a)), changes(owners(long_b))
        where = np.repeat(np.flatnonzero(good), sizes[good])
        group = np.cumsum(new_a & new_b) - 1
        group_a, group_b = group[_ends(long_a)[:-1]], group[_ends(long_b)[:-1]]
        total = int(group[-1]) + 1 if len(group) else 0
        home = np.zeros(total, np.int64)
        home[group_a] = of_a
        n_groups = np.bincount(home, minlength=len(raw))
        overlaps = np.bincount(where[new_a | new_b], minlength=len(raw))
        links = np.bincount(home, np.bincount(group_a, minlength=total) * np.bincount(group_b, minlength=total), len(raw)).astype(np.int64)

        # equal ids of a group are one, with how often it stands there
        ids_a, times_a = np.unique(group_a * len(self.bytes_a.lengths) + a, return_counts=True)
        ids_b, times_b = np.unique(group_b * self.size_b + b, return_counts=True)
        g_a, g_b = ids_a // len(self.bytes_a.lengths), ids_b // self.size_b
        each_b = np.bincount(g_b, minlength=total)
        left = np.repeat(np.arange(len(ids_a)), each_b[g_a])
        right = gather(np.arange(len(ids_b)), _ends(each_b)[g_a], each_b[g_a])
        codes = (ids_a[left] % len(self.bytes_a.lengths)) * self.size_b + ids_b[right] % self.size_b
        counts = np.bincount(home[g_a[left]], minlength=len(raw))

        self.said.update(zip(pieces, self._said(a, b, n_a, n_b, group_a, group_b), strict=True))
        self.index.update(zip(pieces, range(len(self.index), len(self.index) + len(pieces)), strict=True))
        self.figures = np.concatenate([self.figures, np.stack([n_a, n_b, n_groups, overlaps, links, good], 1)])
        self.starts = np.concatenate([self.starts, len(self.codes) + np.cumsum(counts) - counts])
        self.lengths = np.concatenate([self.lengths, counts])
        self.codes, self.times = np.concatenate([self.codes, codes]), np.concatenate([self.times, times_a[left] * times_b[right]])
        self.held += 3 * int(sizes.sum()) + 200 * len(raw) + 2 * codes.nbytes  # two strings and nine numbers for each piece

    def _said(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> Iterator[str]:
        """Of each piece, ``a1,a2|b1;a3|b2``: ids of A and B in decimal, by group."""

        def parts(ids: np.ndarray, group: np.ndarray) -> list[str]:
            at = _ends(np.unique(group, return_counts=True)[1]).tolist()
            text = list(map(self.decimal.__getitem__, ids.tolist()))
            return [",".join(text[lo:hi]) for lo, hi in zip(at[:-1], at[1:], strict=True)]

        groups = [f"{x}|{y}" for x, y in zip(parts(a, group_a), parts(b, group_b), strict=True)]
        first = np.concatenate([group_a, [len(groups)]])[_ends(n_a)].tolist()
        yield from (";".join(groups[lo:hi]) for lo, hi in zip(first[:-1], first[1:], strict=True))

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Figures and digest of each text; document, code and times of its links, by document and piece."""
        cut = [self.pieces(t) for t in texts]
        if len(self.index) > self.limit or self.held > self.limit_bytes:
            self.clear()
        new = sorted(set().union(*cut) - self.index.keys())
        if new:
            self.add(new)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        doc = np.repeat(np.arange(len(cut)), counts)
        figures = np.stack([np.bincount(doc, self.figures[at, k], len(cut)).astype(np.int64) for k in range(6)], 1)
        whole = (figures[:, 5] == counts) & (counts > 0)
        figures = figures[:, :5] * whole[:, None]
        say = self.said.__getitem__
        digests = [sha256(";".join(map(say, c)).encode()).hexdigest() if w else "" for c, w in zip(cut, whole.tolist(), strict=True)]
        at, doc = at[whole[doc]], doc[whole[doc]]
        long = self.lengths[at]
        return figures, digests, np.repeat(doc, long), gather(self.codes, self.starts[at], long), gather(self.times, self.starts[at], long)


@lru_cache(1)
def aligner(model_a: str, model_b: str) -> Aligner:
    return Aligner(model_a, model_b)


#: A block of documents: figures of each; of its links, the place of each document's pairs among the block's, and how often.
BLOCKS = "block long, doc_ids array<long>, figures binary, digests array<string>, links binary, codes array<long>, holders array<int>"


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers, compressed plane by plane of their bytes, as most are small."""
    every = np.concatenate(arrays).astype("<i8")
    planes = every.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(every).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], n * 8, codec="zstd", asbytes=True), np.uint8)
    return planes.reshape(8, n).T.copy().view("<i8").reshape(-1)


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_a: str | None = None, model_b: str | None = None) -> DataFrame:
    """Documents aligned, in blocks of about ``BLOCK`` links (see ``BLOCKS``)."""
    a, b = model_a or default_tokenizer(), model_b or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, links = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            n = np.cumsum([0] + [len(h[1]) for h in held])
            doc = np.concatenate([h[3] + at for h, at in zip(held, n, strict=False)])
            codes, place = np.unique(np.concatenate([h[4] for h in held]), return_inverse=True)
            own, of = np.unique(doc * max(1, len(codes)) + place, return_inverse=True)
            times = np.bincount(of, np.concatenate([h[5] for h in held]), len(own)).astype(np.int64)
            doc, place = own // max(1, len(codes)), own % max(1, len(codes))
            each = np.bincount(doc, minlength=n[-1])
            step = np.diff(place, prepend=0)  # places rise within a document: steps are small
            first = _ends(each)[:-1][each > 0]
            step[first] = place[first]
            figures = np.concatenate([h[1] for h in held])
            row = {
                "block": number, "doc_ids": pa.concat_arrays([h[0] for h in held]), "figures": figures.tobytes(), "digests": list(chain.from_iterable(h[2] for h in held)),
                "links": _packed(each, step, times), "codes": codes, "holders": np.bincount(place, minlength=len(codes)).astype(np.int32),
            }
            kinds = {"block": pa.int64(), "doc_ids": pa.list_(pa.int64()), "figures": pa.binary(), "digests": pa.list_(pa.string()), "links": pa.binary(), "codes": pa.list_(pa.int64()), "holders": pa.list_(pa.int32())}
            return pa.RecordBatch.from_arrays([pa.array([row[k]], kind) for k, kind in kinds.items()], list(kinds))

        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in batches_of(texts, READ):
                held.append((batch.column(0).slice(lo, hi - lo), *aligner(a, b).texts(texts[lo:hi])))
                links += len(held[-1][4])
                if links >= BLOCK:
                    yield block()
                    number, held, links = number + 1, [], 0
        if held:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, BLOCKS)


def pair_counts(made: DataFrame, size_b: int) -> DataFrame:
    """code, n (documents that hold the pair linked), best (whether it is its A id's highest), over blocks."""
    pairs = made.select(F.explode(F.arrays_zip("codes", "holders")).alias("p")).select(F.col("p.codes").alias("code"), F.col("p.holders").alias("n"))
    counts = pairs.groupBy("code").agg(F.sum("n").alias("n"))
    tops = counts.groupBy(F.expr(f"code div {size_b}").alias("a")).agg(F.max("n").alias("top"))  # a row for each id of A at most
    return counts.join(tops, F.expr(f"code div {size_b}") == F.col("a")).select("code", "n", (F.col("n") == F.col("top")).alias("best"))


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_overlaps long"


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_a: str | None = None, model_b: str | None = None) -> DataFrame:
    """Figures of each document's alignment (see ``RESULT``), with counts of id pairs over all documents."""
    a, b = model_a or default_tokenizer(), model_b or default_model()
    made = stash(blocks(docs, id_col, text_col, a, b))
    counts = pair_counts(made, aligner(a, b).size_b)
    asked = made.select("block", F.posexplode("codes").alias("place", "code"))
    told = asked.join(counts, "code").select(F.col("block").alias("of"), "place", "n", "best")
    held = made.select("block", "doc_ids", "figures", "digests", "links")

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in RESULT.split(", ")]
        row = left.to_pylist()[0]
        ids, digests = row["doc_ids"], row["digests"]
        figures = np.frombuffer(row["figures"], np.int64).reshape(-1, 5)
        place, counted, best = (right.column(c).to_numpy() for c in ("place", "n", "best"))
        n, top = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        n[place], top[place] = counted, best
        every = _unpacked(row["links"])
        each, (step, times) = every[: len(ids)], every[len(ids) :].reshape(2, -1)
        doc = np.repeat(np.arange(len(ids)), each)
        at = np.cumsum(step)
        first = _ends(each)[:-1]
        before = np.concatenate([[0], at])[first]  # steps start anew with each document
        at -= np.repeat(before, each)
        total = np.zeros((2, len(ids)), np.int64)
        if len(at):
            np.add.at(total[0], doc, times * top[at])
            np.add.at(total[1], doc, times * n[at])
        columns = [figures[:, 0], figures[:, 1], figures[:, 2], figures[:, 4], total[0], total[1]]
        return pa.table([pa.array(ids, pa.int64()), *map(pa.array, columns), pa.array(digests, pa.string()), pa.array(figures[:, 3])], names)

    return held.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(finish, RESULT)


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_a: str | None = None, model_b: str | None = None) -> DataFrame:
    """doc_id and, of each document, groups: an array of (byte offset, ids of A, ids of B)."""
    a, b = model_a or default_tokenizer(), model_b or default_model()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def groups(text: str) -> list[dict]:
        both, out, at = aligner(a, b), [], 0
        both.texts([text])
        if not all(both.figures[both.index[p], 5] for p in both.pieces(text)):
            return []
        for said in (g for p in both.pieces(text) for g in both.said[p].split(";")):
            left, right = ([int(i) for i in side.split(",")] for side in said.split("|"))
            out.append({"start": at, "a": left, "b": right})
            at += int(both.bytes_a.lengths[left].sum())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([groups(text)], kind)], ["doc_id", "groups"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, groups array<struct<start:long,a:array<int>,b:array<int>>>")
