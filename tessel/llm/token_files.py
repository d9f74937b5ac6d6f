"""Token ids in a binary file format, compressed by Re-Pair grammars.

Documents are range-partitioned by id; each partition is a shard, written as
one blob in id order (a shard of over ``BLOB`` tokens as several, which bounds
memory). A blob's ids are compressed by Re-Pair: in each turn the most frequent
neighbour pairs become nonterminals, until no pair occurs ``LEAST`` times or
all names of 16-bit symbols are given. A turn gives one ``SHARE``-th of the names
left, so that pairs of later turns, whose parts are rules, find names too. The blob stores the rules, each rule's
expansion length, the remaining symbols, and the documents' ids and token
counts; the lengths tell which symbols a document's tokens come from, so one
document decodes without the others.

Blobs are rows of a Parquet table, the container that every executor can write
and read wherever Spark can. Integers are little-endian.

  magic "RPG1" | rules, symbols, documents: u32 each | rules: (left, right) u16
  pairs | expansion lengths: u32 | symbols: u16 | document ids: i64, with the
  lowest value for null | token counts: u32

Tokens are those of the tokenizers library, which each distinct piece of the
texts is handed once, many pieces in one string. Texts are cut where its
byte-level pre-tokenizer never joins: before a space that stands between two
characters other than white space, before and after a line's end that does, and
between an ASCII letter or digit and a mark. Bytes of tokens tell which of a string's tokens are a piece's.

Defined results: a null or empty text has the end id alone; rows that share an
id follow each other in order of their texts, null ids come first; an empty
table writes no blob and gives an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.common import shared_dir
from tessel.llm.textkernel import LINE, MARK, SOLID, SPACE, WORD, kinds, raw
from tessel.llm.wordstore import WordStore, gather

END = 2
#: Bytes of text in a shard, tokens in a blob; bytes of text tokenised at once.
SHARD_BYTES, BLOB, AT_ONCE = 8 << 20, 1 << 22, 4 << 20
#: Re-Pair: least count of a pair; share of the names left that a turn gives, and how many at least; bits of a chosen pair's slot.
LEAST, SHARE, TURN, SLOTS = 8, 2, 512, 18
NO_ID = -(1 << 63)
_RUN = re.compile(r"\s \s|  |\x00")
#: Where a text with runs of white space or NUL may be cut: before a space between two other characters.
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Pieces in one string for the library.
JOINED = 400


def cuts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the pieces of texts lie in their bytes: offsets from 0 to the last byte's end, those of texts among them."""
    kind = kinds(data)
    here = np.zeros(len(data) + 1, bool)
    here[rows] = True
    if len(data) > 1:
        before, after = kind[:-1], kind[1:]
        solid, line = kind & SOLID > 0, kind == LINE
        at = here[1:-1]
        at |= line[1:] & solid[:-1]
        at[1:] |= solid[:-2] & line[1:-1] & solid[2:]  # a line's end within white space goes with it
        at |= (after & MARK > 0) & (before & WORD > 0)
        at[:-1] |= (after[:-1] == SPACE) & solid[:-2] & solid[2:]
    return np.flatnonzero(here)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """Ids as the library gives them, each distinct piece encoded once."""

    def __init__(self, path: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.n_bytes = np.zeros(self.size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.n_bytes[i] = len(token)  # a character stands for a byte
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.n_bytes[i] = len(token.content.encode())
        self.store = WordStore(self._encode, limit)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in many(texts, add_special_tokens=False)]

    def _one_by_one(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self._ids([p.decode() for p in pieces])
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(n.sum())), np.cumsum(n) - n, n

    def _joined(self, pieces: list[bytes], between: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_one_by_one``, of pieces that the library never joins when ``between`` stands between them."""
        text = between.join(pieces)
        ids = np.array(self._ids([text.decode()])[0], np.int32)
        ends = np.concatenate([[0], np.cumsum(self.n_bytes[ids])])
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        to = np.cumsum(n + len(between)) - len(between)
        a, b = np.searchsorted(ends, to - n), np.searchsorted(ends, to)
        if ends[-1] != len(text) or (ends[a] != to - n).any() or (ends[b] != to).any():
            return self._one_by_one(pieces)
        return ids, a, b - a

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces, where each piece's lie in them, and how many they are."""
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(n)
        kind = np.concatenate([kinds(np.frombuffer(b"".join(pieces), np.uint8)), np.zeros(1, np.uint8)])
        first, second, ended = kind[ends - n], kind[ends - n + 1], kind[ends - 1] & SOLID > 0
        spaced = ended & (first == SPACE) & (second & SOLID > 0)
        bare = ended & (first & SOLID > 0)
        flat, held, starts, lengths = [], 0, np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        for which, way in ((spaced, lambda p: self._joined(p, b"")), (bare, lambda p: self._joined(p, b"\n")), (~(spaced | bare), self._one_by_one)):
            at = np.flatnonzero(which)
            for lo in range(0, len(at), JOINED):
                part = at[lo : lo + JOINED]
                ids, since, many = way([pieces[k] for k in part.tolist()])
                starts[part], lengths[part] = since + held, many
                flat.append(ids)
                held += len(ids)
        return np.concatenate(flat), starts, lengths

    @staticmethod
    def pieces(text: str) -> list[str]:
        """A text cut before single spaces alone, where other tokenizers don't join either."""
        if not text:
            return []
        if _RUN.search(text):
            return _CUT.split(text)
        return text.replace(" ", "\x00 ").split("\x00")

    def encode(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts, and each text's offsets into them."""
        data, rows = raw(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
        at = cuts(data, rows)
        ids, ends = self.store.spans(data, at)
        return ids, ends[np.searchsorted(at, rows)]


@lru_cache(1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def _matches(at: np.ndarray) -> np.ndarray:
    """Of overlapping matches at these places, every second one from the left."""
    if not len(at):
        return at
    fresh = np.concatenate([[True], np.diff(at) != 1])
    run = np.maximum.accumulate(np.where(fresh, at, 0))
    return at[(at - run) % 2 == 0]


def re_pair(ids: np.ndarray, first: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Rules (left, right), the k-th for symbol ``first + k``, and the symbols left.

    Ends when no neighbour pair occurs ``least`` times, or all 16-bit names are
    given. Pairs are counted by sorting; those chosen are found again in a table
    of slots, and of two that share one the more frequent is named, the other in
    a later turn.
    """
    seq, rules, shift = ids.astype(np.uint32), [], np.uint32(32 - SLOTS)
    slot = lambda code: (code * np.uint32(0x9E3779B1)) >> shift
    owner, names = np.empty(1 << SLOTS, np.uint32), np.empty(1 << SLOTS, np.uint32)
    while len(seq) > 1:
        names_left = (1 << 16) - first - len(rules)
        room = min(names_left, max(TURN, names_left // SHARE))
        if room < 1:
            break
        code = (seq[:-1] << np.uint32(16)) | seq[1:]
        held = np.sort(code)
        starts = np.concatenate([[0], np.flatnonzero(held[1:] != held[:-1]) + 1])
        counts = np.diff(starts, append=len(held))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        chosen = held[starts[often[np.argsort(-counts[often], kind="stable")[:room]]]]
        at = slot(chosen)
        owner[at[::-1]] = chosen[::-1]
        kept = owner[at] == chosen
        chosen, at = chosen[kept], at[kept]
        names.fill(0)
        names[at] = np.arange(first + len(rules), first + len(rules) + len(chosen), dtype=np.uint32)
        at = slot(code)
        where = np.flatnonzero(owner[at] == code)
        where = _matches(where[names[at[where]] > 0])  # the table keeps pairs of earlier turns
        seq[where] = names[at[where]]
        rules += list(zip((chosen >> np.uint32(16)).tolist(), (chosen & np.uint32(0xFFFF)).tolist(), strict=True))
        left = np.ones(len(seq), bool)
        left[where + 1] = False
        seq = seq[left]
    return np.array(rules, np.int64).reshape(-1, 2), seq


def pack(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray, first: int) -> bytes:
    """One blob."""
    rules, symbols = re_pair(ids, first)
    lengths = np.ones(first + len(rules), np.int64)
    for k, (a, b) in enumerate(rules):
        lengths[first + k] = lengths[a] + lengths[b]
    head = b"RPG1" + struct.pack("<III", len(rules), len(symbols), len(doc_ids))
    return b"".join([head, rules.astype("<u2").tobytes(), lengths[first:].astype("<u4").tobytes(), symbols.astype("<u2").tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes()])


class Blob:
    """Reads a blob; ``document(k)`` decodes one document, ``all()`` every one."""

    def __init__(self, data: bytes, first: int):
        if data[:4] != b"RPG1":
            raise ValueError("not a token blob")
        n_rules, n_symbols, n_docs = struct.unpack_from("<III", data, 4)
        at = 16

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.first = first
        self.rules = take("<u2", 2 * n_rules).reshape(-1, 2)
        spans = take("<u4", n_rules)
        self.symbols, self.doc_ids, self.counts = take("<u2", n_symbols), take("<i8", n_docs), take("<u4", n_docs).astype(np.int64)
        self.lengths = np.concatenate([np.ones(first, np.int64), spans.astype(np.int64)])
        self.ends = np.concatenate([[0], np.cumsum(self.counts)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        flat = np.empty(int(self.lengths.sum()), np.uint16)
        flat[:first] = np.arange(first)
        for k, (a, b) in enumerate(self.rules):
            to, mid = self.starts[first + k], self.starts[first + k] + self.lengths[a]
            flat[to:mid] = flat[self.starts[a] : self.starts[a] + self.lengths[a]]
            flat[mid : mid + self.lengths[b]] = flat[self.starts[b] : self.starts[b] + self.lengths[b]]
        self.flat = flat

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts[symbols], self.lengths[symbols])

    def all(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, k: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(self.lengths[self.symbols])])
        lo, hi = self.ends[k], self.ends[k + 1]
        a, b = int(np.searchsorted(sums, lo, "right")) - 1, int(np.searchsorted(sums, hi, "left"))
        return self._expand(self.symbols[a:b])[lo - sums[a] : hi - sums[a]]


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> None:
    """Writes the token files of ``docs`` to ``path``."""
    model = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    ordered = rows.repartitionByRange(max(1, -(-held // SHARD_BYTES)), "doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, seq, kept, names, counts, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def blob() -> pa.RecordBatch:
            data = pack(np.concatenate(kept), np.concatenate(names), np.concatenate(counts), tokens(model).size)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([seq], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["shard", "seq", "n_tokens", "blob"])

        for batch in batches:
            rows, lo = raw(batch.column(1))[1], 0
            ids_of = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(rows, rows[lo] + AT_ONCE, "right")) - 1)
                ids, at = tokens(model).encode(batch.column(1).slice(lo, hi - lo))
                kept.append(np.insert(ids, at[1:], END).astype(np.int32))
                names.append(ids_of[lo:hi])
                counts.append(np.diff(at) + 1)
                n, lo = n + len(kept[-1]), hi
                if n >= BLOB:
                    yield blob()
                    seq, kept, names, counts, n = seq + 1, [], [], [], 0
        if n:
            yield blob()

    ordered.mapInArrow(run, "shard int, seq int, n_tokens long, blob binary").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """shard, seq, nth, doc_id, local (ids before it in its blob), n_tokens, ids_crc32 of each document in the files."""
    model = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, seq, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                blob = Blob(data.as_buffer().to_pybytes(), tokens(model).size)
                ids, n = blob.all().astype("<u4"), len(blob.counts)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(blob.ends[:-1], blob.ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, shard, np.int32)), pa.array(np.full(n, seq, np.int32)),
                    pa.array(blob.doc_ids, pa.int64(), mask=blob.doc_ids == NO_ID), pa.array(blob.ends[:-1]), pa.array(blob.counts), pa.array(crcs, pa.int64()),
                ], ["shard", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    return spark.read.parquet(path).select("shard", "seq", "blob").mapInArrow(run, "shard int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")


def documents(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files alone."""
    blobs = spark.read.parquet(path).select("shard", "seq", "n_tokens")
    before = Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one small row for each blob
    starts = blobs.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).drop("n_tokens")
    return read(spark, path, tokenizer).join(starts, ["shard", "seq"]).select("doc_id", (F.col("first") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def written(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Writes the files of ``docs`` to a new shared folder and reads them back."""
    path = shared_dir(docs.sparkSession) + "/tokens"
    write(docs, path, id_col, text_col, tokenizer)
    return documents(docs.sparkSession, path, tokenizer)
