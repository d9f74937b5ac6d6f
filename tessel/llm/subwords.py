"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

A text is marked (white space becomes U+2581, one is put in front) and cut
into marked words, which no piece crosses. The distinct words are sorted, so
that they form a trie read depth-first: a forward pass over a word starts at
the prefix that it shares with the word before and reuses the scores there.

For a unigram model the forward score of a prefix is its best sum of piece
scores. For a BPE model, best sums are not what the library gives. There the
forward state of a prefix is the last piece of its encoding, and a piece may
follow another when BPE, run on the two alone, leaves them as they are: merges
on either side of a boundary do not depend on what stands further off, so a
segmentation is the model's own exactly if every two neighbours are such a
pair. Each prefix has one such last piece. Characters that no piece covers
become byte pieces. Ids and texts equal the library's.

Defined results: a null or empty text has no ids and decodes to an empty
text; U+2581 in a text decodes to a space, as in the library; an empty table
gives an empty result. Rows are coded one by one, repeated ones and null ids
like others. A very long text is one row's work, cut into marked words; the
store of words is bounded by their number and bytes. Extra columns pass
through ``coded`` untouched.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import free_name
from tessel.llm.textkernel import raw
from tessel.llm.wordstore import WordStore, batches_of, gather

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}]*")
NONE = -1e30


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """Encodes and decodes with a SentencePiece model file's pieces and scores."""

    def __init__(self, path: str, limit: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        usual = [i for i in range(len(pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {pieces[i]: i for i in usual}
        self.score = {pieces[i]: sp.get_score(i) for i in usual}
        self.byte = {int(pieces[i][3:5], 16): i for i in range(len(pieces)) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.id))
        self.bpe = _model_type(sp.serialized_model_proto()) == 2
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece of this model crosses words")
        endings: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 2:
                endings.setdefault(p[-3:], {2}).add(len(p))
        self.endings = {k: tuple(sorted(v, reverse=True)) for k, v in endings.items()}
        self.follows: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        text = [b""] * len(pieces)
        for p, i in self.id.items():
            text[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            text[i] = bytes([b])
        self.lengths = np.array([len(t) for t in text], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.store = WordStore(self.encode_sorted, limit)

    def merged(self, word: str) -> list[str]:
        """BPE of a short string by definition: the best-scored neighbours merge first, the leftmost among equals."""
        parts, score = list(word), self.score
        while len(parts) > 1:
            best, at = max((score.get(parts[i] + parts[i + 1], NONE), -i) for i in range(len(parts) - 1))
            if best == NONE:
                break
            parts[-at : 2 - at] = [parts[-at] + parts[1 - at]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        known = self.follows.get((left, right))
        if known is None:
            if len(self.follows) > 400_000:
                self.follows.clear()
            known = self.follows[left, right] = self.merged(left + right) == [left, right]
        return known

    def is_whole(self, piece: str) -> bool:
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = self.merged(piece) == [piece]
        return known

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of sorted words given without their first mark; forward states carry over common prefixes."""
        ids, byte, longest, forward = self.id, self.byte, self.longest, self._bpe_step if self.bpe else self._unigram_step
        before, back, best = "", [0], [0.0]
        for w in words:
            w = MARK + w
            n, k = len(w), 0
            most = min(n, len(before))
            while k < most and w[k] == before[k]:
                k += 1
            del back[k + 1 :], best[k + 1 :]
            for j in range(k + 1, n + 1):
                forward(w, j, max(0, j - longest), back, best)
            out, j = [], n
            while j:
                i = back[j]
                piece = w[i:j]
                found = ids.get(piece)
                if found is not None:
                    out.append(found)
                else:
                    out.extend(byte.get(b, self.unknown) for b in reversed(piece.encode()))
                j = i
            out.reverse()
            before = w
            yield out

    def _bpe_step(self, w: str, j: int, lo: int, back: list[int], best: list[float]) -> None:
        ids, follows = self.id, self.follows
        # only lengths that pieces with these last characters have, the longest first
        for n in self.endings.get(w[j - 3 : j], (2,)) if j > 2 else range(j, 1, -1):
            i = j - n
            if i < 0:
                continue
            piece = w[i:j]
            if piece in ids:
                if i == 0:
                    good = self.is_whole(piece)
                else:
                    left = w[back[i] : i]
                    good = follows.get((left, piece))
                    if good is None:
                        good = self.is_whole(piece) and self.may_follow(left, piece)
                if good:
                    back.append(i)
                    best.append(0.0)
                    return
        back.append(j - 1)
        best.append(0.0)

    def _unigram_step(self, w: str, j: int, lo: int, back: list[int], best: list[float]) -> None:
        score, top, at = self.score, NONE, j - 1
        for i in range(lo, j):
            s = score.get(w[i:j])
            if s is not None and best[i] + s > top:
                top, at = best[i] + s, i
        if top == NONE:
            top = best[j - 1] + min(score.values()) - 10
        back.append(at)
        best.append(top)

    @staticmethod
    def words(text: str) -> list[str]:
        """The marked words of a text, each without its first mark."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            return [w[1:] for w in WORD.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts and each text's offsets into them."""
        return self.store.ids([self.words(t) for t in texts])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of texts given as ids, and each text's offsets into them."""
        lengths = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        data = gather(self.flat, self.starts[ids], lengths)
        keep = np.ones(len(data), bool)
        first = ends[:-1][np.diff(ends) > 0]
        keep[first[data[first] == 0x20]] = False  # the mark that encoding puts in front
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def _model_type(proto: bytes) -> int:
    """trainer_spec.model_type of a serialised model: 1 unigram, 2 BPE."""

    def fields(data: bytes):
        at = 0

        def varint() -> int:
            nonlocal at
            out = shift = 0
            while True:
                b = data[at]
                at += 1
                out |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return out

        while at < len(data):
            key = varint()
            if key & 7 == 2:
                n = varint()
                yield key >> 3, data[at : at + n]
                at += n
            elif key & 7 == 0:
                yield key >> 3, varint()
            else:
                at += 8 if key & 7 == 1 else 4
                yield key >> 3, None

    spec = next((v for k, v in fields(proto) if k == 2), b"")
    return next((v for k, v in fields(spec) if k == 3), 1)


@lru_cache(1)
def codec(path: str) -> Codec:
    """One codec for each Python worker, kept between tasks."""
    return Codec(path)


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, ids of every row."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            for lo, hi in batches_of(texts):
                ids, at = codec(path).encode(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                lists = part.column(1)
                counts = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
                data, at = codec(path).decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]))
                texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, text string")


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian 32-bit ids), decoded_sha256, round_trip (decodes to the text)."""
    path = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(1))
            for lo, hi in batches_of(texts):
                part = batch.slice(lo, hi - lo)
                ids, at = codec(path).encode(texts[lo:hi])
                data, ends = codec(path).decode(ids, at)
                told, rows = raw(part.column(1))
                spans = list(zip(ends[:-1], ends[1:], rows[:-1], rows[1:], strict=True))
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array(np.diff(at)),
                    pa.array([zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                    pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b, _, _ in spans]),
                    pa.array([np.array_equal(data[a:b], told[c:d]) for a, b, c, d in spans]),
                ], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def coded(docs: DataFrame, text_col: str = "text", model: str | None = None) -> DataFrame:
    """The rows of ``docs`` with their ids in a new column ``ids``, and as text what the ids decode to."""
    path = model or default_model()
    name = free_name(docs, "ids")
    at_text = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column(at_text))
            for lo, hi in batches_of(texts):
                part = batch.slice(lo, hi - lo)
                ids, at = codec(path).encode(texts[lo:hi])
                data, ends = codec(path).decode(ids, at)
                columns = list(part.columns)
                columns[at_text] = pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
                columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
