"""Phrases of two and three words that stand together more often than their words do.

Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and
pieces into words at spaces and tabs. Words are counted first; a phrase can be
frequent only if its words, and of three words both pairs, are (Apriori). What
may be frequent goes to the mappers as a bit table of fixed size (2**27 bits, two
bits for each frequent word or pair): it lets some others through, never drops
one, and so bounds what is broadcast whatever the corpus.

A phrase's key is the 64-bit hashes of its words (language included), with a
seed under which no frequent word shares its hash with another word; the count
of words, which groups by the words themselves, proves that, or another seed
is tried. Keys then are the words.

Mappers count the candidates of a slice of texts by ``bincount`` and deal them to
sections by key, so many that a section holds about ``SECTION`` rows. A section
builds a minimal perfect hash over its candidates, looks each row's slot up
with the stored key as proof, bincounts parts of its rows by slot and sums the
arrays as a tree.

A phrase cut in two has a score, floor(1000000 * a * a / (l * r)) in decimals of
38 digits (exact while a is under 10**16); the cut with the lowest counts.

Defined results: a null or empty text has no words; a null language is
``und``; rows that repeat are counted again, whatever their ids, which are not
read; an empty table gives an empty result. Texts are read whole, a very long
one as a slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import stash
from tessel.llm.textkernel import PIECE, mix, powers, raw
from tessel.llm.wordstore import gather

LEAST, COVERED, TOP = 10, 50, 2000
#: Bits of the table of what may be frequent; bytes of text in a slice; rows in a section, in a part of one.
BITS, SLICE, SECTION, PART = 27, 8 << 20, 1 << 20, 1 << 17
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK[[0x20, 0x09]] = True
_BLANK |= _BREAK


class Words:
    """All words of a slice: hash, row, place in ``data``; ``joined`` where the next one is in the same piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array, seed: int):
        data, rows = raw(texts)
        self.data = _LOWER[data]
        value = np.random.default_rng(seed).integers(1, 1 << 64, 256, dtype=np.uint64)
        own = {lang: np.uint64(int.from_bytes(blake2b(lang.encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")) for lang in set(langs.to_pylist())}
        of_row = np.array([own[lang] for lang in langs.to_pylist()], np.uint64)
        first = np.zeros(len(data) + 1, bool)
        first[rows] = True
        hashes, starts, ends, pieces, at, n, before = [], [], [], [], 0, len(data), 0
        while at < n:
            to = min(at + PIECE, n)
            while to < n and not (first[to] or _BLANK[data[to]]):
                ahead = data[to : to + 4096]
                stop = np.flatnonzero(_BLANK[ahead] | first[to : to + len(ahead)])
                to += int(stop[0]) if len(stop) else len(ahead)
            part, edge = self.data[at:to], first[at:to]
            full = ~_BLANK[part]
            left, right = np.zeros(len(part), bool), np.zeros(len(part), bool)
            left[1:] = full[:-1] & ~edge[1:]
            right[:-1] = full[1:] & ~edge[1:]
            lo, hi = np.flatnonzero(full & ~left), np.flatnonzero(full & ~right) + 1
            up, down = powers(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(value[part] * up[: len(part)], out=sums[1:])
            hashes.append(mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64)))
            piece = np.cumsum(_BREAK[part] | edge) + before
            before = int(piece[-1])
            starts.append(lo + at)
            ends.append(hi + at)
            pieces.append(piece[lo])
            at = to
        whole = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        self.starts, self.ends, piece = whole(starts), whole(ends), whole(pieces)
        self.row = np.searchsorted(rows, self.starts, side="right") - 1
        self.hash = mix(whole(hashes).astype(np.uint64) + of_row[self.row]) if len(piece) else np.empty(0, np.uint64)
        self.joined = piece[1:] == piece[:-1]

    def bytes_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of words, and their lengths."""
        lengths = self.ends[at] - self.starts[at]
        return gather(self.data, self.starts[at], lengths), lengths


def pair_code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b))


def _may(bits: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether both bits of a code are set."""
    mask, one = np.uint64((1 << BITS) - 1), np.uint64(1)
    test = lambda at: (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & one
    return (test(code & mask) & test((code >> np.uint64(BITS)) & mask)) == one


def bit_table(codes: DataFrame) -> np.ndarray:
    """The bits of a column ``code``: 2**27 of them, whatever its rows."""
    mask = (1 << BITS) - 1
    places = codes.select(F.explode(F.array(F.expr(f"code & {mask}L"), F.expr(f"shiftrightunsigned(code, {BITS}) & {mask}L"))).alias("at"))
    held = places.groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[held.column("word").to_numpy()] = held.column("bits").to_numpy()
    return out.view(np.uint64)


def _slices(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[Words, pa.Array]]:
    """Words and languages of row ranges of about ``SLICE`` bytes."""
    for batch in batches:
        sizes = np.cumsum(np.diff(raw(batch.column(1))[1]))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE)) + 1
            part = batch.slice(lo, hi - lo)
            yield Words(part.column(1), part.column(0), seed), part.column(0)
            lo = hi


def _batches(names: list[str], columns: list) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
    for lo in range(0, whole.num_rows, 1 << 16):
        yield whole.slice(lo, 1 << 16)


def word_rows(texts: DataFrame, seed: int) -> DataFrame:
    """lang, word, code, n by slice. A word that shares its code with another of the slice has a null code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs in _slices(batches, seed):
            code, first, of, n = np.unique(words.hash, return_index=True, return_inverse=True, return_counts=True)
            if not len(code):
                continue
            flat, lengths = words.bytes_of(first)
            starts, same = np.cumsum(lengths) - lengths, True
            for lo in range(0, len(of), PART):  # each word against the one that stands for its code
                part = of[lo : lo + PART]
                mine, own = words.bytes_of(np.arange(lo, lo + len(part)))
                same &= np.array_equal(own, lengths[part]) and np.array_equal(mine, gather(flat, starts[part], lengths[part]))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            word = pa.Array.from_buffers(pa.string(), len(code), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            codes = pa.array(code.view(np.int64), mask=np.full(len(code), not same))
            yield from _batches(["lang", "word", "code", "n"], [langs.take(pa.array(words.row[first])), word, codes, n.astype(np.int64)])

    return texts.mapInArrow(run, "lang string, word string, code long, n long")


def pair_rows(texts: DataFrame, seed: int, bits) -> DataFrame:
    """a, b, n by slice: neighbours that both may be frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in _slices(batches, seed):
            may = _may(bits.value, words.hash)
            own, at = np.unique(words.hash, return_inverse=True)
            here = np.flatnonzero(words.joined & may[:-1] & may[1:])
            pair, n = np.unique(at[here] * len(own) + at[here + 1], return_counts=True)
            if len(pair):
                key = own.view(np.int64)
                yield from _batches(["a", "b", "n"], [key[pair // len(own)], key[pair % len(own)], n.astype(np.int64)])

    return texts.mapInArrow(run, "a long, b long, n long")


def triple_rows(texts: DataFrame, seed: int, bits) -> DataFrame:
    """a, b, c, n by slice: three words in a row whose pairs both may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in _slices(batches, seed):
            if len(words.hash) < 3:
                continue
            own, at = np.unique(words.hash, return_inverse=True)
            may = words.joined & _may(bits.value, pair_code(words.hash[:-1], words.hash[1:]))
            here = np.flatnonzero(may[:-1] & may[1:])
            pair, of = np.unique(at[here] * len(own) + at[here + 1], return_inverse=True)
            triple, n = np.unique(of * len(own) + at[here + 2], return_counts=True)
            if len(triple):
                key, two = own.view(np.int64), pair[triple // len(own)]
                yield from _batches(["a", "b", "c", "n"], [key[two // len(own)], key[two % len(own)], key[triple % len(own)], n.astype(np.int64)])

    return texts.mapInArrow(run, "a long, b long, c long, n long")


class PerfectHash:
    """A minimal perfect hash over the distinct keys among rows, with the keys stored by slot.

    On each level a key has one place; of the keys that meet there one keeps it
    and the others go to the next level. Slots number the places in use, level
    by level. A row finds its slot on the first level where the key stored
    there is its own, so that a key not among them finds none.
    """

    def __init__(self, keys: list[np.ndarray]):
        self.levels: list[np.ndarray] = []
        kept: list[np.ndarray] = []
        left, count = np.arange(len(keys[0])), 0
        while len(left):
            bits = max(4, int(len(left) * 5 // 4).bit_length())
            at = self._place([k[left] for k in keys], bits, len(self.levels))
            owner = np.full(1 << bits, -1, np.int64)
            owner[at] = left
            used = np.flatnonzero(owner >= 0)
            slots = np.full(1 << bits, -1, np.int32)
            slots[used] = count + np.arange(len(used))
            winner = owner[at]
            lost = np.zeros(len(left), bool)
            for k in keys:
                lost |= k[left] != k[winner]
            self.levels.append(slots)
            kept.append(owner[used])
            count, left = count + len(used), left[lost]
        who = np.concatenate(kept) if kept else np.empty(0, np.int64)
        self.keys, self.count = [k[who] for k in keys], count

    @staticmethod
    def _place(keys: list[np.ndarray], bits: int, level: int) -> np.ndarray:
        code = np.full(len(keys[0]), level + 1, np.uint64)
        for k in keys:
            code = mix(code * np.uint64(0x9E3779B97F4A7C15) + k.view(np.uint64))
        return (code >> np.uint64(64 - bits)).astype(np.int64)

    def slots(self, keys: list[np.ndarray]) -> np.ndarray:
        """The slot of each key; -1 of one that is not among the keys."""
        out, left = np.full(len(keys[0]), -1, np.int64), np.arange(len(keys[0]))
        for level, slots in enumerate(self.levels):
            asked = [k[left] for k in keys]
            slot = slots[self._place(asked, len(slots).bit_length() - 1, level)]
            same = slot >= 0
            for own, k in zip(self.keys, asked, strict=True):
                same &= own[slot] == k
            out[left[same]] = slot[same]
            left = left[~same]
            if not len(left):
                break
        return out


def tree_sum(arrays: list[np.ndarray]) -> np.ndarray:
    while len(arrays) > 1:
        arrays = [reduce(np.add, arrays[i : i + 2]) for i in range(0, len(arrays), 2)]
    return arrays[0]


def counted(rows: DataFrame, sections: int, least: int = LEAST) -> DataFrame:
    """The keys of ``rows`` (all columns but n) that occur ``least`` times, with n and, of pairs, code."""
    names = [c for c in rows.columns if c != "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]
        if not held:
            return
        *keys, n = (np.concatenate(parts) for parts in zip(*held, strict=True))
        held.clear()
        table = PerfectHash(keys)
        parts = []
        for lo in range(0, len(n), max(PART, table.count)):
            hi = lo + max(PART, table.count)
            slot, out = table.slots([k[lo:hi] for k in keys]), np.zeros(table.count, np.int64)
            often = n[lo:hi]
            # counts over one are few: all rows are counted once, and these for the rest
            out += np.bincount(slot, minlength=table.count)
            more = often > 1
            np.add.at(out, slot[more], often[more] - 1)
            parts.append(out)
        total = tree_sum(parts)
        good = np.flatnonzero(total >= least)
        found = [k[good] for k in table.keys]
        code = pair_code(*(k.view(np.uint64) for k in found[:2])).view(np.int64)
        yield from _batches([*names, "n", "code"], [*found, total[good], code])

    schema = ", ".join(f"{c} long" for c in [*names, "n", "code"])
    return rows.repartition(sections, *names).mapInArrow(run, schema)


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), in decimals."""
    wide = lambda c: c.cast("decimal(38,0)")
    held = F.struct((wide(a) * wide(a) * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(38,0)").alias("x"), (wide(left) * wide(right)).cast("decimal(38,0)").alias("y"))
    return F.element_at(F.transform(F.array(held), lambda s: F.call_function("div", s["x"], s["y"])), 1)


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def vocabulary(texts: DataFrame, least: int, tries: int = 16) -> tuple[DataFrame, int]:
    """lang, word, code, n of all words, and the seed under which no frequent word shares its code."""
    for seed in range(1, tries + 1):
        found = stash(word_rows(texts, seed).groupBy("lang", "word").agg(F.sum("n").alias("n"), F.max("code").alias("code"), F.bool_or(F.col("code").isNull()).alias("met")))
        met = found.groupBy("code").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("most"), F.bool_or("met").alias("met"))
        if met.filter(f"met OR (words > 1 AND most >= {least})").isEmpty():
            return found.drop("met"), seed
    raise RuntimeError("no seed tells the words apart")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, covered: int = COVERED) -> DataFrame:
    """lang, phrase, a, l, r, n, k, score of each phrase of two or three words that occurs ``least`` times.

    Left out are those in a longer one that has ``covered`` hundredths of their count.
    """
    spark, texts = docs.sparkSession, _texts(docs, text_col, lang_col)
    every, seed = vocabulary(texts, least)
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sections = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // SECTION + 1)
    words = every.filter(F.col("n") >= least)
    send: Callable = spark.sparkContext.broadcast
    pairs = stash(counted(pair_rows(texts, seed, send(bit_table(words.select("code")))), sections, least))
    triples = stash(counted(triple_rows(texts, seed, send(bit_table(pairs.select("code")))), sections, least)).drop("code")
    pairs = pairs.drop("code")

    word = lambda c: words.select(F.col("code").alias(c), F.col("word").alias(f"word_{c}"), F.col("n").alias(f"n_{c}"))
    first = words.select(F.col("code").alias("a"), F.col("word").alias("word_a"), F.col("n").alias("n_a"), "lang")
    longer = triples.select("a", "b", "n").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "n")).groupBy("a", "b").agg(F.max("n").alias("longer"))
    two = pairs.join(longer, ["a", "b"], "left").filter(F.coalesce(F.lit(100) * F.col("longer") < F.lit(covered) * F.col("n"), F.lit(True))).join(first, "a").join(word("b"), "b")
    two = two.select("lang", F.concat_ws(" ", "word_a", "word_b").alias("phrase"), F.col("n").alias("a"), F.col("n_a").alias("l"), F.col("n_b").alias("r"), F.lit(1).alias("k"))
    two = two.withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    ab, bc = pairs.select("a", "b", F.col("n").alias("n_ab")), pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("n_bc"))
    three = triples.join(ab, ["a", "b"]).join(bc, ["b", "c"]).join(first, "a").join(word("b"), "b").join(word("c"), "c")
    three = three.withColumn("s1", score(F.col("n"), F.col("n_a"), F.col("n_bc"))).withColumn("s2", score(F.col("n"), F.col("n_ab"), F.col("n_c")))
    early = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(early, F.col(x)).otherwise(F.col(y))
    three = three.select(
        "lang", F.concat_ws(" ", "word_a", "word_b", "word_c").alias("phrase"), F.col("n").alias("a"), pick("n_a", "n_ab").alias("l"), pick("n_bc", "n_c").alias("r"),
        F.when(early, 1).otherwise(2).alias("k"), F.least("s1", "s2").alias("score"),
    )
    return two.unionByName(three).join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "k", "score")


def best(found: DataFrame, top: int = TOP, salts: int = 64) -> DataFrame:
    """The first ``top`` phrases of each language by score, count and text, with their rank."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top).drop("salt", "rank")
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
