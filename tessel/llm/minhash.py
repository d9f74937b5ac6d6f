"""Near-duplicate detection by min-max hashing.

Each permutation of a document's set of five-word shingles keeps its smallest
and its largest value, two signature entries for one hash evaluation. Bands of
four entries propose pairs; a pair is a link when its full sets confirm it.

Plan. Documents with one and the same set are one class, found by a digest of
the set, and only class representatives go on. In each bucket of a band that
holds several classes, the most central class is the pivot and meets every
member; confirmed links join components. Central means sharing most buckets:
the text that near copies were made from links with copies that do not link
with each other, so one pass settles a bucket of near copies, whatever its
size. After two passes, the members of buckets that still hold several
components (texts around one common passage, say) are joined exactly, by
prefix filtering over their shingles from rare to common: what they all share
comes last and is not joined on. No bucket is gathered in one task, pairs stay
untried only inside a component, and no link that a band proposes is lost.

Signatures have 48 permutations, 96 entries, 24 bands: a pair at a threshold
of 0.85 misses all bands with a chance of 2e-8, one at 0.8 with 3e-6.

Defined results: a text of fewer than five words is one shingle; null, empty
and blank texts have none, link with nothing and stay. Rows with equal texts
link. Ids are expected to be unique: rows that share one share a component.
Rows without an id take the smallest id of their class, or null, and are kept
only if that is null. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import free_name, stash
from tessel.llm.textkernel import mix, shingle_hashes

WIDTH, THRESHOLD = 5, 85
PERMUTATIONS, ROWS = 48, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Shingles hashed at once.
BLOCK = 1 << 15
#: Groups that a hub's pairs are dealt to.
SALTS = 64
#: Passes of pivots before what is still apart is joined by rare shingles.
PIVOTS = 2
_RNG = np.random.default_rng(8)
_A = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)
_BAND = _RNG.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_max(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the smallest and the largest value of every permutation; rows must not be empty."""
    n = len(offsets) - 1
    low = np.full((n, PERMUTATIONS), np.uint64((1 << 64) - 1))
    high = np.zeros((n, PERMUTATIONS), np.uint64)
    row = 0
    while row < n:
        at = offsets[row]
        to = max(row + 1, int(np.searchsorted(offsets, at + BLOCK, side="right")) - 1)
        for lo in range(at, offsets[to], BLOCK):  # one row longer than a block takes several turns
            hi = min(lo + BLOCK, offsets[to])
            values = hashes[lo:hi, None] * _A + _B
            starts = np.maximum(offsets[row:to] - lo, 0) if to > row + 1 else np.zeros(1, np.int64)
            low[row:to] = np.minimum(low[row:to], np.minimum.reduceat(values, starts, axis=0))
            high[row:to] = np.maximum(high[row:to], np.maximum.reduceat(values, starts, axis=0))
        row = to
    return low, high


def bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One key per band; a band mixes entries of different permutations."""
    entries = np.concatenate([low, high], axis=1)
    b = np.arange(BANDS)[:, None] * 2
    order = np.concatenate([b, b + 1, PERMUTATIONS + (b + 2) % PERMUTATIONS, PERMUTATIONS + (b + 3) % PERMUTATIONS], axis=1)
    total = np.zeros((len(low), BANDS), np.uint64)
    for k in range(ROWS):
        total += mix(entries[:, order[:, k]]) * _BAND[:, k]
    return mix(total + np.arange(BANDS, dtype=np.uint64))


def distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes sorted, without repeats."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.concatenate(parts) if parts else hashes, np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.slice(lo, 512)
            sets, at = distinct(*shingle_hashes(part.column(1), WIDTH))
            n = np.diff(at)
            digest = [hashlib.md5(sets[a:b].tobytes()).digest() if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
            full = np.flatnonzero(n)
            keys = bands(*min_max(sets, np.concatenate([at[full], at[-1:]]))).view(np.int64)
            lists = np.zeros(len(n) + 1, np.int32)
            lists[1:] = np.cumsum(np.where(n > 0, BANDS, 0))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(lists), pa.array(keys.ravel()))], ["doc_id", "n_shingles", "set_key", "bands"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (null without words) and bands."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_signatures, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.slice(lo, 512)
            sets, at = distinct(*shingle_hashes(part.column(1), WIDTH))
            held = pa.array([sets[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), held], ["id", "set"])


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (hub, leaf) whose full sets reach the threshold, in hundredths, as links (a, b).

    Pairs travel as ids until they meet their leaf's set. A hub's pairs are
    dealt to ``SALTS`` groups by their leaves and its set goes once to each
    group in use, so a hub that half the corpus was made from is spread.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, held, x = [], None, None
            for hub, a, b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if hub != held:  # rows of one hub follow each other
                    held, x = hub, np.frombuffer(a.as_buffer(), np.uint64)
                y = np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    dealt = stash(pairs.select("hub", "leaf", F.pmod(F.xxhash64("leaf"), F.lit(SALTS)).cast("int").alias("salt")))
    leaves = sets.select(F.col("id").alias("leaf"), F.col("set").alias("set_b"))
    hubs = sets.select(F.col("id").alias("hub"), F.col("set").alias("set_a"))
    spread = dealt.select("hub", "salt").distinct().hint("merge").join(hubs, "hub")
    # sets stay where their ids hash to, at every size; a broadcast of few pairs would change that with the input
    held = dealt.hint("merge").join(leaves, "leaf").hint("merge").join(spread, ["hub", "salt"]).select("hub", "leaf", "set_a", "set_b")
    links = held.mapInArrow(run, "hub long, leaf long")
    return links.select(F.least("hub", "leaf").alias("a"), F.greatest("hub", "leaf").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in ``links`` (a, b), by alternating stars."""
    edges = stash(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = stash(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = stash(small)
        told = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if told(small) == told(edges):
            return small.select(F.col("u").alias("id"), F.col("v").alias("component"))
        edges = small


def prefix_pairs(ids: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (hub, leaf) among ``ids`` (id, n, component) that could be links, by prefix filtering.

    With shingles ordered from rare to common, the first one that two sets
    over the threshold share stands early in both: its places leave room for
    the overlap that their sizes ask for. Shingles of one set alone come first
    and need no join; the smaller set of a pair needs only its short prefix.
    """
    rows = stash(sets.join(ids, "id", "left_semi").mapInArrow(_shingles, "id long, shingle long"))
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    held = rows.join(common, "shingle")
    lone = held.groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    up = lambda share: F.ceil(share - 1e-9)
    # how many of its shared shingles a set's prefix still reaches
    reach = ids.join(lone, "id").withColumn("reach", F.col("shared") - up(F.col("n") * threshold / 100.0) + 1).filter("reach > 0")
    order = Window.partitionBy("id").orderBy("df", "shingle")
    nth = held.join(reach, "id").withColumn("nth", F.row_number().over(order)).filter("nth <= reach")
    prefix = stash(nth.withColumn("at", F.col("n") - F.col("shared") + F.col("nth")).select("shingle", "id", "n", "component", "at"))
    both = threshold / (100.0 + threshold)
    small = prefix.filter(F.col("at") <= F.col("n") - up(2 * both * F.col("n")) + 1)
    large = prefix.select("shingle", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"), F.col("at").alias("at_b"))
    room = 1 + F.least(F.col("n") - F.col("at"), F.col("nb") - F.col("at_b")) >= up(both * (F.col("n") + F.col("nb")))
    sized = (F.col("n") < F.col("nb")) | ((F.col("n") == F.col("nb")) & (F.col("id") < F.col("b")))
    met = small.join(large, (small.shingle == large.shingle) & sized & room & (F.col("component") != F.col("cb")))
    return met.select(F.col("b").alias("hub"), F.col("id").alias("leaf")).distinct()


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held = np.frombuffer(s.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), i, np.int64)), pa.array(held)], ["id", "shingle"])


def near_links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """Confirmed links (a, b) that span the components of the classes (id, n, bands)."""
    keyed = classes.select("id", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("size")).filter("least < most").select("key", "size")
    members = stash(keyed.join(shared, "key"))
    # the text that others were made from shares more of their bands than they do of each other's
    central = members.groupBy("id").agg(F.sum("size").alias("weight"))
    members = stash(members.drop("size").join(central, "id"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sets = stash(texts.hint("merge").join(members.select("id").distinct(), "id", "left_semi").mapInArrow(_sets, "id long, set binary").dropDuplicates(["id"]))
    apart, links, tried = members.withColumn("component", F.col("id")), None, None
    for _ in range(PIVOTS):
        fresh = apart if tried is None else apart.join(tried, ["key", "id"], "left_anti")
        pivots = stash(fresh.groupBy("key").agg(F.max(F.struct("weight", "id", "n", "component")).alias("p")).select("key", F.col("p.id").alias("a"), F.col("p.n").alias("na"), F.col("p.component").alias("ca")))
        met = apart.join(pivots, "key").filter((F.col("id") != F.col("a")) & (F.col("component") != F.col("ca")))
        close = 100 * F.least("n", "na") >= threshold * F.greatest("n", "na")
        pairs = met.filter(close).select(F.col("a").alias("hub"), F.col("id").alias("leaf")).distinct()
        found = stash(confirmed(pairs, sets, threshold))
        links = found if links is None else links.unionByName(found)
        used = pivots.select("key", F.col("a").alias("id"))
        tried = used if tried is None else tried.unionByName(used)
        now = members.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
        # what is left of a bucket: over one component, and a pair that no pivot has met
        left = now.join(tried.withColumn("was", F.lit(1)), ["key", "id"], "left")
        open_ = left.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count_if(F.col("was").isNull()).alias("fresh")).filter("lo < hi AND fresh > 1")
        apart = stash(now.join(open_.select("key"), "key"))
    rest = stash(apart.select("id", "n", "component").distinct())
    return links.unionByName(confirmed(prefix_pairs(rest, sets, threshold), sets, threshold))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    rows = stash(signatures(docs, id_col, text_col))
    least = rows.filter(F.col("set_key").isNotNull()).groupBy("set_key").agg(F.min("doc_id").alias("id"))
    least = stash(least)
    held = rows.select("doc_id", F.col("n_shingles").alias("n"), "bands", "set_key")
    classes = least.filter(F.col("id").isNotNull()).join(held, (held.doc_id == least.id) & (held.set_key == least.set_key)).select("id", "n", "bands").dropDuplicates(["id", "bands"])
    joined = components(near_links(docs, classes, id_col, text_col, threshold))
    named = least.join(joined, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row of ``docs`` for each component: that of its smallest id."""
    kept = near_components(docs, id_col, text_col, threshold).filter("kept").select(F.struct(F.col("doc_id").alias("id")).alias("mark")).distinct()
    mark = free_name(docs, "mark")
    marked = docs.withColumn(mark, F.struct(F.col(id_col).cast("long").alias("id")))
    return marked.join(kept.withColumnRenamed("mark", mark), mark, "left_semi").select(*docs.columns)
