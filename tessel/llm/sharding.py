"""Sharding by sampled splitters, in DataFrame functions alone.

Records are ordered by the key (leading 60 bits of the text's MD5, id, CRC-32
of the text), so equal texts stand together and the order is a shuffle of the
corpus. A size-weighted sample of keys gives quantile boundaries; records are
range-partitioned at them, the ranges are measured over all records, and
ranges that turn out overfull are subdivided by samples of their own until
none is overfull that holds two keys. Shards are then cut at equal bytes:
whole ranges where a cut falls between two, and record by record in the range
that a cut falls into.

Law: ``bytes`` (sizes near equal: a shard's sum misses its share by one record
at most). A cut may fall inside a group of equal texts: the law is on bytes,
and a group may be larger than a shard. Slots follow the key within a shard
without gaps; they come from the ranges' counts, so no task ever orders more
than one range.

Repeated rows (same key) are one record of the order, with a count: however
many there are, they are placed by arithmetic and no task orders them.

Defined results: a null text has size 1; repeated rows get slots of their own,
one after the other; a null id sorts first; an empty table gives an empty
result. Ids are whole numbers, or text that reads as such. Extra columns,
whatever their names, pass through ``write_shards`` untouched, but for
``shard`` and ``slot``, which it adds and which must not be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import free_name, stash

SHARDS = 16
#: Ranges that the first sample aims at, and sampled keys for each of them.
RANGES, PER_RANGE = 512, 8
#: A range of several keys is overfull beyond so many times its even share.
OVERFULL = 4.0
NO_ID = -(1 << 63)


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, h: all that sharding needs of a document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    head = F.conv(F.substring(F.md5(F.encode(text, "utf-8")), 1, 15), 16, 10).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).cast("long").alias("text_crc32"), head.alias("h"))


def sample_keys(rows: DataFrame, weight: Column, rate: float, round_no: int) -> list[tuple[int, int]]:
    """Keys drawn with a chance of ``weight`` times ``rate``: about 1 / share of the data in all, whatever its size."""
    draw = F.pmod(F.xxhash64(F.lit(round_no), "h", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.filter(draw < weight * rate).select("h", F.coalesce("doc_id", F.lit(NO_ID)).alias("k")).distinct()
    return sorted((r.h, r.k) for r in drawn.collect())


def quantiles(keys: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    """Up to ``parts - 1`` boundaries at equal steps of the sorted sample."""
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []


def range_of(splitters: list[tuple[int, int]], h: Column, k: Column) -> Column:
    """How many splitters are at or below the key, by binary search in a constant array."""
    if not splitters:
        return F.lit(0)
    steps = [1 << i for i in range((len(splitters)).bit_length() - 1, -1, -1)]
    hs = F.lit([s[0] for s in splitters]).cast("array<bigint>")
    ks = F.lit([s[1] for s in splitters]).cast("array<bigint>")

    def step(at: Column, width: Column) -> Column:
        to = at + width - 1
        below = (F.get(hs, to) < h) | ((F.get(hs, to) == h) & (F.get(ks, to) <= k))
        return at + F.when(F.coalesce(below, F.lit(False)), width).otherwise(F.lit(0))

    return F.aggregate(F.lit(steps).cast("array<int>"), F.lit(0), step)


def ranged(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    return rows.withColumn("range", range_of(splitters, F.col("h"), F.coalesce("doc_id", F.lit(NO_ID))))


def split(rows: DataFrame, ranges: int = RANGES) -> tuple[list[tuple[int, int]], list]:
    """Splitters, and of each range its records, rows and bytes as measured over all ``rows`` (with ``copies``)."""
    n, size = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0))).first()
    if not n:
        return [], []
    weight = F.col("copies") * (F.col("size") / float(size) + 1 / float(n)) / 2  # bounds a range's bytes and its rows alike
    splitters, round_no = quantiles(sample_keys(rows, weight, float(ranges * PER_RANGE), 0), ranges), 0
    while True:
        held = measure(rows, splitters)
        # what stays above the bar is a single key, which is one row of the order
        full = [r.range for r in held if r.keys > 1 and max(r.bytes / size, r.n / n) > OVERFULL / ranges]
        if not full:
            return splitters, held
        round_no += 1
        inside = ranged(rows, splitters).filter(F.col("range").isin(full))
        more = sample_keys(inside, weight, float(ranges * PER_RANGE * 4), round_no)
        ends = inside.groupBy("range").agg(F.max(F.struct("h", F.coalesce("doc_id", F.lit(NO_ID)).alias("k"))).alias("last")).collect()
        # the last key of a range that holds several is a splitter that always divides it
        splitters = sorted({*splitters, *more[:: 2 * PER_RANGE], *((r.last.h, r.last.k) for r in ends)})


def measure(rows: DataFrame, splitters: list[tuple[int, int]]) -> list:
    held = ranged(rows, splitters).groupBy("range")
    key = F.struct("h", F.coalesce("doc_id", F.lit(NO_ID)))
    keys = F.when(F.min(key) == F.max(key), 1).otherwise(2).alias("keys")  # one, or more
    return held.agg(keys, F.sum("copies").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("bytes")).orderBy("range").collect()


def shards(rows: DataFrame, n_shards: int = SHARDS, ranges: int = RANGES) -> DataFrame:
    """``rows`` with shard and slot. The ranges' table, a few thousand rows at any size, is the only broadcast."""
    spark = rows.sparkSession
    rows = stash(rows.groupBy("h", "doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("copies")))
    splitters, held = split(rows, ranges)
    total, at, before, table = sum(r.bytes for r in held), 0, 0, []
    for r in held:
        table.append((r.range, at, before))
        at, before = at + r.bytes, before + r.n
    starts = spark.createDataFrame(table, "range int, bytes_before long, rows_before long")
    order = Window.partitionBy("range").orderBy("h", "doc_id", "text_crc32")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    copy = F.col("copy")
    placed = (
        ranged(rows, splitters)
        .join(F.broadcast(starts), "range")
        .withColumn("at", F.col("bytes_before") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(so_far), F.lit(0)))
        .withColumn("nth", F.col("rows_before") + F.coalesce(F.sum("copies").over(so_far), F.lit(0)))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("at", F.col("at") + copy * F.col("size"))
        .withColumn("nth", F.col("nth") + copy)
        # a record goes where its middle falls
        .withColumn("shard", F.least(F.floor((F.col("at") * 2 + F.col("size")) * n_shards / F.lit(max(1, 2 * total))), F.lit(n_shards - 1)).cast("int"))
    )
    placed = stash(placed.select("doc_id", "size", "text_crc32", "shard", "nth"))
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("nth") - F.col("first")).drop("first", "nth")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``."""
    return shards(stash(records(docs, id_col, text_col)), n_shards)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", n_shards: int = SHARDS) -> DataFrame:
    """Writes ``docs`` in shard folders under ``path``, each file in slot order; returns the placement.

    A row meets its place by id, CRC-32 and position among its repeats.
    """
    if {"shard", "slot"} & {c.lower() for c in docs.columns}:
        raise ValueError("the rows must not have columns shard or slot")
    placed = stash(assign(docs, id_col, text_col, n_shards))
    mark, nth = free_name(docs, "mark"), free_name(docs, "nth")
    crc = F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")).cast("long")
    keyed = docs.withColumn(mark, F.struct(F.col(id_col).cast("long").alias("id"), crc.alias("crc")))
    keyed = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(mark).orderBy(F.lit(0))))
    places = placed.select(F.struct(F.col("doc_id").alias("id"), F.col("text_crc32").alias("crc")).alias(mark), "shard", "slot")
    places = places.withColumn(nth, F.row_number().over(Window.partitionBy(mark).orderBy("shard", "slot")))
    out = keyed.join(places, [mark, nth]).drop(mark, nth)
    out.repartitionByRange(max(n_shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return placed
