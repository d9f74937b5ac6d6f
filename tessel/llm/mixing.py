"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. Targets. Sources in code point order (null last) weigh 5, 2, 1, repeating,
   and share ``SHARE`` of all words; a target stops at twice its source's size
   and the excess is shared again by weight until no target is above.
2. Blocks. A source's documents, in seeded order, form one stream of words,
   cut into equal blocks of about ``BLOCK`` words.
3. Seats. Target blocks are dealt to sources by highest quotients
   ``t / (2 n + 1)``. The method is house-monotone, so the house after each
   output shard gives integer quotas per shard, and their sum is the whole.
4. Selection. From a seeded start, a source's blocks are taken round and round
   until its seats are used, twice at most.

Streams are summed by (source, hash range) first, so no task orders a whole
source; a source has as many ranges as its rows ask for, ``RUNS`` at most. Rows
of one source, id and size follow each other and are one entry with a count, so
neither a repeated id nor rows without one fill a range. All that meets on one
task is one row per source (sources are taken to be few: thousands, not
millions), or per hash range of a source. Words are counted over whole texts.

Defined results: a null text has no words; an empty text or an empty source
takes nothing; an empty table gives an empty result; repeated rows take places
of their own. A null id or source is a value like others. Extra columns are
not read, and pass through ``mixed`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import free_name, stash, words

WEIGHTS = (5, 2, 1)
#: Of all words that the mix holds, and times its own size that a source may give at most.
SHARE, MOST = 1.5, 2
BLOCK, SHARDS, SEED = 64, 16, "mix-1"
#: Documents of a source that are ordered in one task, on average, and ranges of a source at most.
RUN, RUNS = 512, 1 << 16
#: A source is large when it has over one LARGE-th of all rows.
LARGE = 1024


def seeded(*parts: Column) -> Column:
    """48 bits of the MD5 of the seed and ``parts``."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts))), 1, 12), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, key (the source in a struct, so that nulls meet), h: all that mixing needs."""
    return docs.select(F.col(id_col).alias("doc_id"), F.size(words(F.col(text_col))).cast("long").alias("size"), F.struct(F.col(source_col).alias("source")).alias("key"), seeded(F.col(id_col)).alias("h"))


def targets(rows: DataFrame) -> DataFrame:
    """key, source_size, target: one row per source."""
    big = "decimal(38,0)"
    each = rows.groupBy("key").agg(F.sum("size").alias("source_size"))
    ranked = each.withColumn("nth", F.row_number().over(Window.orderBy(F.col("key.source").asc_nulls_last())) - 1)
    w = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod("nth", F.lit(len(WEIGHTS))) + 1).cast(big))
    w = w.withColumn("cap", (F.col("source_size") * MOST).cast(big))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    every = Window.partitionBy()
    w = w.withColumns({
        "below": F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(big),
        "others": F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)).cast(big),
        "all": F.sum("source_size").over(every).cast(big),
    })
    # twice over, to stay with integers: SHARE is a multiple of a half
    w = w.withColumn("capped", 2 * F.col("cap") * F.col("others") <= (F.lit(int(SHARE * 2)) * F.col("all") - 2 * F.col("below")) * F.col("weight"))
    w = w.withColumns({
        "held": F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0)).cast(big),
        "open": F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every), F.lit(0)).cast(big),
    })
    shared = (F.lit(int(SHARE * 2)) * F.col("all") - 2 * F.col("held")).cast("double") * F.col("weight").cast("double") / (2 * F.col("open").cast("double"))
    return w.select("key", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(shared).alias("target"))


def quotas(sources: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """key, source_size, target, blocks, shard, seats: seats after each shard, by highest quotients."""
    s = sources.withColumn("blocks", F.ceil(F.col("source_size") / float(block)).cast("long"))
    s = s.withColumn("due", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"), 6)).otherwise(0.0))
    house = Window.partitionBy()
    s = s.withColumn("house", F.round(F.sum(F.col("due").cast("decimal(38,6)")).over(house)).cast("long"))
    per = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    per = per.withColumn("seats_due", F.floor(F.col("house") * (F.col("shard") + 1) / F.lit(shards)).cast("long"))
    per = per.withColumn("scaled", F.when(F.col("house") > 0, F.col("due") * F.col("seats_due") / F.col("house")).otherwise(0.0))
    per = per.withColumn("seats", F.least(F.floor(F.col("scaled") + 0.5).cast("long"), F.col("blocks") * MOST))
    by_shard = Window.partitionBy("shard")
    per = per.withColumn("short", F.col("seats_due") - F.sum("seats").over(by_shard))
    # the divisor 1 misses the house by a few seats: the next highest, or the last lowest, quotients settle those
    each = F.least(F.abs("short"), F.ceil(F.abs("short") * F.col("due") / F.greatest(F.col("house"), F.lit(1))) + 2).cast("int")
    nths = F.when(each > 0, F.sequence(F.lit(0), each - 1)).otherwise(F.array().cast("array<int>"))
    tried = per.filter("short != 0").select("key", "shard", "short", "due", "seats", "blocks", F.explode(nths).alias("i"))
    tried = tried.withColumn("gives", F.col("short") > 0)
    tried = tried.filter(F.when(F.col("gives"), F.col("seats") + F.col("i") < F.col("blocks") * MOST).otherwise(F.col("seats") > F.col("i")))
    quotient = F.when(F.col("gives"), -F.col("due") / (2 * (F.col("seats") + F.col("i")) + 1)).otherwise(F.col("due") / (2 * (F.col("seats") - F.col("i")) - 1))
    best = Window.partitionBy("shard").orderBy("quotient", F.col("key.source").asc_nulls_last(), "i")
    change = tried.withColumn("quotient", quotient).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= F.abs("short"))
    change = change.groupBy("key", "shard").agg(F.sum(F.when(F.col("gives"), 1).otherwise(-1)).alias("change"))
    out = per.join(change, ["key", "shard"], "left")
    return out.select("key", "source_size", "target", "blocks", "shard", (F.col("seats") + F.coalesce("change", F.lit(0))).alias("seats"))


def shard_quotas(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS) -> DataFrame:
    """source, shard, blocks: how many blocks of each source an output shard holds."""
    at = quotas(targets(sized(docs, id_col, text_col, source_col)), shards)
    before = F.lag("seats", 1, 0).over(Window.partitionBy("key").orderBy("shard"))
    return at.withColumn("taken", F.col("seats") - before).select(F.col("key.source").alias("source"), "shard", F.col("taken").alias("blocks"))


def mix(rows: DataFrame) -> DataFrame:
    """doc_id, size, source, source_size, target, taken of ``sized`` rows."""
    # ranges by a source's size where it has over one LARGE-th of all rows, as LARGE sources at most do; by that share for others
    total = rows.count()
    ranges = lambda n: F.greatest(F.lit(1), F.least(F.lit(RUNS), F.ceil(n / float(RUN)))).cast("long")
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * LARGE > total).select("key", ranges(F.col("n")).alias("runs"))
    plan = quotas(targets(rows)).filter(F.col("shard") == SHARDS - 1)
    rows = rows.groupBy("key", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"))
    runs = F.coalesce("runs", ranges(F.lit(total / LARGE)))
    # rows of one place in the order are one entry from here on
    rows = stash(rows.join(F.broadcast(large), "key", "left").withColumn("run", F.floor(F.col("h") / float(1 << 48) * runs).cast("int")).drop("runs"))
    all_of = F.col("size") * F.col("copies")
    sums = rows.groupBy("key", "run").agg(F.sum(all_of).alias("words"))
    ahead = Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs_at = sums.withColumn("start", F.coalesce(F.sum("words").over(ahead), F.lit(0))).drop("words").join(plan, "key")
    within = Window.partitionBy("key", "run").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("at", F.coalesce(F.sum(all_of).over(within), F.lit(0))).join(runs_at, ["key", "run"]).withColumn("at", F.col("at") + F.col("start"))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("at", F.col("at") + F.col("copy") * F.col("size"))
    edge = lambda b: F.floor(b.cast("decimal(38,0)") * F.col("source_size") / F.greatest("blocks", F.lit(1))).cast("long")
    placed = placed.withColumns({"first": F.when(F.col("blocks") > 0, F.pmod(seeded(F.col("key.source")), F.col("blocks"))).otherwise(F.lit(0)), "whole": F.when(F.col("blocks") > 0, F.floor(F.col("seats") / F.col("blocks"))).otherwise(F.lit(0))})
    placed = placed.withColumn("last", F.col("first") + F.col("seats") - F.col("whole") * F.col("blocks"))
    end = F.col("at") + F.col("size")
    over = lambda lo, hi: F.greatest(F.least(end, hi) - F.greatest(F.col("at"), lo), F.lit(0))
    once = over(edge(F.col("first")), edge(F.least("last", "blocks"))) + F.when(F.col("last") > F.col("blocks"), over(F.lit(0), edge(F.col("last") - F.col("blocks")))).otherwise(F.lit(0))
    return placed.select("doc_id", "size", F.col("key.source").alias("source"), "source_size", "target", (F.col("whole") * F.col("size") + once).cast("long").alias("taken"))


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of every row of ``docs``."""
    return mix(stash(sized(docs, id_col, text_col, source_col)))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it.

    Only the documents at the two ends of a source's selection are taken in
    part; here they come whole or not at all, whichever is nearer. A row is
    matched with its share by id, source and size; rows equal in all three
    share alike.
    """
    shares = taken(docs, id_col, text_col, source_col)
    copies = F.when(F.col("size") > 0, F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size")))).otherwise(F.lit(0)).cast("int")
    mark = free_name(docs, "mark")
    nth = free_name(docs, "copies")
    held = shares.select(F.struct("doc_id", "source", "size").alias(mark), copies.alias(nth)).groupBy(mark).agg(F.max(nth).alias(nth)).filter(F.col(nth) > 0)
    marked = docs.withColumn(mark, F.struct(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size")))
    joined = marked.join(held, mark)
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(nth)))).select(*docs.columns)
