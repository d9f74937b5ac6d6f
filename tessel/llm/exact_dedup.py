"""Exact dedup through a persistent digest index, in DataFrame functions alone.

The index is a Parquet table bucketed and sorted by digest. An addition is a
batch of documents: their digests are folded to one row each before any
shuffle of rows, and a sort-merge anti-join against the bucketed side tells
digests that no earlier batch had. Those are appended as new; of digests that
are known, what the batch adds to their groups is appended. One pass over a
bucket's sorted files then gives each digest's group: no shuffle at any size.

Rows of the index carry their batch's name. A batch that is added again, after
a lost driver say, is told from its own first try by that name: it finds the
same digests new and appends only what is missing. Callers that write kept
rows thus add the batch, write, and may repeat both.

Two texts are equal when the same after every character of ``[\\x20\\x09-\\x0D]``
is deleted. Of equal texts the one with the most code points stays, then the
smallest id, then (for repeated ids) any one of the equal rows; against an
index filled earlier, the earlier text stays. Null counts as empty, empty texts
are one group, and an empty table gives an empty result. A null id sorts last.
Extra columns, whatever their names, pass through ``dedup`` untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.common import SPACE, free_name, stash, table_name

#: A digest is hot when its group holds over one HOT-th of all rows; so at most HOT are.
HOT = 1024
#: Additions that a table without batches of its own is indexed in.
ADDITIONS = 2


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space, 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", ""), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, chars: what the rest works on, instead of texts."""
    return docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"))


def fold(rows: DataFrame) -> DataFrame:
    """One row per digest: the id that stays, its length, and the group's size."""
    best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id")))
    return rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("best.doc_id").alias("keep_id"), (-F.col("best.chars")).alias("chars"), "group_size")


class DigestIndex:
    """Digests seen so far, in a bucketed and sorted table of the warehouse.

    Columns: digest, keep_id and chars of the batch's best row, group_size (the
    batch's rows), fresh (no earlier batch had the digest), batch.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int):
        self.spark, self.table, self.buckets = spark, table, buckets

    @classmethod
    def temporary(cls, spark: SparkSession) -> DigestIndex:
        return cls(spark, table_name(spark, "digests"), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.table)

    def entries(self) -> DataFrame:
        return self.spark.table(self.table)

    def rows(self) -> DataFrame:
        """The distinct digests, with the best row of the batch that brought each."""
        return self.entries().filter("fresh").select("digest", "keep_id", "chars")

    def groups(self) -> DataFrame:
        """digest, keep_id, chars, group_size over all batches, bucket by bucket."""
        best = F.min(F.struct((-F.col("chars")).alias("chars"), F.col("keep_id").isNull().alias("none"), F.col("keep_id").alias("id")))
        held = self.entries().groupBy("digest").agg(best.alias("best"), F.sum("group_size").alias("group_size"))
        return held.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.chars")).alias("chars"), "group_size")

    def new(self, folded: DataFrame, batch: str) -> DataFrame:
        """The rows of ``folded`` whose digest no other batch has: a sort-merge anti-join on the bucketed side."""
        if not self.exists():
            return folded
        known = self.entries().filter(F.col("fresh") & (F.col("batch") != batch)).select("digest")
        return folded.hint("merge").join(known.hint("merge"), "digest", "left_anti")

    def add(self, folded: DataFrame, batch: str | None = None) -> None:
        """Appends a batch; what an earlier try of the same batch has appended is left out."""
        batch = batch or uuid.uuid4().hex
        if not self.exists():
            self._append(folded.withColumn("fresh", F.lit(True)), batch)
            return
        folded = stash(folded.repartition(self.buckets, "digest"))
        fresh = self.new(folded, batch).withColumn("fresh", F.lit(True))
        others = self.entries().filter(F.col("fresh") & (F.col("batch") != batch)).select("digest")
        more = folded.hint("merge").join(others.hint("merge"), "digest", "left_semi").withColumn("fresh", F.lit(False))
        mine = self.entries().filter(F.col("batch") == batch).select("digest")
        # read before it is written to: the rows to append do not depend on the table while it changes
        self._append(stash(fresh.unionByName(more).hint("merge").join(mine.hint("merge"), "digest", "left_anti")), batch)

    def _append(self, rows: DataFrame, batch: str) -> None:
        # one writer task for each bucket, so that each append adds one sorted file to a bucket
        (
            rows.select("digest", "keep_id", "chars", "group_size", "fresh", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
            .write.format("parquet").mode("append").option("compression", "zstd")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def indexed(rows: DataFrame, additions: int = ADDITIONS) -> DigestIndex:
    """A new index of all ``rows`` of digests, filled in batches that ids deal the rows to."""
    index = DigestIndex.temporary(rows.sparkSession)
    for k in range(additions):
        batch = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(additions)) == k)
        index.add(fold(batch), f"batch {k}")
    return index


def resolve(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row of ``rows`` with its group: doc_id, digest, keep_id, group_size.

    Groups over one HOT-th of all rows, of which there are HOT at most, are
    looked up in a broadcast of that proven size; the other digests, none of
    them large, meet the index bucket by bucket.
    """
    total = rows.count()
    held = groups.select("digest", "keep_id", "group_size")
    hot = held.filter(F.col("group_size") * HOT > total)
    tried = rows.join(F.broadcast(hot), "digest", "left")
    found = tried.filter(F.col("group_size").isNotNull())
    rest = tried.filter(F.col("group_size").isNull()).drop("keep_id", "group_size")
    cold = rest.hint("merge").join(held.filter(F.col("group_size") * HOT <= total), "digest")
    return found.unionByName(cold)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, keep_id, group_size for every row, through a new index."""
    rows = stash(digests(docs, id_col, text_col))
    return resolve(rows, indexed(rows).groups())


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` whose text no other row of the same or an earlier batch keeps.

    Without an index, the rows are indexed in a new one. With one, ``docs`` is
    added to it as ``batch``; the same name gives the same rows again.
    Digests are computed beside the rows and shuffled without the texts; a
    row stays when its id and length are those its digest's group keeps.
    Rows that repeat both id and text are all but one dropped.
    """
    mark = free_name(docs, "mark")
    rows = stash(digests(docs, id_col, text_col))
    if index is None:
        stays = indexed(rows).groups()
    else:
        batch = batch or uuid.uuid4().hex
        folded = fold(rows)
        stays = stash(index.new(folded, batch))
        index.add(folded, batch)
    # the mark holds the id too, so that a hot digest's rows spread, and null ids match as struct fields
    stays = stays.select(F.struct("digest", F.col("keep_id").alias("id"), "chars").alias(mark))
    text = F.col(text_col)
    marked = docs.withColumn(mark, F.struct(digest(text).alias("digest"), F.col(id_col).alias("id"), F.length(F.coalesce(text, F.lit(""))).cast("long").alias("chars")))
    kept = marked.hint("merge").join(stays.hint("merge"), mark, "left_semi")
    return kept.dropDuplicates([mark]).select(*docs.columns)  # an id that repeats with an equal text stays once
