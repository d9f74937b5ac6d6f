"""Change detection between a scan and what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_plan(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """relative_path, logical_id, source_hash, change: new, changed, unchanged or deleted.

    An empty hash (an unreadable file) is a change.
    """
    s = scanned.select("relative_path", F.col("source_hash").alias("now"))
    o = stored.filter("status = 'active'").select("relative_path", F.col("source_hash").alias("was"), "logical_id")
    kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when((F.col("now") == F.col("was")) & (F.col("now") != ""), "unchanged").otherwise("changed")
    return s.join(o, "relative_path", "full_outer").select("relative_path", "logical_id", F.coalesce("now", "was").alias("source_hash"), kind.alias("change"))


def renames(plan: DataFrame) -> DataFrame:
    """new_path, old_path, logical_id: new files whose hash exactly one deleted file had; each is used once, by path order."""
    gone = plan.filter("change = 'deleted'").groupBy("source_hash").agg(F.count(F.lit(1)).alias("n"), F.min("relative_path").alias("old_path"), F.min("logical_id").alias("logical_id")).filter("n = 1")
    order = Window.partitionBy("source_hash").orderBy("relative_path")
    fresh = plan.filter("change = 'new'").withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return fresh.select("source_hash", F.col("relative_path").alias("new_path")).join(gone, "source_hash").select("new_path", "old_path", "logical_id")


def run_status(outcomes: DataFrame) -> DataFrame:
    """Counters of a run and its status."""
    n = lambda c: F.count_if(F.col("outcome") == c).alias(f"n_{c}")
    got = outcomes.agg(F.count(F.lit(1)).alias("n_files"), n("indexed"), n("failed"), n("skipped"), n("deleted"))
    status = F.when(F.col("n_failed") == 0, "success").when(F.col("n_failed") < F.col("n_files"), "partial_success").otherwise("failed")
    return got.withColumn("status", status)


def doctor(chunks: DataFrame, postings_units: DataFrame, embeddings: DataFrame) -> DataFrame:
    """code, severity, n: chunks missing from the index or the vectors, stale and orphan vectors."""
    hashed = F.sha2("embedding_text", 256)
    checks = [
        ("missing_fts", "error", chunks.join(postings_units, "chunk_id", "left_anti")),
        ("orphan_fts", "error", postings_units.join(chunks, "chunk_id", "left_anti")),
        ("missing_embedding", "warning", chunks.join(embeddings, "chunk_id", "left_anti")),
        ("stale_embedding", "warning", chunks.join(embeddings.select("chunk_id", "embedded_hash"), "chunk_id").filter(hashed != F.col("embedded_hash"))),
        ("orphan_embedding", "error", embeddings.join(chunks, "chunk_id", "left_anti")),
    ]
    out = None
    for code, severity, rows in checks:
        row = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n")
        out = row if out is None else out.unionByName(row)
    return out
