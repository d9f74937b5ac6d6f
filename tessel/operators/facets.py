"""Facets, duplicates, neighbours, pages, and statistics of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import text as T


def facet_counts(facets: DataFrame, namespace: str | None = None) -> DataFrame:
    """namespace, value, n_resources over all origins."""
    rows = facets if namespace is None else facets.filter(F.col("namespace") == namespace)
    return rows.groupBy("namespace", "value").agg(F.count_distinct("resource_id").alias("n_resources"))


def metadata_facets(facets: DataFrame) -> DataFrame:
    """Facets of source metadata alone, with their typed values as text."""
    counts = facet_counts(facets.filter("origin = 'source'"))
    return counts.withColumns({"display": F.coalesce(T.facet_display(F.col("value")), F.col("value")), "value_type": F.coalesce(T.facet_type(F.col("value")), F.lit("string"))})


def duplicates(resources: DataFrame, resource_id: str, limit: int) -> DataFrame:
    """Other resources with the content hash of one."""
    own = resources.filter(F.col("resource_id") == resource_id).select("content_hash")
    return resources.filter(F.col("resource_id") != resource_id).join(own, "content_hash", "left_semi").select("resource_id", "content_hash").orderBy("resource_id").limit(limit)


def duplicate_groups(resources: DataFrame) -> DataFrame:
    """content_hash, n, first_id of the hashes that several resources share."""
    return resources.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("resource_id").alias("first_id")).filter("n > 1")


def neighbours(chunks: DataFrame, chunk_id: str, count: int = 2, key: str = "file_id", index: str = "chunk_index") -> DataFrame:
    """The chunks up to ``count`` places before and after one, in order; the chunk itself is left out."""
    own = chunks.filter(F.col("chunk_id") == chunk_id).select(key, F.col(index).alias("_at"))
    near = chunks.join(F.broadcast(own), key).filter(F.col(index).between(F.col("_at") - count, F.col("_at") + count) & (F.col(index) != F.col("_at")))
    return near.withColumn("side", F.when(F.col(index) < F.col("_at"), "before").otherwise("after")).drop("_at").orderBy(index)


def linked(chunks: DataFrame, key: str = "file_id", index: str = "chunk_index") -> DataFrame:
    """Chunks with prev_id and next_id."""
    order = Window.partitionBy(key).orderBy(index)
    return chunks.withColumns({"prev_id": F.lag("chunk_id").over(order), "next_id": F.lead("chunk_id").over(order)})


def duplicate_ordinals(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The nth occurrence, from 0, of each combination of keys."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def page(rows: DataFrame, order: list[str], number: int, size: int) -> tuple[DataFrame, int, bool]:
    """One page, the number of all rows, and whether another page follows."""
    total = rows.count()
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), total, number * size < total


def storage_stats(vectors: DataFrame, spaces: DataFrame, width: int = 4) -> DataFrame:
    """Per space (also empty ones): vectors, and bytes as total, min, median, nearest-rank p95 and max."""
    size = (F.size("vector") * width).cast("double")
    held = vectors.withColumn("bytes", size)
    stats = held.groupBy("space_id").agg(
        F.count(F.lit(1)).alias("n_vectors"), F.sum("bytes").alias("total_bytes"), F.min("bytes").alias("min_bytes"), F.percentile("bytes", 0.5).alias("median_bytes"),
        F.expr("percentile_disc(0.95) within group (order by bytes)").alias("p95_bytes"), F.max("bytes").alias("max_bytes"),
    )
    return spaces.select("space_id").join(stats, "space_id", "left").fillna({"n_vectors": 0})


def length_percentiles(units: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of text lengths and token estimates, and ratios of small and large units."""
    held = units.select(F.length("text").alias("chars"), T.estimate_tokens(F.col("text")).alias("tokens"))
    disc = lambda p, c, n: F.expr(f"percentile_disc({p}) within group (order by {c})").cast("long").alias(n)
    return held.agg(
        F.count(F.lit(1)).alias("n"), disc(0.5, "chars", "p50_chars"), disc(0.9, "chars", "p90_chars"), disc(0.99, "chars", "p99_chars"),
        disc(0.5, "tokens", "p50_tokens"), disc(0.9, "tokens", "p90_tokens"), disc(0.99, "tokens", "p99_tokens"),
        F.round(F.count_if(F.col("chars") < 100) / F.count(F.lit(1)), 9).alias("small_ratio"), F.round(F.count_if(F.col("chars") > 1000) / F.count(F.lit(1)), 9).alias("large_ratio"),
    )


def store_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n for each table."""
    out = None
    for name, frame in tables.items():
        row = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def linear_percentiles(rows: DataFrame, column: str) -> DataFrame:
    """p50, p95 and p99 by linear interpolation."""
    p = F.percentile(column, [0.5, 0.95, 0.99])
    return rows.agg(p.alias("p")).select(*(F.round(F.get("p", F.lit(i)), 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))))


def suffix_overlap(chunks: DataFrame, most: int = 300, key: str = "file_id") -> DataFrame:
    """Longest end of the chunk before (up to ``most`` characters) that starts a chunk."""
    order = Window.partitionBy(key).orderBy("chunk_index")
    # both ends are cut before the window, below which they stay: comparisons are of short texts, not of whole chunks
    ends = chunks.withColumns({"_head": F.left(F.col("text"), F.lit(most)), "_tail": F.right(F.col("text"), F.lit(most))})
    before = ends.withColumn("_before", F.coalesce(F.lag("_tail").over(order), F.lit("")))
    n = F.least(F.length("_before"), F.length("_head"))
    sizes = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    fits = F.filter(sizes, lambda k: F.endswith(F.col("_before"), F.left(F.col("_head"), k)))
    return before.withColumn("overlap_chars", F.coalesce(F.array_max(fits), F.lit(0))).drop("_before", "_head", "_tail")
