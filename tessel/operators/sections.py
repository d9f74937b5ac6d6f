"""Sections of documents from their headings, as window computations over blocks.

Blocks are rows (relative_path, ordinal, block_type, level, plain, start_line,
end_line) as ``sources.markdown.parse_files`` makes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6


def heading_paths(blocks: DataFrame) -> DataFrame:
    """Blocks with ``path``: the open heading of each level, dropped once a higher one begins."""
    so_far = Window.partitionBy("relative_path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("block_type") == "heading"
    last = {k: F.max(F.when(is_heading & (F.col("level") == k), F.struct("ordinal", "plain"))).over(so_far) for k in range(1, LEVELS + 1)}
    marked = blocks.withColumns({f"_h{k}": c for k, c in last.items()})
    parts = []
    for k in range(1, LEVELS + 1):
        above = [F.col(f"_h{j}.ordinal") for j in range(1, k)]
        newest = F.greatest(*above, F.lit(-1)) if above else F.lit(-1)
        parts.append(F.when(F.col(f"_h{k}.ordinal") > newest, F.col(f"_h{k}.plain")))
    return marked.withColumn("path", F.array_compact(F.array(*parts))).drop(*last and [f"_h{k}" for k in last])


def sections(blocks: DataFrame) -> DataFrame:
    """relative_path, section, level, title, path, start_line, end_line, parent: a section ends before the next heading of its level or above.

    What stands before the first heading is section 0 of level 0.
    """
    paths = heading_paths(blocks)
    heads = paths.filter("block_type = 'heading'")
    last = blocks.groupBy("relative_path").agg(F.max("end_line").alias("eof"), F.min("start_line").alias("bof"))
    first = heads.groupBy("relative_path").agg(F.min("start_line").alias("first_heading"))
    preamble = last.join(first, "relative_path", "left").filter("first_heading IS NULL OR bof < first_heading").select("relative_path", F.lit(0).alias("level"), F.lit("").alias("title"), F.array().cast("array<string>").alias("path"), F.col("bof").alias("start_line"), F.coalesce(F.col("first_heading") - 1, F.col("eof")).alias("end_line"))
    after = Window.partitionBy("relative_path").orderBy("start_line").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= k, F.col("start_line"))).over(after) for k in range(1, LEVELS + 1)]
    held = heads.withColumn("_next", F.element_at(F.array(*ends), F.col("level").cast("int"))).join(last, "relative_path")
    own = held.select("relative_path", F.col("level").cast("int").alias("level"), F.col("plain").alias("title"), "path", "start_line", F.coalesce(F.col("_next") - 1, F.col("eof")).alias("end_line"))
    rows = preamble.unionByName(own)
    order = Window.partitionBy("relative_path").orderBy("start_line")
    numbered = rows.withColumn("section", F.row_number().over(order) - 1)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    parents = [F.max(F.when((F.col("level") > 0) & (F.col("level") < k), F.col("section"))).over(before) for k in range(1, LEVELS + 1)]
    return numbered.withColumn("parent", F.when(F.col("level") > 1, F.element_at(F.array(*parents), F.greatest(F.col("level"), F.lit(1)))))


def assign(blocks: DataFrame, secs: DataFrame) -> DataFrame:
    """Each block's deepest covering section: of those that hold all its lines, the highest level, then the latest start."""
    s = secs.select("relative_path", "section", "level", F.col("start_line").alias("s_start"), F.col("end_line").alias("s_end"))
    met = blocks.select("relative_path", "ordinal", "start_line", "end_line").join(s, "relative_path").filter("start_line >= s_start AND end_line <= s_end")
    return met.groupBy("relative_path", "ordinal").agg(F.max_by("section", F.struct("level", "s_start")).alias("section"))


def owners(chunks: DataFrame, secs: DataFrame) -> DataFrame:
    """Each chunk's section: the nearest heading before it with the same path."""
    s = secs.select("relative_path", "section", "path", F.col("start_line").alias("s_start"))
    met = chunks.select("relative_path", "chunk_index", "start_line", F.col("heading_path").alias("path")).join(s, ["relative_path", "path"]).filter("s_start <= start_line")
    return met.groupBy("relative_path", "chunk_index").agg(F.max_by("section", "s_start").alias("section"))


def provenance(chunks: DataFrame, secs: DataFrame) -> DataFrame:
    """Chunks (relative_path, section, heading_path) with their section's title; a chunk without one stays, with its own heading path."""
    s = secs.select("relative_path", "section", F.col("title").alias("section_title"), F.col("path").alias("section_path"))
    held = chunks.join(s, ["relative_path", "section"], "left")
    return held.withColumn("heading_path", F.coalesce("section_path", "heading_path")).drop("section_path")
