"""How well chunks cover the blocks that they were made from, with numbers alone.

Blocks are rows (relative_path, ordinal, block_type, plain, start_line, end_line,
optionally language); chunks are (relative_path, chunk_index, text, start_line, end_line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import facets

#: Block types that no chunk needs to hold.
UNASKED = ("frontmatter", "heading", "thematic_break")
#: What counts as an image in a block's text.
IMAGE = r"(?i)!\[[^\]]*\]\([^)]*\)|!\[\[[^\]]+\]\]|<img\s"


def coverage(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """relative_path, ordinal, n_chunks: how many chunks share a line with each block.

    A sweep down a file's lines: chunks that have begun by a block's last line, less those that ended before its first.
    Running sums over one sorting of the file's lines take the place of a join of ranges. Blocks without lines have null.
    """
    none = F.lit(None).cast("int")
    # at one line: a block's start sees no end of the line, its end sees all beginnings of the line
    ask = blocks.select("relative_path", F.col("ordinal").cast("int").alias("ordinal"), F.explode(F.array(F.struct(F.col("start_line").alias("line"), F.lit(0).alias("turn")), F.struct(F.col("end_line").alias("line"), F.lit(3).alias("turn")))).alias("x"))
    asked = ask.select("relative_path", "ordinal", F.col("x.line").cast("long").alias("line"), F.col("x.turn").alias("turn"))
    held = chunks.filter("start_line IS NOT NULL AND end_line IS NOT NULL")
    bounds = held.select("relative_path", none.alias("ordinal"), F.explode(F.array(F.struct(F.col("start_line").alias("line"), F.lit(1).alias("turn")), F.struct(F.col("end_line").alias("line"), F.lit(2).alias("turn")))).alias("x"))
    every = asked.unionByName(bounds.select("relative_path", "ordinal", F.col("x.line").cast("long").alias("line"), F.col("x.turn").alias("turn")))
    order = Window.partitionBy("relative_path").orderBy("line", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = every.withColumns({"begun": F.count_if(F.col("turn") == 1).over(order), "ended": F.count_if(F.col("turn") == 2).over(order)})
    begun, ended = F.max(F.when((F.col("turn") == 3) & F.col("line").isNotNull(), F.col("begun"))), F.max(F.when((F.col("turn") == 0) & F.col("line").isNotNull(), F.col("ended")))
    return swept.filter("ordinal IS NOT NULL").groupBy("relative_path", "ordinal").agg((begun - ended).alias("n_chunks"))


def block_problems(blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """relative_path, ordinal, n_chunks, problem of the blocks with text that no chunk (orphan) or several chunks (repeated) hold."""
    asked = blocks.filter(~F.col("block_type").isin(*UNASKED) & (F.trim(F.coalesce("plain", F.lit(""))) != ""))
    problem = F.when(F.coalesce("n_chunks", F.lit(0)) < 1, "orphan").when(F.col("n_chunks") > 1, "repeated")
    return coverage(asked, chunks).withColumn("problem", problem).filter("problem IS NOT NULL")


def report(blocks: DataFrame, chunks: DataFrame, least: int = 1200, hard: int = 8000, overlap: int = 300) -> DataFrame:
    """One row for a corpus: files, blocks, chunks, percentiles of sizes, shares of small and oversize chunks, share of repeated ends, kinds of blocks, orphans, repeats.

    Sizes are percentiles by nearest rank; shares of nothing are 0. A chunk's text that begins with the end of the one before counts into ``overlap_ratio``.
    """
    language = F.lower(F.col("language")) if "language" in blocks.columns else F.lit(None).cast("string")
    kind, plain = F.col("block_type"), F.coalesce("plain", F.lit(""))
    diagram = (kind == "mermaid") | (kind == "code") & F.coalesce(language.contains("mermaid"), F.lit(False))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 9)).otherwise(0.0)
    # repeats by digests: partial counts meet per digest before they are summed
    repeats = blocks.groupBy(F.sha2(F.concat_ws("\0", kind, plain), 256).alias("_d")).agg((F.count(F.lit(1)) - 1).alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("duplicate_block_count"))
    counted = blocks.agg(
        F.count_distinct("relative_path").alias("files_count"), F.count(F.lit(1)).alias("blocks_count"), F.count_if((kind == "code") & ~diagram).alias("code_count"), F.count_if(kind == "table").alias("table_count"),
        F.count_if(diagram).alias("diagram_count"), F.coalesce(F.sum(F.regexp_count(plain, F.lit(IMAGE))), F.lit(0)).alias("image_count"),
    )
    lengths = facets.suffix_overlap(chunks.withColumn("text", F.coalesce("text", F.lit(""))), overlap, "relative_path").select(F.length("text").alias("chars"), T.estimate_tokens(F.col("text")).alias("tokens"), "overlap_chars")
    disc = lambda p, c, n: F.coalesce(F.expr(f"percentile_disc({p}) within group (order by {c})").cast("long"), F.lit(0)).alias(n)
    n = F.count(F.lit(1))
    sized = lengths.agg(
        n.alias("chunks_count"), *(disc(p, c, f"chunk_{name}_p{round(100 * p)}") for name, c in (("length", "chars"), ("tokens", "tokens")) for p in (0.5, 0.9, 0.99)),
        share(F.count_if(F.col("chars") < least), n).alias("small_chunk_ratio"), share(F.count_if(F.col("chars") > hard), n).alias("oversize_chunk_ratio"),
        share(F.sum("overlap_chars"), F.sum("chars")).alias("overlap_ratio"),
    )
    problems = block_problems(blocks, chunks).agg(F.count_if(F.col("problem") == "orphan").alias("orphan_block_count"), F.count_if(F.col("problem") == "repeated").alias("repeated_block_count"))
    # each side is one row
    return counted.join(F.broadcast(repeats)).join(F.broadcast(sized)).join(F.broadcast(problems))
