"""The plain chunker: a section's blocks packed into chunks of a target size with a hard limit, small ones merged, ends repeated.

Each step is a fold over a section's pieces in order (``aggregate`` with a
struct as state), as each cut depends on the one before; all steps are keyed by
file and section, so blocks are shuffled once for them. A section is one row
while it is folded.

Blocks are rows (relative_path, section, ordinal, block_type, plain, start_line,
end_line, and optionally language). Null or blank texts, front matter and
thematic breaks give nothing; so do headings that no text follows in their section.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Block types that give no text of a chunk.
SKIPPED = ("frontmatter", "thematic_break")
#: Block types that count as text; code and tables are kinds of their own, other types have none.
TEXTUAL = ("paragraph", "list", "blockquote")
#: White space as Unicode has it, with the four separators of ASCII.
SPACE = r"[\p{IsWhite_Space}\x1c-\x1f]"
KEY = ("relative_path", "section")
JOINT = "\n\n"


@dataclass(frozen=True)
class Sizes:
    """Characters: a chunk closes at ``target``, never grows past ``hard`` by another block, is small below ``least``; ``overlap`` are repeated."""

    target: int = 3200
    least: int = 1200
    hard: int = 8000
    overlap: int = 300


def _left(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+", "")


def _right(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def _stripped(c: Column) -> Column:
    return _right(_left(c))


def _kind(language: Column) -> Column:
    """text, code, mermaid or table; null for any other type."""
    kind = F.col("block_type")
    diagram = F.coalesce(F.lower(language).contains("mermaid"), F.lit(False))
    return F.when(kind.isin(*TEXTUAL), "text").when(kind.isin("code", "mermaid"), F.when(diagram | (kind == "mermaid"), "mermaid").otherwise("code")).when(kind == "table", "table")


def content_type(kinds: Column) -> Column:
    """The type of a chunk from the kinds of its blocks (an array without nulls or repeats)."""
    special = F.array_remove(kinds, "text")
    return F.when(F.size(special) == 0, "text").when(F.array_contains(kinds, "text") | (F.size(special) > 1), "mixed").otherwise(special[0])


def split_text(text: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters where sentences allow it; a text of one sentence is cut between words. A longer sentence or word stays whole."""

    def fold(parts: Column, ready) -> Column:
        none = F.array().cast("array<string>")

        def step(s: Column, part: Column) -> Column:
            full = (s["now"] != "") & (F.length(s["now"]) + 1 + F.length(part) > most)
            closed = F.when(full, F.concat(s["done"], F.array(ready(s["now"])))).otherwise(s["done"])
            now = F.when(full, part).when(s["now"] != "", ready(F.concat(s["now"], F.lit(" "), part))).otherwise(part)
            return F.struct(closed.alias("done"), now.alias("now"))

        return F.aggregate(parts, F.struct(none.alias("done"), F.lit("").alias("now")), step, lambda s: F.filter(F.concat(s["done"], F.array(_stripped(s["now"]))), lambda p: p != ""))

    sentences = F.split(text, rf"(?<=[.!?]){SPACE}+")
    words = F.array_remove(F.split(text, f"{SPACE}+"), "")
    return F.when(F.length(text) <= most, F.array(text)).when(F.size(sentences) > 1, fold(sentences, _stripped)).otherwise(fold(words, lambda c: c))


def _pieces(blocks: DataFrame, sizes: Sizes) -> DataFrame:
    """Texts that a chunk cannot divide, in order (at, part): headings with the block they stand before, or one piece of it."""
    language = F.col("language") if "language" in blocks.columns else F.lit(None).cast("string")
    order = Window.partitionBy(*KEY).orderBy("ordinal")
    is_heading = F.col("block_type") == "heading"
    held = blocks.filter(~F.col("block_type").isin(*SKIPPED) & F.col("plain").rlike(rf"[^\p{{IsWhite_Space}}\x1c-\x1f]"))
    # a heading waits for the next block of its section: both have the same number of blocks before them
    group = F.coalesce(F.sum(F.when(is_heading, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = held.select(*KEY, "ordinal", "plain", "start_line", "end_line", is_heading.alias("_heading"), _kind(language).alias("kind"), group.alias("at"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "plain"))), lambda b: b["plain"])
    groups = marked.groupBy(*KEY, "at").agg(
        F.array_join(texts, JOINT).alias("text"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.max("kind").alias("kind"), F.bool_and("_heading").alias("_alone"),
    ).filter("NOT _alone")
    # a block of no kind counts as text when it stands alone, as there is nothing else to tell
    alone = (F.length("text") > sizes.hard) & F.coalesce(F.col("kind") == "text", F.lit(True))
    cut = groups.withColumns({"alone": alone, "parts": F.when(alone, split_text(F.col("text"), sizes.target)).otherwise(F.array("text"))})
    return cut.select(*KEY, "at", "kind", "alone", "start_line", "end_line", F.posexplode("parts").alias("part", "text"))


def _drafts(pieces: DataFrame, sizes: Sizes) -> DataFrame:
    """Pieces with ``draft``: a chunk closes once it has the target's size, and before a piece that would take it past the limit."""
    row = F.struct("at", "part", F.length("text").alias("n"), "text", "kind", "alone", "start_line", "end_line")
    whole = pieces.groupBy(*KEY).agg(F.sort_array(F.collect_list(row)).alias("pieces"))

    def step(s: Column, p: Column) -> Column:
        grown = F.when(s["chars"] > 0, s["chars"] + 2 + p["n"]).otherwise(p["n"])
        closes = (s["chars"] > 0) & ((grown > sizes.hard) | p["alone"])
        mine = F.when(closes, s["draft"] + 1).otherwise(s["draft"])
        chars = F.when(closes, p["n"]).otherwise(grown)
        full = (chars >= sizes.target) | p["alone"]
        return F.struct(F.when(full, mine + 1).otherwise(mine).alias("draft"), F.when(full, 0).otherwise(chars).alias("chars"), F.concat(s["out"], F.array(mine)).alias("out"))

    start = F.struct(F.lit(0).alias("draft"), F.lit(0).alias("chars"), F.array().cast("array<int>").alias("out"))
    numbered = whole.withColumn("drafts", F.aggregate("pieces", start, step, lambda s: s["out"]))
    each = numbered.select(*KEY, F.explode(F.arrays_zip("pieces", "drafts")).alias("x"))
    return each.select(*KEY, "x.pieces.*", F.col("x.drafts").alias("draft"))


def _merged(drafts: DataFrame, sizes: Sizes) -> DataFrame:
    """Drafts (n characters) with ``chunk``: a small one joins the one before or else takes in the one after, where the limit allows."""
    whole = drafts.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("draft", "n", "text", "kinds", "start_line", "end_line"))).alias("drafts"))
    fits = lambda a, b: a + 2 + b <= sizes.hard

    def step(s: Column, i: Column) -> Column:
        n, after = F.get(F.col("drafts"), i)["n"], F.get(F.col("drafts"), i + 1)["n"]
        small = ~s["skip"] & (n < sizes.least)
        back = small & (s["chunk"] >= 0) & fits(s["last"], n)
        ahead = small & ~back & F.coalesce(fits(n, after), F.lit(False))
        stays = s["skip"] | back
        mine = F.when(stays, s["chunk"]).otherwise(s["chunk"] + 1)
        last = F.when(s["skip"], s["last"]).when(back, s["last"] + 2 + n).when(ahead, n + 2 + after).otherwise(n)
        before = F.when(stays, s["before"]).otherwise(s["last"])
        return F.struct(mine.alias("chunk"), last.alias("last"), before.alias("before"), ahead.alias("skip"), F.concat(s["out"], F.array(mine)).alias("out"))

    def finish(s: Column) -> Column:
        tail = (s["chunk"] > 0) & (s["last"] < sizes.least) & fits(s["before"], s["last"])
        return F.when(tail, F.transform(s["out"], lambda c: F.least(c, s["chunk"] - 1))).otherwise(s["out"])

    start = F.struct(F.lit(-1).alias("chunk"), F.lit(0).alias("last"), F.lit(0).alias("before"), F.lit(False).alias("skip"), F.array().cast("array<int>").alias("out"))
    numbered = whole.withColumn("chunks", F.aggregate(F.sequence(F.lit(0), F.size("drafts") - 1), start, step, finish))
    each = numbered.select(*KEY, F.explode(F.arrays_zip("drafts", "chunks")).alias("x"))
    return each.select(*KEY, "x.drafts.*", F.col("x.chunks").alias("chunk"))


def tail_of(text: Column, most: int) -> Column:
    """The end of a text, from a word's start: all of it where it has ``most`` characters at most."""
    tail = F.right(text, F.lit(most))
    return F.when(F.length(text) <= most, text).when(F.instr(tail, " ") > 0, F.substring(tail, F.instr(tail, " ") + 1, F.lit(most))).otherwise(tail)


def _overlapped(chunks: DataFrame, sizes: Sizes) -> DataFrame:
    """Chunks of text behind another of text begin with its end, as far as the hard limit allows.

    A short chunk hands on what it was given, so ends are folded in order; the state is an end of ``overlap`` characters and one more.
    """
    if sizes.overlap <= 0:
        return chunks
    keep = F.lit(sizes.overlap + 1)
    end = F.struct("chunk", F.length("text").alias("n"), (F.col("content_type") == "text").alias("is_text"), F.right("text", keep).alias("own"), F.right(_right(F.col("text")), keep).alias("trimmed"))
    ends = chunks.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct(end.alias("e"), F.struct("text", "content_type", "start_line", "end_line").alias("c")))).alias("rows"))

    def step(s: Column, r: Column) -> Column:
        e = r["e"]
        given, room = tail_of(s["end"], sizes.overlap), sizes.hard - e["n"]
        safe = F.when(F.length(given) + 1 <= room, given).otherwise(F.right(given, F.greatest(room - 1, F.lit(0))))
        meets = s["is_text"] & e["is_text"] & (room > 1) & (_stripped(safe) != "")
        head = F.when(meets, F.concat(_left(safe), F.lit(" ")))
        after = F.when(meets, F.right(F.concat(head, e["trimmed"]), keep)).otherwise(e["own"])
        return F.struct(after.alias("end"), e["is_text"].alias("is_text"), F.concat(s["out"], F.array(head)).alias("out"))

    start = F.struct(F.lit("").alias("end"), F.lit(False).alias("is_text"), F.array().cast("array<string>").alias("out"))
    headed = ends.withColumn("heads", F.aggregate("rows", start, step, lambda s: s["out"]))
    each = headed.select(*KEY, F.explode(F.arrays_zip("rows", "heads")).alias("x")).select(*KEY, F.col("x.rows.e.chunk").alias("chunk"), "x.rows.c.*", F.col("x.heads").alias("head"))
    return each.withColumn("text", F.when(F.col("head").isNull(), F.col("text")).otherwise(F.concat("head", _right(F.col("text"))))).drop("head")


def packed(blocks: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """relative_path, section, chunk_index, text, content_type, start_line, end_line; chunks are numbered through a file from 0."""
    sizes = sizes or Sizes()
    joined = lambda order: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda r: r["text"]), JOINT)
    lines = (F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))
    pieces = _drafts(_pieces(blocks, sizes), sizes).withColumn("place", F.struct("at", "part"))
    drafts = pieces.groupBy(*KEY, "draft").agg(joined("place").alias("text"), F.collect_set("kind").alias("kinds"), *lines).withColumn("n", F.length("text"))
    chunks = _merged(drafts, sizes).groupBy(*KEY, "chunk").agg(joined("draft").alias("text"), F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"), *lines)
    done = _overlapped(chunks.withColumn("content_type", content_type(F.col("kinds"))).drop("kinds"), sizes)
    order = Window.partitionBy("relative_path").orderBy("section", "chunk")
    return done.withColumn("chunk_index", F.row_number().over(order) - 1).select(*KEY, "chunk_index", "text", "content_type", "start_line", "end_line")
