"""Line dedup by overlapping three-line windows, in DataFrame functions alone.

Every three consecutive lines are hashed (two 64-bit hashes with seeds of
their own), windows that occur more than once in the corpus are found by an
aggregation that combines before it shuffles, and every occurrence but the
first, in order of id and line, is removed: covered positions are merged into
spans and the text is put together from what lies between them.

Defined results: a null text has one empty line; windows of blank lines alone
are never removed; texts of fewer than ``WIDTH`` lines lose nothing; rows that
agree in id and text are one document (and stay equal), rows that share an id
alone are ordered by a hash of their texts; null ids come first; an empty
table gives an empty result. Lines are cut at ``\\n`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import let, stash

WIDTH = 3
#: A window is hot when it holds over one HOT-th of all occurrences; so at most HOT are.
HOT = 1024


def lined(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tie (hash of the text), lines."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("tie"), F.split(text, "\n").alias("lines"))


def windows(rows: DataFrame) -> DataFrame:
    """doc_id, tie, at, h1, h2 of every window with a word."""
    full = F.transform("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    each = F.transform("lines", lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b")))

    def hashed(h: Column, word: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WIDTH)
        step = lambda i: F.struct(
            i.alias("at"),
            F.xxhash64(*(F.get(h, i + k)["a"] for k in range(WIDTH))).alias("h1"),
            F.xxhash64(*(F.get(h, i + k)["b"] for k in range(WIDTH))).alias("h2"),
            (F.get(word, i) | F.get(word, i + 1) | F.get(word, i + 2)).alias("full"),
        )
        return F.transform(at, step)

    held = rows.withColumns({"hashes": each, "words": full}).filter(F.size("lines") >= WIDTH)
    return held.select("doc_id", "tie", F.inline(hashed(F.col("hashes"), F.col("words")))).filter("full").drop("full")


def later(seen: DataFrame) -> DataFrame:
    """doc_id, tie, at of the windows that occur earlier in the corpus."""
    total = seen.count()
    place = F.struct("doc_id", "tie", "at")
    again = stash(seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1"))
    tried = seen.join(F.broadcast(again.filter(F.col("n") * HOT > total)), ["h1", "h2"], "left")
    rest = tried.filter("n IS NULL").drop("n", "first")
    cold = rest.hint("merge").join(again.filter(F.col("n") * HOT <= total), ["h1", "h2"])
    found = tried.filter("n IS NOT NULL").unionByName(cold)
    return found.filter(place != F.col("first")).select("doc_id", "tie", "at")


def spans(gone: DataFrame) -> DataFrame:
    """doc_id, tie, spans: covered positions merged, as sorted (begin, end) pairs."""
    order = Window.partitionBy("doc_id", "tie").orderBy("at")
    once = gone.distinct()
    marked = once.withColumn("new", (F.col("at") > F.lag("at", 1, -WIDTH - 1).over(order) + WIDTH).cast("int"))
    runs = marked.withColumn("run", F.sum("new").over(order))
    merged = runs.groupBy("doc_id", "tie", "run").agg(F.min("at").alias("begin"), (F.max("at") + WIDTH).alias("end"))
    return merged.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def between(lines: Column, cut: Column) -> Column:
    """The lines outside the spans."""
    stop = lambda i: F.coalesce(F.get(cut, i - 1)["end"], F.lit(0))
    parts = F.transform(cut, lambda s, i: F.slice(lines, stop(i) + 1, s["begin"] - stop(i)))
    tail = let(stop(F.size(cut)), lambda e: F.slice(lines, e + 1, F.greatest(F.size(lines) - e, F.lit(0))))
    return F.concat(F.flatten(parts), tail)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, n_spans and kept (the remaining text) of every row."""
    rows = lined(docs, id_col, text_col)
    cut = spans(later(stash(windows(rows))))
    key = F.struct("doc_id", "tie").alias("key")
    held = rows.select("doc_id", "lines", key).join(cut.select(key, "spans"), "key", "left")
    gone = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["begin"])
    return held.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.array_join(F.when(F.col("spans").isNull(), F.col("lines")).otherwise(between(F.col("lines"), F.col("spans"))), "\n").alias("kept"),
    )
