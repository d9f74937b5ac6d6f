"""Relevance evaluation: ranked results against graded judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_seen(ranked: DataFrame) -> DataFrame:
    """(query_id, item_id, rank) with each item at its first rank and ``seen`` false for repeats."""
    order = Window.partitionBy("query_id", "item_id").orderBy("rank")
    return ranked.withColumn("seen", F.row_number().over(order) == 1)


def metrics(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Per query of ``gold`` (query_id, item_id, grade): recall, precision (by returned and by k), MRR, nDCG at k.

    Repeats gain nothing. Queries without judgments do not appear.
    """
    top = first_seen(ranked).filter(F.col("rank") <= k)
    hit = top.join(gold.select("query_id", "item_id", "grade"), ["query_id", "item_id"], "left")
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    got = hit.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("returned"),
        F.count_if(F.col("grade").isNotNull() & F.col("seen")).alias("found"),
        F.count_if(F.col("grade").isNotNull()).alias("hits"),
        F.min(F.when(F.col("grade").isNotNull(), F.col("rank"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("seen"), gain)), F.lit(0.0)).alias("dcg"),
    )
    order = Window.partitionBy("query_id").orderBy(F.col("grade").desc(), "item_id")
    ideal = gold.withColumn("rank", F.row_number().over(order))
    best = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"), F.sum(F.when(F.col("rank") <= k, gain)).alias("idcg"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = best.join(got, "query_id", "left")
    return rows.select(
        "query_id",
        "n_gold",
        F.round(zero(F.col("found") / F.col("n_gold")), 9).alias("recall"),
        F.round(zero(F.col("hits") / F.col("returned")), 9).alias("precision_returned"),
        F.round(zero(F.col("hits") / F.lit(k)), 9).alias("precision_k"),
        F.round(zero(1 / F.col("first")), 9).alias("mrr"),
        F.round(F.when(F.col("idcg") > 0, zero(F.col("dcg") / F.col("idcg"))).otherwise(0.0), 9).alias("ndcg"),
    )


MEASURES = ("recall", "precision_returned", "precision_k", "mrr", "ndcg")


def averages(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(m), 9).alias(m) for m in MEASURES))


def by_slice(per_query: DataFrame, cases: DataFrame) -> DataFrame:
    """Macro means overall, by case kind and by slice tag (``k:v`` reads ``k=v``)."""
    rows = per_query.join(cases, "query_id")
    label = F.concat(F.array(F.lit("overall"), F.concat(F.lit("case_kind="), F.col("case_kind"))), F.transform("slice_tags", lambda t: F.regexp_replace(t, ":", "=")))
    each = rows.select("*", F.explode(F.array_distinct(label)).alias("slice"))
    return each.groupBy("slice").agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(m), 9).alias(m) for m in MEASURES))


def temporal(matches: DataFrame, cases: DataFrame) -> DataFrame:
    """Best IoU per temporal case and its errors; cases without a match count 0."""
    best = matches.groupBy("query_id").agg(F.max(F.struct("iou", -F.col("start_error"), -F.col("end_error"))).alias("b"), F.max("iou").alias("best_iou"))
    rows = cases.join(best, "query_id", "left")
    return rows.select("query_id", F.coalesce("best_iou", F.lit(0.0)).alias("best_iou"), (F.coalesce("best_iou", F.lit(0.0)) > 0).alias("hit"), (-F.col("b.col2")).alias("start_error"), (-F.col("b.col3")).alias("end_error"))


def checked(ranked: DataFrame, gold: DataFrame) -> None:
    """Raises on a case without gold, a repeated judgment or a repeated ranked id."""
    bad = [
        ("case without gold", ranked.select("query_id").distinct().join(gold, "query_id", "left_anti")),
        ("repeated judgment", gold.groupBy("query_id", "item_id").count().filter("count > 1")),
        ("repeated ranked id", ranked.groupBy("query_id", "item_id").count().filter("count > 1")),
    ]
    for what, rows in bad:
        if not rows.isEmpty():
            raise ValueError(what)


def holders(rows: DataFrame, items: DataFrame) -> DataFrame:
    """query_id, item_id of the rows (item_id, text) that hold the text of an item (query_id, text).

    Blocks of items meet blocks of rows, so neither side is held whole anywhere and no plan grows with the items.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                ids, texts, asked, numbers = (batch.column(k)[i].as_py() for k in range(4))
                found = [(q, d) for q, item in zip(numbers, asked, strict=True) for d, t in zip(ids, texts, strict=True) if item in t]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["query_id", "item_id"])

    def pack(names):
        def go(batches):
            for batch in batches:
                for lo in range(0, len(batch), 512):
                    part = batch.slice(lo, 512)
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()]), pa.array([part.column(1).to_pylist()])], names)

        return go

    held = rows.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL").mapInArrow(pack(["ids", "texts"]), "ids array<long>, texts array<string>")
    asked = items.select(F.col("query_id").cast("long"), "text").filter("text IS NOT NULL").mapInArrow(pack(["qs", "items"]), "qs array<long>, items array<string>")
    return held.crossJoin(asked).select("ids", "texts", "items", "qs").mapInArrow(run, "query_id long, item_id long")


def deltas(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Differences of the metrics (name, value) that both runs have."""
    b = baseline.select("name", F.col("value").alias("base"))
    return current.join(b, "name").select("name", "value", "base", F.round(F.col("value") - F.col("base"), 12).alias("delta"))


def chunk_audit(chunks: DataFrame) -> DataFrame:
    """Counts by content type with shares of small and oversize chunks and repeated texts."""
    return chunks.groupBy("content_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.length("text") < F.lit(200)).alias("n_small"), F.count_if(F.length("text") > F.lit(8000)).alias("n_oversize"),
        (F.count(F.lit(1)) - F.count_distinct("text")).alias("n_repeated"),
    )
