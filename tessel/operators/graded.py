"""The graded report of ranked results: several cutoffs, times and slices over one shuffle.

* ``cases`` (query_id, case_kind, slice_tags);
* ``judgments`` (query_id, number, resource_id, unit_id, grade, start_ms, end_ms, timestamp_ms): ``number`` is a judgment's place in its case;
* ``ranked`` (query_id, rank, unit_id, resource_id, start_ms, end_ms, timestamp_ms), ranks from 1.

All rows of a case meet by its id and stay there: grades reach results, and
results' times reach judgments, through windows over that one distribution. What
is held for a case is as many times as the deepest cutoff; judgments stream.
The rows are counted first, so that the number of tasks grows with them and
what one task sorts does not.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEMPORAL = ("timestamp_hit_at_k", "interval_hit_at_k", "best_iou", "start_error_ms", "end_error_ms")
DIGITS = 12
#: Rows of a task, about: cases are dealt to as many tasks as that takes, and at least to the session's shuffle partitions.
SHARE = 400_000
_ROW = "kind string, case_kind string, slice_tags array<string>, place int, unit_id string, resource_id string, grade double, start_ms long, end_ms long, timestamp_ms long"


def measures(cutoffs: tuple[int, ...]) -> tuple[str, ...]:
    return (*(f"recall_at_{k}" for k in cutoffs), "mrr", "ndcg", *TEMPORAL)


def tasks(rows: DataFrame) -> int:
    """How many tasks the rows are dealt to: the session's shuffle partitions, or more where these would have over ``SHARE`` rows."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / SHARE))


def _rows(frame: DataFrame, kind: str, **named: str) -> DataFrame:
    """Rows of one shape: ``named`` maps a column here to one of the frame, the others are taken by name where there are any."""
    cols = []
    for part in _ROW.split(", "):
        name, of = part.split(" ", 1)
        source = named.get(name, name)
        cols.append((F.lit(kind) if name == "kind" else F.col(source) if source in frame.columns else F.lit(None)).cast(of).alias(name))
    return frame.select("query_id", *cols)


def _iou(s: Column, e: Column, gs: Column, ge: Column) -> Column:
    shared, spanned = F.greatest(F.lit(0), F.least(e, ge) - F.greatest(s, gs)), F.greatest(e, ge) - F.least(s, gs)
    return F.when(spanned == 0, 0.0).otherwise(shared / spanned)


def _gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), F.greatest(grade, F.lit(0.0))) - 1) / F.log2(rank + 1)


def per_case(cases: DataFrame, judgments: DataFrame, ranked: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10), mrr_cutoff: int = 10, ndcg_cutoff: int = 10) -> DataFrame:
    """One row per case: query_id, case_kind, slice_tags, ranked_count, temporal_applicable, the measures, and ``problem`` (null where all is well).

    Where no judgment of a case names a unit, results count by their resource, and a resource may count at several ranks;
    otherwise judgments without a unit give times alone. Every judged item is to be found, also one of grade 0. Of several
    judgments of an item the last one's grade counts. Times are of the results down to the deepest cutoff: a timestamp is hit
    exactly, an interval by overlap, and errors are those of the best overlap (the earliest among equals).
    Problems: zero-gold case (no judgment of a grade above 0), duplicate judgment, duplicate ranked id. Results and judgments of unknown cases are left out.
    """
    if not cutoffs or min(*cutoffs, mrr_cutoff, ndcg_cutoff) < 1:
        raise ValueError("invalid cutoff")
    deepest = max(cutoffs)
    rows = _rows(cases, "case").unionByName(_rows(judgments, "gold", place="number")).unionByName(_rows(ranked, "hit", place="rank"))
    case = Window.partitionBy("query_id")
    gold, hit = F.col("kind") == "gold", F.col("kind") == "hit"
    # a task's share is bounded: tasks grow in number with the rows; each of three sorts serves all windows up to the next
    parts = tasks(rows)
    same = Window.partitionBy("query_id", "kind", "unit_id", "resource_id", "start_ms", "end_ms", "timestamp_ms")
    one = Window.partitionBy("query_id", "kind", "unit_id")
    dealt = rows.repartition(parts, "query_id").sortWithinPartitions("query_id", "kind", "unit_id", "resource_id", "start_ms", "end_ms", "timestamp_ms")
    known = dealt.withColumns({
        "_known": F.max(F.col("kind") == "case").over(case), "_by_unit": F.coalesce(F.max(gold & F.col("unit_id").isNotNull()).over(case), F.lit(False)),
        "_again": gold & (F.count(F.lit(1)).over(same) > 1), "_twice": hit & (F.count(F.lit(1)).over(one) > 1),
    }).filter("_known")
    keyed = known.withColumn("key", F.when(F.col("_by_unit"), F.col("unit_id")).otherwise(F.col("resource_id")))
    # an item's grade reaches its results; one of its judgments, the last, stands for it; a key is found at a cutoff once, at whatever rank of its results: the first within the case
    item, own = Window.partitionBy("query_id", "key"), Window.partitionBy("query_id", "key", "kind").orderBy("place", "grade")
    judged = gold & F.col("key").isNotNull()
    graded = keyed.sortWithinPartitions("query_id", "key", "kind", "place", "grade").withColumns({
        "_last": F.max(F.when(judged, F.struct("place", "grade"))).over(item), "_first": F.row_number().over(own) == 1, "_one": judged & F.lead(F.lit(1)).over(own).isNull(),
    }).withColumn("_grade", F.when(F.col("key").isNotNull(), F.col("_last.grade"))).drop("_last")
    # the best order: items by grade, among equals any order gives the same gain
    best = Window.partitionBy("query_id", "_one").orderBy(F.col("_grade").desc(), "key")
    ordered = graded.sortWithinPartitions("query_id", "_one", F.col("_grade").desc(), "key").withColumn("_ideal", F.row_number().over(best))
    # times of results, at most as many as the deepest cutoff, meet each judgment that has times
    timed = F.when(hit & (F.col("place") <= deepest), F.struct("place", "start_ms", "end_ms", "timestamp_ms"))
    met = ordered.withColumn("_times", F.collect_list(timed).over(case))
    temporal = gold & (F.col("start_ms").isNotNull() | F.col("timestamp_ms").isNotNull())
    stamped = lambda t: F.col("timestamp_ms").isNotNull() & t["timestamp_ms"].isNotNull()
    spanned = lambda t: ~stamped(t) & t["start_ms"].isNotNull() & t["end_ms"].isNotNull() & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    overlaps = F.transform(F.filter("_times", spanned), lambda t: F.struct(
        _iou(t["start_ms"], t["end_ms"], F.col("start_ms"), F.col("end_ms")).alias("iou"), (-t["place"]).alias("rank"), (-F.col("place")).alias("number"),
        F.abs(t["start_ms"] - F.col("start_ms")).alias("start"), F.abs(t["end_ms"] - F.col("end_ms")).alias("end"),
    ))
    paired = met.withColumns({
        "_temporal": temporal, "_best": F.when(temporal, F.array_max(F.filter(overlaps, lambda o: o["iou"] > 0))),
        "_stamp": temporal & F.exists("_times", lambda t: stamped(t) & (t["timestamp_ms"] == F.col("timestamp_ms"))),
    }).drop("_times")
    found = hit & F.col("_grade").isNotNull()
    n_items = F.count_if("_one")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    dcg, ideal = total(F.when(found & (F.col("place") <= ndcg_cutoff), _gain(F.col("_grade"), F.col("place")))), total(F.when(F.col("_one") & (F.col("_ideal") <= ndcg_cutoff), _gain(F.col("_grade"), F.col("_ideal"))))
    firsts = F.min(F.when(found, F.col("place")))
    sums = paired.groupBy("query_id").agg(
        F.max(F.when(F.col("kind") == "case", F.col("case_kind"))).alias("case_kind"), F.max(F.when(F.col("kind") == "case", F.coalesce("slice_tags", F.array().cast("array<string>")))).alias("slice_tags"),
        F.count_if(hit).alias("ranked_count"), F.max("_temporal").alias("temporal_applicable"), *(F.round(F.coalesce(F.try_divide(F.count_if(found & F.col("_first") & (F.col("place") <= k)), n_items), F.lit(0.0)), DIGITS).alias(f"recall_at_{k}") for k in cutoffs),
        F.round(F.when(firsts <= mrr_cutoff, 1 / firsts).otherwise(0.0), DIGITS).alias("mrr"), F.round(F.when(ideal > 0, dcg / ideal).otherwise(0.0), DIGITS).alias("ndcg"),
        F.max("_stamp").cast("int").alias("timestamp_hit_at_k"), F.max("_best").alias("_best"),
        F.coalesce(F.max(gold & (F.col("grade") > 0)), F.lit(False)).alias("_gold"), F.max("_again").alias("_again"), F.max("_twice").alias("_twice"),
    )
    problem = F.when(~F.col("_gold"), "zero-gold case").when(F.col("_again"), "duplicate judgment").when(F.col("_twice"), "duplicate ranked id")
    return sums.select(
        "query_id", "case_kind", "slice_tags", "ranked_count", "temporal_applicable", *(f"recall_at_{k}" for k in cutoffs), "mrr", "ndcg", "timestamp_hit_at_k",
        F.col("_best").isNotNull().cast("int").alias("interval_hit_at_k"), F.round(F.coalesce("_best.iou", F.lit(0.0)), DIGITS).alias("best_iou"), F.coalesce("_best.start", F.lit(0)).alias("start_error_ms"),
        F.coalesce("_best.end", F.lit(0)).alias("end_error_ms"), problem.alias("problem"),
    )


def report(results: DataFrame, cutoffs: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Means of ``per_case`` rows: level (summary, case_kind, slice), label, cases, temporal_cases and the measures.

    Means of times are over cases that have times, 0 where there are none. A tag ``k:v`` is the slice ``k=v``; other tags are none, and a tag
    counts once for each time a case names it. A case with a problem makes the report an error.
    """
    fine = results.withColumn("query_id", F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem"))).otherwise(F.col("query_id").cast("string"))).filter("query_id IS NOT NULL")
    label = lambda level, text: F.struct(F.lit(level).alias("level"), text.alias("label"))
    tags = F.transform(F.filter("slice_tags", lambda t: t.contains(":")), lambda t: label("slice", F.concat(F.substring_index(t, ":", 1), F.lit("="), F.substring(t, F.instr(t, ":") + 1, F.length(t)))))
    each = fine.select("*", F.explode(F.concat(F.array(label("summary", F.lit("")), label("case_kind", F.coalesce("case_kind", F.lit("")))), tags)).alias("at"))
    mean = lambda m: F.avg(F.when(F.col("temporal_applicable"), F.col(m)) if m in TEMPORAL else F.col(m))
    return each.groupBy("at.level", "at.label").agg(F.count(F.lit(1)).alias("cases"), F.count_if("temporal_applicable").alias("temporal_cases"), *(F.round(F.coalesce(mean(m), F.lit(0.0)), DIGITS).alias(m) for m in measures(cutoffs)))
