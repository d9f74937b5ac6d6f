"""Timed text: nearby frames, overlaps and interval matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import intervals


def nearby_frames(hits: DataFrame, frames: DataFrame, limit: int) -> DataFrame:
    """resource_id, unit_id, distance_ms: frames closest to the hits (resource_id, unit_id, start_ms, end_ms) of their resource.

    A frame's distance is that to its nearest hit; hits themselves are left out.
    """
    h = hits.select("resource_id", F.col("unit_id").alias("hit_id"), "start_ms", "end_ms")
    f = frames.select("resource_id", "unit_id", "timestamp_ms")
    near = f.join(h, "resource_id").groupBy("resource_id", "unit_id").agg(F.min(intervals.distance_to(F.col("timestamp_ms"), F.col("start_ms"), F.col("end_ms"))).alias("distance_ms"), F.max((F.col("unit_id") == F.col("hit_id")).cast("int")).alias("is_hit"))
    return near.filter("is_hit = 0").drop("is_hit").orderBy("distance_ms", "unit_id").limit(limit)


def nearest_by_bins(points: DataFrame, others: DataFrame, key: str, time: str, reach_ms: int) -> DataFrame:
    """Each point's nearest other of the same key within ``reach_ms``: id, other_id, distance_ms.

    Times are cut into bins of the reach and a point meets three of them, so
    the join is an equi-join and a busy key spreads over its bins.
    """
    bin_ = F.floor(F.col(time) / reach_ms)
    p = points.select(key, "id", F.col(time).alias("t"), F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("bin"))
    o = others.select(key, F.col("id").alias("other_id"), F.col(time).alias("u"), bin_.alias("bin"))
    met = p.join(o, [key, "bin"]).withColumn("distance_ms", F.abs(F.col("t") - F.col("u"))).filter((F.col("distance_ms") <= reach_ms) & (F.col("id") != F.col("other_id")))
    return met.groupBy("id").agg(F.min(F.struct("distance_ms", "other_id")).alias("b")).select("id", F.col("b.other_id").alias("other_id"), F.col("b.distance_ms").alias("distance_ms"))


def overlaps(atoms: DataFrame, key: str = "resource_id") -> DataFrame:
    """Atoms with ``overlaps``: whether they start before the latest end so far of their resource."""
    before = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return atoms.withColumn("overlaps", F.coalesce(F.col("start_ms") < F.max("end_ms").over(before), F.lit(False)))


def interval_matches(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Ranked units and judgments of one query and resource with their IoU, where they meet."""
    g = gold.select("query_id", "resource_id", F.col("start_ms").alias("g_start"), F.col("end_ms").alias("g_end"), "grade")
    met = ranked.join(g, ["query_id", "resource_id"])
    score = intervals.iou(F.col("start_ms"), F.col("end_ms"), F.col("g_start"), F.col("g_end"))
    return met.withColumn("iou", F.round(score, 12)).filter("iou > 0").withColumns({"start_error": F.abs(F.col("start_ms") - F.col("g_start")), "end_error": F.abs(F.col("end_ms") - F.col("g_end"))})
