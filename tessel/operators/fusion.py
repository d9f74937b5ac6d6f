"""Grouping of candidates and weighted reciprocal-rank fusion.

Candidates are rows (branch_no, branch_id, weight, unit_id, resource_id,
score, rank). Positions are dense after units are deduplicated or resources
grouped, and sums run in branch order, so results do not depend on how rows
are partitioned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def branch(rows: DataFrame, no: int, branch_id: str, weight: float) -> DataFrame:
    return rows.select(F.lit(no).alias("branch_no"), F.lit(branch_id).alias("branch_id"), F.lit(float(weight)).alias("weight"), "unit_id", "resource_id", "score", "rank")


def union(branches: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, branches)


def grouped(candidates: DataFrame, target: str, evidence_limit: int = 3) -> DataFrame:
    """One row per branch and target id: position (dense, from 1), representative unit and score, evidence."""
    key = "unit_id" if target == "unit" else "resource_id"
    best = F.min(F.struct("rank", "unit_id", "score", "resource_id")).alias("best")
    seen = F.slice(F.sort_array(F.collect_list(F.struct("rank", "unit_id", "branch_id"))), 1, evidence_limit).alias("evidence")
    rows = candidates.groupBy("branch_no", "branch_id", "weight", F.col(key).alias("id")).agg(best, seen)
    order = Window.partitionBy("branch_no").orderBy("best.rank", "id")  # at most candidate_limit rows each
    return rows.select("branch_no", "branch_id", "weight", "id", F.col("best.unit_id").alias("unit_id"), F.col("best.resource_id").alias("resource_id"), F.col("best.score").alias("score"), "evidence", F.row_number().over(order).alias("position"))


def fuse(groups: DataFrame, rrf_k: int = 60, evidence_limit: int = 3) -> DataFrame:
    """id, score and the rest of every fused result: ties go by the first branch and position seen, then id."""
    part = F.struct("branch_no", "position", (F.col("weight") / (F.lit(rrf_k) + F.col("position"))).alias("part"), "unit_id", "resource_id", "score", "branch_id", "evidence")
    rows = groups.groupBy("id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    first = F.get("parts", F.lit(0))
    total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["part"])
    flat = F.flatten(F.transform("parts", lambda p: p["evidence"]))
    return rows.select(
        "id",
        F.round(total, 12).alias("score"),
        first["branch_no"].alias("first_branch"),
        first["position"].alias("first_position"),
        first["unit_id"].alias("unit_id"),
        first["resource_id"].alias("resource_id"),
        F.size("parts").alias("n_branches"),
        F.transform("parts", lambda p: F.struct(p["branch_id"].alias("branch_id"), p["position"].alias("position"), p["score"].alias("score"))).alias("contributions"),
        F.slice(F.sort_array(F.array_distinct(flat)), 1, evidence_limit).alias("evidence"),
    )


def ranked(fused: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    order = [F.col("score").desc(), F.col("first_branch"), F.col("first_position"), F.col("id")]
    best = fused.orderBy(*order).limit(offset + limit)
    out = best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).filter(F.col("rank") > offset)
    # reranking is off: the columns are there and empty
    return out.withColumns({"rerank_rank": F.lit(None).cast("int"), "rerank_score": F.lit(None).cast("double")})


def rrf_two(text: DataFrame, semantic: DataFrame, k: int = 60) -> DataFrame:
    """Unweighted fusion of two ranked lists (unit_id, rank) with the rank in each."""
    part = lambda c: F.coalesce(1 / (F.lit(k) + F.col(c)), F.lit(0.0))
    both = text.select("unit_id", F.col("rank").alias("text_rank")).join(semantic.select("unit_id", F.col("rank").alias("semantic_rank")), "unit_id", "full_outer")
    return both.withColumn("score", F.round(part("text_rank") + part("semantic_rank"), 12))


def problems(candidates: DataFrame, branch_id: str, limit: int) -> DataFrame:
    """rule, n: how a branch's first ``limit`` candidates break what fusion relies on; all rules always, 0 where kept."""
    rows = candidates.filter(F.col("rank") <= limit)
    n = F.count(F.lit(1)).alias("n")
    checks = {
        "branch_id": rows.filter(F.col("branch_id") != branch_id).agg(n),
        "ranks_from_1": rows.agg((F.coalesce(F.max("rank"), F.lit(0)) - F.count_distinct("rank")).cast("long").alias("n")),
        "rank_repeats": rows.groupBy("rank").count().filter("count > 1").agg(n),
        "unit_repeats": rows.groupBy("unit_id").count().filter("count > 1").agg(n),
    }
    return reduce(DataFrame.unionByName, (f.select(F.lit(k).alias("rule"), "n") for k, f in checks.items()))
