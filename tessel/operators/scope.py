"""Scopes as filters and semi-joins; they always come before a candidate limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.plans.requests import CATEGORIES, Scope


def facet_pairs(facets: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    cond = reduce(lambda a, b: a | b, ((F.col("namespace") == n) & (F.col("value") == v) for n, v in pairs))
    return facets.filter(cond)


def apply_scope(units: DataFrame, facets: DataFrame, scope: Scope | None) -> DataFrame:
    """``units`` (with scope columns) inside ``scope``; None is the scope that nothing is in."""
    if scope is None:
        return units.filter(F.lit(False))
    for name in CATEGORIES:
        if values := getattr(scope, name):
            column = "modality" if name == "modalities" else name.removesuffix("s")
            units = units.filter(F.col(column).isin(*values))
    if scope.facets_any:
        units = units.join(facet_pairs(facets, scope.facets_any).select("resource_id").distinct(), "resource_id", "left_semi")
    if scope.facets_all:
        # one aggregation for any number of clauses
        held = facet_pairs(facets, scope.facets_all).groupBy("resource_id").agg(F.count_distinct("namespace", "value").alias("n")).filter(F.col("n") == len(scope.facets_all))
        units = units.join(held.select("resource_id"), "resource_id", "left_semi")
    if scope.facets_none:
        units = units.join(facet_pairs(facets, scope.facets_none).select("resource_id").distinct(), "resource_id", "left_anti")
    return units


def like(column, text: str):
    """Case-insensitive containment with SQL LIKE wildcards left active."""
    return F.col(column).ilike(f"%{text}%")


def evidence_locator(units: DataFrame) -> DataFrame:
    """``evidence_kind`` and ``evidence``: only coordinates that are safe to hand out, by locator kind."""
    kind = F.col("locator.kind")
    field = lambda n: F.get_json_object(F.col("locator.payload_json"), f"$.{n}")
    safe = {"source_span": ("relative_path", "start_line", "end_line"), "time_segment": ("start_ms", "end_ms"), "video_frame": ("timestamp_ms",), "whole_resource": ()}
    known = F.when(kind.isin(*safe), kind).otherwise(F.lit("opaque"))
    out = F.lit("{}")
    for name, names in safe.items():
        if names:
            out = F.when(kind == name, F.to_json(F.struct(*(field(n).alias(n) for n in sorted(names))))).otherwise(out)
    return units.withColumns({"evidence_kind": known, "evidence": out})
