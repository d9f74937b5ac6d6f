"""Functions on half-open millisecond intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over the hull of both; 0 where they do not meet."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    both = overlap(s1, e1, s2, e2)
    return F.when((hull > 0) & (both > 0), both / hull).otherwise(F.lit(0.0))


def distance_to(t: Column, start: Column, end: Column) -> Column:
    """Milliseconds from a point to an interval, 0 inside."""
    return F.greatest(F.lit(0), start - t, t - end)
