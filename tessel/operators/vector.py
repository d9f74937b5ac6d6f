"""Exact vector search and centroids over embedding spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import vectors as V
from tessel.operators.lexical import top


class IncompatibleSpace(ValueError):
    """The query vector does not fit the embedding space."""


def resolve_spaces(spaces: DataFrame, fingerprint: str, dims: int) -> list[str]:
    """Ids of the spaces with a fingerprint (with or without ``sha256:``) and dimensions."""
    bare = fingerprint.removeprefix("sha256:")
    return sorted(r.space_id for r in spaces.filter(F.col("fingerprint").isin(bare, f"sha256:{bare}") & (F.col("dimensions") == dims)).select("space_id").collect())


def resolve_space(spaces: DataFrame, fingerprint: str, dims: int) -> str | None:
    """The one space that fits; None where none does or several do."""
    found = resolve_spaces(spaces, fingerprint, dims)
    return found[0] if len(found) == 1 else None


def check_query(spaces: DataFrame, space_id: str, vector: tuple[float, ...]) -> str:
    """The space's metric, or an error where the vector does not fit it."""
    row = spaces.filter(F.col("space_id") == space_id).select("dimensions", "metric").first()
    if row is None or row.dimensions != len(vector):
        raise IncompatibleSpace(f"no space {space_id} of {len(vector)} dimensions")
    if row.metric == "cosine" and not any(vector):
        raise IncompatibleSpace("a zero vector has no direction")
    return row.metric


def scores(vectors: DataFrame, space_id: str, metric: str, query: tuple[float, ...]) -> DataFrame:
    """unit_id, score: one matrix product for each Arrow batch, and no shuffle.

    Vectors of other dimensions, with null entries or (for cosine) without a direction are left out.
    """
    import numpy as np
    import pyarrow as pa

    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"no metric {metric}")
    q = np.array(query, np.float64)

    def run(batches):
        for batch in batches:
            held = batch.column(1)
            fits = np.flatnonzero(held.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == len(q))
            held = held.take(pa.array(fits))
            flat = held.flatten()
            if flat.null_count:
                whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, len(q)).any(axis=1)
                fits, flat = fits[whole], held.filter(pa.array(whole)).flatten()
            v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
            if metric == "l2":
                score = 0.0 - np.sqrt(((v - q) ** 2).sum(axis=1))
            else:
                score = v @ q
            if metric == "cosine":
                size = np.sqrt((v * v).sum(axis=1)) * np.sqrt(q @ q)
                some = (size > 0) | np.isnan(size)
                fits, score = fits[some], score[some] / size[some]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(fits)), pa.array(score)], ["unit_id", "score"])

    rows = vectors.filter(F.col("space_id") == space_id).select("unit_id", "vector")
    return rows.mapInArrow(run, "unit_id string, score double").withColumn("score", F.round("score", 9))


def search_vector(vectors: DataFrame, scoped: DataFrame, space_id: str, metric: str, query: tuple[float, ...], limit: int) -> DataFrame:
    """unit_id, resource_id, score, rank of the best units of ``scoped``."""
    rows = scores(vectors, space_id, metric, query).join(scoped.select("unit_id", "resource_id"), "unit_id")
    return top(rows, ["unit_id"], limit)


def weighted_centroids(rows: DataFrame, key: str, id_col: str, vector: str, weight: str | None = None, normalize: bool = False) -> DataFrame:
    """key, centroid: sum of weight times vector over the sum of weights, by position; null where it has no direction.

    Positions are aggregated one by one, so a hot key is summed map-side.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    each = rows.select(key, w.alias("w"), F.posexplode(F.col(vector).cast("array<double>")).alias("at", "x"))
    mean = each.groupBy(key, "at").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    out = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centroid"))
    if not normalize:
        return out
    size = V.norm(F.col("centroid"))
    return out.withColumn("centroid", F.when(size > 0, F.transform("centroid", lambda x: x / size)))


def plain_cosine(rows: DataFrame, query: tuple[float, ...], limit: int, order: str = "ordinal") -> DataFrame:
    """unit_id, score, rank by cosine alone: a vector without a direction scores 0, a query without one finds nothing; ties by ``order``."""
    if not any(query):
        return rows.select("unit_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).filter(F.lit(False))
    q = F.lit([float(x) for x in query])
    scored = rows.select("unit_id", order, F.round(F.coalesce(V.cosine(F.col("vector"), q), F.lit(0.0)), 9).alias("score"))
    best = scored.orderBy(F.col("score").desc(), order).limit(limit)
    return best.select("unit_id", "score", F.row_number().over(Window.orderBy(F.col("score").desc(), order)).alias("rank"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys; the last of ``new`` (by ``embedded_at``) wins."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in new.columns if c not in keys]), "embedded_at").alias("row")).select(*keys, "row.*")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)
