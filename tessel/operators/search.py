"""Search requests as one DataFrame plan, and the searches built from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators import fusion, lexical, vector
from tessel.operators.lexical import Index
from tessel.operators.scope import apply_scope
from tessel.plans.catalog import Catalog
from tessel.plans.requests import Lexical, Override, Request, Scope, Vector, timed_scope


@dataclass
class Result:
    """Rows of a search, and the branches that could not run."""

    rows: DataFrame
    degradations: list[tuple[str, str]] = field(default_factory=list)


def search(c: Catalog, request: Request, index: Index | None = None, offset: int = 0) -> Result:
    """Branches in order, grouped, fused and ranked. Errors of a branch are found while planning.

    A branch whose scope excludes itself is empty and counts as successful.
    """
    units, done, failed = c.scoped_units(), [], []
    first_error: Exception | None = None
    for no, b in enumerate(request.branches):
        scope = request.scope.narrowed(b.override)
        if scope is None:
            done.append(None)
            continue
        inside = apply_scope(units, c.facets, scope)
        try:
            if isinstance(b, Lexical):
                rows = lexical.search_lexical(c.units, inside, b.query, b.candidate_limit, bool(scope.media_types), index)
            else:
                metric = vector.check_query(c.spaces, b.space_id, b.vector)
                rows = vector.search_vector(c.vectors, inside, b.space_id, metric, b.vector, b.candidate_limit)
        except ValueError as e:
            if not request.allow_partial:
                raise
            first_error = first_error or e
            failed.append((b.branch_id, str(e)))
            continue
        done.append(fusion.branch(rows, no, b.branch_id, b.weight))
    if first_error and not done:
        raise first_error
    found = [d for d in done if d is not None]
    if not found:
        none = c.units.sparkSession.createDataFrame([], "branch_no int, branch_id string, weight double, unit_id string, resource_id string, score double, rank int")
        found = [none]
    # a unit has as much evidence as branches have run, a resource as much as asked for
    keep = len(done) if request.target == "unit" else request.evidence_limit
    groups = fusion.grouped(fusion.union(found), request.target, keep)
    return Result(fusion.ranked(fusion.fuse(groups, request.rrf_k, keep), request.limit, offset), failed)


TEXT = Override(representation_kinds=("retrieval_text",), unit_kinds=("text_chunk",))


def raw_scores(rows: DataFrame) -> DataFrame:
    """Results of a single branch with its own score in place of the fused one."""
    return rows.withColumn("score", F.get("contributions", F.lit(0))["score"])


def search_text(c: Catalog, query: str, limit: int = 10, offset: int = 0, scope: Scope | None = None, index: Index | None = None) -> DataFrame:
    r = Request((Lexical("lexical", query, candidate_limit=limit + offset, override=TEXT),), scope or Scope(), limit=limit)
    return raw_scores(search(c, r, index, offset).rows)


def search_semantic(c: Catalog, space_id: str, query: tuple[float, ...], limit: int = 10, scope: Scope | None = None) -> DataFrame:
    scope = scope or Scope()
    own = None if scope.unit_kinds else Override(unit_kinds=("text_chunk",))
    return raw_scores(search(c, Request((Vector("semantic", space_id, query, candidate_limit=limit, override=own),), scope, limit=limit)).rows)


def search_hybrid(c: Catalog, query: str, space_id: str, vec: tuple[float, ...], limit: int = 10, weights: tuple[float, float] = (0.4, 0.6), scope: Scope | None = None, target: str = "unit", index: Index | None = None) -> Result:
    """Both branches with twice the candidates; a branch of weight 0 is left out; without the vector, text alone."""
    scope = scope or Scope()
    own = None if scope.unit_kinds or target == "resource" else Override(unit_kinds=("text_chunk",))
    branches: list = []
    if weights[0]:
        branches.append(Lexical("lexical", query, weights[0], 2 * limit, TEXT))
    if weights[1]:
        branches.append(Vector("semantic", space_id, vec, weights[1], 2 * limit, own))
    return search(c, Request(tuple(branches), scope, target, limit), index)


# What a preset's transcripts, frame captions and metadata weigh, and how the first two are split.
PRESETS: dict[str, dict[str, float]] = {
    "speech_first": {"transcript": 1.0, "frame_caption": 0.35, "metadata": 0.15},
    "balanced": {"transcript": 1.0, "frame_caption": 1.0, "metadata": 0.20},
    "frames_first": {"transcript": 0.6, "frame_caption": 1.0, "metadata": 0.15},
}
LEXICAL_SHARE, SEMANTIC_SHARE = 0.4, 0.6
#: What a preset's branches look at.
SIGNALS = {
    "transcript": Override(representation_kinds=("timed_passage",), unit_kinds=("time_segment",)),
    "frame_caption": Override(representation_kinds=("frame_caption",), unit_kinds=("frame",)),
    "metadata": Override(representation_kinds=("metadata_text",), unit_kinds=("whole_resource",)),
}
MODES = ("text", "semantic", "hybrid")


def preset_request(preset: str, query: str, space_id: str | None, vec: tuple[float, ...] | None, limit: int = 10, scope: Scope | None = None, mode: str | None = None, rrf_k: int = 60) -> Request:
    """Up to three lexical and two vector branches over transcripts, frame captions and metadata.

    ``mode`` is hybrid where there is a vector and text where there is none, if not given.
    """
    if preset not in PRESETS:
        raise ValueError(f"preset must be one of {', '.join(PRESETS)}")
    mode = mode or ("hybrid" if space_id and vec else "text")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode != "text" and not (space_id and vec):
        raise ValueError("semantic branches need a space and a vector")
    most, branches = max(100, 10 * limit), []
    for name, weight in PRESETS[preset].items():
        if mode != "semantic":
            branches.append(Lexical(f"{name}_text", query, weight if name == "metadata" else round(weight * LEXICAL_SHARE, 12), most, SIGNALS[name]))
    for name, weight in PRESETS[preset].items():
        if mode != "text" and name != "metadata":
            branches.append(Vector(f"{name}_semantic", space_id, vec, round(weight * SEMANTIC_SHARE, 12), most, SIGNALS[name]))
    return Request(tuple(branches), scope or Scope(), "resource", limit, rrf_k)


def search_unified(c: Catalog, query: str, vectors_by_space: dict[str, tuple[float, ...]], limit: int = 10, scope: Scope | None = None, index: Index | None = None) -> Result:
    """One lexical branch and one for every space that fits, by resource; titles come with a join."""
    n, most = len(vectors_by_space), max(100, 10 * limit)
    branches: list = [Lexical("lexical", query, 0.4 if n else 1.0, most)]
    branches += [Vector(f"semantic:{s}", s, v, round(0.6 / n, 12), most) for s, v in sorted(vectors_by_space.items())]
    out = search(c, Request(tuple(branches), scope or Scope(), "resource", limit), index)
    titles = c.resources.select("resource_id", "title", "resource_kind")
    return Result(out.rows.join(titles, "resource_id"), out.degradations)


def search_transcripts(c: Catalog, query: str, space_id: str | None = None, vec: tuple[float, ...] | None = None, limit: int = 10, target: str = "unit", weights: tuple[float, float] = (0.4, 0.6), scope: Scope | None = None, index: Index | None = None) -> Result:
    """Passages of audio and video, by unit or resource; nothing where the scope excludes them."""
    inside = timed_scope(scope or Scope())
    most = max(10 * limit, 100)
    branches: list = [Lexical("lexical", query, weights[0], most)]
    if space_id and vec:
        branches.append(Vector("semantic", space_id, vec, weights[1], most))
    if inside is None:
        return Result(search(c, Request(tuple(branches), Scope(), target, limit), index).rows.filter(F.lit(False)))
    return search(c, Request(tuple(branches), inside, target, limit), index)


def search_images(c: Catalog, query: str, space_id: str | None = None, vec: tuple[float, ...] | None = None, limit: int = 10, weights: tuple[float, float] = (0.4, 0.6), index: Index | None = None) -> Result:
    branches: list = [Lexical("lexical", query, weights[0], 2 * limit)] if query and weights[0] else []
    if space_id and vec and weights[1]:
        branches.append(Vector("semantic", space_id, vec, weights[1], 2 * limit))
    return search(c, Request(tuple(branches), Scope(resource_kinds=("image",)), "resource", limit, allow_partial=False), index)


def search_resources_text(c: Catalog, query: str, limit: int = 10, scope: Scope | None = None, index: Index | None = None) -> Result:
    """Metadata (weight 1) and body (0.2), by resource."""
    most = max(limit, 100)
    return search(c, Request((Lexical("metadata", query, 1.0, most, Override(representation_kinds=("metadata_text",))), Lexical("body", query, 0.2, most, Override(representation_kinds=("retrieval_text",)))), scope or Scope(), "resource", limit), index)


def similar(c: Catalog, resource_id: str, space_id: str, limit: int = 10, aggregations: tuple[str, ...] = (), scope: Scope | None = None) -> DataFrame:
    """Whole-resource units nearest to a resource's own, raw scores; the resource itself is left out before the cut.

    ``aggregations`` keeps only units whose metadata name one of them.
    """
    whole = apply_scope(c.scoped_units(), c.facets, scope or Scope()).filter("unit_kind = 'whole_resource'")
    if aggregations:
        whole = whole.filter(F.get_json_object("metadata_json", "$.aggregation").isin(*aggregations))
    own = c.vectors.join(c.units.filter((F.col("resource_id") == resource_id) & (F.col("unit_kind") == "whole_resource")).select("unit_id"), "unit_id").filter(F.col("space_id") == space_id).limit(2).collect()
    if len(own) != 1:
        raise ValueError(f"{resource_id} has {len(own)} whole-resource vectors in {space_id}")
    metric = vector.check_query(c.spaces, space_id, tuple(own[0].vector))
    found = vector.search_vector(c.vectors, whole.filter(F.col("resource_id") != resource_id), space_id, metric, tuple(own[0].vector), limit)
    return found.withColumn("score_kind", F.lit("adapter_raw"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """(unit_id, vector) rows as blocks (ids, matrix) of up to ``size`` unit vectors; rows without a direction are left out."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), size):
                part = batch.slice(lo, size)
                v = np.array(part.column(1).to_pylist(), dtype=np.float64).reshape(len(part), -1)
                n = np.linalg.norm(v, axis=1)
                keep = np.flatnonzero(n > 0)
                if len(keep):
                    unit = v[keep] / n[keep, None]
                    yield pa.RecordBatch.from_arrays([pa.array([part.column(0).take(pa.array(keep)).to_pylist()]), pa.array([unit.tobytes()], pa.binary())], ["ids", "matrix"])

    return rows.select("unit_id", F.col("vector").cast("array<double>").alias("vector")).filter("vector IS NOT NULL").mapInArrow(run, "ids array<string>, matrix binary")


def all_similar(vectors_: DataFrame, queries: DataFrame, limit: int, own: bool = False, ties: bool = False) -> DataFrame:
    """query_id, unit_id, score, rank: nearest of a stated set of queries by cosine, without themselves unless ``own``.

    With ``ties``, all that score like the last one stay, and share its rank.

    Queries and vectors are cut into blocks; each pair of blocks is one matrix
    product that keeps the best per query, so memory is bounded by two blocks
    however many queries are stated, and what is shuffled by the best of a pair.
    """
    import numpy as np
    import pyarrow as pa
    from pyspark.sql import Window

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                asked, ids = np.array(batch.column(0)[i].as_py(), dtype=object), np.array(batch.column(2)[i].as_py(), dtype=object)
                q = np.frombuffer(batch.column(1)[i].as_buffer(), np.float64).reshape(len(asked), -1)
                s = np.round(q @ np.frombuffer(batch.column(3)[i].as_buffer(), np.float64).reshape(len(ids), -1).T, 9)
                if not own:
                    s[asked[:, None] == ids[None, :]] = -np.inf
                cut = -np.partition(-s, min(limit, len(ids)) - 1, axis=1)[:, min(limit, len(ids)) - 1]
                row, at = np.nonzero((s >= cut[:, None]) & np.isfinite(s))
                yield pa.RecordBatch.from_arrays([pa.array(asked[row], pa.string()), pa.array(ids[at], pa.string()), pa.array(s[row, at])], ["query_id", "unit_id", "score"])

    asked = _packed(queries, 256).select(F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"))
    near = asked.crossJoin(_packed(vectors_, 4096)).mapInArrow(run, "query_id string, unit_id string, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "unit_id")
    if ties:
        return near.withColumn("rank", F.rank().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).filter(F.col("rank") <= limit)
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def retrieve_media(units: DataFrame, query: str, limit: int = 10, weights: tuple[float, float] = (0.6, 0.4), nearby_limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """Offline search of transcripts and frames by substring counts, fused with k = 60, and frames near the hits."""
    branches = []
    for no, (kind, w) in enumerate(zip(("time_segment", "frame"), weights, strict=True)):
        if w:
            rows = lexical.substring_rank(units.filter(F.col("unit_kind") == kind), query).withColumn("score", F.col("score").cast("double"))
            branches.append(fusion.branch(lexical.top(rows, ["unit_id"], max(100, limit)), no, kind, w))
    fused = fusion.fuse(fusion.grouped(fusion.union(branches), "unit"))
    hits = fused.orderBy(F.col("score").desc(), "id").limit(limit)
    from tessel.operators.timed import nearby_frames

    return hits, nearby_frames(hits.join(units.select("unit_id", "start_ms", "end_ms", "timestamp_ms"), "unit_id").select("resource_id", "unit_id", F.coalesce("start_ms", "timestamp_ms").alias("start_ms"), F.coalesce("end_ms", "timestamp_ms").alias("end_ms")), units.filter("unit_kind = 'frame'"), nearby_limit)
