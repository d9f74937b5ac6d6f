"""Evaluation cases from YAML, checked, as a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MODES = ("text", "semantic", "hybrid")
CLAUSES = ("content_contains", "file_path_contains", "heading_contains")


def load(text: str) -> list[dict]:
    import yaml

    value = yaml.safe_load(text)
    if not isinstance(value, dict) or not isinstance(value.get("queries"), list):
        raise ValueError("a list of queries is needed")
    out, seen = [], set()
    for q in value["queries"]:
        if not isinstance(q, dict) or not {"id", "query", "mode", "expected"} <= q.keys():
            raise ValueError("a query needs id, query, mode and expected")
        expected, k = q["expected"], (q.get("metrics") or {}).get("recall_at", 10)
        if q["mode"] not in MODES or q["id"] in seen or not str(q["query"]).strip():
            raise ValueError(f"query {q['id']}: bad mode, repeated id or blank text")
        if not expected or set(expected) - set(CLAUSES) or isinstance(k, bool) or not isinstance(k, int) or k < 1:
            raise ValueError(f"query {q['id']}: bad expectation or cutoff")
        seen.add(q["id"])
        out.append({"query_id": str(q["id"]), "query_text": str(q["query"]), "mode": q["mode"], "recall_at": k, **{c: expected.get(c) for c in CLAUSES}})
    return out


def frame(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([tuple(c.values()) for c in load(text)], "query_id string, query_text string, mode string, recall_at int, content_contains string, file_path_contains string, heading_contains string")


def gold(chunks: DataFrame, cases: DataFrame) -> DataFrame:
    """query_id, item_id, grade: chunks that meet all of a case's clauses; ``%`` and ``_`` stay wildcards, case is ignored."""
    from pyspark.sql import functions as F

    low = lambda c: F.lower(F.col(c))
    # a clause with no wildcard is looked for as it stands; a pattern in a column would be compiled for every pair of rows
    plain = lambda clause: ~F.col(clause).rlike(r"[%_\\]")
    met = lambda column, clause: F.col(clause).isNull() | F.when(plain(clause), F.contains(F.col(column), F.col(clause))).otherwise(F.like(F.col(column), F.concat(F.lit("%"), F.col(clause), F.lit("%"))))
    asked = cases.select("query_id", *(low(c).alias(c) for c in ("content_contains", "file_path_contains", "heading_contains")))
    rows = chunks.select("chunk_id", *(low(c).alias(c) for c in ("text", "relative_path", "heading")))
    # clauses on paths and headings, which cases share, are tried once each; then the texts of what they let through
    doors = asked.select(F.col("file_path_contains").alias("_path"), F.col("heading_contains").alias("_heading")).distinct()
    let_in = rows.crossJoin(doors).filter(met("relative_path", "_path") & met("heading", "_heading"))  # a stated query set against all rows; Spark broadcasts it if its size allows
    own = let_in.join(asked, F.col("_path").eqNullSafe(F.col("file_path_contains")) & F.col("_heading").eqNullSafe(F.col("heading_contains")))
    return own.filter(met("text", "content_contains")).select("query_id", F.col("chunk_id").alias("item_id"), F.lit(1).alias("grade"))
