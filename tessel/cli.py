"""Command line: ``python -m tessel.cli --root STORE COMMAND ...``; every command prints one JSON envelope."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession


def ok(data, **meta) -> dict:
    return {"ok": True, "data": data, "meta": meta}


def failed(code: str, message: str) -> dict:
    return {"ok": False, "error": {"code": code, "message": message}, "meta": {}}


def rows(frame: DataFrame) -> list[dict]:
    return [json.loads(x) for x in frame.toJSON().collect()]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessel")
    p.add_argument("--root", required=True, help="folder of the store")
    p.add_argument("--dims", type=int, default=128, help="dimensions of the hash embedder")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [c := sub.add_parser(name), *(c.add_argument(*a, **k) for a, k in args)][0]
    arg = lambda *a, **k: (a, k)
    limit, query = arg("--limit", type=int, default=10), arg("query")
    add("scan", arg("folder"), arg("--include", action="append"), arg("--exclude", action="append", default=[]), arg("--force", action="store_true"))
    s = add("search", query, limit, arg("--mode", choices=("text", "semantic", "hybrid", "unified")), arg("--scope", default="all"), arg("--offset", type=int, default=0), arg("--weights", type=float, nargs=2), arg("--preset"))
    s.add_argument("--tag", action="append", default=[])
    s.add_argument("--meta", action="append", default=[], metavar="PATH=JSON")
    add("transcripts", arg("folder"), arg("--kind", default="audio"))
    add("video", arg("file"))
    add("import", arg("file"))
    for name in ("export", "delete", "duplicates", "similar", "resource", "units"):
        add(name, arg("resource_id"), limit)
    add("neighbours", arg("unit_id"), arg("--count", type=int, default=1))
    add("files", arg("--page", type=int, default=1), arg("--size", type=int, default=50))
    add("facets", arg("--namespace"), arg("--metadata", action="store_true"))
    add("chunk", arg("unit_id"))
    for name in ("init", "status", "storage", "check", "doctor", "inspect", "rollback", "vacuum", "rebuild-vectors", "rebuild-fts"):
        add(name)
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    from tessel.plans.catalog import violations
    from tessel.plans.engine import Engine, HashEmbedder
    from tessel.plans.requests import SCOPES, MetadataFilter, filters_from_text

    e = Engine(spark, a.root, HashEmbedder(a.dims))
    c = a.command
    if c == "scan":
        return ok(rows(e.scan(a.folder, tuple(a.include or ("**/*.md",)), tuple(a.exclude), a.force)))
    if c == "search":
        if a.scope not in SCOPES:
            return failed("unknown_scope", a.scope)
        mode = a.mode or ("hybrid" if not a.preset else None)
        # an option that a mode has no use for is an error, not dropped
        if a.offset and (mode != "text" or a.preset):
            return failed("unusable_option", "--offset needs --mode text")
        if a.weights and (mode != "hybrid" or a.preset):
            return failed("unusable_option", "--weights needs --mode hybrid")
        if a.preset and mode == "unified":
            return failed("unusable_option", "--preset has modes text, semantic and hybrid")
        filters = (*filters_from_text(a.meta, [], {r.namespace for r in e.metadata_facets().select("namespace").collect()} if a.meta else set()), *(MetadataFilter("tags", t) for t in a.tag))
        if a.preset:
            r = e.search_media(a.query, a.preset, a.limit, a.scope, mode, filters)
            return ok(rows(r.rows), degradations=r.degradations)
        if mode == "text":
            return ok(rows(e.search_text(a.query, a.limit, a.offset, a.scope, filters)))
        if mode == "semantic":
            return ok(rows(e.search_semantic(a.query, a.limit, a.scope, filters)))
        r = e.search_hybrid(a.query, a.limit, tuple(a.weights or (0.4, 0.6)), a.scope, filters) if mode == "hybrid" else e.search_unified(a.query, a.limit, a.scope, filters)
        return ok(rows(r.rows), degradations=r.degradations)
    if c == "transcripts":
        return ok(e.ingest_transcripts(a.folder, a.kind))
    if c in ("video", "import"):
        with open(a.file, "rb") as f:
            data = f.read()
        return ok(e.ingest_video(data.decode()) if c == "video" else e.import_manifest(data))
    if c == "files":
        frame, total, more = e.files(a.page, a.size)
        return ok(rows(frame), total=total, has_next=more)
    if c == "facets":
        return ok(rows(e.metadata_facets() if a.metadata else e.facets(a.namespace)))
    if c == "export":
        return ok(json.loads(e.export_manifest(a.resource_id)))
    if c == "delete":
        return ok(e.delete(a.resource_id))
    if c in ("duplicates", "similar"):
        return ok(rows(getattr(e, c)(a.resource_id, a.limit)))
    if c in ("resource", "units"):
        return ok(rows(getattr(e, c)(a.resource_id)))
    if c == "neighbours":
        return ok(rows(e.neighbours(a.unit_id, a.count)))
    if c == "chunk":
        found = rows(e.unit(a.unit_id))
        return ok(found[0]) if found else failed("unknown_unit", a.unit_id)
    if c == "check":
        return ok(rows(violations(e.catalog)))
    return ok({"status": lambda: rows(e.status()), "storage": lambda: rows(e.analyze_storage()), "init": e.init, "doctor": lambda: rows(e.doctor()), "inspect": lambda: rows(e.inspect()), "rebuild-fts": e.rebuild_index, "rollback": e.rollback, "vacuum": e.store.vacuum, "rebuild-vectors": e.rebuild_vectors}[c]())


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tessel").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        out = run(spark, a)
    except (ValueError, RuntimeError, KeyError, OSError) as e:
        out = failed(type(e).__name__, str(e).splitlines()[0] if str(e) else "")
    print(json.dumps(out, ensure_ascii=False))
    return 0 if out["ok"] else 1


if __name__ == "__main__":
    sys.exit(main())
