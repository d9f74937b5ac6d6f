"""Operators of the engine on small hand-made tables, against plain Python."""

import hashlib
import json
import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessel.functions import intervals, metadata
from tessel.functions import text as T
from tessel.functions import vectors as V
from tessel.operators import chunking, evaluation, facets, fusion, graphs, grouping, incremental, lexical, search, timed, vector
from tessel.operators.scope import apply_scope
from tessel.plans.catalog import Catalog, validate, violations
from tessel.plans.engine import Engine, HashEmbedder
from tessel.plans.requests import SCOPES, Lexical, Override, Request, Scope, Vector, facet_parse, facet_scalar, filters_from_text
from tessel.plans.store import Store, StoreError
from tessel.sources import frames, manifest, markdown, transcripts

TEXTS = ["needle in the hay", "needle needle", "the hay of café days", "alpha_beta and alpha beta", "Ёлка and елка", "", "a b c d e f needle the"]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame([(f"u{i}", f"r{i % 3}", t, i) for i, t in enumerate(TEXTS)], "unit_id string, resource_id string, text string, fts_seq long")


def value(spark, column, **cols):
    """A column evaluated on one row of literals."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())).select(column.alias("x")).first().x


# --- lexical -------------------------------------------------------------------


@pytest.mark.parametrize("query", ["needle", "needle the", '"in the"', "needle OR hay", "needle NOT hay", "nee*", "the hay", "cafe", "alpha_beta", "(needle OR hay) AND the", "NEAR(a needle, 6)", "NEAR(a needle, 3)", "^needle", "елка", "a + b"])
def test_bm25_equals_sqlite(units, query):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text, tokenize='unicode61')")
    db.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", [(i + 1, t) for i, t in enumerate(TEXTS) if t.strip()])
    want = {f"u{r - 1}": -s for r, s in db.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (query,))}
    got = {r.unit_id: r.bm25 for r in lexical.bm25(units, query).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_plain_questions_become_phrases():
    assert lexical.parse_query("what's up") == lexical.Phrase(("what", "s", "up"))
    assert lexical.parse_query("foo-bar") == lexical.Phrase(("foo", "bar"))
    for bad in ('"open', "a AND", "(a", "nope:x", "a OR OR b"):
        with pytest.raises(lexical.QuerySyntaxError):
            lexical.parse_query(bad)


def test_lexical_ties_and_statistics_outside_scope(units):
    scoped = units.filter("unit_id <> 'u0'")
    rows = lexical.search_lexical(units, scoped, "needle", 10).collect()
    whole = {r.unit_id: r.score for r in lexical.search_lexical(units, units, "needle", 10).collect()}
    assert all(r.score == whole[r.unit_id] for r in rows) and [r.rank for r in rows] == list(range(1, len(rows) + 1))


def test_postings_and_text_page(spark, units):
    index = lexical.build_index(units)
    lengths = units.select("unit_id", F.size(T.tokens(F.col("text"))).alias("dl"))
    got = {r.unit_id: round(r.score, 9) for r in lexical.postings_bm25(index, lengths, ["needle", "the"]).collect()}
    assert got == {r.unit_id: round(r.bm25, 9) for r in lexical.bm25(units, "needle the").collect()}
    page = lexical.text_page(units.withColumn("heading_path", F.lit("Guide needle")), "needle", 2, 1).collect()
    assert [r.rank for r in page] == [2, 3] and page[0].total_count == 2 and page[0].score < 0 and "<b>" in page[0].snippet


# --- vectors -------------------------------------------------------------------


def test_vector_functions(spark):
    a, b = [3.0, 4.0], [4.0, 3.0]
    col = lambda v: F.lit(v)
    assert value(spark, V.dot(col(a), col(b))) == 24 and value(spark, V.norm(col(a))) == 5
    assert value(spark, V.cosine(col(a), col(b))) == 0.96 and value(spark, V.l2(col(a), col(b))) == math.sqrt(2)
    assert value(spark, V.cosine(col(a), col([0.0, 0.0]))) is None
    assert value(spark, V.is_finite(col([1.0, float("nan")]))) is False and value(spark, V.is_finite(col([1.0]))) is True
    assert value(spark, V.to_float32(col([1e39]))) is None and value(spark, V.to_float32(col([0.1]))) == [pytest.approx(0.1)]
    got = value(spark, V.hash_vector(F.lit("some text"), 16))
    assert got == pytest.approx(HashEmbedder(16).query("some text"))


def test_vector_search_and_spaces(spark):
    rows = [("a", "s", [1.0, 0.0]), ("b", "s", [0.6, 0.8]), ("z", "s", [0.0, 0.0]), ("c", "s", [1.0, 0.0])]
    vecs = spark.createDataFrame(rows, "unit_id string, space_id string, vector array<float>")
    scoped = spark.createDataFrame([(x, "r") for x in "abcz"], "unit_id string, resource_id string")
    got = [(r.unit_id, r.rank) for r in vector.search_vector(vecs, scoped, "s", "cosine", (1.0, 0.0), 10).collect()]
    assert got == [("a", 1), ("c", 2), ("b", 3)]
    spaces = spark.createDataFrame([("s", 2, "cosine", "sha256:f"), ("t", 2, "dot", "f"), ("u", 3, "l2", "g")], "space_id string, dimensions int, metric string, fingerprint string")
    assert vector.resolve_spaces(spaces, "f", 2) == ["s", "t"] and vector.resolve_space(spaces, "f", 2) is None and vector.resolve_space(spaces, "sha256:g", 3) == "u"
    for bad in ((0.0, 0.0), (1.0,)):
        with pytest.raises(vector.IncompatibleSpace):
            vector.check_query(spaces, "s", bad)
    mean = {r.g: r.centroid for r in vector.weighted_centroids(vecs.withColumns({"g": F.lit("g"), "w": F.lit(2.0)}), "g", "unit_id", "vector", "w").collect()}
    assert mean["g"] == pytest.approx([2.6 / 4, 0.8 / 4])
    stamped = vecs.withColumn("embedded_at", F.lit(1))
    new = spark.createDataFrame([("a", "s", [0.0, 1.0], 2), ("a", "s", [0.5, 0.5], 3)], "unit_id string, space_id string, vector array<float>, embedded_at int")
    assert {r.unit_id: r.vector for r in vector.upsert(stamped, new, ["unit_id", "space_id"]).collect()}["a"] == [0.5, 0.5]


# --- scopes, fusion, requests ----------------------------------------------------


def small_catalog(spark) -> Catalog:
    files = spark.createDataFrame([(f"n{i}.md", f"Title {i}", f"hash{i % 4}", [("tags", facet_scalar("x" if i % 2 else "y"))]) for i in range(6)], "relative_path string, title string, source_hash string, facets array<struct<namespace:string,value:string>>")
    chunks = spark.createDataFrame([(f"n{i}.md", k, f"text {i} part {k} needle" + " hay" * i, i, i + k) for i in range(6) for k in range(2)], "relative_path string, chunk_index int, text string, start_line int, end_line int")
    e = HashEmbedder(16)
    plain = graphs.document_graph(files, chunks)
    return graphs.document_graph(files, chunks, e.units(plain.units.filter("unit_kind = 'text_chunk'").select("unit_id", "text")), e.space(spark))


@pytest.fixture(scope="module")
def catalog(spark):
    return small_catalog(spark)


def test_catalog_rules(spark, catalog):
    validate(catalog)
    assert violations(catalog).count() == 23
    bad = Catalog(**(catalog.tables() | {"units": catalog.units.unionByName(catalog.units.limit(1))}))
    with pytest.raises(ValueError, match="unit_id_unique"):
        validate(bad)


def test_scope_clauses(catalog):
    n = lambda **k: apply_scope(catalog.scoped_units(), catalog.facets, Scope(**k)).select("resource_id").distinct().count()
    assert n() == 6 and n(facets_any=(("tags", "s:x"), ("tags", "s:y"))) == 6 and n(facets_all=(("tags", "s:x"), ("tags", "s:y"))) == 0
    assert n(facets_none=(("tags", "s:x"),)) == 3 and n(resource_kinds=("image",)) == 0 and n(modalities=("text",), unit_kinds=("text_chunk",)) == 6
    assert apply_scope(catalog.scoped_units(), catalog.facets, None).count() == 0
    assert Scope(unit_kinds=("a", "b")).narrowed(Override(unit_kinds=("b", "c"))).unit_kinds == ("b",)
    assert Scope(unit_kinds=("a",)).narrowed(Override(unit_kinds=("c",))) is None
    assert set(SCOPES) == {"all", "notes", "audio", "video", "frames", "images"}


def test_facet_texts():
    for v in ("a b/ü~*", "", 3, -1, 2.5, True, False, None, "1", 1):
        assert facet_parse(facet_scalar(v)) == v and type(facet_parse(facet_scalar(v))) is type(v)
    for bad in ("s:a b", "i:01", "x:1", "b:True", "f:1"):
        with pytest.raises(ValueError):
            facet_parse(bad)
    assert [f.path for f in filters_from_text(["year=2020"], ["t"], {"year"})] == ["year", "tags"]
    with pytest.raises(ValueError):
        filters_from_text(["other=1"], [], {"year"})


def test_rrf(spark):
    rows = [(0, "a", 1.0, "x", "r1", 9.0, 1), (0, "a", 1.0, "y", "r1", 8.0, 2), (0, "a", 1.0, "z", "r2", 7.0, 3), (1, "b", 2.0, "z", "r2", 0.5, 1), (1, "b", 2.0, "w", "r3", 0.4, 2)]
    cand = spark.createDataFrame(rows, "branch_no int, branch_id string, weight double, unit_id string, resource_id string, score double, rank int")
    unit = {r.id: r.score for r in fusion.fuse(fusion.grouped(cand, "unit")).collect()}
    assert unit == {"x": round(1 / 61, 12), "y": round(1 / 62, 12), "z": round(1 / 63 + 2 / 61, 12), "w": round(2 / 62, 12)}
    res = [(r.id, r.score, len(r.evidence)) for r in fusion.ranked(fusion.fuse(fusion.grouped(cand, "resource")), 10).collect()]
    assert res == [("r2", round(1 / 62 + 2 / 61, 12), 2), ("r3", round(2 / 62, 12), 1), ("r1", round(1 / 61, 12), 2)]  # positions are dense after grouping
    two = {r.unit_id: r.score for r in fusion.rrf_two(spark.createDataFrame([("s", 1), ("t", 2)], "unit_id string, rank int"), spark.createDataFrame([("s", 2), ("v", 1)], "unit_id string, rank int")).collect()}
    assert two == {"s": 0.032522474881, "t": round(1 / 62, 12), "v": round(1 / 61, 12)}


def test_search_requests(spark, catalog):
    e = HashEmbedder(16)
    text = search.search_text(catalog, "needle", 4, 2).collect()
    assert [r.rank for r in text] == [3, 4, 5, 6] and all(r.score > 0 for r in text)
    both = search.search_hybrid(catalog, "needle hay", e.space_id, e.query("text 3 part 1 needle hay hay hay"), 5)
    assert not both.degradations and both.rows.first().n_branches == 2
    broken = search.search_hybrid(catalog, "needle", "nowhere", (1.0,), 5)
    assert [d[0] for d in broken.degradations] == ["semantic"] and broken.rows.count() == 5
    with pytest.raises(ValueError):
        search.search(catalog, Request((Vector("v", "nowhere", (1.0,)),)))
    disjoint = search.search(catalog, Request((Lexical("l", "needle", override=Override(resource_kinds=("image",))),), Scope(resource_kinds=("document",))))
    assert disjoint.rows.count() == 0 and not disjoint.degradations
    rid = catalog.resources.orderBy("resource_id").first().resource_id
    near = search.similar(catalog, rid, e.space_id, 3, ("centroid",)).collect()
    assert len(near) == 3 and all(r.resource_id != rid for r in near)
    assert search.search_unified(catalog, "needle", {e.space_id: e.query("x")}, 3).rows.count() == 3
    assert search.search_resources_text(catalog, "title", 3).rows.count() == 3
    with pytest.raises(ValueError):
        Request((Lexical("a", "x"), Lexical("a", "y")))


# --- facets, pages, evaluation, increments ---------------------------------------


def test_facets_and_pages(spark, catalog):
    assert {(r.value, r.n_resources) for r in facets.facet_counts(catalog.facets, "tags").collect()} == {("s:x", 3), ("s:y", 3)}
    assert {(r.display, r.value_type) for r in facets.metadata_facets(catalog.facets).collect()} == {("x", "string"), ("y", "string")}
    dup = catalog.resources.groupBy("content_hash").count().filter("count > 1").count()
    assert facets.duplicate_groups(catalog.resources).count() == dup == 2
    rows, total, more = facets.page(catalog.resources, ["resource_id"], 2, 4)
    assert (rows.count(), total, more) == (2, 6, False)
    chunks = spark.createDataFrame([("a", "f", 0, "hello wor"), ("b", "f", 1, "world"), ("c", "f", 2, "x")], "chunk_id string, file_id string, chunk_index int, text string")
    assert [(r.chunk_id, r.side) for r in facets.neighbours(chunks, "b", 1).collect()] == [("a", "before"), ("c", "after")]
    assert [(r.prev_id, r.next_id) for r in facets.linked(chunks).orderBy("chunk_index").collect()] == [(None, "b"), ("a", "c"), ("b", None)]
    assert [r.overlap_chars for r in facets.suffix_overlap(chunks).orderBy("chunk_index").collect()] == [0, 3, 0]


def test_evaluation(spark):
    ranked = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "a", 3), ("p", "z", 1)], "query_id string, item_id string, rank int")
    gold = spark.createDataFrame([("q", "a", 1), ("q", "c", 3), ("p", "y", 2), ("n", "y", 2)], "query_id string, item_id string, grade int")
    got = {r.query_id: r for r in evaluation.metrics(ranked, gold, 10).collect()}
    ideal = 7 / math.log2(2) + 1 / math.log2(3)
    assert (got["q"].recall, got["q"].mrr, got["q"].precision_k) == (0.5, 1.0, 0.2) and got["q"].ndcg == round(1 / ideal, 9)
    assert got["p"].recall == got["n"].ndcg == 0.0
    with pytest.raises(ValueError):
        evaluation.checked(ranked, gold)
    cases = spark.createDataFrame([("q", "lexical", ["k:v"]), ("p", "hybrid", [])], "query_id string, case_kind string, slice_tags array<string>")
    assert {r.slice for r in evaluation.by_slice(evaluation.metrics(ranked, gold), cases).collect()} == {"overall", "case_kind=lexical", "case_kind=hybrid", "k=v"}


def test_change_plan_and_renames(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2x"), ("new", "3"), ("copy1", "5"), ("bad", "")], "relative_path string, source_hash string")
    old = spark.createDataFrame([("a", "1", 1, "active"), ("b", "2", 2, "active"), ("gone", "3", 3, "active"), ("t1", "5", 4, "active"), ("t2", "5", 5, "active"), ("bad", "", 6, "active"), ("off", "9", 7, "deleted")], "relative_path string, source_hash string, logical_id long, status string")
    plan = incremental.change_plan(now, old)
    assert {r.relative_path: r.change for r in plan.collect()} == {"a": "unchanged", "b": "changed", "new": "new", "copy1": "new", "bad": "changed", "gone": "deleted", "t1": "deleted", "t2": "deleted"}
    assert [(r.new_path, r.old_path, r.logical_id) for r in incremental.renames(plan).collect()] == [("new", "gone", 3)]
    runs = spark.createDataFrame([("indexed",), ("failed",)], "outcome string")
    assert incremental.run_status(runs).first().status == "partial_success"


# --- scalar functions --------------------------------------------------------------


def test_text_functions(spark):
    got = lambda c, **k: value(spark, c, **k)
    assert got(T.content_fingerprint(F.lit(" a\r\nb "))) == hashlib.sha256(b"a\nb").hexdigest()
    assert got(T.logical_id("k", F.lit('ü"\n'), F.lit(3))) == "k_" + hashlib.sha256(json.dumps(['ü"\n', "3"], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:32]
    assert got(T.estimate_tokens(F.lit(""))) == 1 and got(T.estimate_tokens(F.lit("üüü"))) == 2
    assert got(T.count_words(F.lit(" a b  c "))) == len(" a b  c ".split())
    assert [got(T.seconds_to_ms(F.lit(s))) for s in ("1.0004", "2.5005", "0.0005", "x")] == [1000, 2501, 1, None]
    assert [got(T.clock_to_ms(F.lit(s))) for s in ("01:02.003", "100:00:01,000", "00:60:00.000")] == [62003, 360001000, None]
    assert got(T.preview(F.lit("x" * 201))) == "x" * 200 + "..."
    assert got(T.heading_key(F.array(F.lit("  A \t B ")))) == ["a b"]
    assert got(T.tokens(F.lit("Café-ÉTÉ Ёлка x_1"))) == T.tokens_of("Café-ÉTÉ Ёлка x_1") == ["cafe", "ete", "ёлка", "x", "1"]
    assert got(intervals.iou(F.lit(0), F.lit(10), F.lit(5), F.lit(20))) == 0.25 and got(intervals.iou(F.lit(0), F.lit(1), F.lit(5), F.lit(6))) == 0.0


def test_metadata():
    value_, gone = metadata.normalize({"a": float("nan"), "b": {1, 2}, "": 1, "d": __import__("datetime").date(2020, 1, 2), "e": object(), "tags": ["x", "x"]})
    assert value_ == {"b": [1, 2], "d": "2020-01-02", "tags": ["x", "x"]} and gone == {"invalid_key": 1, "non_finite_number": 1, "unsupported_type": 1}
    title, fs, texts = metadata.project({"title": " T ", "tags": ["x", "x", 1], "description": "d"})
    assert (title, fs, texts) == ("T", [("tags", "s:x"), ("tags", "i:1")], ["d"])
    assert metadata.resolve_pointer({"a/b": [{"~": 5}]}, "/a~1b/0/~0") == 5
    with pytest.raises(KeyError):
        metadata.resolve_pointer([1, 2], "/01")


# --- markdown, chunks ---------------------------------------------------------------

NOTE = """---
title: Note
tags: [a]
---
# One

First paragraph with **bold** and ![alt text](img.png).

- item
- [ ] task

> [!tip] Watch
> out

| a | b |
|---|---|
""" + "".join(f"| {i} | {i * i} |\n" for i in range(95)) + """
```python
@d
def f():
    return 1

x = 1

class C:
    pass
```

## Two
""" + " ".join(f"Sentence number {i} is here." for i in range(400)) + "\n\n" + "y" * 20000 + "\n\nSetext\n------\n\n***\n\n![[pic|120]] tail\n"


@pytest.mark.parametrize("text", [NOTE, NOTE.replace("\n", "\r\n"), "", "---\nopen: x\n\ntext", "---\na: 1\na: 2\n---\nbody"])
def test_markdown_blocks(text):
    doc = markdown.parse(text)
    unix = text.replace("\r\n", "\n")
    at = 0
    for b in doc.blocks:
        assert unix[b.start_offset : b.end_offset] == b.raw and b.start_offset >= at and not unix[at : b.start_offset].strip()
        assert b.start_line == unix[: b.start_offset].count("\n") + 1
        at = b.end_offset
    assert not unix[at:].strip()
    if text.startswith("---\na: 1"):
        assert doc.diagnostics == ["METADATA_PARSE_FAILED"]
    if text == NOTE:
        assert doc.title == "Note" and [b.kind for b in doc.blocks][:6] == ["frontmatter", "heading", "paragraph", "list", "callout", "table"]
        assert doc.blocks[2].plain == "First paragraph with bold and alt text." and doc.blocks[-1].plain.strip() == "tail" and doc.blocks[-1].heading_path == ("One", "Setext")


def test_chunks_cover_and_fit():
    cfg = chunking.Config(min_chars=1, target_chars=400, hard_chars=900, max_tokens=300)
    blocks = markdown.parse(NOTE).blocks
    made = list(chunking.Chunker(cfg).chunks(blocks))
    assert all(len(p.text) <= 900 and n <= 300 for p, _, n in made)
    assert "".join(p.text for p, _, _ in made if set(p.text) == {"y"}) == "y" * 20000
    prose = next(b for b in blocks if b.plain.startswith("Sentence"))
    assert "".join(p.text for p, _, _ in made if p.blocks[0] is prose) == prose.plain
    tables = [p for p, _, _ in made if p.kind == "table"]
    assert all(p.text.startswith("| a | b |\n|---|---|\n") for p in tables) and sum(p.text.count("\n") - 1 for p in tables) == 95
    assert [p.text.split("\n")[0] for p, _, _ in made if p.kind == "code"] == ["@d", "x = 1", "class C:"]
    merged = list(chunking.Chunker(chunking.Config(min_chars=50)).chunks(markdown.parse("a\n\nb\n\nc\n\n# h\n\nd").blocks))
    assert [p.text for p, _, _ in merged] == ["a\n\nb\n\nc", "d"]


def test_globs():
    import re

    assert re.match(markdown.glob_regex("**/*.md"), "a/b/c.md") and re.match(markdown.glob_regex("**/*.md"), "c.md")
    assert not re.match(markdown.glob_regex("*.md"), "a/c.md") and re.match(markdown.glob_regex("a?/**"), "ab/c/d")


# --- transcripts and grouping ---------------------------------------------------------

FORMATS = {
    "vtt": "﻿WEBVTT\n\nNOTE x\n\n1\n00:01.000 --> 00:02.000 align:start\n<b>Hi</b> &amp; you\n\n00:00:02.500 --> 00:00:03.000\nBye\n",
    "srt": "1\r\n00:00:01,000 --> 00:00:02,000\r\nHi & you\r\n\r\n2\r\n00:00:02,500 --> 00:00:03,000\r\nBye\r\n",
    "whisper_json": json.dumps({"segments": [{"start": 1.0004, "end": 2.0, "text": " Hi & you "}, {"start": 2.4995, "end": 3, "text": "Bye"}]}),
    "timed_json": json.dumps({"schema": "any.timed-transcript.v1", "atoms": [{"atom_id": "a", "start_ms": 1000, "end_ms": 2000, "text": "Hi & you"}, {"atom_id": "b", "start_ms": 2500, "end_ms": 3000, "text": "Bye"}]}),
}


@pytest.mark.parametrize("kind", FORMATS)
def test_transcript_formats_agree(kind):
    got, rows = transcripts.parse(FORMATS[kind])
    assert got == kind and [r[:4] for r in rows] == [(0, 1000, 2000, "Hi & you"), (1, 2500, 3000, "Bye")]


def test_transcript_problems(spark):
    bad = "WEBVTT\n\n00:01.000 --> 00:02.000\na\n\n00:01.500 --> 00:03.000\nb\n\n00:04.000 --> 00:04.000\nc\n\n00:05.000 --> 00:06.000\n\n"
    rows = transcripts.parse(bad)[1]
    assert [(r[0], r[-1]) for r in rows] == [(0, None), (None, "overlap"), (None, "empty_interval"), (None, "empty_text")]
    with pytest.raises(transcripts.TranscriptError):
        transcripts.parse(bad, strict=True)
    with pytest.raises(transcripts.TranscriptError):
        transcripts.parse("nothing")
    frame = transcripts.read_atoms(spark.createDataFrame([("x", FORMATS["srt"]), ("y", "nothing")], "source string, content string"))
    assert {(r.source, r.problem) for r in frame.collect()} == {("x", None), ("y", "unknown_format")}


def random_atoms(rng):
    t, out = 0, []
    for _ in range(rng.randint(0, 30)):
        t += rng.randint(0, 700)
        n = rng.randint(1, 900)
        out.append(grouping.Atom(t, t + n, " ".join(["w"] * rng.randint(1, 8)) + ("." if rng.random() < 0.3 else ""), rng.choice([None, "a", "b"])))
        t += n if rng.random() < 0.9 else n // 2
    return out


def test_grouping_covers_and_repeats():
    p = grouping.Policy(5, 10, 15, 24, 500, 2000, 3000, 5000)
    for seed in range(200):
        atoms = random_atoms(random.Random(seed))
        got = grouping.passages(atoms, p)
        assert [i for a, c in got for i in range(a, c.last + 1)] == list(range(len(atoms)))
        assert got == grouping.passages(atoms, p)
        for a, c in got:
            assert c.tokens == len(grouping.joined(atoms[a : c.last + 1]).split())
            assert c.reason == "unsplittable" or (c.tokens <= 24 and c.end_ms - atoms[a].start_ms <= 5000)
    with pytest.raises(ValueError):
        grouping.passages([grouping.Atom(5, 6, "a"), grouping.Atom(1, 2, "b")], p)


def test_group_atoms_frame(spark):
    atoms = spark.createDataFrame([("r", i, i * 1000, i * 1000 + 900, f"word{i}.", None if i % 2 else "s") for i in range(200)] + [("q", 0, 0, 10, "one", None)], "resource_id string, ordinal int, start_ms long, end_ms long, text string, speaker string")
    rows = grouping.group_atoms(atoms)
    assert {r.resource_id: r.n_covered for r in grouping.grouping_metrics(rows, atoms).collect()} == {"r": 200, "q": 1}
    assert {r.variant for r in grouping.group_variants(atoms).select("variant").distinct().collect()} == {"A", "B", "C"}


def test_nearby(spark):
    hits = spark.createDataFrame([("r", "h", 100, 200)], "resource_id string, unit_id string, start_ms long, end_ms long")
    fr = spark.createDataFrame([("r", "a", 150), ("r", "b", 260), ("r", "c", 0), ("s", "d", 150), ("r", "h", 120)], "resource_id string, unit_id string, timestamp_ms long")
    assert [(r.unit_id, r.distance_ms) for r in timed.nearby_frames(hits, fr, 3).collect()] == [("a", 0), ("b", 60), ("c", 100)]


# --- frames, manifests, store, engine --------------------------------------------------

CAPTIONS = {"schema": "s", "resource_id": "v1", "producer_fingerprint": "p", "normalization_fingerprint": "n", "metadata": {}, "frames": [{"frame_id": "f2", "timestamp_ms": 20, "caption": " b  c ", "metadata": {}}, {"frame_id": "f1", "timestamp_ms": 10, "caption": "needle", "metadata": {"k": 1}}]}


def test_captions():
    head, rows = frames.captions(json.dumps(CAPTIONS))
    assert [r[:4] for r in rows] == [(0, "f1", 10, "needle"), (1, "f2", 20, "b c")]
    for change in ({"extra": 1}, {"frames": CAPTIONS["frames"] * 2}, {"metadata": {"x": {"url": "u"}}}):
        with pytest.raises(frames.CaptionError):
            frames.captions(json.dumps(CAPTIONS | change))


def test_manifest_round_trip(spark, catalog):
    rid = catalog.resources.orderBy("resource_id").first().resource_id
    data = manifest.encode(catalog, rid)
    again = manifest.to_catalog(spark, manifest.decode(data))
    assert manifest.encode(again, rid) == data
    assert b'"text":' not in manifest.encode(catalog, rid, with_text=False, with_vectors=False)
    for bad, code in ((b'{"a":1,"a":2}', "duplicate_key"), (b'{"a":NaN}', "non_finite_number"), (b"{", "not_json"), (b"{}", "unknown_or_missing_field")):
        with pytest.raises(manifest.ManifestError) as e:
            manifest.decode(bad)
        assert e.value.code == code


def test_store(spark, catalog, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.load().units.count() == 0 and store.state()["status"] == "empty"
    first = store.commit(catalog)
    rid = catalog.resources.orderBy("resource_id").first().resource_id
    store.delete(rid)
    assert store.load().resources.count() == 5 and store.load().vectors.join(store.load().units, "unit_id", "left_anti").isEmpty()
    one = manifest.to_catalog(spark, manifest.decode(manifest.encode(catalog, rid)))
    store.replace(one)
    c = store.load()
    assert c.resources.count() == 6 and c.vectors.count() == catalog.vectors.count()
    last = c.units.filter(F.col("resource_id") == rid).agg(F.min("fts_seq")).first()[0]
    assert last > c.units.filter(F.col("resource_id") != rid).agg(F.max("fts_seq")).first()[0]
    before = store.state()["snapshot"]
    with pytest.raises(StoreError):  # a broken batch leaves the pointer where it was
        store.commit(Catalog(**(c.tables() | {"units": c.units.limit(3)})))
    assert store.state()["snapshot"] == before
    store.rollback()
    assert store.load().resources.count() == 5
    assert first in store.vacuum()


def test_engine_scan_and_search(spark, tmp_path):
    folder = tmp_path / "vault"
    (folder / "sub").mkdir(parents=True)
    (folder / ".git").mkdir()
    (folder / ".git" / "x.md").write_text("no")
    (folder / "a.md").write_text("# A\n\nneedle in text\n")
    (folder / "sub" / "b.md").write_text("---\ntitle: Bee\n---\nother words about bees\n")
    e = Engine(spark, f"file://{tmp_path}/store", HashEmbedder(16))
    assert {(r.relative_path, r.change) for r in e.scan(f"file://{folder}").collect()} == {("a.md", "new"), ("sub/b.md", "new")}
    assert {r.change for r in e.scan(f"file://{folder}").collect()} == {"unchanged"}
    assert e.search_text("needle").count() == 1 and e.search_hybrid("bees").rows.count() >= 1 and e.search_unified("bee").rows.count() >= 1
    (folder / "a.md").write_text("# A\n\nchanged words\n")
    (folder / "sub" / "b.md").unlink()
    assert {(r.relative_path, r.change) for r in e.scan(f"file://{folder}").collect()} == {("a.md", "changed"), ("sub/b.md", "deleted")}
    assert e.search_text("needle").count() == 0 and e.search_text("changed").count() == 1 and e.files()[1] == 1
    video = {"schema": "v", "resource": {"resource_id": "v1"}, "transcript": json.loads(FORMATS["timed_json"]), "frame_captions": CAPTIONS}
    e.ingest_video(json.dumps(video))
    assert e.search_media("needle", "frames_first").rows.first().resource_id == "v1" and e.search_transcripts("bye").rows.count() == 1
    images = spark.createDataFrame([("i1", "image/png", "h", "a red needle", "ocr words")], "resource_id string, media_type string, content_hash string, caption_text string, ocr_text string")
    e.ingest_images(images)
    assert e.search_images("needle").rows.first().resource_id == "i1"
    assert {r.name: r.n for r in e.status().collect()}["resources"] == 3
    assert e.analyze_storage().first().n_vectors > 0 and len(e.export_manifest("i1")) > 100


def test_streaming_ingest(spark, tmp_path):
    from tessel.streaming.ingest import stream_markdown

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("streamed needle\n")
    e = Engine(spark, f"file://{tmp_path}/store")
    q = stream_markdown(e, f"file://{folder}", f"file://{tmp_path}/cp")
    q.processAllAvailable()
    (folder / "b.md").write_text("another needle\n")
    q.processAllAvailable()
    q.stop()
    assert e.search_text("needle").count() == 2


def test_partitioning_does_not_matter(spark, catalog):
    e = HashEmbedder(16)
    want = None
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = search.search_hybrid(catalog, "needle", e.space_id, e.query("q"), 5).rows.select("id", "score", "rank").collect()
        assert want in (None, rows)
        want = rows
    spark.conf.set("spark.sql.shuffle.partitions", "4")
