"""The plain chunker, the coverage audit and the graded report."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tessel import report_queries as R
from tessel.operators import audit, graded, grouping, lexical, packing
from tessel.operators.packing import Sizes

SF = "/root/testdata/sf0.001"
BLOCK = "relative_path string, section int, ordinal int, block_type string, language string, plain string, start_line int, end_line int"


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for t in ("documents", "conversations", "lineitem", "orders"):
        out.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


def blocks(spark, *rows):
    """Blocks of one file from (section, type, text), a line each; a type may carry a language."""
    return spark.createDataFrame([("x.md", s, i, k.split(":")[0], k.partition(":")[2] or None, t, i + 1, i + 1) for i, (s, k, t) in enumerate(rows)], BLOCK)


def chunks(spark, sizes, *rows):
    return [(r.section, r.content_type, r.text) for r in packing.packed(blocks(spark, *rows), sizes).orderBy("chunk_index").collect()]


@pytest.mark.parametrize("sizes", [Sizes(300, 120, 500, 40), Sizes(60, 50, 90, 30), Sizes(200, 1, 5000, 0)])
def test_packed_against_sql(spark, db, sizes):
    want = db.sql(R.packed_sql(sizes) + " SELECT doc_id::VARCHAR, sec, chunk_index, text, content_type, start_line, end_line FROM done").fetchall()
    got = [tuple(r) for r in packing.packed(R.line_blocks(spark, SF), sizes).collect()]
    assert sorted(got) == sorted(want)


def test_packed_cases(spark):
    small = Sizes(20, 5, 40, 0)
    # headings go with the next block of their section; one that nothing follows is dropped
    assert chunks(spark, small, (0, "heading", "A"), (0, "heading", "B"), (0, "paragraph", "one"), (1, "heading", "C")) == [(0, "text", "A\n\nB\n\none")]
    # blank, null, front matter and rules give nothing
    assert chunks(spark, small, (0, "paragraph", " \t "), (0, "paragraph", None), (0, "frontmatter", "a: b"), (0, "thematic_break", "---")) == []
    # types: diagrams are code of a language, two special ones or one with text are mixed
    assert [c[1] for c in chunks(spark, small, (0, "code:py", "x" * 30), (1, "code:Mermaid", "y" * 30), (2, "table", "z"), (2, "paragraph", "t"), (3, "html", "<p>"))] == ["code", "mermaid", "mixed", "text"]
    # code stays whole past the limit; long text is cut at sentences, or between words where it has one sentence
    got = chunks(spark, Sizes(20, 1, 30, 0), (0, "code", "c" * 50), (1, "paragraph", "One two three. Four five six! Seven eight?"), (2, "paragraph", "alpha beta gamma delta epsilon zeta"))
    assert [c[2] for c in got] == ["c" * 50, "One two three.", "Four five six!", "Seven eight?", "alpha beta gamma", "delta epsilon zeta"]
    # a small chunk joins the one before, else takes in the one after, never past the limit
    assert [c[2] for c in chunks(spark, Sizes(10, 5, 14, 0), (0, "paragraph", "a" * 10), (0, "paragraph", "b"), (1, "paragraph", "c" * 13), (1, "paragraph", "d"))] == ["a" * 10 + "\n\nb", "c" * 13, "d"]
    assert chunks(spark, small) == []


def test_packed_overlap(spark):
    words = "alpha beta gamma delta"
    # the end of a chunk from a word on, within a section and between texts alone
    got = chunks(spark, Sizes(20, 1, 60, 12), (0, "paragraph", words), (0, "paragraph", "second text of words"), (1, "paragraph", "a section of its own"), (1, "code", "c" * 20))
    assert [c[2] for c in got] == [words, "gamma delta second text of words", "a section of its own", "c" * 20]
    # what is handed on never takes a chunk past the limit
    assert [len(c[2]) for c in chunks(spark, Sizes(20, 1, 30, 12), (0, "paragraph", words), (0, "paragraph", "B" * 27))] == [22, 30]
    # a short chunk hands on what it was given
    got = chunks(spark, Sizes(5, 1, 60, 12), (0, "paragraph", "first one"), (0, "paragraph", "two 2"), (0, "paragraph", "three"))
    assert [c[2] for c in got] == ["first one", "first one two 2", "one two 2 three"]


def test_coverage(spark):
    b = blocks(spark, (0, "paragraph", "a"), (0, "heading", "h"), (0, "code:py", "c"), (0, "paragraph", "![x](y) <img src=z>"), (0, "paragraph", "![[z]]"), (0, "paragraph", "a"), (0, "mermaid", "m"))
    c = spark.createDataFrame([("x.md", 0, "abcd", 1, 3), ("x.md", 1, "cdef", 3, 4), ("x.md", 2, "gh", 6, 6), ("x.md", 3, None, None, None), ("y.md", 0, "z" * 20, 5, 5)], "relative_path string, chunk_index int, text string, start_line int, end_line int")
    assert sorted((r.ordinal, r.n_chunks) for r in audit.coverage(b, c).collect()) == [(0, 1), (1, 1), (2, 2), (3, 1), (4, 0), (5, 1), (6, 0)]
    assert sorted((r.ordinal, r.problem) for r in audit.block_problems(b, c).collect()) == [(2, "repeated"), (4, "orphan"), (6, "orphan")]
    got = audit.report(b, c, least=3, hard=10, overlap=4).first().asDict()
    assert [got[k] for k in ("files_count", "blocks_count", "code_count", "table_count", "diagram_count", "image_count", "duplicate_block_count", "chunks_count")] == [1, 7, 1, 0, 1, 3, 1, 5]
    assert (got["chunk_length_p50"], got["chunk_length_p99"], got["orphan_block_count"], got["repeated_block_count"]) == (4, 20, 2, 1)
    assert (got["small_chunk_ratio"], got["oversize_chunk_ratio"], got["overlap_ratio"]) == (0.4, 0.2, round(2 / 30, 9))
    # chunks inside one block count, in whatever order
    inside = spark.createDataFrame([("x.md", 0, "p", 5, 9)], "relative_path string, ordinal int, plain string, start_line int, end_line int")
    parts = spark.createDataFrame([("x.md", i, "t", a, z) for i, (a, z) in enumerate([(6, 6), (1, 4), (9, 12), (7, 8), (10, 11)])], "relative_path string, chunk_index int, text string, start_line int, end_line int")
    assert audit.coverage(inside, parts).first().n_chunks == 3
    # nothing at all
    empty = audit.report(b.limit(0), c.limit(0)).first().asDict()
    assert set(empty.values()) == {0, 0.0}


JUDGED = "query_id string, number int, resource_id string, unit_id string, grade int, start_ms long, end_ms long, timestamp_ms long"
RANKED = "query_id string, rank int, unit_id string, resource_id string, start_ms long, end_ms long, timestamp_ms long"
CASES = "query_id string, case_kind string, slice_tags array<string>"


def graded_rows(spark, cases, judged, ranked, **options):
    return graded.per_case(spark.createDataFrame(cases, CASES), spark.createDataFrame(judged, JUDGED), spark.createDataFrame(ranked, RANKED), **options)


def test_graded(spark):
    cases = [("a", "hybrid", ["mode:hybrid", "plain"]), ("b", "lexical", ["mode:hybrid"]), ("c", "lexical", None)]
    judged = [("a", 0, "r1", "good", 3, 100, 200, None), ("a", 1, "r1", "weak", 1, 300, 400, None), ("a", 2, "r1", None, 1, None, None, 7), ("b", 0, "r", None, 2, None, None, None), ("b", 1, "s", None, 0, None, None, None), ("c", 0, "r", "u", 1, None, None, None), ("z", 0, "r", "u", 1, None, None, None)]
    ranked = [("a", 1, "good", "r1", 100, 200, None), ("a", 2, "weak", "r1", 350, 450, None), ("a", 3, "other", "r2", None, None, 7), ("b", 1, "x", "q", None, None, None), ("b", 2, "y", "r", None, None, None), ("b", 3, "z", "r", None, None, None), ("z", 1, "u", "r", None, None, None)]
    got = {r.query_id: r for r in graded_rows(spark, cases, judged, ranked, cutoffs=(1, 2, 3), mrr_cutoff=2, ndcg_cutoff=3).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert set(got) == {"a", "b", "c"} and not any(r.problem for r in got.values())
    assert (a.recall_at_1, a.recall_at_2, a.recall_at_3, a.mrr, a.ndcg) == (0.5, 1.0, 1.0, 1.0, 1.0)
    assert (a.timestamp_hit_at_k, a.interval_hit_at_k, a.best_iou, a.start_error_ms, a.end_error_ms, a.ranked_count) == (1, 1, 1.0, 0, 0, 3)
    # by resource, where no judgment names a unit: a resource counts at each of its ranks, a judged one of grade 0 is to be found
    assert (b.recall_at_1, b.recall_at_2, b.recall_at_3, b.mrr, b.temporal_applicable) == (0.0, 0.5, 0.5, 0.5, False)
    assert b.ndcg == round((3 / math.log2(3) + 3 / 2) / 3, 12)
    assert (c.recall_at_3, c.mrr, c.ndcg, c.ranked_count) == (0.0, 0.0, 0.0, 0)
    rows = graded_rows(spark, cases, judged, ranked, cutoffs=(1, 2, 3), mrr_cutoff=2, ndcg_cutoff=3)
    means = {(r.level, r.label): r for r in graded.report(rows, (1, 2, 3)).collect()}
    assert set(means) == {("summary", ""), ("case_kind", "hybrid"), ("case_kind", "lexical"), ("slice", "mode=hybrid")}
    total = means["summary", ""]
    assert (total.cases, total.temporal_cases, total.best_iou, total.mrr) == (3, 1, 1.0, 0.5)
    assert means["case_kind", "lexical"].best_iou == 0.0 and means["slice", "mode=hybrid"].cases == 2


def test_graded_times(spark):
    judged = [("a", 0, "r", "u", 1, 0, 100, None), ("a", 1, "r", "v", 1, 50, 150, None), ("a", 2, "r", "w", 1, None, None, 5)]
    ranked = [("a", 1, "p", "r", 0, 0, None), ("a", 2, "q", "r", 50, 100, None), ("a", 3, "s", "r", 0, 100, None), ("a", 4, "t", "r", 0, 0, 5)]
    row = lambda k: graded_rows(spark, [("a", "k", [])], judged, ranked, cutoffs=(k,)).first()
    # of equal overlaps the first judgment's counts; results past the deepest cutoff have no say
    assert [(r.best_iou, r.interval_hit_at_k, r.start_error_ms, r.end_error_ms, r.timestamp_hit_at_k) for r in map(row, (1, 2, 3, 4))] == [(0.0, 0, 0, 0, 0), (0.5, 1, 50, 0, 0), (1.0, 1, 0, 0, 0), (1.0, 1, 0, 0, 1)]


def test_graded_problems(spark):
    one = ("a", 0, "r", "u", 1, None, None, None)
    hit = ("a", 1, "u", "r", None, None, None)
    of = lambda judged, ranked: graded_rows(spark, [("a", "k", [])], judged, ranked)
    assert of([], []).first().problem == "zero-gold case" and of([one[:4] + (0,) + one[5:]], [hit]).first().problem == "zero-gold case"
    assert of([one, ("a", 1, *one[2:])], [hit]).first().problem == "duplicate judgment"
    twice = of([one], [hit, ("a", 2, *hit[2:])])
    assert twice.first().problem == "duplicate ranked id"
    with pytest.raises(Exception, match="duplicate ranked id"):
        graded.report(twice).collect()
    with pytest.raises(ValueError):
        graded_rows(spark, [], [], [], cutoffs=(0,))
    assert graded_rows(spark, [], [], []).count() == 0
    # one distribution of all rows by case
    plan = of([one], [hit])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_words_read_counts_alone(spark, tmp_path):
    units = spark.createDataFrame([(f"u{i}", "the red fox " + "red " * (i % 4) + ("blue" if i % 5 == 0 else "reef")) for i in range(40)] + [("n", None), ("e", " ")], "unit_id string, text string")
    index = lexical.write_index(lexical.build_index(units), "words_alone", 3)
    plan = lambda q: lexical.indexed_bm25(index, q)._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan("red OR re*") and "positions" in plan('"red fox"') and "positions" in plan("^the")
    for q in ("red", "re*", "red re*", "(blue OR reef) NOT fox*", "blue NOT reef", "red AND blue"):
        want = {r.unit_id: round(r.bm25, 9) for r in lexical.bm25(units, q).collect()}
        assert {r.unit_id: round(r.bm25, 9) for r in lexical.indexed_bm25(index, q).collect()} == want, q
    # a term that all units hold lies in several files
    assert index.postings.filter("term = 'red'").select(F.input_file_name()).distinct().count() > 1


def test_passage_counters(spark):
    atoms = spark.createDataFrame([("r", 0, 0, 100), ("r", 1, 50, 80), ("r", 2, 90, 200), ("r", 3, 200, 300), ("q", 0, 0, 5)], "resource_id string, ordinal int, start_ms long, end_ms long")
    made = spark.createDataFrame([("r", 0, 0, 200, 10, 0, 2, "soft_max"), ("r", 1, 90, 300, 2000, 1, 3, "hard_limit"), ("r", 2, 200, 300, 5, 3, 3, "end_of_input")], "resource_id string, ordinal int, start_ms long, end_ms long, token_count int, first_atom int, last_atom int, reason string")
    got = {r.resource_id: r for r in grouping.grouping_metrics(made, atoms).collect()}
    r = got["r"]
    assert (r.n_atoms, r.n_input_overlaps, r.n_passages, r.n_overlaps, r.n_covered, r.n_repeated_atoms, r.n_hard_exceeded) == (4, 2, 3, 2, 7, 3, 1)
    assert (r.n_tokens, r.max_tokens, r.max_ms, r.n_soft_max, r.n_hard_limit, r.n_end_of_input, r.n_unsplittable) == (2015, 2000, 210, 1, 1, 1, 0)
    # a resource without passages has zeros
    assert (got["q"].n_atoms, got["q"].n_passages, got["q"].n_covered) == (1, 0, 0)


def test_graded_tasks_grow_with_the_rows(spark, monkeypatch):
    tables = R._graded_tables(spark, SF)
    want = sorted(map(str, graded.per_case(*tables, (1, 3, 5), 4, 5).collect()))
    plan = lambda: graded.per_case(*tables, (1, 3, 5), 4, 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id#" in plan() and ", 4)" in plan()
    monkeypatch.setattr(graded, "SHARE", 500)
    n = sum(t.count() for t in tables)
    assert f", {math.ceil(n / 500)}), REPARTITION_BY_NUM" in plan()
    assert sorted(map(str, graded.per_case(*tables, (1, 3, 5), 4, 5).collect())) == want
    # one sort of the rows of a case for the windows of its rows, one for those of its items, one for the best order
    case = plan().split("REPARTITION_BY_NUM")[0]
    assert sum(line.count("Sort [query_id") for line in case.splitlines()) == 3


def test_postings_are_made_without_a_shuffle(spark):
    units = spark.createDataFrame([("u", "b a  B é"), ("v", "x " * 2000 + "a"), ("n", None), ("e", " "), ("p", "..")], "unit_id string, text string").repartition(2)
    assert "Exchange hashpartitioning" not in lexical.postings_of(units)._jdf.queryExecution().executedPlan().toString()
    got = {(r.term, r.unit_id): (r.tf, r.positions) for r in lexical.postings_of(units).collect()}
    assert got == {("b", "u"): (2, [0, 2]), ("a", "u"): (1, [1]), ("e", "u"): (1, [3]), ("x", "v"): (2000, list(range(2000))), ("a", "v"): (1, [2000])}
    assert lexical.postings_of(units.limit(0)).count() == 0


def test_hash_vectors_hash_a_text_once(spark):
    import hashlib

    from tessel.functions import vectors as V

    texts = ["a", "", "é\n", None]
    made = spark.createDataFrame([(t,) for t in texts], "text string").select("text", V.hash_vector(F.col("text"), 40).alias("v"))
    for r in made.collect():
        if r.text is None:
            assert r.v is None or all(x is None for x in r.v)
            continue
        raw = [(hashlib.sha256(r.text.encode()).digest()[i % 32] * (i + 1) % 256) / 127.5 - 1 for i in range(40)]
        assert r.v == pytest.approx([x / math.sqrt(sum(x * x for x in raw)) for x in raw], abs=1e-12)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1


def test_clauses_of_cases_with_and_without_wildcards(spark):
    from tessel.sources import cases

    chunks = spark.createDataFrame([("1", "The 100% RED fox", "d/A_b.md", "One"), ("2", "a\nred\\fox", "d/axb.md", None), ("3", None, "x", "ONE"), ("4", "", "d/a.md", "")], "chunk_id string, text string, relative_path string, heading string")
    asked = [("a", "red FOX", None, None), ("b", "r%x", None, None), ("c", None, "a_B", None), ("d", "", None, "one"), ("e", "red", "D/", None), ("f", None, None, None), ("g", "0\\%", None, None), ("h", "red\\\\fox", "d/%.MD", None), ("a", "red FOX", None, None)]
    items = spark.createDataFrame(asked, "query_id string, content_contains string, file_path_contains string, heading_contains string")
    chunks.createOrReplaceTempView("case_chunks"), items.createOrReplaceTempView("case_items")
    met = lambda c, k: f"({k} IS NULL OR {c} ILIKE concat('%', {k}, '%'))"
    want = spark.sql(f"SELECT query_id, chunk_id FROM case_chunks, case_items WHERE {met('text', 'content_contains')} AND {met('relative_path', 'file_path_contains')} AND {met('heading', 'heading_contains')}")
    found = cases.gold(chunks, items)
    assert sorted((r.query_id, r.item_id) for r in found.collect()) == sorted(map(tuple, want.collect())) and {r.query_id for r in want.collect()} == set("abcdefgh")
    # texts meet only the cases whose other clauses their files met
    assert "contains(" in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_the_audit_makes_its_chunks_once(spark):
    from tessel.operators import facets

    plan = R.coverage_audit(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "audited_" in plan
    # ends are cut before the window, not anew for each length that is tried
    texts = ["x" * 500 + "éab", "éab" + "y" * 500, "y" * 9, None, "q", "qq" * 300, "qq" * 200]
    chunks = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file_id string, chunk_index int, text string")
    found = facets.suffix_overlap(chunks, 300)
    assert [r.overlap_chars for r in found.orderBy("chunk_index").collect()] == [0, 3, 9, 0, 0, 1, 300] and found.columns == [*chunks.columns, "overlap_chars"]
    assert "right(text" not in found._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
    assert "_tail" in found._jdf.queryExecution().optimizedPlan().toString().split("Window")[1]


def test_preset_search_makes_its_passages_once(spark):
    from tessel import queries

    plan = queries.preset_search(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "passages_" in plan
