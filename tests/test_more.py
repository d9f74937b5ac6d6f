"""Sections, privacy, cases, cache and small decisions."""

import pytest

from tessel.functions import ids, privacy
from tessel.operators import packing, sections
from tessel.plans.cache import ArtifactCache, Key
from tessel.sources import cases, markdown

TEXT = "intro\n\n# A\n\nin a\n\n### C\n\nin c\n\n## B\n\nin b\n\n# D\n\nin d\n"


def test_sections(spark):
    blocks = markdown.parse_files(spark.createDataFrame([("x.md", TEXT), ("y.md", "only text\n")], "relative_path string, content string")).cache()
    paths = {(r.relative_path, r.ordinal): (tuple(r.path), tuple(r.heading_path)) for r in sections.heading_paths(blocks).collect()}
    assert all(a == b for a, b in paths.values())
    secs = sections.sections(blocks)
    got = [(r.title, r.level, r.start_line, r.end_line, r.parent) for r in secs.filter("relative_path = 'x.md'").orderBy("start_line").collect()]
    assert got == [("", 0, 1, 2, None), ("A", 1, 3, 14, None), ("C", 3, 7, 10, 1), ("B", 2, 11, 14, 1), ("D", 1, 15, 17, None)]
    owned = {r.ordinal: r.section for r in sections.assign(blocks, secs).filter("relative_path = 'x.md'").collect()}
    plain = {r.plain: owned[r.ordinal] for r in blocks.filter("relative_path = 'x.md'").collect()}
    assert (plain["intro"], plain["in a"], plain["in c"], plain["in b"], plain["in d"]) == (0, 1, 2, 3, 4)
    full = blocks.join(sections.assign(blocks, secs), ["relative_path", "ordinal"])
    assert [r.text for r in packing.packed(full).filter("relative_path = 'x.md'").orderBy("chunk_index").collect()] == ["intro", "A\n\nin a", "C\n\nin c", "B\n\nin b", "D\n\nin d"]


def test_privacy(spark):
    value = {"a": ["see /home/me/x", "ok"], "b": {"password": "p"}, "c": "token: abc", "d": "https://x"}
    assert set(privacy.scan(value, frozenset({"password"}), frozenset({"ok"}))) == {("absolute_path", "/a/0"), ("forbidden_value", "/a/1"), ("forbidden_key", "/b/password"), ("credential", "/c"), ("url", "/d")}
    row = privacy.flags(spark.createDataFrame([("api_key = 1",), (None,)], "t string"), "t").collect()
    assert [r.has_credential for r in row] == [True, False]


def test_cases(spark):
    text = "queries:\n- {id: q1, query: bees, mode: text, expected: {content_contains: BEE}, metrics: {recall_at: 5}}\n- {id: q2, query: x, mode: hybrid, expected: {heading_contains: h_t}}\n"
    chunks = spark.createDataFrame([("c1", "a bee", "p.md", "hot"), ("c2", "none", "p.md", "other")], "chunk_id string, text string, relative_path string, heading string")
    assert {(r.query_id, r.item_id) for r in cases.gold(chunks, cases.frame(spark, text)).collect()} == {("q1", "c1"), ("q2", "c1")}
    for bad in ("queries: 1", "queries:\n- {id: a}", text.replace("mode: text", "mode: nope"), text.replace("q2", "q1"), text.replace("5", "0")):
        with pytest.raises(ValueError):
            cases.load(bad)


def test_cache(spark, tmp_path):
    cache = ArtifactCache(spark, f"file://{tmp_path}/cache")
    key = Key("s", "p", "c", "e", "n", "j", "v1")
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert cache.get(key, make).count() == cache.get(key, make).count() == 3 and len(made) == 1
    assert cache.verify() == {key.fingerprint: True}
    (tmp_path / "cache" / key.fingerprint / "_KEY.json").write_text("{")
    assert cache.lookup(key) is None and cache.get(key, make).count() == 3 and len(made) == 2
    with pytest.raises(ValueError):
        cache.purge()
    assert cache.discard(key) and cache.purge(confirm=True) == 0


def test_ids():
    assert ids.request_id("{12345678123456781234567812345678}") == "12345678-1234-5678-1234-567812345678"
    assert ids.request_id("01arz3ndektsv4rrffq69g5fav") == "01ARZ3NDEKTSV4RRFFQ69G5FAV"
    with pytest.raises(ValueError):
        ids.request_id("x")
    assert ids.output_dimensions(None, 8) == 8 and ids.output_dimensions(4, 8, (4,)) == 4
    for bad in ((9, 8), (4, 8), (0, 8)):
        with pytest.raises(ValueError):
            ids.output_dimensions(*bad)


# --- the store: one snapshot for each write, an index beside it --------------------


def _vault(tmp_path, files):
    for name, text in files.items():
        (tmp_path / name).write_text(text)


@pytest.fixture
def vault(spark, tmp_path):
    from tessel.plans.engine import Engine, HashEmbedder

    folder = tmp_path / "vault"
    folder.mkdir()
    _vault(folder, {"a.md": "# Alpha\n\nthe red fox jumps", "b.md": "# Beta\n\na blue whale sings\n\n## More\n\nthe red sea", "d.md": "# Delta\n\ngreen hills"})
    engine = Engine(spark, f"file://{tmp_path}/store", HashEmbedder(16))
    engine.scan(str(folder))
    return engine, folder


def _paths(engine):
    return sorted(r.relative_path for r in engine.files()[0].collect())


def test_scan_is_one_snapshot_and_renames_keep_their_id(vault):
    engine, folder = vault
    ids = {r.relative_path: r.resource_id for r in engine.files()[0].collect()}
    first = engine.store.state()
    (folder / "b.md").rename(folder / "c.md")
    _vault(folder, {"a.md": "# Alpha\n\nthe red fox sleeps", "b.md": "# New\n\na second beta"})
    (folder / "d.md").unlink()
    plan = {r.relative_path: r.change for r in engine.scan(str(folder)).collect()}
    assert plan == {"a.md": "changed", "b.md": "changed", "d.md": "deleted", "c.md": "new"} or plan["c.md"] in ("new", "renamed")
    (folder / "c.md").rename(folder / "e.md")
    plan = {r.relative_path: r.change for r in engine.scan(str(folder)).collect()}
    assert plan["e.md"] == "renamed" and plan["c.md"] == "renamed_from"
    now = {r.relative_path: r.resource_id for r in engine.files()[0].collect()}
    assert set(now) == {"a.md", "b.md", "e.md"} and now["a.md"] == ids["a.md"] and len(set(now.values())) == 3
    assert engine.store.state()["number"] == first["number"] + 2
    engine.rollback()
    assert _paths(engine) == ["a.md", "b.md", "c.md"]
    _vault(folder, {"c.md": "# Other\n\nnot the file that was here"})
    engine.scan(str(folder))
    assert _paths(engine) == ["a.md", "b.md", "c.md", "e.md"]


def test_a_new_file_where_a_renamed_one_was(vault):
    engine, folder = vault
    (folder / "b.md").rename(folder / "c.md")
    engine.scan(str(folder))
    _vault(folder, {"b.md": "# Third\n\nanother text"})
    engine.scan(str(folder))
    assert _paths(engine) == ["a.md", "b.md", "c.md", "d.md"]


def test_rebuild_vectors_gives_means_too(vault):
    engine, _ = vault
    before = {r.unit_id: [round(x, 5) for x in r.vector] for r in engine.catalog.vectors.collect()}
    engine.rebuild_vectors()
    assert {r.unit_id: [round(x, 5) for x in r.vector] for r in engine.catalog.vectors.collect()} == before and len(before) >= 6


def test_insertion_numbers_are_unique_and_grow(vault):
    engine, folder = vault
    numbers = [r.fts_seq for r in engine.catalog.units.collect()]
    assert None not in numbers and len(set(numbers)) == len(numbers)
    _vault(folder, {"a.md": "# Alpha\n\nthe red fox is new"})
    last = max(numbers)
    engine.scan(str(folder))
    a = engine.files()[0].filter("relative_path = 'a.md'").first().resource_id
    assert min(r.fts_seq for r in engine.units(a).collect()) > last
    assert len({r.fts_seq for r in engine.catalog.units.collect()}) == engine.catalog.units.count()


def test_two_writers(spark, vault):
    from tessel.plans.store import Store, StoreError

    engine, _ = vault
    other = Store(spark, engine.store.root)
    seen = other.state()
    engine.rebuild_index()
    with pytest.raises(StoreError, match="another writer"):
        other.commit(other.load(), seen=seen)
    assert other.state()["number"] == seen["number"] + 1


def test_stored_index_answers_like_the_texts(vault):
    from tessel.operators import lexical

    engine, folder = vault
    rows = {(r.what, r.kind): r.n for r in engine.inspect().collect()}
    assert rows["resource", "document"] == 3 and rows["vector", "hash-16"] == engine.catalog.vectors.count()
    _vault(folder, {"a.md": "# Alpha\n\nthe red fox and the red hen", "z.md": "# Zed\n\nred red red"})
    engine.scan(str(folder))
    units, index = engine.catalog.units.cache(), engine.store.index()
    show = lambda rows: [(r.unit_id, r.score, r.rank) for r in rows.collect()]
    for query in ("red", "the red", '"the red"', "red OR blue", "re*", "the NOT fox", "^the", '"the re"*', "(fox OR whale) AND the", "nothing"):
        assert lexical.answers(index, query)
        assert show(lexical.search_lexical(units, units, query, 10, index=index)) == show(lexical.search_lexical(units, units, query, 10)), query
    assert "text" not in lexical.indexed_bm25(index, "red").schema.names and engine.store.index_problems(engine.store.state()["snapshot"]) == {}
    before = sorted((r.term, r.unit_id, r.tf) for r in index.postings.collect())
    engine.rebuild_index()
    assert before == sorted((r.term, r.unit_id, r.tf) for r in engine.store.index().postings.collect())


# --- values that are fixed --------------------------------------------------------


def test_fixed_values():
    from tessel.operators.grouping import VARIANTS, Policy
    from tessel.operators.search import preset_request
    from tessel.plans.requests import SCOPES, Scope, similarity_scope, timed_scope

    got = {b.branch_id: (b.weight, b.candidate_limit, b.override.unit_kinds) for b in preset_request("speech_first", "q", "s", (1.0,), 20).branches}
    assert got == {
        "transcript_text": (0.4, 200, ("time_segment",)), "frame_caption_text": (0.14, 200, ("frame",)), "metadata_text": (0.15, 200, ("whole_resource",)),
        "transcript_semantic": (0.6, 200, ("time_segment",)), "frame_caption_semantic": (0.21, 200, ("frame",)),
    }
    assert [b.weight for b in preset_request("frames_first", "q", None, None).branches] == [0.24, 0.4, 0.15]
    assert [b.branch_id for b in preset_request("balanced", "q", "s", (1.0,), mode="semantic").branches] == ["transcript_semantic", "frame_caption_semantic"]
    for bad in ({"preset": "loud"}, {"mode": "fast"}, {"mode": "hybrid"}):
        with pytest.raises(ValueError):
            preset_request(**({"preset": "balanced", "query": "q", "space_id": None, "vec": None} | bad))
    assert VARIANTS["B"] == Policy() and (VARIANTS["A"].target_tokens, VARIANTS["A"].soft_max_ms) == (256, 67_500) and (VARIANTS["C"].target_tokens, VARIANTS["C"].hard_max_ms) == (480, 120_000)
    assert SCOPES["audio"] == Scope(resource_kinds=("audio",), modalities=("text",)) and SCOPES["video"].representation_kinds == ("timed_passage",)
    assert similarity_scope("frames") == Scope(resource_kinds=("video",), modalities=("text",), unit_kinds=("whole_resource",))
    assert timed_scope(Scope()).representation_kinds == ("timed_passage",)
    assert timed_scope(Scope(unit_kinds=("frame",))) is None


# --- embedders --------------------------------------------------------------------


def test_media_graphs_get_vectors(spark, tmp_path):
    from tessel.operators import graphs, grouping
    from tessel.plans.engine import Engine
    from tessel.plans.ports import BatchEmbedder

    flat = BatchEmbedder("letters", 3, lambda texts: [[t.count("a") + 1.0, t.count("e") + 1.0, len(t) + 1.0] for t in texts], batch=2, query_prefix="aa")
    assert flat.query("e") == (3.0, 2.0, 4.0)
    engine = Engine(spark, f"file://{tmp_path}/store", flat)
    rows = [("r1", 0, 1000, "a cat sat.", None), ("r1", 1000, 200_000, "then it ate.", None), ("r2", 0, 900, "empty hall", None)]
    atoms = spark.createDataFrame([(r, i, *rest) for i, (r, *rest) in enumerate(rows)], "resource_id string, ordinal int, start_ms long, end_ms long, text string, speaker string")
    graph = graphs.transcript_graph(grouping.group_atoms(atoms))
    engine.store.replace(engine._embedded(graph))
    c = engine.catalog
    assert c.vectors.count() == c.units.count() == graph.units.count() + 2
    found = engine.search_transcripts("cat", target="resource").rows.collect()
    assert found[0].resource_id == "r1" and found[0].n_branches == 2
    assert engine.similar("r1").collect()[0].resource_id == "r2"
    long = graphs.with_vectors(graph, flat.units, engine._space(), direct_tokens=2)
    how = {r.resource_id: r.metadata_json for r in long.units.filter("unit_kind = 'whole_resource'").collect()}
    assert how == {"r1": '{"aggregation":"centroid"}', "r2": '{"aggregation":"direct"}'}


def test_embedders_are_checked(spark, tmp_path):
    from tessel.plans.engine import Engine
    from tessel.plans.ports import BatchEmbedder

    with pytest.raises(TypeError):
        Engine(spark, f"file://{tmp_path}/store", object())
    with pytest.raises(ValueError, match="finite vector"):
        BatchEmbedder("s", 2, lambda texts: [[1.0]] * len(texts)).query("x")


# --- grouping against a second, declarative implementation -------------------------


def _grouped_by_hand(atoms, p):
    """Passages as (first, last, reason, score): every seam is described first, then chosen among."""
    ends = ".!?。！？…"
    out, first = [], 0
    while first < len(atoms):
        seams = []
        for last in range(first, len(atoms)):
            part, text = atoms[first : last + 1], ""
            for a in part:
                text += ("" if not text or text[-1].isspace() or a.text[0].isspace() else " ") + a.text
            end, nxt = max(a.end_ms for a in part), atoms[last + 1] if last + 1 < len(atoms) else None
            seams.append({"last": last, "tokens": len(text.split()), "ms": end - part[0].start_ms, "end": end, "next": nxt, "free": nxt is None or nxt.start_ms >= end})
        over = lambda s: s["tokens"] > p.hard_max_tokens or s["ms"] > p.hard_max_ms
        full = lambda s: s["tokens"] >= p.soft_max_tokens or s["ms"] >= p.soft_max_ms
        for k, s in enumerate(seams):
            s["risk"] = s["next"] is not None and not over(s) and over(seams[k + 1])
            s["stops"] = s["free"] and (over(s) or s["risk"] or full(s) or s["next"] is None)
            s["counts"] = s["free"] and not over(s) and (s["stops"] or s["tokens"] >= p.soft_min_tokens and s["ms"] >= p.soft_min_ms)

        def score(s, risk):
            a, n, pause = atoms[s["last"]], s["next"], (s["next"].start_ms - s["end"]) if s["next"] else None
            worth = 100 * risk + 40 * (a.text.rstrip()[-1] in ends) + 15 * ("\n" in a.text) + 20 * full(s) + 10 * (s["tokens"] >= p.target_tokens) + 10 * (s["ms"] >= p.target_ms)
            if n:
                worth += 45 * (a.speaker is not None and n.speaker is not None and a.speaker != n.speaker)
                worth += 35 if pause >= p.strong_pause_ms else 15 if pause >= p.medium_pause_ms else 0
            far, long = abs(s["tokens"] - p.target_tokens) * 10 // p.target_tokens, abs(s["ms"] - p.target_ms) * 10 // p.target_ms
            return worth - far - long, far, long

        beyond = next((k for k, s in enumerate(seams) if over(s)), len(seams))
        stop = next((k for k, s in enumerate(seams[:beyond]) if s["stops"]), None)
        known = [s for s in seams[: beyond if stop is None else stop + 1] if s["counts"]]
        if known:
            if stop is None:
                marks = [(score(s, s is known[-1]), s["last"]) for s in known]
                reason = "hard_limit"
            else:
                marks = [(score(s, s["risk"]), s["last"]) for s in known]
                reason = "hard_limit" if seams[stop]["risk"] else "soft_max" if full(seams[stop]) else "end_of_input"
            mark, last = min(marks, key=lambda m: (-m[0][0], m[0][1], m[0][2], m[1]))
            out.append((first, last, reason, mark[0]))
        else:
            s = next(s for s in seams if s["free"] and over(s))
            last = s["last"]
            out.append((first, last, "unsplittable", score(s, False)[0]))
        first = last + 1
    return out


@pytest.mark.parametrize("seed", range(40))
def test_grouping_by_hand(seed):
    import random

    from tessel.operators.grouping import VARIANTS, Atom, Policy, passages

    rng = random.Random(seed)
    p = VARIANTS["ABC"[seed % 3]] if seed % 4 else Policy(4, 10, 15, 30, 1000, 3000, 5000, 9000)
    at, atoms = 0, []
    for _ in range(rng.randint(1, 70)):
        n = rng.randint(1, 60) if seed % 4 else rng.randint(1, 12)
        long = rng.randint(200, 30_000) if seed % 4 else rng.randint(100, 4000)
        text = " ".join(rng.choice(["word", "und", "ça"]) for _ in range(n)) + rng.choice(["", ".", "!", " ", "\n", "…"])
        atoms.append(Atom(at, at + long, text, rng.choice([None, "a", "b"])))
        at += max(0, long + rng.choice([0, 0, 300, 800, 2000, -500]))
    got = [(a, c.last, c.reason, c.score) for a, c in passages(atoms, p)]
    assert got == _grouped_by_hand(atoms, p)
    assert [x for a, last, *_ in got for x in range(a, last + 1)] == list(range(len(atoms)))
    whole = lambda t: len(t.split())  # noqa: E731 - not the usual counter, so texts are joined and recounted
    assert [(a, c.last, c.tokens) for a, c in passages(atoms, p, whole)] == [(a, c.last, c.tokens) for a, c in passages(atoms, p)]
