"""The store in buckets: writes of a batch alone, no lost updates, what a vacuum may take."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from tessel.operators import lexical
from tessel.plans.catalog import SCHEMAS, Catalog
from tessel.plans.store import Store, StoreError, bucket


def _catalog(spark, ids, word="red", locator=None):
    place = lambda i: ("source_file", json.dumps({"relative_path": f"{locator or i}.md"}), f"fp-{locator or i}")
    rows = {
        "resources": [(i, "document", "text/markdown", "vault", place(i), "h", i, None) for i in ids],
        "representations": [(f"{i}-rep", i, "document_text", "text", None, "en", 3, None) for i in ids],
        "units": [(f"{i}-u{k}", i, f"{i}-rep", "text_chunk", "text", f"the {word} {i} number {k}", None, k, None, None, None, None, None) for i in ids for k in range(2)],
        "spaces": [("s", 2, "cosine", "f")],
        "vectors": [(f"{i}-u{k}", "s", [1.0, float(k)]) for i in ids for k in range(2)],
        "facets": [(i, "tag", "x", "user", None) for i in ids],
    }
    return Catalog(**{t: spark.createDataFrame(rows[t], SCHEMAS[t]) for t in SCHEMAS})


def _rows(store):
    """All rows of the current catalog but insertion numbers, and the index."""
    c = store.load()
    out = {t: sorted(map(str, f.drop("fts_seq").collect())) for t, f in c.tables().items()}
    return out | {"postings": sorted(map(str, store.index().postings.collect())), "lengths": sorted(map(str, store.index().lengths.collect()))}


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("store") / "store"
    Store(spark, f"file://{folder}", buckets=8).commit(_catalog(spark, [f"r{i}" for i in range(10)]))
    return folder


@pytest.fixture
def store(spark, written, tmp_path):
    """A copy of its own: folders are named relative to the store."""
    shutil.copytree(written, tmp_path / "store")
    return Store(spark, f"file://{tmp_path}/store")


def test_a_write_touches_its_buckets_alone(spark, store):
    before = store.manifest(store.state()["snapshot"])
    b = spark.range(1).select(bucket(F.lit("r3"), 8)).first()[0]
    opened = []
    real = store._table

    def watched(manifest, table, only=None):
        frame = real(manifest, table, only)
        opened.extend((table, f.split("bucket=")[1].split("/")[0]) for f in frame.inputFiles() if "bucket=" in f)
        return frame

    store._table = watched
    store.replace(_catalog(spark, ["r3"], "blue"))
    store._table = real
    assert {k for t, k in opened if t not in ("keys", "spaces")} == {str(b)} and len({k for t, k in opened if t == "keys"}) < 8
    after = store.manifest(store.state()["snapshot"])
    for t in ("resources", "representations", "units", "vectors", "facets", "postings", "lengths"):
        changed = {k for k in before["files"][t] | after["files"][t] if before["files"][t].get(k) != after["files"][t].get(k)}
        assert changed == {str(b)}, t
    assert store.load().units.filter("text LIKE '%blue%'").count() == 2 and store.load().units.count() == 20


def test_writes_in_parts_give_what_a_whole_write_gives(spark, store, tmp_path):
    store.replace(_catalog(spark, ["r3", "r11"], "blue"), spark.createDataFrame([("r5",), ("nobody",)], "resource_id string"))
    store.delete("r7")
    whole = Store(spark, f"file://{tmp_path}/whole", buckets=8)
    c = store.load()
    whole.commit(Catalog(**{t: spark.createDataFrame(f.collect(), SCHEMAS[t]) for t, f in c.tables().items()}))
    assert _rows(store) == _rows(whole)
    assert {r.resource_id for r in c.resources.collect()} == {"r0", "r1", "r2", "r3", "r4", "r6", "r8", "r9", "r11"}
    keys = lambda s: sorted(map(str, s._table(s.manifest(s.state()["snapshot"]), "keys").collect()))
    assert keys(store) == keys(whole)
    numbers = [r.fts_seq for r in c.units.collect()]
    assert len(set(numbers)) == len(numbers) == 18 and min(r.fts_seq for r in c.units.filter("resource_id = 'r11'").collect()) > max(r.fts_seq for r in c.units.filter("resource_id = 'r9'").collect())
    units = c.units
    show = lambda rows: [(r.unit_id, r.score, r.rank) for r in rows.collect()]
    for query in ("red", "blue r3", '"the blue"', "numb*"):
        assert show(lexical.search_lexical(units, units, query, 10, index=store.index())) == show(lexical.search_lexical(units, units, query, 10)), query


def test_ids_are_unique_over_buckets(spark, store):
    taken = _catalog(spark, ["new"])
    same_unit = Catalog(**(taken.tables() | {"units": taken.units.withColumn("unit_id", F.when(F.col("ordinal") == 0, F.lit("r1-u0")).otherwise(F.col("unit_id"))), "vectors": taken.vectors.limit(0)}))
    before = store.state()
    with pytest.raises(StoreError, match="unit_id_unique"):
        store.replace(same_unit)
    with pytest.raises(StoreError, match="source belongs to another"):
        store.replace(_catalog(spark, ["new"], locator="r1"))
    # the source is free once its resource goes in the same write
    store.replace(_catalog(spark, ["new"], locator="r1"), spark.createDataFrame([("r1",)], "resource_id string"))
    assert before["number"] + 1 == store.state()["number"] and store.load().resources.count() == 10


def _between(store, act):
    """Calls ``act`` once, just before the next snapshot is made current."""
    real, done = store._finish, []

    def late(*args):
        if not done:
            done.append(1)
            act()
        return real(*args)

    store._finish = late


@pytest.mark.parametrize("operation", ["delete", "rebuild_index", "rebuild_vectors", "replace", "commit"])
def test_no_update_is_lost(spark, store, operation):
    other = Store(spark, store.root)
    _between(store, lambda: other.replace(_catalog(spark, ["late"], "green")))
    embed = lambda rows: rows.select("unit_id", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("vector"))
    run = {
        "delete": lambda: store.delete("r2"), "rebuild_index": store.rebuild_index, "rebuild_vectors": lambda: store.rebuild_vectors("s", embed),
        "replace": lambda: store.replace(_catalog(spark, ["r2"], "grey")), "commit": lambda: store.commit(_catalog(spark, ["r1"])),
    }[operation]
    with pytest.raises(StoreError, match="another writer"):
        run()
    ids = {r.resource_id for r in store.load().resources.collect()}
    assert ids == {f"r{i}" for i in range(10)} | {"late"} and store.load().units.filter("text LIKE '%grey%'").isEmpty()
    run()  # once more, from what is there now
    assert operation == "commit" or "late" in {r.resource_id for r in store.load().resources.collect()}
    assert store.index_problems(store.state()["snapshot"]) == {}


def test_vacuum_leaves_what_is_named_and_what_others_build(spark, store):
    first = store.state()["snapshot"]
    store._create("snapshot-other/units/part", "x")  # another writer's, unfinished
    store.replace(_catalog(spark, ["r3"], "blue"))
    store.replace(_catalog(spark, ["r4"], "blue"))
    want = _rows(store)
    assert store.vacuum() == [first] and _rows(store) == want
    assert store._names("snapshot-other") == ["snapshot-other"]
    store.rollback()
    assert store.load().units.filter("text LIKE '%blue%'").count() == 2
    assert "snapshot-other" in store.vacuum(age=-1)


def test_a_dead_writers_claim_is_taken_over(spark, store, monkeypatch):
    from tessel.plans import store as module

    store._create(f"_claim-{store.state()['number'] + 1:012d}", "")
    with pytest.raises(StoreError, match="another writer"):
        store.delete("r1")
    monkeypatch.setattr(module, "STALE", -1)
    store.delete("r1")
    assert store.load().resources.count() == 9


def test_a_common_term_lies_in_many_files(spark, store):
    files = {f for f in store._table(store.manifest(store.state()["snapshot"]), "postings").filter("term = 'the'").select(F.input_file_name().alias("f")).distinct().toPandas().f}
    assert len(files) > 3
