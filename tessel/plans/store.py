"""The catalog on storage: buckets of Parquet files, snapshots that name them, and a pointer to the current one.

Rows lie in a bucket of their resource's id. A snapshot is a manifest: for each
table and bucket the folder that holds it, whichever write made it. A write
makes new folders for the buckets it touches, checks the rules on them, and adds
the next pointer; what it does not touch is neither read nor written. Readers
take the highest pointer once. Every write starts from one reading of the
pointer and fails if another has been added since, so no update is lost.

Ids must be unique in the store, not in a bucket alone: ``keys`` holds those of
representations, units and sources, in buckets of the key, with the resource
they belong to; a write reads and writes the buckets of its own keys.

Postings are sorted by term in each bucket, so that a query's terms reach the
row groups and a common term lies in as many files as there are buckets; vectors
are sorted by space for the same reason.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.operators import lexical
from tessel.operators.vector import weighted_centroids
from tessel.plans.catalog import SCHEMAS, Catalog, conform, violations

POINTER, CLAIM, PLAN, MANIFEST, ACTIVE = "_pointer-", "_claim-", "_plan-", "_manifest.json", "_active"
#: States of a store.
STATES = ("empty", "building", "ready", "failed")
#: Buckets of a new store. More suit a large one; the number is fixed with the first write.
BUCKETS = 16
#: Seconds after which a claim or an unfinished snapshot is taken for a dead writer's.
STALE = 3600
#: Tables of files: the catalog's, the lexical index's (``home`` is the bucket of the unit's resource), and the keys.
FILES = {t: f"{s}, home int" if t == "vectors" else s for t, s in SCHEMAS.items()} | {
    "postings": "term string, unit_id string, tf int, positions array<int>, home int", "lengths": "unit_id string, dl int, home int", "keys": "kind string, key string, resource_id string",
}


class StoreError(RuntimeError):
    """A write that was not carried out."""


def together(calls: dict[str, Callable], at_once: int = 8) -> dict:
    """Results of calls whose Spark jobs do not wait for each other.

    For plans over files: rows that lie in a plan itself are worked off in the driver, by expressions
    that two threads cannot share (``to_json``), and are written one table at a time.
    """
    with ThreadPoolExecutor(at_once) as pool:
        running = {k: pool.submit(f) for k, f in calls.items()}
        return {k: f.result() for k, f in running.items()}


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self._new_buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _read_text(self, name: str) -> str:
        """Through the file system, since Spark's readers skip names that begin with an underscore."""
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _names(self, prefix: str) -> list[str]:
        if not self._fs.exists(self._path("")):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self._path(""))) if n.startswith(prefix))

    # pointer ----------------------------------------------------------------
    # Pointers are numbered and never changed: a reader takes the highest. Who
    # wants to add the next must first make its claim file, which fails where
    # there is one already.

    def state(self) -> dict:
        """status, number, snapshot, previous."""
        found = self._names(POINTER)
        return json.loads(self._read_text(found[-1])) if found else {"status": "empty", "number": 0, "snapshot": None, "previous": None}

    def _create(self, name: str, text: str) -> bool:
        """Makes a file; false where it exists. The local file system's own way is used there, as Hadoop's checks first and creates later."""
        path = self._path(name)
        if self._fs.getUri().getScheme() == "file":
            made = self._jvm.java.io.File(path.toUri().getPath())
            made.getParentFile().mkdirs()
            if not made.createNewFile():
                return False
            out = self._fs.create(path, True)
        else:
            try:
                out = self._fs.create(path, False)
            except Exception as e:
                if self._fs.exists(path):
                    return False
                raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _age(self, name: str) -> float:
        return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def _advance(self, state: dict, seen: int) -> None:
        number = seen + 1
        name, claim = f"{POINTER}{number:012d}", f"{CLAIM}{number:012d}"
        lost = StoreError("another writer has changed the store")
        if self.state()["number"] != seen:
            raise lost
        if not self._create(claim, ""):
            if self._fs.exists(self._path(name)) or self._age(claim) < STALE:
                raise lost
            self._fs.delete(self._path(claim), False)  # its writer died between claim and pointer
            if not self._create(claim, ""):
                raise lost
        part = f"_part-{uuid.uuid4().hex}"
        self._create(part, json.dumps(state | {"number": number}))
        if self.state()["number"] != seen or self._fs.exists(self._path(name)) or not self._fs.rename(self._path(part), self._path(name)):
            self._fs.delete(self._path(part), False)
            raise lost
        for old in self._names(POINTER)[:-3] + self._names(CLAIM)[:-3]:
            self._fs.delete(self._path(old), False)

    def activate(self, snapshot: str, seen: dict | None = None) -> None:
        """Makes a snapshot the current one, if the pointer is still the one in ``seen``."""
        now = seen or self.state()
        self._create(f"{snapshot}/{ACTIVE}", "")
        self._advance({"status": "ready", "snapshot": snapshot, "previous": now["snapshot"]}, now["number"])

    def rollback(self) -> None:
        """Back to the snapshot before the current one."""
        now = self.state()
        if not now["previous"]:
            raise StoreError("there is no earlier snapshot")
        self._advance({"status": "ready", "snapshot": now["previous"], "previous": None}, now["number"])

    # reading ----------------------------------------------------------------

    def manifest(self, snapshot: str | None) -> dict:
        """buckets, last (highest insertion number) and files (table, bucket, folder) of a snapshot."""
        if not snapshot:
            return {"buckets": self._new_buckets, "last": -1, "files": {t: {} for t in FILES}}
        return json.loads(self._read_text(f"{snapshot}/{MANIFEST}"))

    def _table(self, manifest: dict, table: str, only: set[int] | None = None) -> DataFrame:
        """A table's rows, of some buckets or of all."""
        folders = [f"{self.root}/{f}" for k, f in sorted(manifest["files"][table].items()) if only is None or int(k) in only]
        if not folders:
            return self.spark.createDataFrame([], FILES[table])
        return self.spark.read.schema(FILES[table]).parquet(*folders).select(*T.StructType.fromDDL(FILES[table]).names)

    def _catalog(self, manifest: dict, only: set[int] | None = None) -> Catalog:
        return Catalog(**{t: self._table(manifest, t, None if t == "spaces" else only).drop("home") for t in SCHEMAS})

    def load(self, snapshot: str | None = None) -> Catalog:
        snapshot = snapshot or self.state()["snapshot"]
        return self._catalog(self.manifest(snapshot)) if snapshot else Catalog.empty(self.spark)

    def index(self, snapshot: str | None = None) -> lexical.Index | None:
        """The stored lexical index of a snapshot: postings and lengths of its units with text."""
        snapshot = snapshot or self.state()["snapshot"]
        return self._index(self.manifest(snapshot)) if snapshot else None

    def _index(self, manifest: dict, only: set[int] | None = None) -> lexical.Index:
        return lexical.index_of(self._table(manifest, "postings", only).drop("home"), self._table(manifest, "lengths", only).drop("home"))

    # writing ----------------------------------------------------------------

    def _put(self, snapshot: str, table: str, rows: DataFrame, where: Column, order: tuple[str, ...] = ()) -> dict[str, str]:
        """Writes rows by bucket; the folders made."""
        held = rows.withColumn("bucket", where)
        if order:  # by range, so that no bucket or term has to be one task's
            held = held.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)
        else:
            held = held.hint("rebalance", "bucket")
        held.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.root}/{snapshot}/{table}")
        made = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{snapshot}/{table}"))]
        return {n.removeprefix("bucket="): f"{snapshot}/{table}/{n}" for n in made if n.startswith("bucket=")}

    def _put_catalog(self, snapshot: str, c: Catalog, buckets: int, at_once: int = 8) -> dict[str, dict[str, str]]:
        home = c.units.select("unit_id", bucket(F.col("resource_id"), buckets).alias("home"))
        own = {t: lambda t=t: self._put(snapshot, t, conform(getattr(c, t), t), bucket(F.col("resource_id"), buckets)) for t in SCHEMAS if t not in ("spaces", "vectors")}
        spaces = lambda: self._put(snapshot, "spaces", conform(c.spaces, "spaces"), F.lit(0))
        return together(own | {"spaces": spaces, "vectors": lambda: self._put_vectors(snapshot, c.vectors, home)}, at_once)

    def _put_vectors(self, snapshot: str, vectors: DataFrame, home: DataFrame) -> dict[str, str]:
        # a vector without a unit stays, for the rules to find
        return self._put(snapshot, "vectors", conform(vectors, "vectors").join(home.dropDuplicates(["unit_id"]), "unit_id", "left").withColumn("home", F.coalesce("home", F.lit(0))), F.col("home"), ("space_id", "unit_id"))

    def _put_index(self, snapshot: str, index: lexical.Index, home: DataFrame) -> dict[str, dict[str, str]]:
        place = lambda rows: rows.join(home, "unit_id")
        postings = lambda: self._put(snapshot, "postings", place(index.postings), F.col("home"), ("term", "unit_id"))
        return together({"postings": postings, "lengths": lambda: self._put(snapshot, "lengths", place(index.lengths), F.col("home"))})

    @staticmethod
    def _keys(c: Catalog) -> DataFrame:
        """kind, key, resource_id of what must be unique over all resources."""
        one = lambda kind, rows, key: rows.select(F.lit(kind).alias("kind"), key.alias("key"), "resource_id")
        source = F.to_json(F.struct("source_namespace", F.col("locator.kind").alias("kind"), F.col("locator.fingerprint").alias("fingerprint")))
        return one("representation", c.representations, F.col("representation_id")).unionByName(one("unit", c.units, F.col("unit_id"))).unionByName(one("source", c.resources.filter("locator IS NOT NULL"), source))

    def _finish(self, snapshot: str, manifest: dict, seen: dict, problems: dict[str, int]) -> str:
        if problems:
            raise StoreError(f"integrity rules broken: {problems}")
        self._create(f"{snapshot}/{MANIFEST}", json.dumps(manifest))
        self.activate(snapshot, seen)
        return snapshot

    def _problems(self, c: Catalog, index: lexical.Index) -> dict[str, int]:
        found = together({"rules": lambda: {r.rule: r.n for r in violations(c).filter("n > 0").collect()}, "index": lambda: self._index_problems(c, index)})
        return found["rules"] | found["index"]

    @staticmethod
    def _index_problems(c: Catalog, index: lexical.Index) -> dict[str, int]:
        texts, held = c.units.filter(F.trim("text") != "").select("unit_id"), index.lengths.select("unit_id")
        n = together({"missing_fts": texts.join(held, "unit_id", "left_anti").count, "orphan_fts": held.join(texts, "unit_id", "left_anti").count})
        return {k: v for k, v in n.items() if v}

    def index_problems(self, snapshot: str) -> dict[str, int]:
        """Units with text that the lexical index lacks, and indexed units that are none, by code."""
        return self._index_problems(self.load(snapshot), self.index(snapshot))

    def _building(self):
        """A new snapshot's name; its folder goes if what is done with it fails."""
        return _Building(self)

    def commit(self, c: Catalog, index: lexical.Index | None = None, seen: dict | None = None) -> str:
        """Writes, checks and activates a whole catalog; on a broken rule the snapshot goes and the pointer stays."""
        seen = seen or self.state()
        manifest = self.manifest(seen["snapshot"])
        n = manifest["buckets"]
        with self._building() as snapshot:
            numbered, _ = self._numbered(c, -1)
            manifest["files"] = self._put_catalog(snapshot, numbered, n, 1) | {t: {} for t in ("postings", "lengths", "keys")}
            written = self._catalog(manifest)
            home = written.units.select("unit_id", bucket(F.col("resource_id"), n).alias("home"))
            made = together({
                "index": lambda: self._put_index(snapshot, index or lexical.build_index(written.units), home), "keys": lambda: self._put(snapshot, "keys", self._keys(written), bucket(F.col("key"), n)),
                "last": lambda: self._last(written),
            })
            manifest["files"] |= made["index"] | {"keys": made["keys"]}
            manifest["last"] = made["last"]
            return self._finish(snapshot, manifest, seen, self._problems(written, self._index(manifest)))

    @staticmethod
    def _last(c: Catalog) -> int:
        return c.units.agg(F.coalesce(F.max("fts_seq"), F.lit(-1))).first()[0]

    @staticmethod
    def _numbered(c: Catalog, last: int) -> tuple[Catalog, DataFrame]:
        """Insertion numbers after ``last``: units that have one keep their order, those without follow by their resource's place, representation and ordinal."""
        shifted = c.units.withColumn("fts_seq", F.col("fts_seq") + F.lit(last + 1))
        top = shifted.agg(F.coalesce(F.max("fts_seq"), F.lit(last)).alias("last")).first().last
        old, new = shifted.filter("fts_seq IS NOT NULL"), shifted.filter("fts_seq IS NULL")
        place = c.resources.select("resource_id", "source_namespace", F.col("locator.payload_json").alias("_place"))
        ordered = new.join(place, "resource_id", "left").orderBy("source_namespace", "_place", "resource_id", "representation_id", "ordinal", "unit_id")
        numbered = ordered.withColumn("fts_seq", F.monotonically_increasing_id() + (top + 1))
        units = conform(old, "units").unionByName(conform(numbered, "units"))
        return Catalog(**(c.tables() | {"units": units})), units

    def replace(self, batch: Catalog, gone: DataFrame | None = None, seen: dict | None = None) -> str:
        """The resources of ``batch`` in place of those with their ids, without those in ``gone`` (resource_id): one snapshot.

        Reads and writes the buckets of these resources and of their keys alone. Spaces may not change.
        ``seen`` is the state that the batch was made from; without it, the state now.
        """
        seen = seen or self.state()
        manifest = self.manifest(seen["snapshot"])
        n = manifest["buckets"]
        with self._building() as snapshot:
            # the batch is made once: whatever parses, chunks or embeds runs in this write alone
            stash = f"{snapshot}/_batch"
            for t, f in batch.tables().items():
                conform(f, t).write.parquet(f"{self.root}/{stash}/{t}")
            batch = Catalog(**{t: self.spark.read.schema(SCHEMAS[t]).parquet(f"{self.root}/{stash}/{t}") for t in SCHEMAS})
            ids = batch.resources.select("resource_id")
            leaving = (ids if gone is None else ids.unionByName(gone.select("resource_id"))).distinct()
            touched = {r.b for r in leaving.select(bucket(F.col("resource_id"), n).alias("b")).distinct().collect()}  # as many as there are buckets at most
            old = self._catalog(manifest, touched)
            changed = batch.spaces.alias("n").join(old.spaces.alias("o"), "space_id").filter("n.dimensions <> o.dimensions OR n.metric <> o.metric OR n.fingerprint <> o.fingerprint")
            if not changed.isEmpty():
                raise StoreError("an embedding space is immutable")
            kept, out = self._without(old, leaving)
            numbered, _ = self._numbered(batch, manifest["last"])
            merged = {t: getattr(kept, t).unionByName(conform(f, t)) for t, f in numbered.tables().items() if t != "spaces"}
            merged["spaces"] = kept.spaces.unionByName(conform(batch.spaces, "spaces").join(kept.spaces, "space_id", "left_anti"))
            part = {"buckets": n, "last": manifest["last"], "files": self._put_catalog(snapshot, Catalog(**merged), n) | {t: {} for t in ("postings", "lengths", "keys")}}
            written = self._catalog(part)
            home = written.units.select("unit_id", bucket(F.col("resource_id"), n).alias("home"))
            held, new = self._index(manifest, touched), lexical.build_index(batch.units)
            index = lexical.index_of(held.postings.join(out, "unit_id", "left_anti").unionByName(new.postings), held.lengths.join(out, "unit_id", "left_anti").unionByName(new.lengths))
            made = together({
                "index": lambda: self._put_index(snapshot, index, home), "keys": lambda: self._put_keys(snapshot, manifest, self._keys(old), self._keys(batch), leaving, n), "last": lambda: self._last(written),
            })
            files, asked = made["keys"]
            part["files"] |= made["index"] | {"keys": files}
            part["last"] = max(manifest["last"], made["last"])
            problems = self._problems(written, self._index(part))
            whole = {t: {k: f for k, f in manifest["files"][t].items() if int(k) not in (asked if t == "keys" else touched)} | part["files"][t] for t in FILES}
            whole["spaces"] = part["files"]["spaces"]
            done = self._finish(snapshot, part | {"files": whole}, seen, problems)
            self._fs.delete(self._path(stash), True)
            return done

    def _put_keys(self, snapshot: str, manifest: dict, old: DataFrame, new: DataFrame, leaving: DataFrame, n: int) -> tuple[dict[str, str], set[int]]:
        """The keys' buckets that change, and which those are. A key of the batch that another resource holds is an error."""
        where = bucket(F.col("key"), n)
        moving = old.join(leaving, "resource_id", "left_semi")
        asked = {r.b for r in moving.unionByName(new).select(where.alias("b")).distinct().collect()}
        stay = self._table(manifest, "keys", asked).join(leaving, "resource_id", "left_anti")
        taken = [r.kind for r in new.join(stay.select("kind", "key", F.col("resource_id").alias("other")), ["kind", "key"]).select("kind").distinct().collect()]
        if "source" in taken:
            raise StoreError("a source belongs to another resource id")
        if taken:
            raise StoreError(f"integrity rules broken: {[f'{k}_id_unique' for k in sorted(taken)]}")
        return self._put(snapshot, "keys", stay.unionByName(new), where), asked

    def rebuild_index(self) -> str:
        """The lexical index anew, from the units; nothing else is written."""
        seen = self.state()
        manifest = self.manifest(seen["snapshot"])
        c = self._catalog(manifest)
        with self._building() as snapshot:
            home = c.units.select("unit_id", bucket(F.col("resource_id"), manifest["buckets"]).alias("home"))
            manifest["files"] |= self._put_index(snapshot, lexical.build_index(c.units), home)
            return self._finish(snapshot, manifest, seen, self._index_problems(c, self._index(manifest)))

    def delete(self, resource_id: str) -> str:
        """Takes a resource and all that hangs on it out; an unknown id changes nothing but the snapshot."""
        return self.replace(Catalog.empty(self.spark), self.spark.createDataFrame([(resource_id,)], "resource_id string"))

    @staticmethod
    def _without(c: Catalog, ids: DataFrame) -> tuple[Catalog, DataFrame]:
        """The catalog without resources, and the ids of the units that go."""
        gone = c.units.join(ids, "resource_id", "left_semi").select("unit_id")
        out = {t: f.join(ids, "resource_id", "left_anti") if "resource_id" in f.columns else f for t, f in c.tables().items()}
        out["vectors"] = c.vectors.join(gone, "unit_id", "left_anti")
        return Catalog(**out), gone

    def rebuild_vectors(self, space_id: str, embed) -> str:
        """All vectors of a space anew: ``embed`` maps (unit_id, text) rows to (unit_id, vector). Nothing but vectors is written.

        Units without text that had a vector are means: they get the mean of their resource's new vectors,
        of its text chunks or, where it has none, of all its units with text.
        """
        seen = self.state()
        manifest = self.manifest(seen["snapshot"])
        c = self._catalog(manifest)
        texts = c.units.filter(F.trim("text") != "")
        had = c.vectors.filter(F.col("space_id") == space_id).select("unit_id")
        means = c.units.join(had, "unit_id", "left_semi").join(texts.select("unit_id"), "unit_id", "left_anti").select("unit_id", "resource_id")
        # a unit with text is embedded if it was, or if no mean stands for it
        asked = texts.join(had, "unit_id", "left_semi").unionByName(texts.join(had, "unit_id", "left_anti").filter("unit_kind <> 'whole_resource'"))
        with self._building() as snapshot:
            made = embed(asked.select("unit_id", "text"))
            made.write.parquet(f"{self.root}/{snapshot}/_batch/rows")  # two uses embed once
            fresh = self.spark.read.schema(made.schema).parquet(f"{self.root}/{snapshot}/_batch/rows")
            parts = fresh.join(texts.select("unit_id", "resource_id", "unit_kind"), "unit_id").filter("unit_kind <> 'whole_resource'").join(means.select("resource_id"), "resource_id", "left_semi")
            mean = weighted_centroids(parts, "resource_id", "unit_id", "vector", normalize=True).filter("centroid IS NOT NULL")
            wholes = means.join(mean, "resource_id").select("unit_id", F.col("centroid").cast("array<float>").alias("vector"))
            every = c.vectors.filter(F.col("space_id") != space_id).unionByName(conform(fresh.unionByName(wholes).withColumn("space_id", F.lit(space_id)), "vectors"))
            home = c.units.select("unit_id", bucket(F.col("resource_id"), manifest["buckets"]).alias("home"))
            manifest["files"]["vectors"] = self._put_vectors(snapshot, every, home)
            found = {r.rule: r.n for r in violations(self._catalog(manifest)).filter("n > 0").collect()}
            done = self._finish(snapshot, manifest, seen, found)
            self._fs.delete(self._path(f"{snapshot}/_batch"), True)
            return done

    def keep(self, rows: DataFrame) -> DataFrame:
        """Rows written beside the snapshots and read back; they stay until a vacuum after ``STALE`` seconds."""
        path = f"{self.root}/{PLAN}{uuid.uuid4().hex}/rows"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def vacuum(self, age: float = STALE) -> list[str]:
        """Deletes what neither the pointer nor a rollback can reach; the snapshots that are gone.

        Folders of a gone snapshot that a later one names stay. A snapshot that was never current and is younger
        than ``age`` seconds may be another writer's and stays, too.
        """
        now = self.state()
        reached = [s for s in (now["snapshot"], now["previous"]) if s]
        used = {f for s in reached for folders in self.manifest(s)["files"].values() for f in folders.values()}
        for name in self._names(PLAN):
            if self._age(name) > max(age, STALE):
                self._fs.delete(self._path(name), True)
        gone = []
        for name in self._names("snapshot-"):
            if name in reached or (not self._fs.exists(self._path(f"{name}/{ACTIVE}")) and self._age(name) < age):
                continue
            gone.append(name)
            if not any(f.startswith(f"{name}/") for f in used):
                self._fs.delete(self._path(name), True)
                continue
            for table in FILES:
                if self._fs.exists(self._path(f"{name}/{table}")):
                    for s in self._fs.listStatus(self._path(f"{name}/{table}")):
                        if f"{name}/{table}/{s.getPath().getName()}" not in used:
                            self._fs.delete(s.getPath(), True)
        return gone


class _Building:
    """Names a snapshot; takes its folder away if the write fails."""

    def __init__(self, store: Store):
        self.store, self.name = store, f"snapshot-{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        return self.name

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.store._fs.delete(self.store._path(self.name), True)
