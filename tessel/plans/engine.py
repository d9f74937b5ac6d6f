"""One object for ingest, search, similarity and maintenance over a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import chunking, facets, graphs, grouping, incremental, search
from tessel.plans.catalog import Catalog, violations
from tessel.plans.ports import Embedder, HashEmbedder, checked
from tessel.plans.requests import SCOPES, Scope, compile_filters, similarity_scope
from tessel.plans.store import Store, StoreError
from tessel.sources import frames as frame_source
from tessel.sources import manifest, markdown, transcripts

__all__ = ["Engine", "HashEmbedder"]


class Engine:
    """Searches read the store's current snapshot; every ingest is one new snapshot."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, config: chunking.Config | None = None):
        self.spark, self.store, self.embedder, self.config = spark, Store(spark, root), checked(embedder), config

    @property
    def catalog(self) -> Catalog:
        return self.store.load()

    # ingest -----------------------------------------------------------------

    def scan(self, folder: str, include: tuple[str, ...] = ("**/*.md",), exclude: tuple[str, ...] = (), force: bool = False, namespace: str = "vault") -> DataFrame:
        """Indexes new and changed Markdown files, takes deleted ones out, and returns the plan of changes."""
        files = markdown.scan(self.spark, folder, include, exclude)
        seen = self.store.state()
        old = self.store.load(seen["snapshot"])
        path = F.get_json_object("locator.payload_json", "$.relative_path")
        stored = old.resources.filter((F.col("source_namespace") == namespace) & (F.col("locator.kind") == "source_file")).select(path.alias("relative_path"), F.col("content_hash").alias("source_hash"), F.col("resource_id").alias("logical_id"), F.lit("active").alias("status"))
        plan = incremental.change_plan(files, stored)
        moves = incremental.renames(plan)
        rows = plan.join(moves.select(F.col("new_path").alias("relative_path"), F.col("logical_id").alias("moved_id")), "relative_path", "left")
        rows = rows.join(moves.select(F.col("old_path").alias("relative_path"), F.lit(True).alias("left")), "relative_path", "left")
        kind = F.when(F.col("moved_id").isNotNull() | F.col("left"), F.when(F.col("left"), "renamed_from").otherwise("renamed")).otherwise(F.col("change"))
        # the plan is written beside the snapshot that it was made from
        found = self.store.keep(rows.select("relative_path", F.coalesce("moved_id", "logical_id").alias("logical_id"), "source_hash", kind.alias("change")).orderBy("relative_path"))
        if force or not found.filter("change <> 'unchanged'").isEmpty():
            work = found.filter("change NOT IN ('deleted', 'renamed_from')" if force else "change IN ('new', 'changed', 'renamed')")
            # what changed keeps the id it is stored under, wherever the file is now
            todo = files.join(work.select("relative_path", F.col("logical_id").alias("resource_id")), "relative_path")
            # a new file at a path whose first file has moved on cannot have that one's id
            own = T.logical_id("document", F.lit(namespace), F.col("relative_path"))
            todo = todo.join(stored.select(F.col("logical_id").alias("taken")), (F.col("taken") == own) & F.col("resource_id").isNull(), "left")
            anew = F.when(F.col("taken").isNotNull(), T.logical_id("document", F.lit(namespace), F.col("relative_path"), F.col("source_hash")))
            todo = todo.withColumn("resource_id", F.coalesce("resource_id", anew)).drop("taken")
            titled = todo.join(markdown.titles(todo), "relative_path")
            batch = self._documents(titled, chunking.chunk_files(todo.drop("resource_id"), self.config), namespace)
            self.store.replace(batch, found.filter("change = 'deleted'").select(F.col("logical_id").alias("resource_id")), seen)
        return found

    def _space(self) -> DataFrame:
        return graphs.space(self.spark, self.embedder.space_id, self.embedder.dims)

    def _documents(self, files: DataFrame, chunks: DataFrame, namespace: str) -> Catalog:
        graph = graphs.document_graph(files, chunks, namespace=namespace)
        if self.embedder is None:
            return graph
        return graphs.document_graph(files, chunks, self.embedder.units(graph.units.filter("unit_kind = 'text_chunk'").select("unit_id", "text")), self._space(), namespace)

    def _embedded(self, graph: Catalog) -> Catalog:
        return graph if self.embedder is None else graphs.with_vectors(graph, self.embedder.units, self._space())

    def ingest_transcripts(self, folder: str, kind: str = "audio", policy: grouping.Policy | None = None, strict: bool = True) -> str:
        atoms = transcripts.read_atoms(transcripts.scan(self.spark, folder), strict).filter("problem IS NULL").withColumn("resource_id", F.concat(F.lit("media_"), F.substring(F.sha2("source", 256), 1, 32)))
        return self.store.replace(self._embedded(graphs.transcript_graph(grouping.group_atoms(atoms, policy), kind)))

    def ingest_video(self, text: str, policy: grouping.Policy | None = None) -> str:
        """A video manifest: transcript and frames of one resource."""
        resource, transcript, captions = frame_source.video_manifest(text)
        rid = resource["resource_id"]
        files = lambda body: self.spark.createDataFrame([(rid, body)], "source string, content string")
        atoms = transcripts.read_atoms(files(transcript), True).withColumn("resource_id", F.lit(rid))
        return self.store.replace(self._embedded(graphs.video_graph(grouping.group_atoms(atoms, policy), frame_source.read_captions(files(captions)))))

    def ingest_images(self, images: DataFrame) -> str:
        return self.store.replace(self._embedded(graphs.image_graph(images)))

    def import_manifest(self, data: bytes) -> str:
        return self.store.replace(manifest.to_catalog(self.spark, manifest.decode(data)))

    def export_manifest(self, resource_id: str, **options) -> bytes:
        return manifest.encode(self.catalog, resource_id, **options)

    def delete(self, resource_id: str) -> str:
        return self.store.delete(resource_id)

    # search -----------------------------------------------------------------

    def _scope(self, scope: str | Scope | None, filters: tuple = ()) -> Scope:
        base = SCOPES[scope] if isinstance(scope, str) else scope or Scope()
        return compile_filters(all_=filters, base=base) if filters else base

    def search_text(self, query: str, limit: int = 10, offset: int = 0, scope: str | Scope | None = None, filters: tuple = ()) -> DataFrame:
        return search.search_text(self.catalog, query, limit, offset, self._scope(scope, filters), self.store.index())

    def search_semantic(self, query: str, limit: int = 10, scope: str | Scope | None = None, filters: tuple = ()) -> DataFrame:
        return search.search_semantic(self.catalog, self.embedder.space_id, self.embedder.query(query), limit, self._scope(scope, filters))

    def search_hybrid(self, query: str, limit: int = 10, weights: tuple[float, float] = (0.4, 0.6), scope: str | Scope | None = None, filters: tuple = ()) -> search.Result:
        """Text alone, with the reason, where there is no usable vector."""
        return search.search_hybrid(self.catalog, query, self.embedder.space_id, self.embedder.query(query), limit, weights, self._scope(scope, filters), index=self.store.index())

    def search_unified(self, query: str, limit: int = 10, scope: str | Scope | None = None, filters: tuple = ()) -> search.Result:
        vecs = {self.embedder.space_id: self.embedder.query(query)} if self.embedder else {}
        return search.search_unified(self.catalog, query, vecs, limit, self._scope(scope, filters), self.store.index())

    def _asked(self, query: str) -> tuple[str | None, tuple[float, ...] | None]:
        """Space and vector of a query, where the store has vectors of the embedder."""
        if self.embedder is None or self.catalog.spaces.filter(F.col("space_id") == self.embedder.space_id).isEmpty():
            return None, None
        return self.embedder.space_id, self.embedder.query(query)

    def search_transcripts(self, query: str, limit: int = 10, target: str = "unit") -> search.Result:
        return search.search_transcripts(self.catalog, query, *self._asked(query), limit=limit, target=target, index=self.store.index())

    def search_media(self, query: str, preset: str = "balanced", limit: int = 10, scope: str | Scope | None = None, mode: str | None = None, filters: tuple = ()) -> search.Result:
        """A preset's branches: all five where the store has vectors, the lexical three where it has none."""
        return search.search(self.catalog, search.preset_request(preset, query, *self._asked(query), limit, self._scope(scope, filters), mode), self.store.index())

    def search_images(self, query: str, limit: int = 10) -> search.Result:
        return search.search_images(self.catalog, query, *self._asked(query), limit=limit, index=self.store.index())

    def search_resources(self, query: str, limit: int = 10) -> search.Result:
        return search.search_resources_text(self.catalog, query, limit, index=self.store.index())

    # reads ------------------------------------------------------------------

    def similar(self, resource_id: str, limit: int = 10, scope: str | None = None) -> DataFrame:
        return search.similar(self.catalog, resource_id, self.embedder.space_id, limit, ("centroid", "direct"), similarity_scope(scope) if scope else None)

    def duplicates(self, resource_id: str, limit: int = 10) -> DataFrame:
        return facets.duplicates(self.catalog.resources, resource_id, limit)

    def facets(self, namespace: str | None = None) -> DataFrame:
        return facets.facet_counts(self.catalog.facets, namespace)

    def metadata_facets(self) -> DataFrame:
        return facets.metadata_facets(self.catalog.facets)

    def resource(self, resource_id: str) -> DataFrame:
        return self.catalog.resources.filter(F.col("resource_id") == resource_id)

    def unit(self, unit_id: str) -> DataFrame:
        return self.catalog.units.filter(F.col("unit_id") == unit_id)

    def units(self, resource_id: str) -> DataFrame:
        return self.catalog.units.filter(F.col("resource_id") == resource_id).orderBy("representation_id", "ordinal")

    def vector(self, unit_id: str, space_id: str) -> DataFrame:
        return self.catalog.vectors.filter((F.col("space_id") == space_id) & (F.col("unit_id") == unit_id))

    def files(self, page: int = 1, size: int = 50) -> tuple[DataFrame, int, bool]:
        path = F.get_json_object("locator.payload_json", "$.relative_path")
        rows = self.catalog.resources.filter("locator.kind = 'source_file'").select(path.alias("relative_path"), "resource_id", "title", "content_hash")
        return facets.page(rows, ["relative_path"], page, size)

    def neighbours(self, unit_id: str, count: int = 2) -> DataFrame:
        chunks = self.catalog.units.filter("unit_kind = 'text_chunk'").select(F.col("unit_id").alias("chunk_id"), F.col("representation_id").alias("file_id"), F.col("ordinal").alias("chunk_index"), "text")
        return facets.neighbours(chunks, unit_id, count)

    def analyze_storage(self) -> DataFrame:
        c = self.catalog
        return facets.storage_stats(c.vectors, c.spaces)

    def status(self) -> DataFrame:
        return facets.store_counts(self.catalog.tables())

    def inspect(self) -> DataFrame:
        """Counts of resources, units and vectors by kind: nothing of their content, names or places."""
        c = self.catalog
        count = lambda frame, what, kind: frame.groupBy(F.lit(what).alias("what"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
        parts = [count(c.resources, "resource", "resource_kind"), count(c.representations, "representation", "representation_kind"), count(c.units, "unit", "unit_kind"), count(c.vectors, "vector", "space_id"), count(c.facets, "facet", "origin")]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def init(self) -> str:
        """An empty store with a snapshot; an error where there is one."""
        if self.store.state()["snapshot"]:
            raise StoreError("the store is not empty")
        return self.store.commit(Catalog.empty(self.spark))

    def doctor(self) -> DataFrame:
        """code, severity, n: units with text against the lexical index and the embedder's vectors, and broken integrity rules."""
        c, index = self.catalog, self.store.index()
        texts = c.units.filter(F.trim("text") != "").select(F.col("unit_id").alias("chunk_id"), F.col("text").alias("embedding_text"), "unit_kind")
        indexed = (index.lengths if index else c.units.limit(0)).select(F.col("unit_id").alias("chunk_id"))
        space = self.embedder.space_id if self.embedder else None
        # titles and the like need no vector; the store keeps no hash of what was embedded, so none is told to be stale
        asked = texts.filter("unit_kind <> 'whole_resource'") if self.embedder else texts.limit(0)
        held = c.vectors.filter(F.col("space_id") == F.lit(space)).select(F.col("unit_id").alias("chunk_id"))
        hashes = held.join(texts.select("chunk_id", F.sha2("embedding_text", 256).alias("embedded_hash")), "chunk_id")
        lexical = incremental.doctor(texts, indexed, hashes).filter("code LIKE '%fts'")
        semantic = incremental.doctor(asked, asked.select("chunk_id"), hashes).filter("code IN ('missing_embedding', 'stale_embedding')")
        orphans = held.join(c.units.select(F.col("unit_id").alias("chunk_id")), "chunk_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("orphan_embedding").alias("code"), F.lit("error").alias("severity"), "n")
        broken = violations(c).select(F.concat(F.lit("rule_"), "rule").alias("code"), F.lit("error").alias("severity"), "n").filter("n > 0")
        return lexical.unionByName(semantic).unionByName(orphans).unionByName(broken)

    def rebuild_index(self) -> str:
        return self.store.rebuild_index()

    def rollback(self) -> None:
        self.store.rollback()

    def rebuild_vectors(self) -> str:
        return self.store.rebuild_vectors(self.embedder.space_id, self.embedder.units)
