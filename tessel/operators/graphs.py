"""Resource graphs of documents, transcripts, frames and images, as catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators.vector import weighted_centroids
from tessel.plans.catalog import Catalog, conform


def locator(kind: str, **fields: Column) -> Column:
    """A locator of a kind; its payload is JSON with sorted keys."""
    body = F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items())))) if fields else F.lit("{}")
    return F.struct(F.lit(kind).alias("kind"), body.alias("payload_json"), F.sha2(body, 256).alias("fingerprint"))


def catalog_of(spark, **tables: list[DataFrame]) -> Catalog:
    """A catalog of the given frames, each conformed and united; the rest is empty."""
    out = Catalog.empty(spark).tables()
    for name, frames in tables.items():
        for f in frames:
            out[name] = out[name].unionByName(conform(f, name))
    return Catalog(**out)


def space(spark, space_id: str, dims: int, metric: str = "cosine", fingerprint: str = "") -> DataFrame:
    return spark.createDataFrame([(space_id, dims, metric, fingerprint or space_id)], "space_id string, dimensions int, metric string, fingerprint string")


def document_graph(files: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, space_frame: DataFrame | None = None, namespace: str = "vault") -> Catalog:
    """Files (relative_path, title, source_hash, facets?, resource_id?) and their chunks as documents.

    A file that was renamed brings the id that it had; others get one from their path.

    Each has a text representation with a unit per chunk, a metadata unit with
    its title, and a whole-resource unit whose vector is the mean of its chunks'.
    """
    spark = files.sparkSession
    rid = T.logical_id("document", F.lit(namespace), F.col("relative_path"))
    docs = files.withColumn("resource_id", F.coalesce("resource_id", rid) if "resource_id" in files.columns else rid)
    path = locator("source_file", relative_path=F.col("relative_path"))
    resources = docs.select("resource_id", F.lit("document").alias("resource_kind"), F.lit("text/markdown").alias("media_type"), F.lit(namespace).alias("source_namespace"), path.alias("locator"), F.col("source_hash").alias("content_hash"), "title")
    rep = lambda kind: F.concat_ws(":", "resource_id", F.lit(kind))
    held = chunks.join(docs.select("relative_path", "resource_id"), "relative_path")
    has_text = held.select("resource_id").distinct()
    titled = docs.filter(F.trim("title") != "")
    reps = [
        has_text.select(rep("text").alias("representation_id"), "resource_id", F.lit("retrieval_text").alias("representation_kind"), F.lit("text").alias("modality")),
        titled.select(rep("meta").alias("representation_id"), "resource_id", F.lit("metadata_text").alias("representation_kind"), F.lit("text").alias("modality"), F.col("title").alias("text")),
    ]
    cid = T.logical_id("chunk", F.col("resource_id"), F.col("chunk_index"), F.sha2("text", 256))
    where = locator("source_span", end_line=F.col("end_line"), relative_path=F.col("relative_path"), start_line=F.col("start_line"))
    units = [
        held.select(cid.alias("unit_id"), "resource_id", rep("text").alias("representation_id"), F.lit("text_chunk").alias("unit_kind"), F.lit("text").alias("modality"), "text", where.alias("locator"), F.col("chunk_index").alias("ordinal"), F.lit(None).cast("long").alias("fts_seq")),
        titled.select(rep("meta:0").alias("unit_id"), "resource_id", rep("meta").alias("representation_id"), F.lit("whole_resource").alias("unit_kind"), F.lit("text").alias("modality"), F.col("title").alias("text"), F.lit(0).alias("ordinal")),
    ]
    vecs, spaces = [], []
    if vectors is not None:
        each = vectors.join(units[0].select("unit_id", "resource_id"), "unit_id")
        whole = weighted_centroids(each, "resource_id", "unit_id", "vector", normalize=True).filter("centroid IS NOT NULL")
        sid = space_frame.select("space_id").first()[0]
        vecs = [each.select("unit_id", F.lit(sid).alias("space_id"), "vector"), whole.select(rep("whole:0").alias("unit_id"), F.lit(sid).alias("space_id"), F.col("centroid").alias("vector"))]
        reps.append(whole.select(rep("whole").alias("representation_id"), "resource_id", F.lit("whole_resource_text").alias("representation_kind"), F.lit("text").alias("modality")))
        units.append(whole.select(rep("whole:0").alias("unit_id"), "resource_id", rep("whole").alias("representation_id"), F.lit("whole_resource").alias("unit_kind"), F.lit("text").alias("modality"), F.lit(0).alias("ordinal"), F.lit('{"aggregation":"centroid"}').alias("metadata_json")))
        spaces = [space_frame]
    facets = [docs.select("resource_id", F.inline("facets")).withColumn("origin", F.lit("source"))] if "facets" in files.columns else []
    return catalog_of(spark, resources=[resources], representations=reps, units=units, vectors=vecs, spaces=spaces, facets=facets)


#: A whole text of up to so many tokens gets a vector of its own; a longer one the mean of its parts'.
DIRECT_TOKENS = 8_000


def with_vectors(c: Catalog, embed, space_frame: DataFrame, direct_tokens: int = DIRECT_TOKENS) -> Catalog:
    """A graph of transcripts, frames or images with a vector for each unit with text, and one for each resource.

    Resources without a whole-resource unit get one: with the text of their
    representation and its own vector where that has up to ``direct_tokens``
    tokens, else with the mean of the units' vectors, weighted by tokens. A
    mean without a direction is left out.
    """
    spark = c.units.sparkSession
    sid = space_frame.select("space_id").first()[0]
    texts = c.units.filter(F.trim("text") != "")
    each = embed(texts.select("unit_id", "text"))
    lacking = c.resources.select("resource_id").join(c.units.filter("unit_kind = 'whole_resource'").select("resource_id"), "resource_id", "left_anti")
    uid, rep = F.concat_ws(":", "resource_id", F.lit("whole:0")), F.concat_ws(":", "resource_id", F.lit("whole"))
    ordered = F.array_sort(F.collect_list(F.struct("representation_id", "ordinal", "text")))
    wholes = texts.join(lacking, "resource_id", "left_semi").groupBy("resource_id").agg(F.array_join(F.transform(ordered, lambda u: u["text"]), "\n\n").alias("text"), F.sum(T.count_words(F.col("text"))).alias("n"))
    short = wholes.filter(F.col("n") <= direct_tokens).select(uid.alias("unit_id"), "resource_id", "text")
    parts = texts.join(wholes.filter(F.col("n") > direct_tokens).select("resource_id"), "resource_id", "left_semi").select("unit_id", "resource_id", T.count_words(F.col("text")).alias("n_words"))
    means = weighted_centroids(parts.join(each, "unit_id"), "resource_id", "unit_id", "vector", "n_words", True).filter("centroid IS NOT NULL")
    made = short.select("unit_id", "resource_id", "text", F.lit("direct").alias("how")).unionByName(means.select(uid.alias("unit_id"), "resource_id", F.lit(None).cast("string").alias("text"), F.lit("centroid").alias("how")))
    units = made.select("unit_id", "resource_id", rep.alias("representation_id"), F.lit("whole_resource").alias("unit_kind"), F.lit("text").alias("modality"), "text", F.lit(0).alias("ordinal"), F.to_json(F.struct(F.col("how").alias("aggregation"))).alias("metadata_json"))
    reps = made.select(rep.alias("representation_id"), "resource_id", F.lit("whole_resource_text").alias("representation_kind"), F.lit("text").alias("modality"))
    vecs = [each, embed(short.select("unit_id", "text")), means.select(uid.alias("unit_id"), F.col("centroid").alias("vector"))]
    new = catalog_of(spark, representations=[reps], units=[units], spaces=[space_frame], vectors=[v.select("unit_id", F.lit(sid).alias("space_id"), "vector") for v in vecs])
    return Catalog(**{t: f.unionByName(getattr(new, t)) for t, f in c.tables().items()})


def whole_texts(parts: DataFrame, key: str = "resource_id", ordinal: str = "ordinal") -> DataFrame:
    """key, text (parts joined by blank lines in order) and token_count (their sum)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, "text"))), lambda p: p["text"]), "\n\n")
    return parts.groupBy(key).agg(text.alias("text"), F.sum("token_count").alias("token_count"))


def transcript_graph(passages: DataFrame, kind: str = "audio", media_type: str = "audio/mpeg", namespace: str = "media") -> Catalog:
    """Passages as time segments of audio or video resources."""
    spark = passages.sparkSession
    rep = F.concat_ws(":", "resource_id", F.lit("passages"))
    wholes = whole_texts(passages).withColumn("token_count", F.col("token_count").cast("int"))
    resources = wholes.select("resource_id", F.lit(kind).alias("resource_kind"), F.lit(media_type).alias("media_type"), F.lit(namespace).alias("source_namespace"), F.sha2("text", 256).alias("content_hash"))
    reps = wholes.select(rep.alias("representation_id"), "resource_id", F.lit("timed_passage").alias("representation_kind"), F.lit("text").alias("modality"), "text", "token_count")
    uid = T.logical_id("passage", F.col("resource_id"), F.col("ordinal"), F.sha2("text", 256))
    where = locator("time_segment", end_ms=F.col("end_ms"), start_ms=F.col("start_ms"))
    units = passages.select(uid.alias("unit_id"), "resource_id", rep.alias("representation_id"), F.lit("time_segment").alias("unit_kind"), F.lit("text").alias("modality"), "text", where.alias("locator"), "ordinal", F.lit(None).cast("long").alias("fts_seq"), "start_ms", "end_ms")
    return catalog_of(spark, resources=[resources], representations=[reps], units=[units])


def frame_graph(frames: DataFrame, namespace: str = "media") -> Catalog:
    """Frame captions as units of video resources."""
    spark = frames.sparkSession
    rep = F.concat_ws(":", "resource_id", F.lit("frames"))
    ids = frames.groupBy("resource_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws("\t", "timestamp_ms", "caption"))), "\n"), 256).alias("content_hash"))
    resources = ids.select("resource_id", F.lit("video").alias("resource_kind"), F.lit("video/mp4").alias("media_type"), F.lit(namespace).alias("source_namespace"), "content_hash")
    reps = ids.select(rep.alias("representation_id"), "resource_id", F.lit("frame_caption").alias("representation_kind"), F.lit("text").alias("modality"))
    units = frames.select(F.concat_ws(":", "resource_id", "frame_id").alias("unit_id"), "resource_id", rep.alias("representation_id"), F.lit("frame").alias("unit_kind"), F.lit("text").alias("modality"), F.col("caption").alias("text"), locator("video_frame", timestamp_ms=F.col("timestamp_ms")).alias("locator"), "ordinal", F.lit(None).cast("long").alias("fts_seq"), "timestamp_ms", "metadata_json")
    return catalog_of(spark, resources=[resources], representations=[reps], units=[units])


def video_graph(passages: DataFrame, frames: DataFrame) -> Catalog:
    """Transcript and frames of videos in one graph; a resource's hash covers both."""
    a, b = transcript_graph(passages, "video", "video/mp4"), frame_graph(frames)
    both = a.resources.unionByName(b.resources)
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    merged = both.groupBy("resource_id").agg(*(first(c) for c in both.columns if c not in ("resource_id", "content_hash")), F.sha2(F.array_join(F.sort_array(F.collect_list("content_hash")), "\n"), 256).alias("content_hash"))
    return Catalog(conform(merged, "resources"), a.representations.unionByName(b.representations), a.units.unionByName(b.units), a.spaces, a.vectors, a.facets)


def image_graph(images: DataFrame, namespace: str = "images") -> Catalog:
    """Images (resource_id, media_type, content_hash, caption_text, ocr_text) with a unit per text and one for both."""
    spark = images.sparkSession
    texts = images.select("resource_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("text")) for k in ("caption_text", "ocr_text")))).alias("t")).select("resource_id", "t.*").filter(F.trim("text") != "")
    rep = F.concat_ws(":", "resource_id", "kind")
    whole = texts.groupBy("resource_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kind", "text"))), lambda t: t["text"]), "\n\n").alias("text")).withColumn("kind", F.lit("image_text_aggregate"))
    every = texts.unionByName(whole)
    resources = images.select("resource_id", F.lit("image").alias("resource_kind"), "media_type", F.lit(namespace).alias("source_namespace"), "content_hash")
    reps = every.select(rep.alias("representation_id"), "resource_id", F.col("kind").alias("representation_kind"), F.lit("text").alias("modality"), "text", T.count_words(F.col("text")).cast("int").alias("token_count"))
    units = every.select(F.concat_ws(":", rep, F.lit("0")).alias("unit_id"), "resource_id", rep.alias("representation_id"), F.lit("whole_resource").alias("unit_kind"), F.lit("text").alias("modality"), "text", F.lit(0).alias("ordinal"), F.lit(None).cast("long").alias("fts_seq"))
    return catalog_of(spark, resources=[resources], representations=[reps], units=[units])
