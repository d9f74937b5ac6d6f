"""The synthetic tables as a catalog.

documents are resources (namespace: source), their paragraphs units, their
languages and labels facets; embeddings are whole-resource vectors of one
cosine space, paired with documents by ``vec_id = doc_id`` (the data have no
key of their own; the pairing is ours).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.plans.catalog import Catalog, conform

SPACE = "space-64"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """unit_id, resource_id, doc_id, ordinal, text, fts_seq of every paragraph."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    rid = F.col("doc_id").cast("string")
    return docs.select(F.concat_ws(":", rid, F.col("ordinal")).alias("unit_id"), rid.alias("resource_id"), "doc_id", "ordinal", "text", (F.col("doc_id") * 1000000 + F.col("ordinal")).alias("fts_seq"))


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    docs = read(spark, sf_dir, "documents")
    rid = F.col("doc_id").cast("string").alias("resource_id")
    resources = docs.select(rid, F.lit("document").alias("resource_kind"), F.lit("text/plain").alias("media_type"), F.col("source").alias("source_namespace"), F.sha2("text", 256).alias("content_hash"))
    reps = docs.select(F.concat("doc_id", F.lit(":text")).alias("representation_id"), rid, F.lit("retrieval_text").alias("representation_kind"), F.lit("text").alias("modality"), F.col("lang").alias("language"))
    wholes = docs.select(F.concat("doc_id", F.lit(":whole")).alias("representation_id"), rid, F.lit("whole_resource_text").alias("representation_kind"), F.lit("text").alias("modality"))
    parts = paragraphs(spark, sf_dir)
    units = parts.select("unit_id", "resource_id", F.concat("doc_id", F.lit(":text")).alias("representation_id"), F.lit("text_chunk").alias("unit_kind"), F.lit("text").alias("modality"), "text", "ordinal", "fts_seq")
    whole_units = docs.select(F.concat("doc_id", F.lit(":whole")).alias("unit_id"), rid, F.concat("doc_id", F.lit(":whole")).alias("representation_id"), F.lit("whole_resource").alias("unit_kind"), F.lit("text").alias("modality"), F.lit(0).alias("ordinal"))
    vectors = read(spark, sf_dir, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit(":whole")).alias("unit_id"), F.lit(SPACE).alias("space_id"), F.col("embedding").alias("vector"))
    labels = read(spark, sf_dir, "labels")
    facets = docs.select(rid, F.lit("lang").alias("namespace"), F.col("lang").alias("value"))
    for name in ("quality", "toxic"):
        facets = facets.unionByName(labels.select(rid, F.lit(name).alias("namespace"), F.concat(F.lit("i:"), F.col(name)).alias("value")))
    facets = facets.withColumns({"origin": F.when(F.col("namespace") == "lang", "source").otherwise("classifier"), "confidence": F.lit(None).cast("double")})
    spaces = spark.createDataFrame([(SPACE, 64, "cosine", "sha256:demo")], "space_id string, dimensions int, metric string, fingerprint string")
    return Catalog(
        conform(resources, "resources"), conform(reps, "representations").unionByName(conform(wholes, "representations")),
        conform(units, "units").unionByName(conform(whole_units, "units")), spaces, conform(vectors, "vectors"), conform(facets, "facets"),
    )


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 3) -> tuple[float, ...]:
    """One stored vector, as a query."""
    return tuple(read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first().embedding)
