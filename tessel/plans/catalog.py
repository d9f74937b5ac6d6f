"""The catalog as DataFrames, its schema, and the rules its rows keep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import vectors

LOCATOR = "struct<kind:string,payload_json:string,fingerprint:string>"
SCHEMAS = {
    "resources": f"resource_id string, resource_kind string, media_type string, source_namespace string, locator {LOCATOR}, content_hash string, title string, metadata_json string",
    "representations": "representation_id string, resource_id string, representation_kind string, modality string, text string, language string, token_count int, metadata_json string",
    "units": f"unit_id string, resource_id string, representation_id string, unit_kind string, modality string, text string, locator {LOCATOR}, ordinal int, fts_seq long, start_ms long, end_ms long, timestamp_ms long, metadata_json string",
    "spaces": "space_id string, dimensions int, metric string, fingerprint string",
    "vectors": "unit_id string, space_id string, vector array<float>",
    "facets": "resource_id string, namespace string, value string, origin string, confidence double",
}
KINDS = {
    "resource_kind": ("document", "image", "audio", "video"),
    "modality": ("text", "image", "audio", "video"),
    "metric": ("cosine", "dot", "l2"),
    "origin": ("user", "source", "extractor", "classifier"),
}


@dataclass
class Catalog:
    """The six tables. Frames are lazy; nothing is read until a query runs."""

    resources: DataFrame
    representations: DataFrame
    units: DataFrame
    spaces: DataFrame
    vectors: DataFrame
    facets: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        return cls(**{t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()})

    def tables(self) -> dict[str, DataFrame]:
        return {t: getattr(self, t) for t in SCHEMAS}

    def register(self, prefix: str = "") -> None:
        """Temporary views of the tables, for SQL."""
        for name, frame in self.tables().items():
            frame.createOrReplaceTempView(prefix + name)

    def scoped_units(self) -> DataFrame:
        """Units with the columns that scopes filter on."""
        reps = self.representations.select("representation_id", "representation_kind")
        res = self.resources.select("resource_id", "resource_kind", "media_type", "source_namespace", "title")
        return self.units.join(reps, "representation_id").join(res, "resource_id")


def conform(frame: DataFrame, table: str) -> DataFrame:
    """``frame`` with the columns and types of a table; missing ones are null."""
    schema = frame.sparkSession.createDataFrame([], SCHEMAS[table]).schema
    have = set(frame.columns)
    return frame.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def violations(c: Catalog) -> DataFrame:
    """rule, n: how often each integrity rule is broken; one row per rule, all rules always."""
    blank = lambda col: F.col(col).isNull() | (F.trim(F.col(col)) == "")
    one = F.count(F.lit(1)).alias("n")

    def broken(rule: str, frame: DataFrame) -> DataFrame:
        return frame.agg(one).select(F.lit(rule).alias("rule"), "n")

    def repeated(table: DataFrame, *keys: str) -> DataFrame:
        return table.groupBy(*keys).count().filter("count > 1")

    vec = c.vectors.join(c.units.select("unit_id", F.lit(True).alias("owned")), "unit_id", "left").join(c.spaces, "space_id", "left")
    used = c.vectors.select("unit_id").distinct().withColumn("has_vector", F.lit(True))
    checks = [
        broken("resource_id_unique", repeated(c.resources, "resource_id")),
        broken("representation_id_unique", repeated(c.representations, "representation_id")),
        broken("unit_id_unique", repeated(c.units, "unit_id")),
        broken("unit_ordinal_unique", repeated(c.units, "representation_id", "ordinal")),
        broken("space_id_unique", repeated(c.spaces, "space_id")),
        broken("vector_unique", repeated(c.vectors, "unit_id", "space_id")),
        broken("facet_unique", repeated(c.facets, "resource_id", "namespace", "value", "origin")),
        broken("source_unique", repeated(c.resources.filter("locator IS NOT NULL"), "source_namespace", "locator.kind", "locator.fingerprint")),
        broken("representation_has_resource", c.representations.join(c.resources, "resource_id", "left_anti")),
        broken("resource_has_representation", c.resources.join(c.representations, "resource_id", "left_anti")),
        broken("unit_has_representation", c.units.join(c.representations, ["representation_id", "resource_id"], "left_anti")),
        broken("representation_has_unit", c.representations.join(c.units, "representation_id", "left_anti")),
        broken("unit_modality", c.units.select("representation_id", F.col("modality").alias("m")).join(c.representations, "representation_id").filter("m <> modality")),
        broken("unit_text_or_vector", c.units.filter(blank("text")).join(used, "unit_id", "left_anti")),
        broken("vector_has_unit", vec.filter("owned IS NULL")),
        broken("vector_has_space", vec.filter("metric IS NULL")),
        broken("vector_dimensions", vec.filter(F.size("vector") != F.col("dimensions"))),
        broken("vector_finite", vec.filter(~vectors.is_finite(F.col("vector")))),
        broken("vector_norm", vec.filter((F.col("metric") == "cosine") & (vectors.norm(F.col("vector")) == 0))),
        broken("facet_has_resource", c.facets.join(c.resources, "resource_id", "left_anti")),
        broken("resource_kind", c.resources.filter(~F.col("resource_kind").isin(*KINDS["resource_kind"]))),
        broken("space_metric", c.spaces.filter(~F.col("metric").isin(*KINDS["metric"]))),
        broken("facet_origin", c.facets.filter(~F.col("origin").isin(*KINDS["origin"]))),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def validate(c: Catalog) -> None:
    """Raises when a rule is broken."""
    found = {r.rule: r.n for r in violations(c).filter("n > 0").collect()}
    if found:
        raise ValueError(f"integrity rules broken: {found}")
