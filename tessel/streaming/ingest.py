"""Files that arrive, indexed batch by batch into the store.

The same graph as the batch scan makes; each micro-batch is one snapshot, so
a batch that is tried again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.text import file_hash
from tessel.operators import chunking
from tessel.plans.engine import Engine
from tessel.sources import markdown


def stream_markdown(engine: Engine, folder: str, checkpoint: str, namespace: str = "vault"):
    """Starts a stream over the Markdown files of a folder; stop it, or run it with ``processAllAvailable``."""
    spark: SparkSession = engine.spark
    base = "/" + folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(folder)

    def add(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        path = F.regexp_replace("path", f"^(?:[\\w+.-]+:)?/*{base.lstrip('/')}/", "")
        rows = batch.select(path.alias("relative_path"), F.col("content").cast("string").alias("content")).withColumn("source_hash", file_hash(F.col("content")))
        graph = engine._documents(rows.join(markdown.titles(rows), "relative_path"), chunking.chunk_files(rows, engine.config), namespace)
        engine.store.replace(graph)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
