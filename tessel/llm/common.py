"""Helpers shared by the training-data operators.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``. Operators name the
columns they read (``id_col``, ``text_col``) and select only those, so extra
columns of the input, whatever their names, never reach their plans.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
_MADE: list[tuple[SparkSession, str]] = []
_TABLES: list[tuple[SparkSession, str]] = []


def let(value: Column, body) -> Column:
    """``body(x)`` with ``x`` bound to ``value`` once, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share.

    A session on one machine that names none (tests) gets one beside its
    warehouse; on a cluster that is an error, as no folder is known to be shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/tessel-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def stash(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, stem: str, buckets: int, column: str) -> DataFrame:
    """``df`` in a table of this session alone, bucketed where it is made; its files lie in the shared folder and go with it."""
    spark = df.sparkSession
    name = table_name(spark, stem)
    df.write.format("parquet").option("compression", "zstd").option("path", shared_dir(spark)).bucketBy(buckets, column).saveAsTable(name)
    return spark.table(name)


def table_name(spark: SparkSession, stem: str) -> str:
    """A name for a table that only this session's results need; it is dropped when Python ends."""
    name = f"tessel_{stem}_{uuid.uuid4().hex}"
    _TABLES.append((spark, name))
    return name


@atexit.register
def _sweep() -> None:
    for spark, name in _TABLES:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # as below
            return
    for spark, path in _MADE:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended; the folder goes with the cluster's own cleaning
            return
