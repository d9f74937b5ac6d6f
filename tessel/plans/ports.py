"""What users can put in place of the built-in parts: plain classes, checked when an engine takes them.

An embedder maps rows to vectors as a DataFrame step, so that its model runs
where the rows are (an Arrow batch at a time, say, as ``BatchEmbedder`` does).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Sequence
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.vectors import hash_vector
from tessel.operators import graphs


@runtime_checkable
class Embedder(Protocol):
    """Text embeddings of one space."""

    space_id: str
    dims: int

    def units(self, rows: DataFrame) -> DataFrame:
        """(unit_id, text) to (unit_id, vector)."""

    def query(self, text: str) -> tuple[float, ...]:
        """The vector of a query."""


@runtime_checkable
class TokenCounter(Protocol):
    """How long a text is, for grouping and chunking."""

    def __call__(self, text: str) -> int: ...


class HashEmbedder:
    """The deterministic embedder of tests, as columns and for one query."""

    def __init__(self, dims: int = 128):
        self.dims, self.space_id = dims, f"hash-{dims}"

    def space(self, spark: SparkSession) -> DataFrame:
        return graphs.space(spark, self.space_id, self.dims)

    def units(self, rows: DataFrame) -> DataFrame:
        return rows.select("unit_id", hash_vector(F.col("text"), self.dims).cast("array<float>").alias("vector"))

    def query(self, text: str) -> tuple[float, ...]:
        d = hashlib.sha256(text.encode()).digest()
        raw = [((d[i % 32] * (i + 1)) % 256) / 127.5 - 1 for i in range(self.dims)]
        size = math.sqrt(sum(x * x for x in raw)) or 1.0
        return tuple(x / size for x in raw)


class BatchEmbedder:
    """An embedder of any function from texts to vectors, called with up to ``batch`` texts at a time on the workers.

    ``query_prefix`` goes before queries alone. A vector of other dimensions, or with an entry that is not finite, is an error.
    """

    def __init__(self, space_id: str, dims: int, embed: Callable[[Sequence[str]], Iterable[Sequence[float]]], batch: int = 64, query_prefix: str = ""):
        if dims < 1 or batch < 1:
            raise ValueError("dimensions and batch must be positive")
        self.space_id, self.dims, self.embed, self.batch, self.query_prefix = space_id, dims, embed, batch, query_prefix

    @staticmethod
    def _vectors(embed, texts: Sequence[str], dims: int) -> list[list[float]]:
        out = [[float(x) for x in v] for v in embed(texts)]
        if len(out) != len(texts) or any(len(v) != dims or not all(map(math.isfinite, v)) for v in out):
            raise ValueError(f"the embedder did not give a finite vector of {dims} dimensions for each text")
        return out

    def units(self, rows: DataFrame) -> DataFrame:
        import pyarrow as pa

        embed, dims, size, vectors = self.embed, self.dims, self.batch, self._vectors

        def run(batches):
            for held in batches:
                for lo in range(0, len(held), size):
                    part = held.slice(lo, size)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors(embed, part.column(1).to_pylist(), dims), pa.list_(pa.float32()))], ["unit_id", "vector"])

        return rows.select("unit_id", "text").mapInArrow(run, "unit_id string, vector array<float>")

    def query(self, text: str) -> tuple[float, ...]:
        return tuple(self._vectors(self.embed, [self.query_prefix + text], self.dims)[0])


def checked(embedder: Embedder | None) -> Embedder | None:
    """``embedder``, or an error where it lacks a part of the protocol."""
    if embedder is not None and (not isinstance(embedder, Embedder) or not isinstance(embedder.dims, int) or embedder.dims < 1):
        raise TypeError("an embedder needs space_id, dims, units and query")
    return embedder
