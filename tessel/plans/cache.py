"""Results kept by what they were made from: Parquet folders named by a key's fingerprint.

A folder counts once its marker is there, and the marker is written last; a
folder without one, or with another key, is a miss and is replaced.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Key:
    source: str
    parser: str
    chunker: str
    embedder: str
    normalizer: str
    projection: str
    contract: str

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


class ArtifactCache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self._conf)

    def _marker(self, name: str) -> dict | None:
        path, fs = self._at(f"{name}/_KEY.json")
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except (ValueError, Py4JJavaError):  # damaged, by content or by checksum: a miss
            return None
        finally:
            stream.close()

    def lookup(self, key: Key) -> DataFrame | None:
        if self._marker(key.fingerprint) != asdict(key):
            return None
        return self.spark.read.parquet(f"{self.root}/{key.fingerprint}/data")

    def store(self, key: Key, rows: DataFrame) -> DataFrame:
        if (held := self.lookup(key)) is not None:
            return held
        rows.write.mode("overwrite").parquet(f"{self.root}/{key.fingerprint}/data")
        path, fs = self._at(f"{key.fingerprint}/_KEY.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(asdict(key)).encode()))
        out.close()
        return self.lookup(key)

    def get(self, key: Key, make: Callable[[], DataFrame]) -> DataFrame:
        held = self.lookup(key)
        return held if held is not None else self.store(key, make())

    def discard(self, key: Key) -> bool:
        path, fs = self._at(key.fingerprint)
        return fs.delete(path, True)

    def names(self) -> list[str]:
        path, fs = self._at("")
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def verify(self) -> dict[str, bool]:
        """Whether each entry is whole: its marker names the key that its folder is named by."""
        out = {}
        for n in self.names():
            m = self._marker(n)
            out[n] = bool(m) and Key(**m).fingerprint == n
        return out

    def purge(self, confirm: bool = False) -> int:
        if not confirm:
            raise ValueError("purging needs confirm=True")
        names = self.names()
        for n in names:
            path, fs = self._at(n)
            fs.delete(path, True)
        return len(names)
