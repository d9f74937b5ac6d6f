"""Frame captions, video manifests and images, read strictly."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME = "resource_id string, ordinal int, frame_id string, timestamp_ms long, caption string, metadata_json string"
HEAD = {"schema", "resource_id", "producer_fingerprint", "normalization_fingerprint", "metadata", "frames"}
KEYS = {"frame_id", "timestamp_ms", "caption", "metadata"}
#: Metadata may not hold raw media or places on a machine.
FORBIDDEN = ("path", "absolute_path", "url", "bytes", "data", "pixels", "token", "password", "secret")
IMAGES = {b"\x89PNG\r\n\x1a\n": "image/png", b"\xff\xd8\xff": "image/jpeg", b"GIF8": "image/gif", b"RIFF": "image/webp"}


class CaptionError(ValueError):
    """Captions that break a rule."""


def _forbidden(value) -> bool:
    if isinstance(value, dict):
        return any(k.casefold() in FORBIDDEN or _forbidden(v) for k, v in value.items())
    return isinstance(value, list) and any(map(_forbidden, value))


def captions(text: str) -> tuple[dict, list[tuple]]:
    """Header and (ordinal, frame_id, timestamp_ms, caption, metadata_json) rows in time order."""
    value = json.loads(text)
    if not isinstance(value, dict) or set(value) != HEAD:
        raise CaptionError("keys")
    rows, ids, seen = [], set(), set()
    for f in value["frames"]:
        if not isinstance(f, dict) or set(f) != KEYS:
            raise CaptionError("frame keys")
        if not isinstance(f["timestamp_ms"], int) or isinstance(f["timestamp_ms"], bool) or f["timestamp_ms"] < 0:
            raise CaptionError("timestamp")
        caption = " ".join(str(f["caption"]).split())
        if not caption:
            raise CaptionError("empty caption")
        if f["frame_id"] in ids or (f["timestamp_ms"], caption) in seen:
            raise CaptionError("repeated frame")
        ids.add(f["frame_id"])
        seen.add((f["timestamp_ms"], caption))
        if _forbidden(f["metadata"]):
            raise CaptionError("forbidden metadata")
        rows.append((f["timestamp_ms"], f["frame_id"], caption, json.dumps(f["metadata"], sort_keys=True)))
    if _forbidden(value["metadata"]):
        raise CaptionError("forbidden metadata")
    rows.sort()
    return {k: value[k] for k in HEAD - {"frames"}}, [(n, i, t, c, m) for n, (t, i, c, m) in enumerate(rows)]


def read_captions(files: DataFrame) -> DataFrame:
    """Frames of caption files (source, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch.content:
                head, rows = captions(content)
                out += [(head["resource_id"], *r) for r in rows]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FRAME.split(", ")])

    return files.select("source", "content").mapInPandas(run, FRAME)


def video_manifest(text: str) -> tuple[dict, str, str]:
    """Resource, transcript and frame captions (both as JSON text) of a video manifest."""
    value = json.loads(text)
    if not isinstance(value, dict) or set(value) != {"schema", "resource", "transcript", "frame_captions"}:
        raise CaptionError("keys")
    return value["resource"], json.dumps(value["transcript"]), json.dumps(value["frame_captions"])


def scan_images(spark: SparkSession, path: str, most_bytes: int = 20 << 20) -> DataFrame:
    """source, media_type, content_hash, length of images up to a size; the type is read from the first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).filter(F.col("length") <= most_bytes)
    head = F.hex(F.substring("content", 1, 12))
    kind = F.lit(None).cast("string")
    for magic, name in IMAGES.items():
        kind = F.when(head.startswith(magic.hex().upper()), F.lit(name)).otherwise(kind)
    return files.select(F.col("path").alias("source"), kind.alias("media_type"), F.sha2("content", 256).alias("content_hash"), "length").filter("media_type IS NOT NULL")
