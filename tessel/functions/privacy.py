"""Privacy scan of nested values: findings name a category and a place, never the value."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERNS = {
    "absolute_path": r"(?:^|[\s\"'=(])(?:/(?:home|Users|root|var|tmp|etc|mnt)/|[A-Za-z]:\\)",
    "url": r"\b[a-z][a-z0-9+.-]*://",
    "credential": r"(?i)\b(?:api[_-]?key|secret|password|passwd|token|bearer|authorization)\b\s*[:=]",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
}


def scan(value, forbidden_keys: frozenset[str] = frozenset(), forbidden_values: frozenset[str] = frozenset(), place: str = "") -> Iterator[tuple[str, str]]:
    """(category, JSON pointer) of every finding."""
    if isinstance(value, dict):
        for k, v in value.items():
            at = f"{place}/{str(k).replace('~', '~0').replace('/', '~1')}"
            if str(k).casefold() in forbidden_keys:
                yield "forbidden_key", at
            yield from scan(v, forbidden_keys, forbidden_values, at)
    elif isinstance(value, list | tuple):
        for i, v in enumerate(value):
            yield from scan(v, forbidden_keys, forbidden_values, f"{place}/{i}")
    elif isinstance(value, str):
        if value in forbidden_values:
            yield "forbidden_value", place
        for name, pattern in PATTERNS.items():
            if re.search(pattern, value):
                yield name, place


def flags(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with a boolean per category, for a text column."""
    return rows.withColumns({f"has_{n}": F.coalesce(F.col(column).rlike(p), F.lit(False)) for n, p in PATTERNS.items()})
