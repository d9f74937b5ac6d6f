"""User metadata: bounded normal form, and projection into title, facets and text."""

from __future__ import annotations

import json
import math
from collections import Counter
from dataclasses import dataclass
from datetime import date, datetime

from tessel.plans.requests import facet_scalar


@dataclass(frozen=True)
class Limits:
    depth: int = 16
    items: int = 10_000
    bytes: int = 1_000_000
    key: int = 256
    text: int = 100_000


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def normalize(value, limits: Limits | None = None) -> tuple[dict, dict[str, int]]:
    """Plain JSON metadata and counts of what had to go, by category."""
    lim, gone, seen = limits or Limits(), Counter(), [0]
    drop = object()

    def lose(why: str):
        gone[why] += 1
        return drop

    def walk(v, depth: int):
        seen[0] += 1
        if seen[0] > lim.items:
            return lose("too_many_items")
        if depth > lim.depth:
            return lose("too_deep")
        if v is None or isinstance(v, bool | int):
            return v
        if isinstance(v, float):
            return v if math.isfinite(v) else lose("non_finite_number")
        if isinstance(v, str):
            try:
                v.encode()
            except UnicodeEncodeError:
                return lose("invalid_unicode")
            return v if len(v) <= lim.text else lose("text_too_long")
        if isinstance(v, datetime | date):
            return v.isoformat()
        if isinstance(v, dict):
            out = {}
            for k, x in v.items():
                if not isinstance(k, str) or not k.strip():
                    lose("invalid_key")
                elif len(k) > lim.key:
                    lose("key_too_long")
                elif (y := walk(x, depth + 1)) is not drop:
                    out[k] = y
            return out
        if isinstance(v, set | frozenset):
            return sorted((y for x in v if (y := walk(x, depth + 1)) is not drop), key=canonical_json)
        if isinstance(v, list | tuple):
            return [y for x in v if (y := walk(x, depth + 1)) is not drop]
        return lose("unsupported_type")

    if not isinstance(value, dict):
        return {}, {"not_a_mapping": 1}
    out = walk(value, 0)
    if len(canonical_json(out).encode()) > lim.bytes:
        gone["too_large"] += 1
        out = {}
    return out, dict(sorted(gone.items()))


def resolve_pointer(value, pointer: str):
    """The value at a JSON pointer; KeyError where there is none."""
    if pointer == "":
        return value
    if not pointer.startswith("/"):
        raise ValueError("a pointer starts with /")
    for part in pointer[1:].split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict):
            value = value[part]
        elif isinstance(value, list) and part.isdigit() and (part == "0" or part[0] != "0") and int(part) < len(value):
            value = value[int(part)]
        else:
            raise KeyError(pointer)
    return value


#: Pointer, mode and facet name of the usual rules.
RULES = (("/title", "canonical_title", None), ("/tags", "facet_many", "tags"), ("/category", "facet", "category"), ("/author", "facet", "author"), ("/description", "lexical_text", None), ("/summary", "lexical_text", None))
MODES = ("store_only", "canonical_title", "facet", "facet_many", "lexical_text", "ignore")


def project(value: dict, rules=RULES) -> tuple[str | None, list[tuple[str, str]], list[str]]:
    """Title (the last rule that has one), facets and lexical texts, without repeats."""
    title, facets, texts = None, [], []
    for pointer, mode, name in rules:
        if mode not in MODES:
            raise ValueError(f"no mode {mode}")
        try:
            v = resolve_pointer(value, pointer)
        except KeyError:
            continue
        if mode == "canonical_title" and isinstance(v, str) and v.strip():
            title = v.strip()
        elif mode == "facet" and not isinstance(v, dict | list):
            facets.append((name, facet_scalar(v)))
        elif mode == "facet_many":
            facets += [(name, facet_scalar(x)) for x in (v if isinstance(v, list) else [v]) if not isinstance(x, dict | list)]
        elif mode == "lexical_text":
            texts += [x for x in (v if isinstance(v, list) else [v]) if isinstance(x, str) and x.strip()]
    return title, list(dict.fromkeys(facets)), list(dict.fromkeys(texts))
