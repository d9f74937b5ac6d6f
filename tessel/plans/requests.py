"""Typed search requests: what to search, in which scope, and how to combine it."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields, replace

CATEGORIES = ("resource_kinds", "media_types", "source_namespaces", "representation_kinds", "modalities", "unit_kinds")
METRICS = ("cosine", "dot", "l2")


def _texts(value, name: str) -> tuple[str, ...]:
    out = tuple(value)
    if any(not isinstance(x, str) or not x.strip() for x in out):
        raise ValueError(f"{name} must hold non-blank strings")
    return tuple(dict.fromkeys(out))


def _count(value: int, name: str, least: int = 1) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be an integer of at least {least}")


@dataclass(frozen=True)
class Scope:
    """Six categorical filters (empty: no filter) and facet clauses, all of which must hold."""

    resource_kinds: tuple[str, ...] = ()
    media_types: tuple[str, ...] = ()
    source_namespaces: tuple[str, ...] = ()
    representation_kinds: tuple[str, ...] = ()
    modalities: tuple[str, ...] = ()
    unit_kinds: tuple[str, ...] = ()
    facets_any: tuple[tuple[str, str], ...] = ()
    facets_all: tuple[tuple[str, str], ...] = ()
    facets_none: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name in CATEGORIES:
                object.__setattr__(self, f.name, _texts(value, f.name))
            else:
                object.__setattr__(self, f.name, tuple(dict.fromkeys((str(a), str(b)) for a, b in value)))

    def narrowed(self, override: Override | None) -> Scope | None:
        """The scope of one branch; None where the two exclude each other. Facets stay as they are."""
        if override is None:
            return self
        out = {}
        for name in CATEGORIES:
            mine, theirs = getattr(self, name), getattr(override, name)
            if mine and theirs:
                both = tuple(x for x in mine if x in theirs)
                if not both:
                    return None
                out[name] = both
            else:
                out[name] = mine or theirs
        return replace(self, **out)


@dataclass(frozen=True)
class Override:
    """A branch's own categorical filters."""

    resource_kinds: tuple[str, ...] = ()
    media_types: tuple[str, ...] = ()
    source_namespaces: tuple[str, ...] = ()
    representation_kinds: tuple[str, ...] = ()
    modalities: tuple[str, ...] = ()
    unit_kinds: tuple[str, ...] = ()


# The named scopes of the unified search.
SCOPES: dict[str, Scope] = {
    "all": Scope(modalities=("text",)),
    "notes": Scope(resource_kinds=("document",), modalities=("text",)),
    "audio": Scope(resource_kinds=("audio",), modalities=("text",)),
    "video": Scope(resource_kinds=("video",), representation_kinds=("timed_passage",), modalities=("text",), unit_kinds=("time_segment",)),
    "frames": Scope(resource_kinds=("video",), representation_kinds=("frame_caption",), modalities=("text",), unit_kinds=("frame",)),
    "images": Scope(resource_kinds=("image",), modalities=("text",)),
}


def similarity_scope(name: str) -> Scope:
    """A named scope for similarity: the same resources, by their whole-resource units."""
    if name not in SCOPES:
        raise ValueError(f"scope must be one of {', '.join(SCOPES)}")
    return replace(SCOPES[name], representation_kinds=(), unit_kinds=("whole_resource",))


@dataclass(frozen=True)
class Lexical:
    """One lexical branch."""

    branch_id: str
    query: str
    weight: float = 1.0
    candidate_limit: int = 100
    override: Override | None = None

    def __post_init__(self) -> None:
        if not self.query.strip():
            raise ValueError("query must not be blank")
        _count(self.candidate_limit, "candidate_limit")


@dataclass(frozen=True)
class Vector:
    """One vector branch over one embedding space."""

    branch_id: str
    space_id: str
    vector: tuple[float, ...]
    weight: float = 1.0
    candidate_limit: int = 100
    override: Override | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "vector", tuple(map(float, self.vector)))
        if not self.vector or not all(map(math.isfinite, self.vector)):
            raise ValueError("a query vector needs finite entries")
        _count(self.candidate_limit, "candidate_limit")


@dataclass(frozen=True)
class Request:
    """Branches in order, what to return and how many."""

    branches: tuple[Lexical | Vector, ...]
    scope: Scope = field(default_factory=Scope)
    target: str = "unit"
    limit: int = 10
    rrf_k: int = 60
    evidence_limit: int = 3
    allow_partial: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "branches", tuple(self.branches))
        if not self.branches or len({b.branch_id for b in self.branches}) != len(self.branches):
            raise ValueError("a request needs branches with distinct ids")
        if self.target not in ("unit", "resource"):
            raise ValueError("target is unit or resource")
        for name in ("limit", "rrf_k", "evidence_limit"):
            _count(getattr(self, name), name)


def facet_scalar(value) -> str:
    """Typed text of a facet value: ``s: i: f: b: z:``."""
    from urllib.parse import quote

    if value is None:
        return "z:null"
    if isinstance(value, bool):
        return f"b:{str(value).lower()}"
    if isinstance(value, int):
        return f"i:{value}"
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a facet value must be finite")
        return f"f:{json.dumps(value)}"
    return "s:" + quote(str(value), safe="")


def facet_parse(text: str):
    """The value of a typed facet text; only canonical texts are read."""
    from urllib.parse import unquote

    kind, body = text[:2], text[2:]
    read = {"s:": unquote, "i:": int, "f:": float, "b:": {"true": True, "false": False}.__getitem__, "z:": {"null": None}.__getitem__}
    try:
        value = read[kind](body)
    except (KeyError, ValueError):
        raise ValueError(f"not a facet value: {text!r}") from None
    if facet_scalar(value) != text:
        raise ValueError(f"not a canonical facet value: {text!r}")
    return value


@dataclass(frozen=True)
class MetadataFilter:
    """A facet path and its value."""

    path: str
    value: object


def compile_filters(any_: tuple = (), all_: tuple = (), none: tuple = (), base: Scope | None = None) -> Scope:
    """Metadata filters as facet clauses on top of a scope, in order and without repeats."""
    base = base or Scope()
    clauses = lambda fs: tuple((f.path, facet_scalar(f.value)) for f in fs)
    return replace(base, facets_any=base.facets_any + clauses(any_), facets_all=base.facets_all + clauses(all_), facets_none=base.facets_none + clauses(none))


def filters_from_text(items: list[str], tags: list[str], projected: set[str]) -> tuple[MetadataFilter, ...]:
    """``PATH=JSON_SCALAR`` items, whose paths must be projected facets, and tags."""
    out = []
    for item in items:
        path, eq, value = item.partition("=")
        if not eq or path not in projected:
            raise ValueError(f"not a filter on a projected facet: {item!r}")
        parsed = json.loads(value)
        if isinstance(parsed, dict | list):
            raise ValueError("a filter value must be a JSON scalar")
        out.append(MetadataFilter(path, parsed))
    return (*out, *(MetadataFilter("tags", t) for t in tags))


def timed_scope(scope: Scope) -> Scope | None:
    """A scope restricted to timed passages of audio and video; None where nothing can match."""
    return scope.narrowed(Override(resource_kinds=("audio", "video"), representation_kinds=("timed_passage",), unit_kinds=("time_segment",)))
