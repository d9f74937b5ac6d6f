"""Markdown as blocks: a scanner for top-level blocks, front matter and image text.

Covers ATX and setext headings, fenced and indented code, tables, lists,
quotes and callouts, rules, HTML blocks and paragraphs, each with its raw
text, plain text, language, heading path, lines and character offsets. A
document is parsed on one worker; documents spread over ``mapInPandas``.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IGNORED_DIRS = (".git", ".obsidian", ".venv", "node_modules", "__pycache__")
BLOCK = "relative_path string, ordinal int, block_type string, raw string, plain string, language string, level int, heading_path array<string>, start_line int, end_line int, start_offset int, end_offset int, attributes string"


@dataclass
class Block:
    kind: str
    raw: str
    plain: str
    start_line: int
    end_line: int
    start_offset: int
    end_offset: int
    language: str | None = None
    level: int | None = None
    heading_path: tuple[str, ...] = ()
    attributes: dict = field(default_factory=dict)


@dataclass
class Document:
    title: str | None
    metadata: dict
    blocks: list[Block]
    diagnostics: list[str]


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*([^`]*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^ {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_DIVIDER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_CALLOUT = re.compile(r"^ {0,3}>[ \t]*\[!([\w-]+)\][+-]?[ \t]*(.*)$")
_HTML = re.compile(r"^ {0,3}<(?:[A-Za-z][\w-]*[\s/>]|/[A-Za-z]|!--|\?|![A-Z])")
_TASK = re.compile(r"^\s*[-+*][ \t]+\[[ xX]\][ \t]", re.M)
_IMAGE = re.compile(r"!\[([^\]]*)\]\((?:[^()\s]|\([^)]*\))*(?:[ \t]+\"[^\"]*\")?\)|!\[([^\]]*)\]\[[^\]]*\]|!\[\[([^\]|]*)(?:\|([^\]]*))?\]\]|<img\b[^>]*?\balt=(?:\"([^\"]*)\"|'([^']*)')[^>]*>|<img\b[^>]*>")
_SIZE = re.compile(r"^\d+(?:x\d+)?$")


def front_matter(text: str) -> tuple[dict, int, str | None]:
    """Metadata, characters it takes with its fences, and a diagnostic; an open fence is no front matter."""
    if not text.startswith("---\n"):
        return {}, 0, None
    m = re.compile(r"^(?:---|\.\.\.)[ \t]*(?:\n|\Z)", re.M).search(text, 4)
    if not m:
        return {}, 0, None
    import yaml

    class Strict(yaml.SafeLoader):
        pass

    def mapping(loader, node):
        keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
        if len(keys) != len({json.dumps(k, default=str) for k in keys}):
            raise yaml.YAMLError("repeated key")
        return yaml.SafeLoader.construct_mapping(loader, node, deep=True)

    Strict.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    try:
        value = yaml.load(text[4 : m.start()], Strict) or {}
        if not isinstance(value, dict):
            raise yaml.YAMLError("not a mapping")
        return value, m.end(), None
    except (yaml.YAMLError, ValueError):
        return {}, m.end(), "METADATA_PARSE_FAILED"


def flat_front_matter(text: str) -> dict[str, str]:
    """The plain variant: ``key: value`` lines as strings."""
    out = {}
    if text.startswith("---\n") and (end := text.find("\n---", 3)) >= 0:
        for line in text[4:end].split("\n"):
            key, colon, value = line.partition(":")
            if colon and not line.lstrip().startswith("#"):
                out[key.strip()] = value.strip().strip("\"'")
    return out


def image_text(raw: str) -> tuple[str, list[tuple[int, ...]]]:
    """Text with images replaced by their alternative text, and spans (text start, end, raw start, end, kind, 0).

    Paths go; an alias that is only a size goes too; code spans stay.
    """
    out, spans, at, n = [], [], 0, 0
    codes = [m.span() for m in re.finditer(r"(`+)(?!`).*?(?<!`)\1(?!`)", raw, re.S)]
    for m in _IMAGE.finditer(raw):
        if any(a <= m.start() < b for a, b in codes):
            continue
        inline, reference, embed, alias, alt, alt2 = m.groups()
        if embed is not None:
            text = "" if alias is None or _SIZE.match(alias.strip()) else alias.strip()
        else:
            text = html.unescape(next((t for t in (inline, reference, alt, alt2) if t is not None), "")).strip()
        keep = raw[at : m.start()]
        out.append(keep)
        n += len(keep)
        spans.append((n, n + len(text), m.start(), m.end(), 1, 0))
        out.append(text)
        n += len(text)
        at = m.end()
    return "".join([*out, raw[at:]]), spans


def plain_inline(text: str) -> str:
    """Inline mark-up without its signs."""
    text = re.sub(r"\[\[([^\]|]*)\|([^\]]*)\]\]", r"\2", text)
    text = re.sub(r"\[\[([^\]]*)\]\]", r"\1", text)
    text = re.sub(r"(?<!!)\[([^\]]*)\]\((?:[^()]|\([^)]*\))*\)", r"\1", text)
    text = re.sub(r"(`+)(.+?)\1", r"\2", text)
    return re.sub(r"(\*\*|__|\*|(?<!\w)_|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", text)


class Scanner:
    """Cuts lines into top-level blocks."""

    def __init__(self, text: str, line: int, offset: int):
        self.lines = text.split("\n")
        if self.lines and self.lines[-1] == "":
            self.lines.pop()
        self.starts, at = [], offset
        for x in self.lines:
            self.starts.append(at)
            at += len(x) + 1
        self.first, self.at = line, 0
        self.path: list[tuple[int, str]] = []

    def opens(self, i: int) -> bool:
        """Whether line ``i`` begins something that ends a paragraph."""
        x = self.lines[i]
        return not x.strip() or bool(_FENCE.match(x) or _ATX.match(x) or _RULE.match(x) or x.lstrip().startswith(">") or _HTML.match(x) or re.match(r"^ {0,3}(?:[-+*]|1[.)])[ \t]+\S", x))

    def block(self, kind: str, a: int, b: int, plain: str, **more) -> Block:
        raw = "\n".join(self.lines[a:b])
        path = tuple(t for _, t in self.path)
        return Block(kind, raw, plain, self.first + a, self.first + b - 1, self.starts[a], self.starts[b - 1] + len(self.lines[b - 1]), heading_path=path, **more)

    def prose(self, kind: str, a: int, b: int, text: str, **attributes) -> Block:
        shown, spans = image_text(text)
        if spans:
            attributes["projection_spans"] = spans
        return self.block(kind, a, b, plain_inline(shown), attributes=attributes)

    def heading(self, a: int, b: int, level: int, text: str) -> Block:
        title = plain_inline(image_text(text.strip())[0])
        while self.path and self.path[-1][0] >= level:
            self.path.pop()
        self.path.append((level, title))
        return self.block("heading", a, b, title, level=level)

    def blocks(self) -> Iterator[Block]:
        n = len(self.lines)
        while self.at < n:
            i, x = self.at, self.lines[self.at]
            if not x.strip():
                self.at += 1
                continue
            if m := _FENCE.match(x):
                j = i + 1
                while j < n and not re.match(rf"^ {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$", self.lines[j]):
                    j += 1
                self.at = min(j + 1, n)
                language = (m[2].split() or [None])[0]
                kind = "mermaid" if (language or "").casefold() == "mermaid" else "code"
                yield self.block(kind, i, self.at, "\n".join(self.lines[i + 1 : j]), language=language)
            elif m := _ATX.match(x):
                self.at += 1
                yield self.heading(i, i + 1, len(m[1]), m[2] or "")
            elif _RULE.match(x):
                self.at += 1
                yield self.block("thematic_break", i, i + 1, "")
            elif x.lstrip(" ").startswith(">") and not x.startswith("    "):
                j = i
                while j < n and self.lines[j].strip() and (self.lines[j].lstrip().startswith(">") or not self.opens(j)):
                    j += 1
                self.at = j
                inner = "\n".join(re.sub(r"^ {0,3}> ?", "", y) for y in self.lines[i:j])
                if c := _CALLOUT.match(x):
                    yield self.prose("callout", i, j, inner.partition("]")[2].lstrip("+- "), callout=c[1].lower())
                else:
                    yield self.prose("blockquote", i, j, inner)
            elif _ITEM.match(x):
                j = i + 1
                while j < n:
                    y = self.lines[j]
                    if not y.strip():
                        k = j
                        while k < n and not self.lines[k].strip():
                            k += 1
                        if k < n and (_ITEM.match(self.lines[k]) or self.lines[k].startswith(("  ", "\t"))):
                            j = k
                            continue
                        break
                    if not (_ITEM.match(y) or y.startswith(("  ", "\t"))) and self.opens(j):
                        break
                    j += 1
                self.at = j
                raw = "\n".join(self.lines[i:j])
                yield self.prose("list", i, j, raw, ordered=bool(re.match(r"^ {0,3}\d", x)), task_list=bool(_TASK.search(raw)))
            elif x.startswith(("    ", "\t")):
                j = i
                while j < n and (not self.lines[j].strip() or self.lines[j].startswith(("    ", "\t"))):
                    j += 1
                while not self.lines[j - 1].strip():
                    j -= 1
                self.at = j
                yield self.block("code", i, j, "\n".join(re.sub(r"^(?: {4}|\t)", "", y) for y in self.lines[i:j]))
            elif "|" in x and i + 1 < n and _DIVIDER.match(self.lines[i + 1]) and "-" in self.lines[i + 1]:
                j = i + 2
                while j < n and self.lines[j].strip() and not self.opens(j):
                    j += 1
                self.at = j
                yield self.block("table", i, j, "\n".join(plain_inline(y) for y in self.lines[i:j]))
            elif _HTML.match(x):
                j = i
                while j < n and self.lines[j].strip():
                    j += 1
                self.at = j
                raw = "\n".join(self.lines[i:j])
                shown, spans = image_text(raw)
                yield self.block("unknown", i, j, re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", shown))).strip() if spans else raw, attributes={"html": True} | ({"projection_spans": spans} if spans else {}))
            else:
                j = i + 1
                while j < n and not self.opens(j) and not re.match(r"^ {0,3}(?:=+|-+)[ \t]*$", self.lines[j]):
                    j += 1
                if j < n and (m := re.match(r"^ {0,3}(=+|-+)[ \t]*$", self.lines[j])):
                    self.at = j + 1
                    yield self.heading(i, j + 1, 1 if m[1][0] == "=" else 2, " ".join(y.strip() for y in self.lines[i:j]))
                    continue
                self.at = j
                yield self.prose("paragraph", i, j, "\n".join(y.strip() for y in self.lines[i:j]))


def parse(text: str) -> Document:
    """Blocks of one document; its title is the front matter's or the first top heading."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    metadata, size, problem = front_matter(text)
    head = text[:size]
    blocks = [Block("frontmatter", head.rstrip("\n"), "", 1, head.rstrip("\n").count("\n") + 1, 0, len(head.rstrip("\n")))] if size else []
    blocks += Scanner(text[size:], head.count("\n") + 1, size).blocks()
    title = metadata.get("title") if isinstance(metadata.get("title"), str) and metadata["title"].strip() else next((b.plain for b in blocks if b.kind == "heading" and b.level == 1), None)
    return Document(title, metadata, blocks, [problem] if problem else [])


def parse_files(files: DataFrame) -> DataFrame:
    """Blocks of files (relative_path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOCK.split(", ")]
        for batch in batches:
            out = []
            for path, content in zip(batch.relative_path, batch.content, strict=True):
                for n, b in enumerate(parse(content or "").blocks):
                    out.append((path, n, b.kind, b.raw, b.plain, b.language, b.level, list(b.heading_path), b.start_line, b.end_line, b.start_offset, b.end_offset, json.dumps(b.attributes, sort_keys=True)))
            yield pd.DataFrame(out, columns=names).astype({"level": "Int32"})

    return files.select("relative_path", "content").mapInPandas(run, BLOCK)


def titles(files: DataFrame) -> DataFrame:
    """relative_path, title, metadata_json, diagnostics of files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs = [parse(c or "") for c in batch.content]
            plain = lambda v: v.isoformat() if isinstance(v, date | datetime) else str(v)
            yield pd.DataFrame({"relative_path": batch.relative_path, "title": [d.title for d in docs], "metadata_json": [json.dumps(d.metadata, sort_keys=True, default=plain, ensure_ascii=False) for d in docs], "diagnostics": [d.diagnostics for d in docs]})

    return files.select("relative_path", "content").mapInPandas(run, "relative_path string, title string, metadata_json string, diagnostics array<string>")


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``**`` crosses folders, ``*`` and ``?`` do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = ("**/*.md",), exclude: tuple[str, ...] = ()) -> DataFrame:
    """relative_path, content, source_hash of the files under ``root``; exclusion comes first, an unreadable file fails the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", False).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.regexp_replace("path", f"^(?:[\\w+.-]+:)?/*{re.escape(base)}/", "")
    rows = files.select(path.alias("relative_path"), F.col("content").cast("string").alias("content"))
    rows = rows.filter(~F.col("relative_path").rlike("(?:^|/)(?:" + "|".join(map(re.escape, IGNORED_DIRS)) + ")/"))
    for p in exclude:
        rows = rows.filter(~F.col("relative_path").rlike(glob_regex(p)))
    rows = rows.filter(F.array_max(F.array(*(F.col("relative_path").rlike(glob_regex(p)) for p in include))))
    from tessel.functions.text import file_hash

    return rows.withColumn("source_hash", file_hash(F.col("content")))
