"""Structural chunks of parsed documents, within limits of characters and tokens.

Headings, front matter and rules make no chunk and part what stands around
them. Prose is cut at paragraphs, then sentences, words and characters; code
by top-level definitions or lines; tables by rows under their repeated header.
Pieces are contiguous ranges of a block, so nothing is lost or doubled.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from tessel.sources.markdown import Block, parse

CHUNK = "relative_path string, chunk_index int, content_type string, text string, embedding_text string, heading_path array<string>, start_offset int, end_offset int, start_line int, end_line int, n_blocks int, estimated_tokens int"
#: Ends of prose units, from coarse to fine.
LEVELS = (re.compile(r"\n[ \t]*\n+"), re.compile(r"(?<=[.!?…])\s+"), re.compile(r"(?<=\S)(?=\s)"))
TYPES = {"paragraph": "text", "list": "list", "blockquote": "blockquote", "callout": "callout", "code": "code", "mermaid": "mermaid", "table": "table"}
SILENT = ("frontmatter", "heading", "thematic_break")


@dataclass(frozen=True)
class Config:
    min_chars: int = 1
    target_chars: int = 3200
    hard_chars: int = 8000
    max_tokens: int = 2000
    code_lines: int = 80
    table_rows: int = 40

    def __post_init__(self) -> None:
        if not 1 <= self.min_chars <= self.target_chars <= self.hard_chars or min(self.max_tokens, self.code_lines, self.table_rows) < 1:
            raise ValueError("chunk limits must be positive and in order")


@dataclass
class Piece:
    """A chunk in the making: its blocks, shown text, and the range of the first block's text that it owns."""

    blocks: list[Block]
    text: str
    kind: str
    span: tuple[int, int, int, int]
    joins: bool = False


def tokens_of(text: str) -> int:
    return max(1, (len(text.encode()) + 3) // 4)


class Chunker:
    def __init__(self, config: Config | None = None):
        self.c = config or Config()

    # limits -------------------------------------------------------------

    def prefix(self, b: Block, kind: str) -> str:
        tag = {"text": "", "code": f"[code:{b.language or 'text'}]", "mermaid": "[mermaid diagram]"}.get(kind, f"[{kind}]")
        room = self.c.max_tokens * 4 - 6
        if room <= 0:
            return ""
        whole = "\n".join(x for x in (" > ".join(b.heading_path), tag) if x)
        return whole.encode()[:room].decode("utf-8", "ignore").rstrip()

    def room(self, b: Block, kind: str, target: bool = False) -> tuple[int, int]:
        """Characters and UTF-8 bytes that a chunk of a block may have."""
        head = self.prefix(b, kind)
        left = self.c.max_tokens * 4 - len(head.encode()) - (2 if head else 0)
        return self.c.target_chars if target else self.c.hard_chars, max(1, left)

    @staticmethod
    def fits(text: str, room: tuple[int, int]) -> bool:
        return len(text) <= room[0] and len(text.encode()) <= room[1]

    # cutting --------------------------------------------------------------

    def ranges(self, text: str, room: tuple[int, int], a: int = 0, b: int | None = None, level: int = 0) -> list[tuple[int, int]]:
        """Contiguous ranges of ``text[a:b]`` that fit, cut as coarsely as they can be and packed greedily."""
        b = len(text) if b is None else b
        if self.fits(text[a:b], room):
            return [(a, b)]
        if level == len(LEVELS):
            return list(self.by_characters(text, room, a, b))
        cuts = [a, *(m.end() for m in LEVELS[level].finditer(text, a, b) if a < m.end() < b), b]
        if len(cuts) == 2:
            return self.ranges(text, room, a, b, level + 1)
        out: list[tuple[int, int]] = []
        begin = a
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if self.fits(text[begin:hi], room):
                continue
            if begin < lo:
                out.append((begin, lo))
            begin = lo
            if not self.fits(text[lo:hi], room):
                out += self.ranges(text, room, lo, hi, level + 1)
                begin = hi
        if begin < b:
            out.append((begin, b))
        return out

    @staticmethod
    def by_characters(text: str, room: tuple[int, int], a: int, b: int) -> Iterator[tuple[int, int]]:
        while a < b:
            n = min(b - a, room[0])
            n = len(text[a : a + n].encode()[: room[1]].decode("utf-8", "ignore"))
            if not n:
                raise ValueError("limits too small for one character")
            yield a, a + n
            a += n

    # blocks ---------------------------------------------------------------

    def span(self, b: Block, text: str, lo: int, hi: int) -> tuple[int, int, int, int]:
        """Offsets and lines of a range of a block; the whole block where its text differs from the source."""
        at = b.raw.find(text) if text else -1
        if at < 0:
            return b.start_offset, b.end_offset, b.start_line, b.end_line
        first = b.start_line + b.raw.count("\n", 0, at + lo)
        return b.start_offset + at + lo, b.start_offset + at + hi, first, first + text.count("\n", lo, max(lo, hi - 1))

    def prose(self, b: Block) -> Iterator[Piece]:
        kind = TYPES.get(b.kind, "unknown")
        text = b.plain if b.kind == "paragraph" or "projection_spans" in b.attributes else b.raw
        if not text.strip():
            return
        found = self.ranges(text, self.room(b, kind, b.kind == "paragraph"))
        for lo, hi in found:
            if text[lo:hi].strip():
                yield Piece([b], text[lo:hi], kind, self.span(b, text, lo, hi), len(found) == 1 and b.kind in ("paragraph", "list", "blockquote"))

    def code(self, b: Block) -> Iterator[Piece]:
        kind, text = TYPES[b.kind], b.plain.strip("\n")
        if not text:
            return
        room = self.room(b, kind)
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        cuts = self.definitions(text, starts) if (b.language or "").casefold() in ("py", "python") else None
        for lo, hi in cuts or [(0, len(text))]:
            if cuts and self.fits(text[lo:hi], room):
                lo += len(text[lo:hi]) - len(text[lo:hi].lstrip("\n"))
                yield Piece([b], text[lo:hi].rstrip("\n"), kind, self.span(b, text, lo, hi))
            else:
                yield from self.windows(b, kind, text, [s for s in starts if lo <= s < hi] + [hi], room)

    def windows(self, b: Block, kind: str, text: str, starts: list[int], room: tuple[int, int]) -> Iterator[Piece]:
        """Runs of whole lines; a line that does not fit is cut by characters."""
        begin, n = starts[0], 0
        for lo, hi in zip(starts, starts[1:], strict=False):
            body = text[begin:hi].rstrip("\n")
            if n and (n >= self.c.code_lines or not self.fits(body, room)):
                yield Piece([b], text[begin:lo].rstrip("\n"), kind, self.span(b, text, begin, lo))
                begin, n = lo, 0
            if not self.fits(text[lo:hi].rstrip("\n"), room):
                for x, y in self.by_characters(text, room, lo, hi):
                    yield Piece([b], text[x:y], kind, self.span(b, text, x, y))
                begin, n = hi, 0
            else:
                n += 1
        if begin < starts[-1] and text[begin : starts[-1]].strip("\n"):
            yield Piece([b], text[begin : starts[-1]].rstrip("\n"), kind, self.span(b, text, begin, starts[-1]))

    @staticmethod
    def definitions(text: str, starts: list[int]) -> list[tuple[int, int]] | None:
        """Ranges at top-level functions and classes with their decorators; None where the code does not parse."""
        try:
            body = ast.parse(text).body
        except (SyntaxError, ValueError):
            return None
        heads = [min([x.lineno, *(d.lineno for d in x.decorator_list)]) for x in body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
        ends = [x.end_lineno for x in body if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
        if not heads:
            return None
        cuts = sorted({0, len(text), *(starts[h - 1] for h in heads), *(starts[e] for e in ends if e < len(starts))})
        return [(a, z) for a, z in zip(cuts, cuts[1:], strict=False) if text[a:z].strip()]

    def table(self, b: Block) -> Iterator[Piece]:
        lines, room = b.raw.split("\n"), self.room(b, "table")
        starts = [0]
        for x in lines:
            starts.append(starts[-1] + len(x) + 1)
        end = lambda k: min(starts[k] - 1, len(b.raw))
        head, at = "\n".join(lines[:2]), 2
        if len(lines) <= 2:
            yield Piece([b], b.raw if self.fits(b.raw, room) else self.marker("table", b.raw, room), "table", self.span(b, b.raw, 0, len(b.raw)))
        while at < len(lines):
            to, text = at, head
            while to < len(lines) and to - at < self.c.table_rows and self.fits(f"{text}\n{lines[to]}", room):
                text, to = f"{text}\n{lines[to]}", to + 1
            if to == at:
                text, to = self.marker("table row", lines[at], room), at + 1
                yield Piece([b], text, "table", self.span(b, b.raw, starts[at], end(to)))
            else:
                yield Piece([b], text, "table", self.span(b, b.raw, 0 if at == 2 else starts[at], end(to)))
            at = to

    def marker(self, what: str, source: str, room: tuple[int, int]) -> str:
        """What stands for text that cannot be shown, as long as there is room for."""
        name = hashlib.sha256(source.encode()).hexdigest()
        for text in (f"[{what} omitted; chars={len(source)}; sha256={name}]", f"[{what} omitted; sha256={name}]", f"[{what} omitted]", "~"):
            if self.fits(text, room):
                return text
        raise ValueError(f"no room for a {what} marker")

    # documents ------------------------------------------------------------

    def pieces(self, blocks: list[Block]) -> Iterator[Piece]:
        """Pieces in order, small neighbours of one kind and heading path joined."""
        held: Piece | None = None
        for b in blocks:
            if b.kind in SILENT:
                made: list[Piece | None] = [None]
            elif b.kind in ("code", "mermaid"):
                made = list(self.code(b))
            elif b.kind == "table":
                made = list(self.table(b))
            else:
                made = list(self.prose(b))
            for p in made:
                if p and held and p.joins and (both := self.joined(held, p)):
                    held = both
                    continue
                if held:
                    yield held
                held = p if p and p.joins else None
                if p and not p.joins:
                    yield p
        if held:
            yield held

    def joined(self, a: Piece, b: Piece) -> Piece | None:
        text = f"{a.text}\n\n{b.text}"
        small = min(len(a.text), len(b.text)) < self.c.min_chars
        if not small or a.kind != b.kind or a.blocks[0].heading_path != b.blocks[0].heading_path or not self.fits(text, self.room(a.blocks[0], a.kind, True)):
            return None
        return Piece(a.blocks + b.blocks, text, a.kind, (a.span[0], b.span[1], a.span[2], b.span[3]), True)

    def chunks(self, blocks: list[Block]) -> Iterator[tuple[Piece, str, int]]:
        for p in self.pieces(blocks):
            head = self.prefix(p.blocks[0], p.kind)
            text = f"{head}\n\n{p.text}" if head else p.text
            if len(p.text) > self.c.hard_chars or tokens_of(text) > self.c.max_tokens:
                raise ValueError("a chunk is beyond its hard limits")
            yield p, text, tokens_of(text)


def chunk_files(files: DataFrame, config: Config | None = None) -> DataFrame:
    """Chunks of files (relative_path, content)."""
    chunker = Chunker(config)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch.relative_path, batch.content, strict=True):
                for n, (p, text, tokens) in enumerate(chunker.chunks(parse(content or "").blocks)):
                    out.append((path, n, p.kind, p.text, text, list(p.blocks[0].heading_path), *p.span, len(p.blocks), tokens))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHUNK.split(", ")])

    return files.select("relative_path", "content").mapInPandas(run, CHUNK)
