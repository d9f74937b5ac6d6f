"""Lexical search: a full-text query grammar compiled to columns, and BM25.

Corpus statistics (documents, average length, documents with each phrase) are
taken over the whole index whatever the scope. The ad-hoc path reads units
once for the statistics and once for the scores and shuffles no text; with a
built index, units that hold none of the words are pruned by a semi-join on
the postings, bucketed by term, before texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import text as T

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Postings that leave a worker at once.
POSTINGS = 1 << 18


# --- query grammar -----------------------------------------------------------


class QuerySyntaxError(ValueError):
    """The query is not a full-text expression."""


@dataclass(frozen=True)
class Phrase:
    """Consecutive tokens; ``prefix``: the last one may go on; ``first``: at the start of the column."""

    tokens: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    within: int = 10


@dataclass(frozen=True)
class Bool:
    op: str
    left: object
    right: object


_LEX = re.compile(r'\s*(?:(?P<string>"(?:[^"]|"")*")|(?P<word>[\w]+)|(?P<sign>[()*+^:,{}\-]))', re.UNICODE)


def _lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _LEX.match(query, at)
        if not m:
            raise QuerySyntaxError(f"unexpected {query[at:].strip()[:1]!r}")
        kind = m.lastgroup
        value = m[kind]
        out.append((kind, value[1:-1].replace('""', '"') if kind == "string" else value))
        at = m.end()
    return out


class Parser:
    """expr: and-chains joined by OR; NOT binds before AND; juxtaposition is AND."""

    def __init__(self, query: str, columns: tuple[str, ...] = ("text",)):
        self.items, self.at, self.columns = _lex(query), 0, columns

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.items[self.at + k] if self.at + k < len(self.items) else ("end", "")

    def take(self, kind: str, value: str | None = None) -> bool:
        if self.peek()[0] == kind and value in (None, self.peek()[1]):
            self.at += 1
            return True
        return False

    def parse(self):
        out = self.either()
        if self.peek()[0] != "end":
            raise QuerySyntaxError(f"unexpected {self.peek()[1]!r}")
        return out

    def either(self):
        out = self.both()
        while self.take("word", "OR"):
            out = Bool("or", out, self.both())
        return out

    def both(self):
        out = self.without()
        while self.peek()[0] not in ("end",) and self.peek() not in (("sign", ")"), ("word", "OR")):
            self.take("word", "AND")
            out = Bool("and", out, self.without())
        return out

    def without(self):
        out = self.atom()
        while self.take("word", "NOT"):
            out = Bool("not", out, self.atom())
        return out

    def atom(self):
        if self.take("sign", "("):
            out = self.either()
            if not self.take("sign", ")"):
                raise QuerySyntaxError("a parenthesis is open")
            return out
        column = None
        if self.peek()[0] in ("word", "string") and self.peek(1) == ("sign", ":"):
            column = self.peek()[1]
            if column not in self.columns:
                raise QuerySyntaxError(f"no such column: {column}")
            self.at += 2
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("sign", "("):
            self.at += 2
            phrases, within = [], 10
            while not self.take("sign", ")"):
                if self.take("sign", ","):
                    kind, value = self.peek()
                    if kind != "word" or not value.isdigit():
                        raise QuerySyntaxError("NEAR needs a number")
                    within, self.at = int(value), self.at + 1
                else:
                    phrases.append(self.phrase(column))
            return Near(tuple(phrases), within)
        return self.phrase(column)

    def phrase(self, column: str | None) -> Phrase:
        first, parts, prefix = self.take("sign", "^"), [], False
        while True:
            kind, value = self.peek()
            if kind not in ("word", "string") or value in ("AND", "OR", "NOT") and kind == "word":
                raise QuerySyntaxError(f"unexpected {value!r}" if value else "the query ends early")
            self.at += 1
            parts += T.tokens_of(value)
            prefix = self.take("sign", "*")
            if not self.take("sign", "+"):
                break
        return Phrase(tuple(parts), prefix, first, column)


def _meant_as_expression(query: str) -> bool:
    """Whether a text that does not parse has signs or words of the grammar, in any case of letters."""
    words = {w.upper() for w in re.findall(r"\w+", query)}
    return bool(set('"()*') & set(query) or words & {"AND", "OR", "NOT", "NEAR"} or any(w and (w[-1].isalnum() or w[-1] == "_") for w in query.split(":")[:-1]))


def parse_query(query: str, columns: tuple[str, ...] = ("text",)):
    """The expression of a query; plain text that is no expression becomes one phrase."""
    try:
        return Parser(query, columns).parse()
    except QuerySyntaxError:
        if _meant_as_expression(query):
            raise
        return Phrase(tuple(T.tokens_of(query)))


def phrases_of(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    if isinstance(node, Near):
        return list(node.phrases)
    return phrases_of(node.left) + phrases_of(node.right)


# --- columns of an expression ------------------------------------------------


def starts_of(tokens: Column, p: Phrase) -> Column:
    """Positions at which a phrase begins."""
    n = len(p.tokens)
    if not n:
        return F.array().cast("array<int>")

    def hit(i: Column) -> Column:
        cond = F.lit(True)
        for k, t in enumerate(p.tokens):
            here = F.get(tokens, i + k)
            cond = cond & (here.startswith(t) if p.prefix and k == n - 1 else here == t)
        return F.coalesce(cond, F.lit(False))

    if p.first:
        return F.when(hit(F.lit(0)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, hit)


def spaced(tokens: Column) -> Column:
    """Tokens as one text, each between spaces of its own."""
    return F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))


def count_of(columns: dict[str, Column], p: Phrase) -> Column:
    """How often a phrase occurs in the columns it may stand in; occurrences may overlap.

    Tokens are letters and digits, so they need no escapes, and one pass of a
    pattern over the spaced text counts without a lambda: filters that the
    optimizer moves below the tokens still read them once.
    """
    if not p.tokens:
        return F.lit(0)
    body = " " + "  ".join(p.tokens) + ("" if p.prefix else " ")
    pattern = ("^" if p.first else "") + f"(?={body})"
    return sum((F.regexp_count(spaced(columns[n]), F.lit(pattern)) for n in ([p.column] if p.column else columns)), F.lit(0))


def near(tokens: Column, node: Near) -> Column:
    """Whether all phrases occur with at most ``within`` tokens between the first's end and the last's start."""
    lists = [starts_of(tokens, p) for p in node.phrases]
    spans = [len(p.tokens) for p in node.phrases]

    def holds(k: int, low: Column, high: Column, total: int) -> Column:
        if k == len(lists):
            return high - low - total <= node.within
        return F.exists(lists[k], lambda i: holds(k + 1, F.least(low, i), F.greatest(high, i + spans[k]), total + spans[k]))

    return F.exists(lists[0], lambda i: holds(1, i, i + spans[0], spans[0]))


def matches(columns: dict[str, Column], node) -> Column:
    if isinstance(node, Phrase):
        return count_of(columns, node) > 0
    if isinstance(node, Near):
        out = F.lit(False)
        for name, tokens in columns.items():
            every = F.lit(True)
            for p in node.phrases:
                every = every & (count_of({name: tokens}, p) > 0)
            out = out | (every & near(tokens, node))
        return out
    left, right = matches(columns, node.left), matches(columns, node.right)
    return {"and": left & right, "or": left | right, "not": left & ~right}[node.op]


# --- scores ------------------------------------------------------------------


def idf(total: Column, having: Column) -> Column:
    raw = F.ln((total - having + 0.5) / (having + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def weight(tf: Column, length: Column, average: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


@dataclass
class Index:
    """Terms of units: postings by term, one row of statistics, and the length of each unit with text."""

    postings: DataFrame
    stats: DataFrame
    lengths: DataFrame | None = None


def postings_of(units: DataFrame) -> DataFrame:
    """term, unit_id, tf, positions of units with text; a unit is one row, so its terms are counted where it is read, without a shuffle."""
    rows = units.filter(F.trim("text") != "").select("unit_id", T.tokens(F.col("text")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            coded = batch.column(1).flatten().dictionary_encode()
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            key = row * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
            order = np.argsort(key, kind="stable")  # positions of a unit's term rise
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            ends = np.concatenate([first, [len(key)]])
            for lo in range(0, len(first), POSTINGS):
                own = first[lo : lo + POSTINGS]
                bounds = ends[lo : lo + len(own) + 1]
                places = pa.array(at[order[bounds[0] : bounds[-1]]], pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), places)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(coded.indices.take(pa.array(order[own]))), batch.column(0).take(pa.array(row[order[own]])), pa.array(np.diff(bounds), pa.int32()), lists], ["term", "unit_id", "tf", "positions"])

    return rows.mapInArrow(run, f"term string, unit_id {rows.schema['unit_id'].dataType.simpleString()}, tf int, positions array<int>")


def lengths_of(units: DataFrame) -> DataFrame:
    """unit_id, dl of units with text."""
    return units.filter(F.trim("text") != "").select("unit_id", F.size(T.tokens(F.col("text"))).alias("dl"))


def index_of(postings: DataFrame, lengths: DataFrame) -> Index:
    return Index(postings, lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len")), lengths)


def build_index(units: DataFrame) -> Index:
    """postings (term, unit_id, tf, positions), stats (n_docs, total_len) and lengths (unit_id, dl) of units with text."""
    return index_of(postings_of(units), lengths_of(units))


def _has_near(node) -> bool:
    return isinstance(node, Near) or (isinstance(node, Bool) and (_has_near(node.left) or _has_near(node.right)))


def answers(index: Index | None, query: str) -> bool:
    """Whether postings alone can answer: every query but those with NEAR or with a phrase of no token."""
    node = parse_query(query)
    return index is not None and index.lengths is not None and not _has_near(node) and all(p.tokens for p in phrases_of(node))


def indexed_bm25(index: Index, query: str) -> DataFrame:
    """unit_id, bm25 of the units that match, from postings of the query's terms and units' lengths; no text is read.

    Terms reach the postings' scan as filters, prefixes as ranges. Words are
    counted by ``tf`` alone; only where there is a phrase of several words, or
    one at a text's start, are positions read, and a phrase is counted where
    they follow each other.
    """
    node = parse_query(query)
    phrases = phrases_of(node)
    slots, wanted = {}, F.lit(False)
    for p in phrases:
        for k, t in enumerate(p.tokens):
            prefix = p.prefix and k == len(p.tokens) - 1
            slots[t, prefix] = F.col("term").startswith(t) if prefix else F.col("term") == t
    for cond in slots.values():
        wanted = wanted | cond
    names = {key: f"_at{i}" for i, key in enumerate(slots)}
    none = F.array().cast("array<int>")
    asked = index.postings.filter(wanted)
    if all(len(p.tokens) == 1 and not p.first for p in phrases):
        counts = asked.groupBy("unit_id").agg(*(F.coalesce(F.sum(F.when(cond, F.col("tf"))), F.lit(0)).alias(names[key]) for key, cond in slots.items()))
        return _scored(index, node, phrases, counts.select("unit_id", *(F.col(names[p.tokens[0], p.prefix]).alias(f"_tf{i}") for i, p in enumerate(phrases))))
    held = asked.groupBy("unit_id").agg(*(F.flatten(F.collect_list(F.when(cond, F.col("positions")))).alias(names[key]) for key, cond in slots.items()))

    def earlier(at: Column, k: int) -> Column:
        return F.transform(F.coalesce(at, none), lambda x: x - k)

    def count(p: Phrase) -> Column:
        at = none
        for k, t in enumerate(p.tokens):
            here = earlier(F.col(names[t, p.prefix and k == len(p.tokens) - 1]), k)
            at = here if k == 0 else F.array_intersect(at, here)
        return F.size(F.filter(at, lambda x: x == 0) if p.first else at)

    return _scored(index, node, phrases, held.select("unit_id", *(count(p).alias(f"_tf{i}") for i, p in enumerate(phrases))))


def _scored(index: Index, node, phrases: list[Phrase], counted: DataFrame) -> DataFrame:
    """unit_id, bm25 of the units that match, from how often each phrase occurs in them (``_tf0``, ...)."""
    having = counted.agg(*(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(phrases))))
    stats = index.stats.select(F.col("n_docs").alias("_n"), (F.col("total_len") / F.col("n_docs")).alias("_avg"))
    number = iter(range(len(phrases)))

    def fits(node) -> Column:
        if isinstance(node, Phrase):
            return F.col(f"_tf{next(number)}") > 0
        left = fits(node.left)
        right = fits(node.right)
        return {"and": left & right, "or": left | right, "not": left & ~right}[node.op]

    score = F.lit(0.0)
    # both sides are one row
    scored = counted.filter(fits(node)).join(index.lengths, "unit_id").join(F.broadcast(stats)).join(F.broadcast(having))
    for i in range(len(phrases)):
        score = score + idf(F.col("_n"), F.col(f"_df{i}")) * weight(F.col(f"_tf{i}"), F.col("dl"), F.col("_avg"))
    return scored.select("unit_id", score.alias("bm25"))


def write_index(index: Index, table: str, ranges: int | None = None) -> Index:
    """The index in tables ``<table>_postings``, ``<table>_stats`` and ``<table>_lengths`` of the warehouse.

    Postings lie in ranges of term and unit, sorted, so that a query's terms reach few row groups and a frequent term is no one task's.
    The number of ranges is the session's of shuffle partitions unless given.
    """
    spark = index.postings.sparkSession
    keys = ("term", "unit_id")
    # written once as they come: ranges are chosen by a first pass, which is to read keys and no text
    index.postings.write.mode("overwrite").saveAsTable(f"{table}_unsorted")
    made = spark.table(f"{table}_unsorted")
    held = made.repartitionByRange(ranges, *keys) if ranges else made.repartitionByRange(*keys)
    held.sortWithinPartitions(*keys).write.mode("overwrite").saveAsTable(f"{table}_postings")
    spark.sql(f"DROP TABLE {table}_unsorted")
    if index.lengths is None:
        index.stats.write.mode("overwrite").saveAsTable(f"{table}_stats")
        return Index(spark.table(f"{table}_postings"), spark.table(f"{table}_stats"))
    index.lengths.write.mode("overwrite").saveAsTable(f"{table}_lengths")
    # of the lengths as they are written, so that no text is read for them again
    index_of(index.postings, spark.table(f"{table}_lengths")).stats.write.mode("overwrite").saveAsTable(f"{table}_stats")
    return Index(spark.table(f"{table}_postings"), spark.table(f"{table}_stats"), spark.table(f"{table}_lengths"))


def bm25(units: DataFrame, query: str, columns: tuple[str, ...] = ("text",), index: Index | None = None) -> DataFrame:
    """All columns of the units that match, and ``bm25`` (higher is better)."""
    node = parse_query(query, columns)
    phrases = phrases_of(node)
    held = units.filter(F.trim("text") != "")
    toks = {c: f"_tokens_{c}" for c in columns}
    marked = held.withColumns({toks[c]: T.tokens(F.col(c)) for c in columns})
    cols = {c: F.col(toks[c]) for c in columns}
    length = sum((F.size(c) for c in cols.values()), F.lit(0))
    counted = marked.withColumns({"_length": length, **{f"_tf{i}": count_of(cols, p) for i, p in enumerate(phrases)}})
    stats = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_length").alias("_avg"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(phrases))))
    score = F.lit(0.0)
    for i in range(len(phrases)):
        score = score + idf(F.col("_n"), F.col(f"_df{i}")) * weight(F.col(f"_tf{i}"), F.col("_length"), F.col("_avg"))
    found = counted.filter(matches(cols, node))
    if index is not None and not any(p.prefix for p in phrases) and not _negative(node):
        terms = sorted({t for p in phrases for t in p.tokens})
        found = found.join(index.postings.filter(F.col("term").isin(*terms)).select("unit_id").distinct(), "unit_id", "left_semi")
    # the statistics are one row
    return found.join(F.broadcast(stats)).withColumn("bm25", score).select(*units.columns, "bm25")


def _negative(node) -> bool:
    return isinstance(node, Bool) and (node.op == "not" or _negative(node.left) or _negative(node.right))


def search_lexical(units: DataFrame, scoped: DataFrame, query: str, limit: int, by_unit: bool = False, index: Index | None = None) -> DataFrame:
    """unit_id, resource_id, score, rank of the best units of ``scoped``; statistics are those of ``units``.

    Ties go by insertion order (``fts_seq``), or by unit id with ``by_unit``.
    """
    if answers(index, query):
        inside = indexed_bm25(index, query).join(scoped.select("unit_id", "resource_id", "fts_seq"), "unit_id")
    else:
        ranked = bm25(units.select("unit_id", "text", "fts_seq"), query, index=index)
        inside = ranked.join(scoped.select("unit_id", "resource_id"), "unit_id")
    return top(inside.withColumn("score", F.round("bm25", 9)), ["unit_id"] if by_unit else ["fts_seq", "unit_id"], limit)


def top(rows: DataFrame, ties: list[str], limit: int) -> DataFrame:
    """The best rows by score and tie columns, ranked from 1; at most ``limit`` rows are ranked in one task."""
    order = [F.col("score").desc(), *map(F.col, ties)]
    best = rows.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("unit_id", "resource_id", "score", "rank")


def postings_bm25(index: Index, lengths: DataFrame, terms: list[str]) -> DataFrame:
    """unit_id, score of the units that hold every term, from the postings alone; ``lengths`` has unit_id, dl."""
    hit = index.postings.filter(F.col("term").isin(*terms))
    df = hit.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = index.stats.select("n_docs", (F.col("total_len") / F.col("n_docs")).alias("avgdl"))
    scored = hit.join(F.broadcast(df), "term").join(lengths, "unit_id").join(F.broadcast(stats))
    part = idf(F.col("n_docs"), F.col("df")) * weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    return scored.groupBy("unit_id").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(set(terms))).drop("n")


def snippet(text: Column, terms: list[str], size: int = 64) -> Column:
    """Up to ``size`` words from the first hit on, hits in ``<b>``."""
    found = F.array_remove(F.split(text, r"\s+"), "")
    is_hit = lambda w: F.exists(T.tokens(w), lambda t: t.isin(*terms))
    first = F.greatest(F.array_position(F.transform(found, is_hit), F.lit(True)), F.lit(1))
    part = F.slice(found, first.cast("int"), size)
    body = F.array_join(F.transform(part, lambda w: F.when(is_hit(w), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w)), " ")
    return F.concat(F.when(first > 1, F.lit("...")).otherwise(F.lit("")), body, F.when(F.size(found) - first + 1 > size, F.lit("...")).otherwise(F.lit("")))


def text_page(units: DataFrame, query: str, limit: int, offset: int = 0) -> DataFrame:
    """Ranks ``offset + 1`` to ``offset + limit`` over text and heading path, raw (negative) scores, snippets."""
    rows = bm25(units, query, ("text", "heading_path"))
    ranked = rows.withColumn("score", F.round(-F.col("bm25"), 9)).orderBy("score", "fts_seq").limit(offset + limit)
    page = ranked.withColumn("rank", F.row_number().over(Window.orderBy("score", "fts_seq"))).filter(F.col("rank") > offset)
    terms = sorted({t for p in phrases_of(parse_query(query, ("text", "heading_path"))) for t in p.tokens})
    return page.withColumn("snippet", snippet(F.col("text"), terms)).withColumn("total_count", F.count(F.lit(1)).over(Window.partitionBy()))


def substring_rank(units: DataFrame, query: str, distinct_terms: bool = False) -> DataFrame:
    """unit_id, score: how often the query's words occur in a text as substrings; none are dropped rows."""
    terms = re.findall(r"\w+", query.lower())
    terms = list(dict.fromkeys(terms)) if distinct_terms else terms
    low = F.lower("text")
    score = sum(((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t) for t in terms), F.lit(0.0))
    return units.withColumn("score", F.round(score).cast("long")).filter("score > 0")
