"""Queries of the plain chunker, the coverage audit, the graded report, the stored index and counters of passages, with their SQL.

Lines of documents stand in for the blocks of files: sixteen to a section, short ones in every fourth place are headings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel import testdata as D
from tessel.operators import audit, graded, grouping, lexical, packing
from tessel.operators.packing import Sizes
from tessel.queries import _TERMS, UNITS, bm25_sql, query, renamed

_W = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
_LINES = rf"""lines AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS ord, unnest(p) AS txt FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),
 b AS (SELECT doc_id, ord, ord // 16 AS sec, txt, ord % 4 = 0 AND length(txt) <= 40 AS h, CASE WHEN ord % 4 = 0 AND length(txt) <= 40 THEN NULL WHEN ord % 16 = 7 THEN CASE WHEN doc_id % 2 = 0 THEN 'mermaid' ELSE 'code' END
   WHEN ord % 16 = 11 THEN 'table' ELSE 'text' END AS kind FROM lines WHERE regexp_matches(txt, '[^\s\p{{Z}}\x0b\x1c-\x1f\x85]'))"""


def packed_sql(s: Sizes) -> str:
    """Chunks ``done`` of the lines, each fold as a recursive query over places."""
    strip = lambda x: f"regexp_replace(regexp_replace({x}, '^{_W}+', ''), '{_W}+$', '')"
    return rf"""WITH RECURSIVE {_LINES},
 g AS (SELECT *, coalesce(sum(CASE WHEN h THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, sec ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pl FROM b),
 gr AS (SELECT doc_id, sec, pl, string_agg(txt, chr(10) || chr(10) ORDER BY ord) AS t, max(kind) AS kind, min(ord) AS a, max(ord) AS z FROM g GROUP BY doc_id, sec, pl HAVING NOT bool_and(h)),
 big AS (SELECT *, string_split(regexp_replace(t, '([.!?]){_W}+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM gr WHERE kind = 'text' AND length(t) > {s.hard}),
 pt AS (SELECT doc_id, sec, pl, kind, a, z, CASE WHEN len(ss) > 1 THEN ss ELSE list_filter(regexp_split_to_array(t, '{_W}+'), lambda x: x <> '') END AS ps FROM big),
 sp AS (SELECT doc_id, sec, pl, 1::BIGINT AS i, 0 AS no, ps[1] AS now FROM pt
   UNION ALL SELECT sp.doc_id, sp.sec, sp.pl, i + 1, CASE WHEN now <> '' AND length(now) + 1 + length(ps[i + 1]) > {s.target} THEN no + 1 ELSE no END,
     CASE WHEN now = '' OR length(now) + 1 + length(ps[i + 1]) > {s.target} THEN ps[i + 1] ELSE {strip("now || ' ' || ps[i + 1]")} END FROM sp JOIN pt USING (doc_id, sec, pl) WHERE i < len(ps)),
 cut AS (SELECT doc_id, sec, pl, no, {strip("arg_max(now, i)")} AS t FROM sp GROUP BY doc_id, sec, pl, no),
 pieces AS (SELECT doc_id, sec, pl, 0 AS no, t, kind, false AS alone, a, z FROM gr ANTI JOIN big USING (doc_id, sec, pl)
   UNION ALL SELECT doc_id, sec, pl, no, cut.t, kind, true, a, z FROM cut JOIN big USING (doc_id, sec, pl) WHERE cut.t <> ''),
 it AS (SELECT *, length(t) AS n, row_number() OVER (PARTITION BY doc_id, sec ORDER BY pl, no) AS i FROM pieces),
 f1 AS (SELECT doc_id, sec, 0::BIGINT AS i, 0 AS mine, 0 AS draft, 0::BIGINT AS chars FROM it WHERE i = 1
   UNION ALL SELECT doc_id, sec, i, mine, CASE WHEN c >= {s.target} OR alone THEN mine + 1 ELSE mine END, CASE WHEN c >= {s.target} OR alone THEN 0 ELSE c END FROM (
     SELECT doc_id, sec, i, alone, CASE WHEN closes THEN draft + 1 ELSE draft END AS mine, CASE WHEN closes THEN n ELSE grown END AS c FROM (
       SELECT it.*, draft, chars > 0 AND (alone OR chars + 2 + n > {s.hard}) AS closes, CASE WHEN chars > 0 THEN chars + 2 + n ELSE n END AS grown FROM f1 JOIN it ON it.doc_id = f1.doc_id AND it.sec = f1.sec AND it.i = f1.i + 1))),
 dr AS (SELECT doc_id, sec, mine AS i, string_agg(t, chr(10) || chr(10) ORDER BY i) AS t, list(DISTINCT kind) AS ks, min(a) AS a, max(z) AS z FROM f1 JOIN it USING (doc_id, sec, i) GROUP BY doc_id, sec, mine),
 dl AS (SELECT *, length(t) AS n, lead(length(t)) OVER (PARTITION BY doc_id, sec ORDER BY i) AS nx FROM dr),
 f2 AS (SELECT doc_id, sec, -1 AS i, -1 AS chunk, 0::BIGINT AS lst, 0::BIGINT AS bef, false AS skip FROM dl WHERE i = 0
   UNION ALL SELECT doc_id, sec, i, CASE WHEN skip OR back THEN chunk ELSE chunk + 1 END, CASE WHEN skip THEN lst WHEN back THEN lst + 2 + n WHEN ahead THEN n + 2 + nx ELSE n END, CASE WHEN skip OR back THEN bef ELSE lst END, ahead FROM (
     SELECT *, NOT skip AND n < {s.least} AND NOT back AND coalesce(n + 2 + nx <= {s.hard}, false) AS ahead FROM (
       SELECT dl.*, chunk, lst, bef, skip, NOT skip AND n < {s.least} AND chunk >= 0 AND lst + 2 + n <= {s.hard} AS back FROM f2 JOIN dl ON dl.doc_id = f2.doc_id AND dl.sec = f2.sec AND dl.i = f2.i + 1))),
 fin AS (SELECT doc_id, sec, max(chunk) AS top, arg_max(lst, i) AS lst, arg_max(bef, i) AS bef FROM f2 GROUP BY doc_id, sec),
 nm AS (SELECT doc_id, sec, i, CASE WHEN top > 0 AND fin.lst < {s.least} AND fin.bef + 2 + fin.lst <= {s.hard} THEN least(chunk, top - 1) ELSE chunk END AS chunk FROM f2 JOIN fin USING (doc_id, sec) WHERE i >= 0),
 ch AS (SELECT doc_id, sec, chunk, string_agg(t, chr(10) || chr(10) ORDER BY i) AS t, list_distinct(flatten(list(ks))) AS ks, min(a) AS a, max(z) AS z FROM nm JOIN dr USING (doc_id, sec, i) GROUP BY doc_id, sec, chunk),
 ty AS (SELECT *, length(t) AS n, list_filter(ks, lambda k: k <> 'text') AS sp, CASE WHEN len(sp) = 0 THEN 'text' WHEN list_contains(ks, 'text') OR len(sp) > 1 THEN 'mixed' ELSE sp[1] END AS ct FROM ch),
 f3 AS (SELECT doc_id, sec, -1 AS chunk, '' AS t, 'none' AS ct FROM ty WHERE chunk = 0
   UNION ALL SELECT doc_id, sec, chunk, CASE WHEN ct = 'text' AND was = 'text' AND {s.hard} - n > 1 AND {strip("safe")} <> '' THEN {strip("safe || ' ' || t")} ELSE t END, ct FROM (
     SELECT *, CASE WHEN length(ov) + 1 <= {s.hard} - n THEN ov ELSE right(ov, greatest({s.hard} - n - 1, 0)) END AS safe FROM (
       SELECT ty.*, f3.ct AS was, CASE WHEN length(f3.t) <= {s.overlap} THEN f3.t WHEN strpos(right(f3.t, {s.overlap}), ' ') > 0 THEN substr(right(f3.t, {s.overlap}), strpos(right(f3.t, {s.overlap}), ' ') + 1) ELSE right(f3.t, {s.overlap}) END AS ov
       FROM f3 JOIN ty ON ty.doc_id = f3.doc_id AND ty.sec = f3.sec AND ty.chunk = f3.chunk + 1))),
 done AS (SELECT doc_id, sec, row_number() OVER (PARTITION BY doc_id ORDER BY sec, chunk) - 1 AS chunk_index, f3.t AS text, f3.ct AS content_type, a AS start_line, z AS end_line FROM f3 JOIN ty USING (doc_id, sec, chunk))"""


def line_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as blocks."""
    at = F.col("ordinal")
    heading = (at % 4 == 0) & (F.length("text") <= 40)
    kind = F.when(heading, "heading").when(at % 16 == 7, "code").when(at % 16 == 11, "table").otherwise("paragraph")
    return D.paragraphs(spark, sf).select(
        F.col("resource_id").alias("relative_path"), F.floor(at / 16).cast("int").alias("section"), "ordinal", kind.alias("block_type"), F.when(F.col("doc_id") % 2 == 0, "Mermaid").alias("language"),
        F.col("text").alias("plain"), at.alias("start_line"), at.alias("end_line"),
    )


@query("packed_chunks", packed_sql(Sizes()) + " SELECT doc_id::VARCHAR AS relative_path, sec::INT AS section, chunk_index::INT AS chunk_index, text, content_type, start_line::INT AS start_line, end_line::INT AS end_line FROM done")
def packed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(line_blocks(spark, sf))


_AUDIT_BLOCKS = "ab AS (SELECT doc_id, ord, CASE WHEN ord % 4 = 0 AND length(txt) <= 40 THEN 'heading' WHEN ord % 16 = 7 THEN 'code' WHEN ord % 16 = 11 THEN 'table' ELSE 'paragraph' END AS ty, txt FROM lines)"
#: Every 13th chunk is left out and every 9th ends 3 lines later, so that there are orphans and repeats to find.
_AUDIT_CHUNKS = "ac AS (SELECT doc_id, chunk_index, text, start_line AS a, CASE WHEN (doc_id + chunk_index) % 9 = 0 THEN end_line + 3 ELSE end_line END AS z FROM done WHERE (doc_id + chunk_index) % 13 <> 0)"
_TOUCHED = "cov AS (SELECT q.doc_id, q.ord, count(a) AS n_chunks FROM (SELECT doc_id, ord FROM ab WHERE ty <> 'heading' AND trim(txt) <> '') q LEFT JOIN ac ON ac.doc_id = q.doc_id AND ac.a <= q.ord AND ac.z >= q.ord GROUP BY ALL)"


def _audited(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    made = packing.packed(line_blocks(spark, sf))
    nth = F.col("relative_path").cast("long") + F.col("chunk_index")
    return line_blocks(spark, sf), made.filter(nth % 13 != 0).withColumn("end_line", F.when(nth % 9 == 0, F.col("end_line") + 3).otherwise(F.col("end_line")))


@query("block_coverage", packed_sql(Sizes()) + f", {_AUDIT_BLOCKS}, {_AUDIT_CHUNKS}, {_TOUCHED} SELECT doc_id::VARCHAR AS relative_path, ord::INT AS ordinal, n_chunks, CASE WHEN n_chunks = 0 THEN 'orphan' ELSE 'repeated' END AS problem FROM cov WHERE n_chunks <> 1")
def block_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return audit.block_problems(*_audited(spark, sf))


@query("coverage_audit", packed_sql(Sizes()) + rf""", {_AUDIT_BLOCKS}, {_AUDIT_CHUNKS}, {_TOUCHED},
 lg AS (SELECT doc_id, text, coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index), '') AS was FROM ac),
 le AS (SELECT length(text) AS n, greatest(1, (strlen(text) + 3) // 4) AS tk, coalesce(list_max(list_filter(range(1, least(length(text), length(was), 300) + 1), lambda k: right(was, k) = left(text, k))), 0) AS ov FROM lg)
 SELECT (SELECT count(DISTINCT doc_id) FROM ab) AS files_count, (SELECT count(*) FROM ab) AS blocks_count, (SELECT count(*) FROM ab WHERE ty = 'code' AND doc_id % 2 = 1) AS code_count, (SELECT count(*) FROM ab WHERE ty = 'table') AS table_count,
  (SELECT count(*) FROM ab WHERE ty = 'code' AND doc_id % 2 = 0) AS diagram_count, (SELECT sum(len(regexp_extract_all(txt, '(?i)!\[[^\]]*\]\([^)]*\)|!\[\[[^\]]+\]\]|<img\s')))::BIGINT FROM ab) AS image_count,
  (SELECT count(*) - count(DISTINCT (ty, txt)) FROM ab) AS duplicate_block_count, count(*) AS chunks_count, quantile_disc(n, 0.5)::BIGINT AS chunk_length_p50, quantile_disc(n, 0.9)::BIGINT AS chunk_length_p90, quantile_disc(n, 0.99)::BIGINT AS chunk_length_p99,
  quantile_disc(tk, 0.5)::BIGINT AS chunk_tokens_p50, quantile_disc(tk, 0.9)::BIGINT AS chunk_tokens_p90, quantile_disc(tk, 0.99)::BIGINT AS chunk_tokens_p99, round(count(*) FILTER (n < 1200) / count(*), 9) AS small_chunk_ratio,
  round(count(*) FILTER (n > 8000) / count(*), 9) AS oversize_chunk_ratio, round(sum(ov)::DOUBLE / sum(n)::DOUBLE, 9) AS overlap_ratio, (SELECT count(*) FROM cov WHERE n_chunks = 0) AS orphan_block_count, (SELECT count(*) FROM cov WHERE n_chunks > 1) AS repeated_block_count FROM le""")
def coverage_audit(spark: SparkSession, sf: str) -> DataFrame:
    blocks, made = _audited(spark, sf)
    # chunks are read for their sizes and for what they touch: made once, as a table of the warehouse
    table = f"audited_{uuid.uuid4().hex}"
    made.select("relative_path", "chunk_index", "text", "start_line", "end_line").write.saveAsTable(table)
    return audit.report(blocks, spark.table(table))


_CUTS, _MRR, _NDCG = (1, 3, 5), 4, 5
_GRADED = rf"""l AS (SELECT l_orderkey AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS r, 'r' || l_suppkey % 5 AS res, l_suppkey AS s, l_partkey AS p, l_quantity::BIGINT AS n FROM lineitem),
 c AS (SELECT o_orderkey AS q, o_orderpriority AS kind, o_orderstatus AS st, o_custkey % 3 AS cu FROM orders),
 k AS (SELECT q, r, 'u' || r AS unit, res, CASE WHEN p % 4 <> 0 THEN n * 10 END AS a, CASE WHEN p % 4 <> 0 THEN n * 10 + 40 + p % 60 END AS z, CASE WHEN p % 4 = 0 THEN n % 5 END AS ts FROM l SEMI JOIN c USING (q)),
 j AS (SELECT q, r AS number, s % 4 AS grade, CASE WHEN q % 2 = 0 THEN 'u' || r END AS unit, res, CASE WHEN s % 3 = 0 THEN n * 10 + p % 30 END AS a, CASE WHEN s % 3 = 0 THEN n * 10 + 50 END AS z, CASE WHEN s % 3 = 1 AND q % 3 = 0 THEN n % 5 END AS ts FROM l SEMI JOIN c USING (q) WHERE p % 3 <> 0),
 bu AS (SELECT q, bool_or(unit IS NOT NULL) AS bu FROM j GROUP BY q),
 g AS (SELECT q, key, arg_max(grade, number) AS grade FROM (SELECT q, number, grade, CASE WHEN bu THEN unit ELSE res END AS key FROM j JOIN bu USING (q)) WHERE key IS NOT NULL GROUP BY ALL),
 h AS (SELECT k.q, k.r, CASE WHEN bu THEN unit ELSE res END AS key, g.grade FROM k LEFT JOIN bu USING (q) LEFT JOIN g ON g.q = k.q AND g.key = CASE WHEN bu THEN unit ELSE res END),
 ideal AS (SELECT q, count(*) AS n, sum((2.0 ** grade - 1) / log2(i + 1)) FILTER (i <= {_NDCG}) AS best, max(grade) AS top FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY grade DESC) AS i FROM g) GROUP BY q),
 got AS (SELECT q, {", ".join(f"count(DISTINCT key) FILTER (grade IS NOT NULL AND r <= {n}) AS n{n}" for n in _CUTS)}, min(r) FILTER (grade IS NOT NULL) AS f, sum((2.0 ** grade - 1) / log2(r + 1)) FILTER (grade IS NOT NULL AND r <= {_NDCG}) AS dcg, count(*) AS ranked FROM h GROUP BY q),
 pr AS (SELECT j.q, j.number, k.r, k.a AS ka, j.a AS ja, k.ts IS NOT NULL AND j.ts IS NOT NULL AS st, k.ts = j.ts AS eq, greatest(0, least(k.z, j.z) - greatest(k.a, j.a))::DOUBLE / (greatest(k.z, j.z) - least(k.a, j.a)) AS iou, abs(k.a - j.a) AS ea, abs(k.z - j.z) AS ez
   FROM j JOIN k ON k.q = j.q AND k.r <= {max(_CUTS)} WHERE j.a IS NOT NULL OR j.ts IS NOT NULL),
 tm AS (SELECT q, bool_or(st AND eq) AS stamp, arg_max({{'iou': iou, 'ea': ea, 'ez': ez}}, (iou, -r, -number)) FILTER (NOT st AND ka IS NOT NULL AND ja IS NOT NULL AND iou > 0) AS b FROM pr GROUP BY q),
 tj AS (SELECT q, bool_or(a IS NOT NULL OR ts IS NOT NULL) AS t, max(grade) AS top, count(*) <> count(DISTINCT (res, coalesce(unit, ''), coalesce(a, -1), coalesce(z, -1), coalesce(ts, -1))) AS again FROM j GROUP BY q),
 pc AS (SELECT c.q, c.kind, c.st, c.cu, coalesce(ranked, 0) AS ranked_count, coalesce(t, false) AS temporal_applicable, {", ".join(f"coalesce(n{n} / n, 0) AS recall_at_{n}" for n in _CUTS)}, CASE WHEN f <= {_MRR} THEN 1 / f ELSE 0 END AS mrr,
   CASE WHEN best > 0 THEN coalesce(dcg, 0) / best ELSE 0 END AS ndcg, coalesce(stamp, false)::INT AS timestamp_hit_at_k, (b IS NOT NULL)::INT AS interval_hit_at_k, coalesce(b.iou, 0) AS best_iou, coalesce(b.ea, 0) AS start_error_ms, coalesce(b.ez, 0) AS end_error_ms,
   CASE WHEN coalesce(tj.top, 0) <= 0 THEN 'zero-gold case' WHEN again THEN 'duplicate judgment' END AS problem FROM c LEFT JOIN tj USING (q) LEFT JOIN ideal USING (q) LEFT JOIN got USING (q) LEFT JOIN tm USING (q))"""


def _graded_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as cases, their lines by price as results, two thirds of them as judgments."""
    orders, q, n, p, s = D.read(spark, sf, "orders"), F.col("query_id"), F.col("l_quantity").cast("long"), F.col("l_partkey"), F.col("l_suppkey")
    cases = orders.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderpriority").alias("case_kind"), F.array(F.concat(F.lit("status:"), "o_orderstatus"), F.lit("plain"), F.concat(F.lit("customer:of:"), F.col("o_custkey") % 3)).alias("slice_tags"))
    order = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "l_linenumber", "l_partkey", "l_suppkey")
    bought = D.read(spark, sf, "lineitem")
    lines = bought.repartition(graded.tasks(bought), "l_orderkey").select("*", F.col("l_orderkey").alias("query_id"), F.row_number().over(order).alias("rank"), F.concat(F.lit("r"), s % 5).alias("resource_id"))
    unit = F.concat(F.lit("u"), "rank")
    ranked = lines.select("query_id", "rank", unit.alias("unit_id"), "resource_id", F.when(p % 4 != 0, n * 10).alias("start_ms"), F.when(p % 4 != 0, n * 10 + 40 + p % 60).alias("end_ms"), F.when(p % 4 == 0, n % 5).alias("timestamp_ms"))
    judgments = lines.filter(p % 3 != 0).select(
        "query_id", F.col("rank").alias("number"), (s % 4).alias("grade"), F.when(q % 2 == 0, unit).alias("unit_id"), "resource_id", F.when(s % 3 == 0, n * 10 + p % 30).alias("start_ms"), F.when(s % 3 == 0, n * 10 + 50).alias("end_ms"),
        F.when((s % 3 == 1) & (q % 3 == 0), n % 5).alias("timestamp_ms"),
    )
    return cases, judgments, ranked


def _to_nine(rows: DataFrame) -> DataFrame:
    """Measures to 9 digits, as sums in another order differ in the last of 12."""
    return rows.withColumns({m: F.round(F.col(m).cast("double"), 9) for m in graded.measures(_CUTS)})


@query("graded_cases", f"WITH {_GRADED} SELECT q AS query_id, ranked_count, temporal_applicable, {', '.join(f'round(round({m}::DOUBLE, 12), 9) AS {m}' for m in graded.measures(_CUTS))}, problem FROM pc")
def graded_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _to_nine(graded.per_case(*_graded_tables(spark, sf), _CUTS, _MRR, _NDCG)).drop("case_kind", "slice_tags")


_MEANS = ", ".join(f"round(coalesce(avg({m}){' FILTER (temporal_applicable)' if m in graded.TEMPORAL else ''}, 0), 9) AS {m}" for m in graded.measures(_CUTS))


@query("graded_report", f"""WITH {_GRADED}, lb AS MATERIALIZED (SELECT *, unnest([{{'level': 'summary', 'label': ''}}, {{'level': 'case_kind', 'label': kind}}, {{'level': 'slice', 'label': 'status=' || st}}, {{'level': 'slice', 'label': 'customer=of:' || cu}}]) AS x FROM pc WHERE problem IS NULL)
 SELECT x.level AS level, x.label AS label, count(*) AS cases, count(*) FILTER (temporal_applicable) AS temporal_cases, {_MEANS} FROM lb GROUP BY ALL""")
def graded_report(spark: SparkSession, sf: str) -> DataFrame:
    return _to_nine(graded.report(graded.per_case(*_graded_tables(spark, sf), _CUTS, _MRR, _NDCG).filter("problem IS NULL"), _CUTS))


def _stored(spark: SparkSession, sf: str) -> lexical.Index:
    """The index of all paragraphs, built, written to the warehouse and read back."""
    return lexical.write_index(lexical.build_index(D.paragraphs(spark, sf)), f"lexical_{uuid.uuid4().hex}")


@query("stored_index_words", f"WITH {UNITS}, {bm25_sql(_TERMS)} SELECT doc_id, ord, s AS score FROM bm")
def stored_index_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words, from a stored index: counts alone are read, no text and no position."""
    return renamed(lexical.indexed_bm25(_stored(spark, sf), " ".join(_TERMS))).select("doc_id", "ord", F.round("bm25", 9).alias("score"))


@query("stored_index_phrase", f"WITH {UNITS} SELECT doc_id, ord FROM tok WHERE (list_contains(t, 'of') OR list_contains(t, 'que') OR ' ' || array_to_string(t, ' ') LIKE '% of the%') AND NOT len(list_filter(t, lambda x: x LIKE 'sta%')) > 0")
def stored_index_phrase(spark: SparkSession, sf: str) -> DataFrame:
    """A phrase whose last word is a beginning, alternatives and a beginning left out, from a stored index."""
    return renamed(lexical.indexed_bm25(_stored(spark, sf), '((of OR que) OR "of the"*) NOT sta*')).select("doc_id", "ord")


@query("passage_counters", """WITH a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS o, turn * 1000 AS s, turn * 1000 + length(coalesce(text, '')) * 9 AS e FROM conversations),
 ov AS (SELECT *, coalesce(s < max(e) OVER (PARTITION BY conv_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hit FROM a),
 p AS (SELECT conv_id, o // 3 AS n, min(s) AS s, max(e) AS e, min(o) AS f, count(*) AS k FROM (SELECT conv_id, o, s, e FROM a UNION ALL SELECT conv_id, o - 1, s, e FROM a WHERE o % 3 = 0 AND o > 0) GROUP BY conv_id, o // 3),
 q AS (SELECT *, coalesce(s < lag(e) OVER (PARTITION BY conv_id ORDER BY n), false) AS late FROM p),
 x AS (SELECT conv_id, count(*) AS n_passages, sum(k * 100)::BIGINT AS n_tokens, max(k * 100) AS max_tokens, max(e - s) AS max_ms, count(*) FILTER (late) AS n_overlaps, sum(k)::BIGINT AS n_covered, count(*) FILTER (k * 100 > 350 OR e - s > 4000) AS n_hard_exceeded,
   count(*) FILTER (n % 2 = 0) AS n_soft_max, count(*) FILTER (n % 2 = 1) AS n_end_of_input FROM q GROUP BY conv_id)
 SELECT conv_id::VARCHAR AS resource_id, count(*) AS n_atoms, count(*) FILTER (hit) AS n_input_overlaps, any_value(n_passages) AS n_passages, any_value(n_tokens) AS n_tokens, any_value(max_tokens) AS max_tokens, any_value(max_ms) AS max_ms, any_value(n_overlaps) AS n_overlaps,
  any_value(n_covered) AS n_covered, any_value(n_covered) - count(*) AS n_repeated_atoms, any_value(n_hard_exceeded) AS n_hard_exceeded, 0 AS n_hard_limit, any_value(n_soft_max) AS n_soft_max, any_value(n_end_of_input) AS n_end_of_input, 0 AS n_unsplittable FROM ov JOIN x USING (conv_id) GROUP BY conv_id""")
def passage_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Counters of passages of three turns that repeat the first turn of the next."""
    turn = F.col("turn")
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    atoms = D.read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("resource_id"), at.alias("ordinal"), (turn * 1000).alias("start_ms"), (turn * 1000 + F.length(F.coalesce("text", F.lit(""))) * 9).alias("end_ms"))
    again = atoms.filter("ordinal % 3 = 0 AND ordinal > 0").select("*", F.floor((F.col("ordinal") - 1) / 3).alias("n"))
    passages = atoms.select("*", F.floor(F.col("ordinal") / 3).alias("n")).unionByName(again).groupBy("resource_id", "n").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("ordinal").alias("first_atom"), F.max("ordinal").alias("last_atom"), (F.count(F.lit(1)) * 100).alias("token_count"),
    )
    marked = passages.withColumn("ordinal", F.col("n")).withColumn("reason", F.when(F.col("n") % 2 == 0, "soft_max").otherwise("end_of_input"))
    policy = grouping.Policy(soft_min_tokens=100, target_tokens=200, soft_max_tokens=300, hard_max_tokens=350, soft_min_ms=1000, target_ms=2000, soft_max_ms=3000, hard_max_ms=4000)
    return grouping.grouping_metrics(marked, atoms, policy)
