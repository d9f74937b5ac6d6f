"""Queries of the retrieval operators over the synthetic tables, and their SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel import testdata as D
from tessel.functions import intervals
from tessel.functions import text as T
from tessel.functions import vectors as V
from tessel.operators import evaluation, facets, fusion, incremental, lexical, search, timed, vector
from tessel.operators.scope import apply_scope
from tessel.plans.requests import Scope

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Shared by the SQL texts: paragraphs, tokens and BM25 over them, as in ``testdata`` and ``lexical``.
UNITS = r"""
units AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS ord, unnest(p) AS txt, lang, source FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS p FROM documents)),
tok AS (SELECT doc_id, ord, list_filter(regexp_split_to_array(translate(lower(txt), '{marked}', '{plain}'), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '') AS t FROM units WHERE trim(txt) <> ''),
cs AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM tok)
""".format(marked=T._MARKED, plain=T._PLAIN)


def bm25_sql(terms: list[str], name: str = "bm") -> str:
    """CTE ``name`` (doc_id, ord, s): BM25 of paragraphs that hold every term."""
    tf = {t: f"len(list_filter(t, lambda x: x = '{t}'))" for t in terms}
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END"
    cols = ", ".join(f"{e} AS f{i}" for i, e in enumerate(tf.values()))
    dfs = ", ".join(f"(count(*) FILTER (f{i} > 0))::DOUBLE AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    return f"{name}_f AS (SELECT doc_id, ord, len(t)::DOUBLE AS dl, {cols} FROM tok), {name}_d AS (SELECT {dfs} FROM {name}_f), {name} AS (SELECT doc_id, ord, round({score}, 9) AS s FROM {name}_f, {name}_d, cs WHERE {' AND '.join(f'f{i} > 0' for i in range(len(terms)))})"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def renamed(df: DataFrame) -> DataFrame:
    """Unit results as doc_id, ord."""
    return df.withColumns({"doc_id": F.split_part("unit_id", F.lit(":"), F.lit(1)).cast("long"), "ord": F.split_part("unit_id", F.lit(":"), F.lit(2)).cast("long")})


# --- scopes and facets -------------------------------------------------------


@query("scope_filter", "SELECT doc_id::VARCHAR AS resource_id, source AS source_namespace, count(*) AS n_units FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) FROM documents WHERE source IN ('src1', 'src2', 'src7')) GROUP BY ALL")
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = D.catalog(spark, sf)
    inside = apply_scope(c.scoped_units(), c.facets, Scope(source_namespaces=("src1", "src2", "src7"), unit_kinds=("text_chunk",), modalities=("text",)))
    return inside.groupBy("resource_id", "source_namespace").agg(F.count(F.lit(1)).alias("n_units"))


_FACET_SQL = "WITH f AS (SELECT doc_id, 'lang' AS ns, lang AS v FROM documents UNION ALL SELECT doc_id, 'quality', 'i:' || quality FROM labels UNION ALL SELECT doc_id, 'toxic', 'i:' || toxic FROM labels) SELECT doc_id::VARCHAR AS resource_id FROM documents d WHERE "


def _by_facets(spark: SparkSession, sf: str, **clauses) -> DataFrame:
    c = D.catalog(spark, sf)
    return apply_scope(c.scoped_units(), c.facets, Scope(**clauses)).select("resource_id").distinct()


@query("facets_any", _FACET_SQL + "EXISTS (SELECT 1 FROM f WHERE f.doc_id = d.doc_id AND ((ns = 'lang' AND v = 'fr') OR (ns = 'toxic' AND v = 'i:1')))")
def facets_any(spark: SparkSession, sf: str) -> DataFrame:
    return _by_facets(spark, sf, facets_any=(("lang", "fr"), ("toxic", "i:1")))


@query("facets_all", _FACET_SQL + "EXISTS (SELECT 1 FROM f WHERE f.doc_id = d.doc_id AND ns = 'lang' AND v = 'en') AND EXISTS (SELECT 1 FROM f WHERE f.doc_id = d.doc_id AND ns = 'quality' AND v = 'i:1')")
def facets_all(spark: SparkSession, sf: str) -> DataFrame:
    return _by_facets(spark, sf, facets_all=(("lang", "en"), ("quality", "i:1")))


@query("facets_none", _FACET_SQL + "NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = d.doc_id AND ((ns = 'lang' AND v = 'en') OR (ns = 'toxic' AND v = 'i:1')))")
def facets_none(spark: SparkSession, sf: str) -> DataFrame:
    return _by_facets(spark, sf, facets_none=(("lang", "en"), ("toxic", "i:1")))


@query("facet_counts", "SELECT 'lang' AS namespace, lang AS value, count(DISTINCT doc_id) AS n_resources FROM documents GROUP BY lang UNION ALL SELECT 'quality', 'i:' || quality, count(DISTINCT doc_id) FROM labels GROUP BY quality UNION ALL SELECT 'toxic', 'i:' || toxic, count(DISTINCT doc_id) FROM labels GROUP BY toxic")
def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    return facets.facet_counts(D.catalog(spark, sf).facets)


@query("metadata_facets", "SELECT 'lang' AS namespace, lang AS value, count(DISTINCT doc_id) AS n_resources, lang AS display, 'string' AS value_type FROM documents GROUP BY lang")
def metadata_facets(spark: SparkSession, sf: str) -> DataFrame:
    return facets.metadata_facets(D.catalog(spark, sf).facets)


# --- vector search -----------------------------------------------------------

_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 3)"


def _vector_top(metric: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        c = D.catalog(spark, sf)
        q = D.query_vector(spark, sf)
        rows = vector.scores(c.vectors, D.SPACE, metric, q).withColumn("vec_id", F.split_part("unit_id", F.lit(":"), F.lit(1)).cast("long"))
        best = rows.orderBy(F.col("score").desc(), "vec_id").limit(100)
        return best.select("vec_id", "score", F.row_number().over(Window.orderBy(F.col("score").desc(), "vec_id")).alias("rank"))

    return run


for _metric, _expr in (("cosine", "list_cosine_similarity(embedding::DOUBLE[], q)"), ("dot", "list_dot_product(embedding::DOUBLE[], q)"), ("l2", "0 - list_distance(embedding::DOUBLE[], q)")):
    query(f"vector_topk_{_metric}", f"WITH {_Q}, s AS (SELECT vec_id, round({_expr}, 9) AS score FROM embeddings, q) SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM s ORDER BY score DESC, vec_id LIMIT 100")(_vector_top(_metric))


@query("centroid_by_label", "WITH e AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT label, pos::INT AS pos, round(avg(x), 6) AS x FROM e GROUP BY ALL")
def centroid_by_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.read(spark, sf, "embeddings").select("label", "vec_id", "embedding")
    return vector.weighted_centroids(rows, "label", "vec_id", "embedding").select("label", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("similar_excluding_self", f"WITH {_Q}, s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS score FROM embeddings, q WHERE vec_id <> 3) SELECT vec_id, score FROM s ORDER BY score DESC, vec_id::VARCHAR LIMIT 20")
def similar_excluding_self(spark: SparkSession, sf: str) -> DataFrame:
    found = search.similar(D.catalog(spark, sf), "3", D.SPACE, 20)
    return found.select(F.split_part("unit_id", F.lit(":"), F.lit(1)).cast("long").alias("vec_id"), "score")


@query("all_similar", """WITH s AS (SELECT a.vec_id AS q, b.vec_id AS u, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, u::VARCHAR || ':whole') AS rank FROM s) SELECT q AS query_id, u AS vec_id, score, rank::INT AS rank FROM r WHERE rank <= 10""")
def all_similar(spark: SparkSession, sf: str) -> DataFrame:
    vecs = D.catalog(spark, sf).vectors
    number = lambda c: F.split_part(c, F.lit(":"), F.lit(1)).cast("long")
    found = search.all_similar(vecs, vecs.filter(number("unit_id") % 20 == 0), 10)
    return found.select(number("query_id").alias("query_id"), number("unit_id").alias("vec_id"), "score", "rank")


@query("near_space_resolution", "SELECT 'space-64' AS space_id, 64 AS dimensions")
def near_space_resolution(spark: SparkSession, sf: str) -> DataFrame:
    c = D.catalog(spark, sf)
    found = vector.resolve_space(c.spaces, "demo", 64)
    return c.spaces.filter(F.col("space_id") == found).select("space_id", "dimensions")


# --- lexical and hybrid search -----------------------------------------------

_TERMS = ["the", "ing"]


@query("bm25_topk", f"WITH {UNITS}, {bm25_sql(_TERMS)} SELECT doc_id, ord, s AS score, row_number() OVER (ORDER BY s DESC, doc_id, ord)::INT AS rank FROM bm ORDER BY s DESC, doc_id, ord LIMIT 100")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    units = D.paragraphs(spark, sf)
    return renamed(lexical.search_lexical(units, units, " ".join(_TERMS), 100)).select("doc_id", "ord", "score", "rank")


@query("bm25_index", f"WITH {UNITS}, {bm25_sql(_TERMS)} SELECT doc_id, ord, s AS score FROM bm")
def bm25_index(spark: SparkSession, sf: str) -> DataFrame:
    units = D.paragraphs(spark, sf)
    lengths = units.select("unit_id", F.size(T.tokens(F.col("text"))).alias("dl"))
    rows = lexical.postings_bm25(lexical.build_index(units), lengths, _TERMS)
    return renamed(rows).select("doc_id", "ord", F.round("score", 9).alias("score"))


@query("fts_boolean", f"WITH {UNITS} SELECT doc_id, ord FROM tok WHERE (list_contains(t, 'the') AND list_contains(t, 'of') OR list_contains(t, 'que')) AND NOT list_contains(t, 'is')")
def fts_boolean(spark: SparkSession, sf: str) -> DataFrame:
    return renamed(lexical.bm25(D.paragraphs(spark, sf).select("unit_id", "text"), "((the AND of) OR que) NOT is")).select("doc_id", "ord")


@query("fts_phrase", f"WITH {UNITS} SELECT doc_id, ord FROM tok WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' of the ')")
def fts_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return renamed(lexical.bm25(D.paragraphs(spark, sf).select("unit_id", "text"), '"of the"')).select("doc_id", "ord")


@query("fts_prefix", f"WITH {UNITS} SELECT doc_id, ord FROM tok WHERE len(list_filter(t, lambda x: starts_with(x, 'thin'))) > 0")
def fts_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return renamed(lexical.bm25(D.paragraphs(spark, sf).select("unit_id", "text"), "thin*")).select("doc_id", "ord")


_BRANCHES = f"""{UNITS}, {bm25_sql(_TERMS)}, {_Q},
lx AS (SELECT doc_id, ord, row_number() OVER (ORDER BY s DESC, doc_id, ord) AS r FROM bm),
lg AS (SELECT doc_id, row_number() OVER (ORDER BY min(r)) AS p, 0 AS b, 0.4 AS w FROM lx WHERE r <= 100 GROUP BY doc_id),
vs AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 9) AS s FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM documents)),
vg AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id::VARCHAR || ':whole') AS p, 1 AS b, 0.6 AS w FROM vs ORDER BY s DESC, doc_id::VARCHAR || ':whole' LIMIT 100),
u AS (SELECT * FROM lg UNION ALL SELECT * FROM vg),
fu AS (SELECT doc_id, round(coalesce(sum(w / (60 + p)) FILTER (b = 0), 0) + coalesce(sum(w / (60 + p)) FILTER (b = 1), 0), 12) AS score, min(b * 1000 + p) AS first, count(*)::INT AS n_branches FROM u GROUP BY doc_id)"""


@query("hybrid_rrf_resources", f"WITH {_BRANCHES} SELECT doc_id::VARCHAR AS resource_id, score, n_branches, row_number() OVER (ORDER BY score DESC, first, doc_id::VARCHAR)::INT AS rank FROM fu ORDER BY score DESC, first, doc_id::VARCHAR LIMIT 20")
def hybrid_rrf_resources(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: BM25 and cosine branches over scoped units, grouped by resource, fused, best 20."""
    from tessel.plans.requests import Lexical, Override, Request, Vector

    c = D.catalog(spark, sf)
    text, whole = Override(unit_kinds=("text_chunk",)), Override(unit_kinds=("whole_resource",))
    request = Request((Lexical("lexical", " ".join(_TERMS), 0.4, 100, text), Vector("semantic", D.SPACE, D.query_vector(spark, sf), 0.6, 100, whole)), target="resource", limit=20)
    return search.search(c, request).rows.select("resource_id", "score", "n_branches", "rank")


@query("rrf_two_lists", f"WITH {UNITS}, {bm25_sql(['the'], 'a')}, {bm25_sql(['of'], 'b')}, x AS (SELECT doc_id, ord, row_number() OVER (ORDER BY s DESC, doc_id, ord)::INT AS r FROM a ORDER BY r LIMIT 50), y AS (SELECT doc_id, ord, row_number() OVER (ORDER BY s DESC, doc_id, ord)::INT AS r FROM b ORDER BY r LIMIT 50) SELECT doc_id, ord, x.r AS text_rank, y.r AS semantic_rank, round(coalesce(1 / (60 + x.r), 0) + coalesce(1 / (60 + y.r), 0), 12) AS score FROM x FULL JOIN y USING (doc_id, ord)")
def rrf_two_lists(spark: SparkSession, sf: str) -> DataFrame:
    units = D.paragraphs(spark, sf)
    a, b = (lexical.search_lexical(units, units, t, 50) for t in ("the", "of"))
    return renamed(fusion.rrf_two(a, b)).select("doc_id", "ord", "text_rank", "semantic_rank", "score")


@query("media_rank", "WITH u AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS ord, lower(unnest(p)) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)), s AS (SELECT doc_id, ord, ((length(x) - length(replace(x, 'the', ''))) / 3 + (length(x) - length(replace(x, 'ou', ''))) / 2)::BIGINT AS score FROM u) SELECT doc_id, ord, score FROM s WHERE score > 0")
def media_rank(spark: SparkSession, sf: str) -> DataFrame:
    return renamed(lexical.substring_rank(D.paragraphs(spark, sf), "The ou")).select("doc_id", "ord", "score")


# --- joins, windows, pages ---------------------------------------------------


@query("duplicates_by_hash", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id::VARCHAR) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicates_by_hash(spark: SparkSession, sf: str) -> DataFrame:
    return facets.duplicate_groups(D.catalog(spark, sf).resources)


@query("neighbours", "SELECT (CASE WHEN ord < 3 THEN 'before' ELSE 'after' END) AS side, doc_id, ord FROM (SELECT doc_id, generate_subscripts(p, 1) - 1 AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE doc_id = 2)) WHERE ord BETWEEN 1 AND 5 AND ord <> 3")
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    chunks = D.paragraphs(spark, sf).select(F.col("unit_id").alias("chunk_id"), F.col("doc_id").alias("file_id"), F.col("ordinal").alias("chunk_index"))
    near = facets.neighbours(chunks, "2:3", 2)
    return near.select("side", F.col("file_id").alias("doc_id"), F.col("chunk_index").cast("long").alias("ord"))


@query("prev_next", "SELECT unit_id, lag(unit_id) OVER w AS prev_id, lead(unit_id) OVER w AS next_id FROM (SELECT doc_id, ord, doc_id || ':' || ord AS unit_id FROM (SELECT doc_id, generate_subscripts(p, 1) - 1 AS ord FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))) WINDOW w AS (PARTITION BY doc_id ORDER BY ord)")
def prev_next(spark: SparkSession, sf: str) -> DataFrame:
    chunks = D.paragraphs(spark, sf).select(F.col("unit_id").alias("chunk_id"), F.col("doc_id").alias("file_id"), F.col("ordinal").alias("chunk_index"))
    return facets.linked(chunks).select(F.col("chunk_id").alias("unit_id"), "prev_id", "next_id")


@query("duplicate_ordinals", "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text), lang ORDER BY doc_id)::INT - 1 AS nth FROM documents")
def duplicate_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    docs = D.read(spark, sf, "documents").withColumn("fp", F.sha2("text", 256))
    return facets.duplicate_ordinals(docs, ["fp", "lang"], ["doc_id"]).select("doc_id", "nth")


@query("pagination", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 25 OFFSET 50")
def pagination(spark: SparkSession, sf: str) -> DataFrame:
    return facets.page(D.read(spark, sf, "documents").select("doc_id", "source"), ["source", "doc_id"], 3, 25)[0]


_SNAPSHOTS = """now AS (SELECT 'd/' || (CASE WHEN doc_id % 10 = 7 THEN doc_id + 1000000 ELSE doc_id END) AS path, sha256(CASE WHEN doc_id % 10 = 3 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 10 <> 5),
old AS (SELECT 'd/' || doc_id AS path, sha256(text) AS h, doc_id AS id FROM documents WHERE doc_id % 10 <> 9)"""


def _snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two made-up states of a folder: files changed, renamed, removed and added by the last digit of their id."""
    docs = D.read(spark, sf, "documents")
    digit = F.col("doc_id") % 10
    now = docs.filter(digit != 5).select(F.concat(F.lit("d/"), F.when(digit == 7, F.col("doc_id") + 1000000).otherwise(F.col("doc_id"))).alias("relative_path"), F.sha2(F.when(digit == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("source_hash"))
    old = docs.filter(digit != 9).select(F.concat(F.lit("d/"), "doc_id").alias("relative_path"), F.sha2("text", 256).alias("source_hash"), F.col("doc_id").alias("logical_id"), F.lit("active").alias("status"))
    return now, old


@query("change_plan", f"WITH {_SNAPSHOTS} SELECT coalesce(now.path, old.path) AS relative_path, id AS logical_id, coalesce(now.h, old.h) AS source_hash, CASE WHEN old.h IS NULL THEN 'new' WHEN now.h IS NULL THEN 'deleted' WHEN now.h = old.h THEN 'unchanged' ELSE 'changed' END AS change FROM now FULL JOIN old ON now.path = old.path")
def change_plan(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.change_plan(*_snapshots(spark, sf))


@query("rename_detection", f"WITH {_SNAPSHOTS}, gone AS (SELECT h, min(path) AS old_path, min(id) AS logical_id FROM old WHERE path NOT IN (SELECT path FROM now) GROUP BY h HAVING count(*) = 1), fresh AS (SELECT h, min(path) AS new_path FROM now WHERE path NOT IN (SELECT path FROM old) GROUP BY h) SELECT new_path, old_path, logical_id FROM fresh JOIN gone USING (h)")
def rename_detection(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.renames(incremental.change_plan(*_snapshots(spark, sf)))


# --- evaluation --------------------------------------------------------------

_EVAL = f"""WITH g AS (SELECT b.item_id AS q, d.doc_id AS i, 1 + (d.doc_id % 3) AS grade FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
 s AS (SELECT b.item_id AS q, e.vec_id AS i, row_number() OVER (PARTITION BY b.item_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], x.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS r FROM benchmark b JOIN embeddings x ON x.vec_id = b.item_id JOIN embeddings e ON true),
 top AS (SELECT q, i, r FROM s WHERE r <= 50), h AS (SELECT top.q, top.i, r, grade FROM top LEFT JOIN g ON g.q = top.q AND g.i = top.i),
 a AS (SELECT q, count(*) AS ret, count(grade) AS found, min(CASE WHEN grade IS NOT NULL THEN r END) AS first, coalesce(sum((pow(2, grade) - 1) / log2(r + 1)), 0) AS dcg FROM h GROUP BY q),
 o AS (SELECT q, grade, row_number() OVER (PARTITION BY q ORDER BY grade DESC, i) AS r FROM g),
 z AS (SELECT q, count(*) AS n_gold, sum(CASE WHEN r <= 50 THEN (pow(2, grade) - 1) / log2(r + 1) END) AS idcg FROM o GROUP BY q),
 m AS (SELECT z.q AS query_id, n_gold, round(coalesce(found / n_gold, 0), 9) AS recall, round(coalesce(found / ret, 0), 9) AS precision_returned, round(coalesce(found / 50, 0), 9) AS precision_k,
   round(coalesce(1 / first, 0), 9) AS mrr, round(coalesce(dcg / idcg, 0), 9) AS ndcg FROM z LEFT JOIN a USING (q))"""


def _evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics at 50 of nearest vectors as answers to the benchmark items; gold: the documents that hold the item."""
    bench, docs = D.read(spark, sf, "benchmark"), D.read(spark, sf, "documents")
    held = evaluation.holders(docs.select(F.col("doc_id").alias("item_id"), "text"), bench.select(F.col("item_id").alias("query_id"), "text"))
    gold = held.select("item_id", (1 + F.col("item_id") % 3).alias("grade"), "query_id")
    vecs = D.read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("unit_id"), F.col("embedding").alias("vector"))
    asked = vecs.join(bench.select(F.col("item_id").cast("string").alias("unit_id")), "unit_id", "left_semi")
    near = _ranked_with_self(asked, vecs, 50)
    return evaluation.metrics(near, gold, 50)


def _ranked_with_self(asked: DataFrame, vecs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` with ties at the last place, ranked by score and number."""
    rows = search.all_similar(vecs, asked, k, own=True, ties=True).select(F.col("query_id").cast("long").alias("query_id"), F.col("unit_id").cast("long").alias("item_id"), "score")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("score")


@query("eval_recall_mrr_ndcg", _EVAL + " SELECT * FROM m")
def eval_recall_mrr_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluation(spark, sf)


@query("eval_by_slice", _EVAL + ", c AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'lexical' ELSE 'semantic' END AS k, 'mod=' || (item_id % 3) AS t FROM benchmark), x AS (SELECT m.*, unnest(['overall', 'case_kind=' || k, t]) AS slice FROM m JOIN c USING (query_id)) SELECT slice, count(*) AS n_queries, round(avg(recall), 9) AS recall, round(avg(precision_returned), 9) AS precision_returned, round(avg(precision_k), 9) AS precision_k, round(avg(mrr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg FROM x GROUP BY slice")
def eval_by_slice(spark: SparkSession, sf: str) -> DataFrame:
    cases = D.read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "lexical").otherwise("semantic").alias("case_kind"), F.array(F.concat(F.lit("mod:"), F.col("item_id") % 3)).alias("slice_tags"))
    return evaluation.by_slice(_evaluation(spark, sf), cases)


# --- timed data --------------------------------------------------------------

_EVENTS = "e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS t FROM events)"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return D.read(spark, sf, "events").select("event_id", "user_id", "event_type", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) DIV 1000").alias("t"))


@query("nearby_events", f"WITH {_EVENTS}, m AS (SELECT p.event_id AS id, o.event_id AS other_id, abs(p.t - o.t) AS d FROM e p JOIN e o ON p.user_id = o.user_id AND p.event_id <> o.event_id AND abs(p.t - o.t) <= 3600000 WHERE p.event_type = 'purchase') SELECT id, min(d) AS distance_ms, min_by(other_id, (d, other_id)) AS other_id FROM m GROUP BY id")
def nearby_events(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumnRenamed("event_id", "id")
    return timed.nearest_by_bins(e.filter("event_type = 'purchase'"), e, "user_id", "t", 3600000)


@query("overlap_counts", f"WITH {_EVENTS}, i AS (SELECT user_id, event_id, t AS s, t + 600000 AS en, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS o FROM e), x AS (SELECT user_id, s < max(en) OVER (PARTITION BY user_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ov FROM i) SELECT user_id, count(*) AS n, count(*) FILTER (ov) AS n_overlaps FROM x GROUP BY user_id")
def overlap_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    atoms = e.select(F.col("user_id").alias("resource_id"), F.col("t").alias("start_ms"), (F.col("t") + 600000).alias("end_ms"), F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).alias("ordinal"))
    return timed.overlaps(atoms).groupBy(F.col("resource_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n"), F.count_if("overlaps").alias("n_overlaps"))


@query("interval_iou", f"WITH {_EVENTS}, n AS (SELECT event_id, user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS u FROM e) SELECT event_id, round(CASE WHEN t + 600000 > u THEN (t + 600000 - u)::DOUBLE / (u + 600000 - t) ELSE 0 END, 9) AS iou FROM n WHERE u IS NOT NULL")
def interval_iou(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("u", F.lead("t").over(Window.partitionBy("user_id").orderBy("t", "event_id"))).filter("u IS NOT NULL")
    return e.select("event_id", F.round(intervals.iou(F.col("t"), F.col("t") + 600000, F.col("u"), F.col("u") + 600000), 9).alias("iou"))


# --- statistics and scalar functions -----------------------------------------


@query("storage_stats", "WITH b AS (SELECT (len(embedding) * 4)::DOUBLE AS x FROM embeddings) SELECT 'space-64' AS space_id, count(*) AS n_vectors, sum(x) AS total_bytes, min(x) AS min_bytes, median(x) AS median_bytes, quantile_disc(x, 0.95) AS p95_bytes, max(x) AS max_bytes FROM b")
def storage_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = D.catalog(spark, sf)
    return facets.storage_stats(c.vectors, c.spaces)


@query("chunk_length_percentiles", "WITH u AS (SELECT length(x) AS c, greatest(1, (octet_length(encode(x)) + 3) // 4) AS k FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents)) SELECT count(*) AS n, " + ", ".join(f"quantile_disc({c}, {p / 100})::BIGINT AS p{p}_{n}" for c, n in (("c", "chars"), ("k", "tokens")) for p in (50, 90, 99)) + ", round(count(*) FILTER (c < 100) / count(*), 9) AS small_ratio, round(count(*) FILTER (c > 1000) / count(*), 9) AS large_ratio FROM u")
def chunk_length_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return facets.length_percentiles(D.paragraphs(spark, sf))


@query("token_estimates", r"SELECT doc_id, greatest(1, (octet_length(encode(text)) + 3) // 4)::BIGINT AS estimate, len(regexp_extract_all(text, '[^\s]+'))::BIGINT AS n_words, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM documents")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return D.read(spark, sf, "documents").select("doc_id", T.estimate_tokens(text).alias("estimate"), T.count_words(text).alias("n_words"), T.preview(text).alias("preview"))


@query("fingerprints", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS content_fp, 'doc_' || substr(sha256('["' || source || '","' || doc_id || '"]'), 1, 32) AS logical_id FROM documents""")
def fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return D.read(spark, sf, "documents").select("doc_id", T.content_fingerprint(F.col("text")).alias("content_fp"), T.logical_id("doc", F.col("source"), F.col("doc_id")).alias("logical_id"))


@query("facet_codec", "WITH w AS (SELECT DISTINCT unnest(string_split(text, chr(10))) AS x FROM documents) SELECT x, 's:' || url_encode(x) AS encoded, x AS decoded FROM w")
def facet_codec(spark: SparkSession, sf: str) -> DataFrame:
    parts = D.read(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("x")).distinct()
    return parts.withColumn("encoded", T.facet_text(F.col("x"))).withColumn("decoded", T.facet_display(F.col("encoded")))


@query("seconds_to_ms", "SELECT event_id, round(value::DECIMAL(30, 12) * 1000)::BIGINT AS ms FROM events")
def seconds_to_ms(spark: SparkSession, sf: str) -> DataFrame:
    return D.read(spark, sf, "events").select("event_id", T.seconds_to_ms(F.col("value")).alias("ms"))


@query("page_title_and_h1", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS h1 FROM pages")
def page_title_and_h1(spark: SparkSession, sf: str) -> DataFrame:
    tag = lambda name: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", f"(?is)<{name}[^>]*>(.*?)</{name}>", 1), "<[^>]+>", ""), r"\s+", " "))
    return D.read(spark, sf, "pages").select("page_id", tag("title").alias("title"), tag("h1").alias("h1"))


@query("hash_embeddings", """WITH h AS (SELECT doc_id, sha256(text) AS x FROM documents),
 r AS (SELECT doc_id, list_transform(range(32), lambda i: ((('0x' || substr(x, 2 * i + 1, 2))::INT * (i + 1)) % 256) / 127.5 - 1) AS v FROM h),
 n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM r)
 SELECT doc_id, k::INT AS pos, round(CASE WHEN size > 0 THEN v[k + 1] / size ELSE v[k + 1] END, 9) AS x FROM (SELECT *, unnest(range(32)) AS k FROM n)""")
def hash_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.read(spark, sf, "documents").select("doc_id", F.posexplode(V.hash_vector(F.col("text"), 32)).alias("pos", "x"))
    return rows.withColumn("x", F.round("x", 9))


@query("store_counts", "SELECT 'resources' AS name, count(*) AS n FROM documents UNION ALL SELECT 'representations', 2 * count(*) FROM documents UNION ALL SELECT 'units', sum(1 + len(string_split(text, chr(10))))::BIGINT FROM documents UNION ALL SELECT 'spaces', 1 UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'facets', (SELECT count(*) FROM documents) + 2 * count(*) FROM labels")
def store_counts(spark: SparkSession, sf: str) -> DataFrame:
    return facets.store_counts(D.catalog(spark, sf).tables())


@query("latency_percentiles", "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return facets.linear_percentiles(D.read(spark, sf, "events"), "value")


@query("whole_resource_text", "SELECT conv_id::VARCHAR AS resource_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text, sum(len(regexp_extract_all(text, '[^\\s]+')))::BIGINT AS n_tokens FROM conversations GROUP BY conv_id")
def whole_resource_text(spark: SparkSession, sf: str) -> DataFrame:
    from tessel.operators import graphs

    rows = D.read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("resource_id"), "turn", "text", T.count_words(F.col("text")).alias("token_count"))
    return graphs.whole_texts(rows, ordinal="turn").withColumnRenamed("token_count", "n_tokens")


@query("catalog_violations", """WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents),
 l AS (SELECT * FROM labels), f AS (SELECT doc_id, 'lang' AS ns, lang AS v FROM documents UNION ALL SELECT doc_id, 'quality', 'i:' || quality FROM l UNION ALL SELECT doc_id, 'toxic', 'i:' || toxic FROM l),
 n(rule, n) AS (VALUES ('resource_id_unique', (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1))),
  ('facet_unique', (SELECT count(*) FROM (SELECT doc_id, ns, v FROM f GROUP BY ALL HAVING count(*) > 1))),
  ('unit_text_or_vector', (SELECT count(*) FROM d WHERE trim(x) = '' OR x IS NULL) + (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings))),
  ('vector_unique', (SELECT count(*) FROM (SELECT vec_id FROM embeddings GROUP BY vec_id HAVING count(*) > 1))),
  ('vector_has_unit', (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents))),
  ('vector_dimensions', (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64)),
  ('vector_finite', (SELECT count(*) FROM embeddings WHERE len(embedding) = 0 OR len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0)),
  ('vector_norm', (SELECT count(*) FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: x * x)) = 0)),
  ('facet_has_resource', (SELECT count(*) FROM f WHERE doc_id NOT IN (SELECT doc_id FROM documents)))),
 r(rule) AS (VALUES ('resource_id_unique'), ('representation_id_unique'), ('unit_id_unique'), ('unit_ordinal_unique'), ('space_id_unique'), ('vector_unique'), ('facet_unique'), ('source_unique'), ('representation_has_resource'),
  ('resource_has_representation'), ('unit_has_representation'), ('representation_has_unit'), ('unit_modality'), ('unit_text_or_vector'), ('vector_has_unit'), ('vector_has_space'), ('vector_dimensions'), ('vector_finite'),
  ('vector_norm'), ('facet_has_resource'), ('resource_kind'), ('space_metric'), ('facet_origin'))
 SELECT rule, coalesce(n, 0)::BIGINT AS n FROM r LEFT JOIN n USING (rule)""")
def catalog_violations(spark: SparkSession, sf: str) -> DataFrame:
    from tessel.plans.catalog import violations

    return violations(D.catalog(spark, sf))


# --- sequential algorithms (beyond SQL; properties and parts of them are held in tests) ---


@query("timed_passages")
def timed_passages(spark: SparkSession, sf: str) -> DataFrame:
    from tessel.operators import grouping
    from tessel.sources import transcripts

    return grouping.group_atoms(transcripts.conversation_atoms(D.read(spark, sf, "conversations")))


@query("grouping_metrics")
def grouping_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from tessel.operators import grouping
    from tessel.sources import transcripts

    atoms = transcripts.conversation_atoms(D.read(spark, sf, "conversations"))
    return grouping.grouping_metrics(grouping.group_atoms(atoms), atoms)


@query("grouping_variants")
def grouping_variants(spark: SparkSession, sf: str) -> DataFrame:
    from tessel.operators import grouping
    from tessel.sources import transcripts

    rows = grouping.group_variants(transcripts.conversation_atoms(D.read(spark, sf, "conversations")))
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n_passages"), F.sum("token_count").alias("n_tokens"), F.max("token_count").alias("max_tokens"))


def _as_files(spark: SparkSession, sf: str) -> DataFrame:
    return D.read(spark, sf, "documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".md")).alias("relative_path"), F.col("text").alias("content"))


@query("structural_chunks")
def structural_chunks(spark: SparkSession, sf: str) -> DataFrame:
    from tessel.operators import chunking

    return chunking.chunk_files(_as_files(spark, sf))


@query("markdown_blocks")
def markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    from tessel.sources import markdown

    return markdown.parse_files(_as_files(spark, sf)).groupBy("block_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("raw")).alias("n_chars"))


@query("chunk_audit")
def chunk_audit(spark: SparkSession, sf: str) -> DataFrame:
    from tessel.operators import chunking

    return evaluation.chunk_audit(chunking.chunk_files(_as_files(spark, sf)))


@query("preset_search")
def preset_search(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transcripts and events as frames, searched with a preset."""
    from tessel.operators import graphs, grouping
    from tessel.sources import transcripts

    # the catalog is read by each branch for its statistics and its rows: passages are made once, as a table of the warehouse
    table = f"passages_{uuid.uuid4().hex}"
    grouping.group_atoms(transcripts.conversation_atoms(D.read(spark, sf, "conversations"))).write.saveAsTable(table)
    passages = spark.table(table)
    e = _events(spark, sf)
    frames = e.select(F.col("user_id").cast("string").alias("resource_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")).alias("ordinal"), F.col("event_id").cast("string").alias("frame_id"), F.col("t").alias("timestamp_ms"), F.col("event_type").alias("caption"), F.lit("{}").alias("metadata_json"))
    c = graphs.video_graph(passages, frames)
    return search.search(c, search.preset_request("balanced", "purchase", None, None, 10)).rows.select("resource_id", "score", "rank")


@query("interval_matches", f"WITH {_EVENTS}, r AS (SELECT user_id AS q, event_id, t AS s, t + 900000 AS e FROM e WHERE event_type = 'click'), g AS (SELECT user_id AS q, event_id AS g, t AS gs, t + 600000 AS ge FROM e WHERE event_type = 'purchase') SELECT event_id, g AS gold_id, round((least(r.e, ge) - greatest(s, gs))::DOUBLE / (greatest(r.e, ge) - least(s, gs)), 9) AS iou, abs(s - gs) AS start_error FROM r JOIN g USING (q) WHERE least(r.e, ge) > greatest(s, gs)")
def interval_matches(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf)
    own = lambda kind, more: e.filter(F.col("event_type") == kind).select(F.col("user_id").alias("query_id"), F.lit("r").alias("resource_id"), "event_id", F.col("t").alias("start_ms"), (F.col("t") + more).alias("end_ms"))
    gold = own("purchase", 600000).withColumn("grade", F.col("event_id"))
    return timed.interval_matches(own("click", 900000), gold).select("event_id", F.col("grade").alias("gold_id"), F.round("iou", 9).alias("iou"), "start_error")


@query("scalar_facets", "SELECT 'quality' AS namespace, quality AS v, 'i:' || quality AS typed, 'integer' AS kind, count(*) AS n FROM labels GROUP BY quality UNION ALL SELECT 'toxic', toxic, 'b:' || (toxic = 1), 'boolean', count(*) FROM labels GROUP BY toxic")
def scalar_facets(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.read(spark, sf, "labels")
    q = rows.select(F.lit("quality").alias("namespace"), F.col("quality").alias("v"), T.facet_value(F.col("quality"), "int").alias("typed"))
    t = rows.select(F.lit("toxic").alias("namespace"), F.col("toxic").alias("v"), T.facet_value(F.col("toxic") == 1, "bool").alias("typed"))
    return q.unionByName(t).groupBy("namespace", "v", "typed", T.facet_type(F.col("typed")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("doctor", "SELECT * FROM (VALUES ('missing_fts', 'error', (SELECT count(*) FROM documents WHERE doc_id % 11 = 0)), ('orphan_fts', 'error', 0), ('missing_embedding', 'warning', (SELECT count(*) FROM documents WHERE doc_id % 7 = 0)), ('stale_embedding', 'warning', (SELECT count(*) FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 13 = 0)), ('orphan_embedding', 'error', 0)) AS v(code, severity, n)")
def doctor(spark: SparkSession, sf: str) -> DataFrame:
    docs = D.read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("embedding_text"))
    hashed = F.sha2(F.when(F.col("chunk_id") % 13 == 0, F.lit("old")).otherwise(F.col("embedding_text")), 256)
    return incremental.doctor(docs, docs.filter("chunk_id % 11 <> 0").select("chunk_id"), docs.filter("chunk_id % 7 <> 0").select("chunk_id", hashed.alias("embedded_hash")))


@query("tpch_like_join", "SELECT n_name, count(*) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def tpch_like_join(spark: SparkSession, sf: str) -> DataFrame:
    r = lambda t: D.read(spark, sf, t)
    rows = r("lineitem").join(r("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(r("customer"), F.col("o_custkey") == F.col("c_custkey")).join(r("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
