"""Queries over vectors, postings and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import evaluation as E
from siltstone.operators import hybrid as H
from siltstone.operators import lexical as L
from siltstone.operators import vectors as V
from siltstone.plans.cut import written
from siltstone.plans.registry import query
from siltstone.sources.tables import delivered_once, table

#: The stated query set of vector searches: every row whose id is divisible by 50, against all rows.
ASKED = "vec_id % 50 = 0"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    base = table(spark, d, "embeddings", "vec_id", "embedding")
    return base, base.where(ASKED).withColumnRenamed("vec_id", "query_id")


def _prefix(df: DataFrame, dims: int) -> DataFrame:
    return df.withColumn("embedding", F.slice("embedding", 1, dims))


def _flat_sql(k: int, dims: int = 64, name: str = "flat") -> str:
    part = "" if dims == 64 else f"[1:{dims}]"
    v = lambda a: f"(({a}.embedding)::DOUBLE[]){part}"
    cos = f"list_inner_product({v('q')}, {v('b')}) / (sqrt(list_inner_product({v('q')}, {v('q')})) * sqrt(list_inner_product({v('b')}, {v('b')})))"
    return f"""{name} AS (SELECT * FROM (SELECT q.vec_id AS query_id, b.vec_id AS vec_id, {cos} AS s,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY {cos} DESC, b.vec_id) AS rank FROM embeddings q, embeddings b WHERE q.{ASKED}) WHERE rank <= {k})"""


@query(f"WITH {_flat_sql(10)} SELECT query_id, vec_id, rank, round(s, 6) AS similarity FROM flat")
def vector_topk_flat(spark: SparkSession, d: str) -> DataFrame:
    base, asked = _vectors(spark, d)
    return V.topk(base, "vec_id", asked, "query_id", 10).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_flat_sql(5)} SELECT query_id, vec_id, rank, round(s, 6) AS similarity FROM flat WHERE s >= 0.3")
def vector_threshold_search(spark: SparkSession, d: str) -> DataFrame:
    base, asked = _vectors(spark, d)
    return V.within(base, "vec_id", asked, "query_id", 0.3, 5).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


@query()
def vector_topk_cells(spark: SparkSession, d: str) -> DataFrame:
    base, asked = _vectors(spark, d)
    return V.topk_cells(base, "vec_id", asked, "query_id", 10).select("query_id", "vec_id", "rank", F.round("similarity", 6).alias("similarity"))


@query()
def ann_effort_sweep_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall and NDCG at 5, 10 and 50 of approximate search at rising effort; ``tuned`` marks the effort that ``vector_topk_cells`` takes."""
    base, asked = _vectors(spark, d)
    exact = written(V.topk(base, "vec_id", asked, "query_id", 50), "exact")
    cells = V.fit_cells(base, "embedding", 64)
    parts = None
    for probes in sorted({1, *(max(1, len(cells.centres) * p // 8) for p in (1, 2, 4, 6)), cells.probes, len(cells.centres)}):
        found = V.topk_cells(base, "vec_id", asked, "query_id", 50, probes=probes, cells=cells)
        one = E.ranking_metrics(exact, found, "query_id", "vec_id", [5, 10, 50]).groupBy("k").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"))
        one = one.withColumn("probes", F.lit(probes)).withColumn("tuned", F.lit(probes == cells.probes))
        parts = one if parts is None else parts.unionByName(one)
    return parts


_METRIC_SQL = """, spread AS (SELECT e.query_id, e.vec_id, e.rank, k, size, {k} AS kk FROM flat e JOIN (SELECT query_id, max(rank) AS size FROM flat GROUP BY 1) USING (query_id), (SELECT unnest([5, 10, 50]) AS k)),
 m AS (SELECT s.query_id, s.k, max(s.size) AS size, max(s.kk) AS kk, count(*) FILTER (WHERE f.rank <= s.kk) AS hits,
   sum((s.kk - s.rank + 1) / log2(s.rank + 1)) AS best, sum(CASE WHEN f.rank <= s.kk THEN (s.kk - s.rank + 1) / log2(f.rank + 1) END) AS got
   FROM spread s LEFT JOIN part f ON f.query_id = s.query_id AND f.vec_id = s.vec_id WHERE s.rank <= s.kk GROUP BY 1, 2),
 metrics AS (SELECT query_id, k, round({recall}, 6) AS recall, round(coalesce(got, 0) / best, 6) AS ndcg FROM m)"""
_PLAIN = _METRIC_SQL.format(k="k", recall="CASE WHEN size >= k THEN hits / k END")
_CAPPED = _METRIC_SQL.format(k="least(k, size)", recall="hits / kk")


def _compared(spark: SparkSession, d: str, exact_k: int, capped: bool = False) -> DataFrame:
    base, asked = _vectors(spark, d)
    exact = V.topk(base, "vec_id", asked, "query_id", exact_k)
    found = V.topk(_prefix(base, 32), "vec_id", _prefix(asked, 32), "query_id", 50, dims=32)
    return E.ranking_metrics(exact, found, "query_id", "vec_id", [5, 10, 50], capped)


@query(f"WITH {_flat_sql(50)}, {_flat_sql(50, 32, 'part')}{_PLAIN} SELECT * FROM metrics")
def recall_ndcg_compare(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d, 50)


@query(f"WITH {_flat_sql(7)}, {_flat_sql(50, 32, 'part')}{_CAPPED} SELECT * FROM metrics")
def rerank_compare_capped(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d, 7, True)


@query(f"""WITH {_flat_sql(50)}, {_flat_sql(50, 32, 'part')}{_PLAIN} SELECT k, count(*) AS queries, round(avg(recall), 6) AS avg_recall, min(recall) AS min_recall, round(avg(ndcg), 6) AS avg_ndcg,
  min(ndcg) AS min_ndcg, round(median(ndcg), 6) AS median_ndcg, quantile_disc(ndcg, 0.1) AS p10_ndcg FROM metrics WHERE recall IS NOT NULL GROUP BY k""")
def comparison_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.metric_summary(_compared(spark, d, 50))


STRATEGY = "json_extract_string(metadata, '$.chunk_strategy') = 'section_aware_v2'"
_ONCE = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM document_chunks) WHERE rn = 1)"


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return delivered_once(table(spark, d, "document_chunks", "id", *columns, "created_at")).drop("created_at")


_SEED_SQL = f"""WITH {_ONCE}, seeds AS (SELECT query_id, document_id, chunk_index, min(rank) AS rank FROM reranked_results WHERE run = 'flat' AND rank <= 3 AND chunk_index IS NOT NULL GROUP BY 1, 2, 3),
 met AS (SELECT s.query_id, s.rank, s.document_id, s.chunk_index, c.chunk_index AS i, c.id, c.section_path, c.content, o.section_path AS own FROM seeds s
   JOIN once c ON c.document_id = s.document_id AND c.chunk_index BETWEEN greatest(0, s.chunk_index - 1) AND s.chunk_index + 1
   LEFT JOIN once o ON o.document_id = s.document_id AND o.chunk_index = s.chunk_index)"""
_PASSAGE = "SELECT query_id, rank, document_id, chunk_index, string_agg(i::VARCHAR, ',' ORDER BY i, id) AS neighbour_indexes, string_agg(id, ',' ORDER BY i, id) AS neighbour_ids, string_agg('[chunk_index=' || i || ' section=' || coalesce(section_path, '') || ']' || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY i, id) AS passage FROM met"


def _around(spark: SparkSession, d: str, seeds: DataFrame) -> DataFrame:
    """The chunks that can be neighbours of a seed: only these bring their texts."""
    spots = seeds.select("document_id", F.explode(F.sequence(F.col("chunk_index") - 1, F.col("chunk_index") + 1)).alias("chunk_index")).distinct()
    rows = table(spark, d, "document_chunks", "id", "document_id", "chunk_index", "section_path", "content", "created_at")
    return delivered_once(rows.join(spots, ["document_id", "chunk_index"], "left_semi")).drop("created_at")


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "reranked_results", "run", "query_id", "rank", "document_id", "chunk_index").where("run = 'flat' and rank <= 3").drop("run")


@query(f"{_SEED_SQL} {_PASSAGE} GROUP BY 1, 2, 3, 4")
def neighbor_expand(spark: SparkSession, d: str) -> DataFrame:
    seeds = _seeds(spark, d)
    return H.neighbours(seeds, _around(spark, d, seeds), "query_id")


@query(f"{_SEED_SQL} {_PASSAGE} WHERE section_path IS NOT DISTINCT FROM own GROUP BY 1, 2, 3, 4")
def neighbor_expand_same_section(spark: SparkSession, d: str) -> DataFrame:
    seeds = _seeds(spark, d)
    return H.neighbours(seeds, _around(spark, d, seeds), "query_id", same_section=True)


@query("""WITH h AS (SELECT DISTINCT query_id, rank, chunk_id, source FROM reranked_results WHERE run = 'hybrid')
 SELECT h.* FROM h JOIN (SELECT query_id, bool_or(source = 'lexical') AS found FROM h GROUP BY 1) USING (query_id) WHERE source = 'lexical' OR NOT found""")
def topk_strategy_fallback(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "reranked_results", "query_id", "rank", "chunk_id", "source", "run").where("run = 'hybrid'").drop("run").distinct()
    return H.strategy_or_all(hits, "query_id", F.col("source") == "lexical")


#: A row of words with their fields' weights and places, stems on both sides, as in ``siltstone.operators.lexical``.
_STEM = "CASE WHEN regexp_matches({w}, '[^ea]ies$') THEN left({w}, -3) || 'y' WHEN length({w}) > 2 AND regexp_matches({w}, '[^us]s$') THEN left({w}, -1) ELSE {w} END"
_words = lambda c, weight: f"list_transform(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda x: {{'w': x, 'weight': {weight}}})"
_TERMS_SQL = f"""terms AS (SELECT DISTINCT query_id, {_STEM.format(w='w')} AS lexeme FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS w FROM queries) WHERE NOT list_contains([{', '.join(chr(39) + w + chr(39) for w in L.STOP_WORDS)}], w)),
 need AS (SELECT query_id, count(*) AS need FROM terms GROUP BY 1), listed AS (SELECT id, list_concat({_words('title', '1.0')}, list_concat({_words('section_path', '0.4')}, {_words('content', '0.2')})) AS ws FROM once WHERE_),
 posts AS (SELECT id, pos, weight, {_STEM.format(w='w')} AS lexeme FROM (SELECT id, generate_subscripts(ws, 1) AS pos, unnest(ws).w AS w, unnest(ws).weight AS weight FROM listed)),
 hits AS (SELECT t.query_id, p.* FROM posts p JOIN terms t USING (lexeme))"""
_MATCH_SQL = "matched AS (SELECT h.query_id, h.id, h.score FROM (SELECT query_id, id, round(sum(weight), 6) AS score, count(DISTINCT lexeme) AS met FROM hits GROUP BY 1, 2) h JOIN need n ON n.query_id = h.query_id AND n.need = h.met)"
_COVER_SQL = """ends AS (SELECT h.query_id, h.id, h.pos, k.lexeme, max(k.pos) AS near, arg_max(k.weight, k.pos) AS w FROM hits h SEMI JOIN matched m ON m.query_id = h.query_id AND m.id = h.id JOIN hits k ON k.query_id = h.query_id AND k.id = h.id AND k.pos <= h.pos GROUP BY 1, 2, 3, 4),
 whole AS (SELECT query_id, id, pos, need, min(near) AS first, sum(1 / w) AS inverse FROM ends JOIN need USING (query_id) GROUP BY 1, 2, 3, 4 HAVING count(*) = need),
 covers AS (SELECT *, lag(first) OVER (PARTITION BY query_id, id ORDER BY pos) AS before FROM whole),
 dense AS (SELECT query_id, id, round(sum(need / inverse / (1 + greatest(0, pos - first + 1 - need))), 6) AS score FROM covers WHERE before IS NULL OR first > before GROUP BY 1, 2)"""
_BM25_SQL = """lens AS (SELECT id, len(ws) AS len FROM listed), st AS (SELECT count(*) AS n, avg(len) AS a FROM lens), tf AS (SELECT id, lexeme, count(*) AS tf FROM posts GROUP BY 1, 2),
 df AS (SELECT lexeme, count(*) AS df FROM tf GROUP BY 1), scored AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score
  FROM tf JOIN df USING (lexeme) JOIN lens USING (id) JOIN terms USING (lexeme), st GROUP BY 1, 2)"""
_top_sql = lambda source, k: f"SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {source}) WHERE rank <= {k}"
_FIELDS = {"title": "A", "section_path": "B", "content": "C"}


def _lexical(spark: SparkSession, d: str, how: str, **options) -> DataFrame:
    chunks = table(spark, d, "document_chunks", "id", *_FIELDS, *(["metadata"] if options.get("strategy") else []))
    return L.search(chunks, "id", _FIELDS, table(spark, d, "queries", "query_id", "query"), "query_id", how, **options)


@query(f"WITH {_ONCE}, {_TERMS_SQL.replace('WHERE_', '')}, {_MATCH_SQL} {_top_sql('matched', 20)}")
def lexical_match_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, "match")


@query(f"WITH {_ONCE}, {_TERMS_SQL.replace('WHERE_', 'WHERE ' + STRATEGY)}, {_MATCH_SQL} {_top_sql('matched', 20)}")
def lexical_match_strategy(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, "match", strategy="section_aware_v2")


@query(f"WITH {_ONCE}, {_TERMS_SQL.replace('WHERE_', '')}, {_BM25_SQL} {_top_sql('scored', 20)}")
def lexical_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, "bm25")


@query(f"WITH {_ONCE}, {_TERMS_SQL.replace('WHERE_', '')}, {_MATCH_SQL}, {_COVER_SQL} {_top_sql('dense', 20)}")
def lexical_cover_density(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d, "cover")


@query(f"""WITH {_ONCE}, {_TERMS_SQL.replace('WHERE_', '')}, {_MATCH_SQL}, {_COVER_SQL} {_top_sql('dense', 20)}""")
def lexical_web_search(spark: SparkSession, d: str) -> DataFrame:
    """Web-style reading of the benchmark queries: none of them has quotes, ``or`` or exclusions, so the SQL asks for all words."""
    return _lexical(spark, d, "cover", web=True)


_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_SEMANTIC_SQL = f"""vec AS (SELECT id, e, sqrt(list_inner_product(e, e)) AS m FROM (SELECT id, embedding::DOUBLE[] AS e FROM once WHERE {_USABLE})),
 qv AS (SELECT query_id, e, sqrt(list_inner_product(e, e)) AS m FROM (SELECT query_id, embedding::DOUBLE[] AS e FROM queries JOIN embeddings ON vec_id = query_id WHERE {_USABLE})),
 sem AS (SELECT * FROM (SELECT query_id, id, c AS score, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS rank FROM (SELECT q.query_id, v.id, list_inner_product(q.e, v.e) / (q.m * v.m) AS c FROM qv q, vec v)) WHERE rank <= 50)"""
_derived = lambda *names: ", ".join(f"json_extract_string(metadata, '$.{n}')" for n in names)
_HYBRID_SQL = f"""WITH {_ONCE}, {_TERMS_SQL.replace('WHERE_', '')}, {_BM25_SQL}, {_SEMANTIC_SQL}, lex AS ({_top_sql('scored', 50)}),
 merged AS (SELECT coalesce(s.query_id, l.query_id) AS query_id, coalesce(s.id, l.id) AS id, s.rank AS semantic_rank, l.rank AS lexical_rank, round(s.score, 6) AS semantic_score, l.score AS lexical_score,
  CASE WHEN s.id IS NOT NULL AND l.id IS NOT NULL THEN 'both' WHEN s.id IS NOT NULL THEN 'semantic' ELSE 'lexical' END AS provenance FROM sem s FULL JOIN lex l ON s.query_id = l.query_id AND s.id = l.id),
 ordered AS (SELECT m.*, CASE WHEN provenance = 'semantic' THEN o.title ELSE coalesce(o.title, {_derived('article_title', 'title')}) END AS title, CASE WHEN provenance = 'semantic' THEN o.section_path ELSE coalesce(o.section_path, {_derived('section_path', 'section_title')}) END AS section_path,
  o.document_id, o.chunk_index, o.metadata, o.content, row_number() OVER (PARTITION BY query_id ORDER BY semantic_rank NULLS LAST, lexical_rank NULLS LAST, m.id) AS candidate_rank FROM merged m JOIN once o ON o.id = m.id)"""
_SIX = ["title", "section_path", "content", "metadata", "document_id", "chunk_index"]


def _query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the benchmark queries: those of ``embeddings`` under the same number, for no embedder is at hand."""
    vectors = table(spark, d, "embeddings", F.col("vec_id").alias("query_id"), "embedding")
    return table(spark, d, "queries", "query_id").join(vectors, "query_id")


def _semantic(spark: SparkSession, d: str, k: int = 50) -> DataFrame:
    base = table(spark, d, "document_chunks", "id", "embedding").dropDuplicates(["id"])
    return V.topk(base, "id", _query_vectors(spark, d), "query_id", k).withColumnRenamed("similarity", "score")


def _hybrid(spark: SparkSession, d: str, fields: bool = True) -> DataFrame:
    """Vector and lexical hits on the chunks, merged; a title or section that is not stored comes from the lexical row's metadata."""
    semantic, lexical = _semantic(spark, d), _lexical(spark, d, "bm25", k=50)
    if not fields:
        return H.merge(semantic, lexical, "query_id", "id")
    semantic, lexical = written(semantic, "semantic"), written(lexical, "lexical")
    wanted = semantic.select("id").union(lexical.select("id")).distinct()
    # Only the chunks that were found bring their texts.
    found = delivered_once(table(spark, d, "document_chunks", "id", *_SIX, "created_at").join(wanted, "id", "left_semi")).drop("created_at")
    return H.merge(semantic.join(found, "id"), lexical.join(L.search_fields(found), "id"), "query_id", "id", _SIX)


@query(_HYBRID_SQL + " SELECT query_id, id, semantic_rank::VARCHAR AS semantic_rank, lexical_rank::VARCHAR AS lexical_rank, semantic_score, lexical_score, provenance, candidate_rank, title, section_path, document_id, chunk_index, md5(content) AS content_hash, metadata FROM ordered")
def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    ranks = [F.col(c).cast("string") for c in ("semantic_rank", "lexical_rank")]
    return _hybrid(spark, d).select("query_id", "id", *ranks, F.round("semantic_score", 6).alias("semantic_score"), "lexical_score", "provenance", "candidate_rank", "title", "section_path", "document_id", "chunk_index", F.md5("content").alias("content_hash"), "metadata")


@query(_HYBRID_SQL + """ SELECT count(*) AS queries, round(avg(c), 6) AS avg_candidates, min(c) AS min_candidates, max(c) AS max_candidates, round(avg(o), 6) AS avg_overlap
 FROM (SELECT query_id, count(*) AS c, count(*) FILTER (WHERE provenance = 'both') AS o FROM ordered GROUP BY 1)""")
def hybrid_summary(spark: SparkSession, d: str) -> DataFrame:
    return H.merge_summary(_hybrid(spark, d, False), "query_id")


@query(_HYBRID_SQL + """ SELECT query_id, count(*) FILTER (WHERE provenance = 'semantic') AS semantic_only, count(*) FILTER (WHERE provenance = 'lexical') AS lexical_only,
 count(*) FILTER (WHERE provenance = 'both') AS both_sources FROM ordered WHERE candidate_rank <= 60 GROUP BY 1""")
def source_attribution(spark: SparkSession, d: str) -> DataFrame:
    return H.attribution(_hybrid(spark, d, False), "query_id", 60)


_label_sql = lambda t, s: f"concat_ws(chr(10) || chr(10), CASE WHEN {t} <> '' THEN 'Title: ' || {t} END, CASE WHEN {s} <> '' THEN 'Section: ' || {s} END, 'Content:' || chr(10) || coalesce(content, ''))"


@query(_HYBRID_SQL + f""", texts AS (SELECT o.query_id, o.id, o.candidate_rank, {_label_sql("coalesce(nullif(title, ''), " + _derived('article_title', 'title') + ", '')", "coalesce(nullif(section_path, ''), " + _derived('section_path', 'section_title') + ", '')")} AS t, q.query FROM ordered o JOIN queries q ON q.query_id = o.query_id WHERE candidate_rank <= 50),
 sc AS (SELECT query_id, id, candidate_rank AS original_rank, md5(t) AS text_hash, round(coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')))) / nullif(len(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+'))), 0), 0), 6) AS rerank_score FROM texts)
 SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, original_rank, id) AS rank FROM sc) WHERE rank <= 10""")
def rerank_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 hybrid candidates scored on their title, section and content, with metadata for what is missing."""
    cands = _hybrid(spark, d).withColumnRenamed("candidate_rank", "rank").join(table(spark, d, "queries", "query_id", "query"), "query_id")
    cands = cands.withColumn("t", T.hybrid_rerank_text(F.col("title"), F.col("section_path"), F.col("metadata"), F.col("content")))
    out = H.rerank(cands, "query_id", "id", H.overlap_score(F.col("query"), F.col("t")), 50, 10)
    return out.select("query_id", "id", "original_rank", F.md5("t").alias("text_hash"), "rerank_score", "rank")


@query(f"""WITH {_ONCE} SELECT id, coalesce(title, json_extract_string(metadata, '$.article_title'), json_extract_string(metadata, '$.title')) AS title,
 coalesce(section_path, json_extract_string(metadata, '$.section_path'), json_extract_string(metadata, '$.section_title')) AS section_path,
 concat_ws(chr(10), coalesce(title, json_extract_string(metadata, '$.article_title'), json_extract_string(metadata, '$.title')), coalesce(section_path, json_extract_string(metadata, '$.section_path'), json_extract_string(metadata, '$.section_title')), content) AS search_text FROM once""")
def search_fields(spark: SparkSession, d: str) -> DataFrame:
    return L.search_fields(_chunks(spark, d, "title", "section_path", "content", "metadata")).select("id", "title", "section_path", "search_text")


@query(f"""WITH {_ONCE} SELECT id, coalesce(json_extract_string(metadata, '$.article_title'), json_extract_string(metadata, '$.title'), title) AS title,
 coalesce(json_extract_string(metadata, '$.section_path'), json_extract_string(metadata, '$.section_title'), section_path) AS section_path FROM once""")
def search_fields_backfill(spark: SparkSession, d: str) -> DataFrame:
    return L.search_fields(_chunks(spark, d, "title", "section_path", "content", "metadata"), stored_first=False).select("id", "title", "section_path")


_ROUTE_SQL = "routed AS (SELECT query_id, query, expected_route, concat_ws(',', " + ", ".join(
    f"CASE WHEN regexp_matches(query, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, p in H.SIGNALS.items()
) + ", CASE WHEN " + " OR ".join(f"contains(lower(query), '{t}')" for t in H.RARE_TERMS) + " THEN 'rare_exact_term' END) AS matched_signals FROM queries)"


@query(f"WITH {_ROUTE_SQL} SELECT query_id, matched_signals, CASE WHEN matched_signals <> '' THEN 'hybrid' ELSE 'semantic' END AS selected_route FROM routed")
def route_queries(spark: SparkSession, d: str) -> DataFrame:
    return H.route(table(spark, d, "queries", "query_id", "query")).select("query_id", "matched_signals", "selected_route")


@query(f"""WITH {_ROUTE_SQL}, s AS (SELECT *, CASE WHEN matched_signals <> '' THEN 'hybrid' ELSE 'semantic' END AS r FROM routed), h AS (SELECT query_id, count(*) AS c, count(*) FILTER (WHERE source = 'semantic,lexical') AS o FROM (SELECT DISTINCT query_id, chunk_id, source FROM reranked_results WHERE run = 'hybrid') GROUP BY 1)
 SELECT count(*) AS queries, count(*) FILTER (WHERE r = 'hybrid') AS hybrid, count(*) FILTER (WHERE r = 'semantic') AS semantic, count(expected_route) AS labelled, round(avg((r = expected_route)::INT), 6) AS accuracy,
 round(avg(CASE WHEN r = 'hybrid' THEN c END), 6) AS avg_hybrid_candidates, round(avg(CASE WHEN r = 'hybrid' THEN o END), 6) AS avg_hybrid_overlap FROM s LEFT JOIN h USING (query_id)""")
def routing_summary(spark: SparkSession, d: str) -> DataFrame:
    r = H.route(table(spark, d, "queries", "query_id", "query", "expected_route"))
    found = table(spark, d, "reranked_results", "run", "query_id", "chunk_id", "source").where("run = 'hybrid'").drop("run").distinct()
    return H.routing_summary(r.join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("source") == "semantic,lexical").alias("overlap")), "query_id", "left"))


@query(f"""WITH {_ROUTE_SQL}, {_ONCE}, {_TERMS_SQL.replace('WHERE_', '')}, {_BM25_SQL}, {_SEMANTIC_SQL}, lex AS ({_top_sql('scored', 50)}), c AS (SELECT query_id, id, 'semantic' AS route FROM sem UNION SELECT query_id, id, 'hybrid' FROM sem UNION SELECT query_id, id, 'hybrid' FROM lex)
 SELECT r.query_id, r.route AS selected_route, count(c.id) AS candidates, CASE WHEN count(c.id) = 0 THEN 'no candidates' END AS error FROM (SELECT query_id, CASE WHEN matched_signals <> '' THEN 'hybrid' ELSE 'semantic' END AS route FROM routed) r
 LEFT JOIN c ON c.query_id = r.query_id AND c.route = r.route GROUP BY 1, 2""")
def route_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Every query runs the branch of its route; one that finds nothing is a row with an error."""
    queries = H.route(table(spark, d, "queries", "query_id", "query"))
    semantic, lexical = _semantic(spark, d).select("query_id", "id"), _lexical(spark, d, "bm25", k=50).select("query_id", "id")
    branches = {"semantic": lambda q: q.join(semantic, "query_id").select("query_id", "id"), "hybrid": lambda q: q.join(semantic.union(lexical).distinct(), "query_id").select("query_id", "id")}
    found = H.routed(queries, branches).groupBy("query_id").agg(F.count(F.lit(1)).alias("candidates"))
    out = queries.select("query_id", "selected_route").join(found, "query_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return out.withColumn("error", F.when(F.col("candidates") == 0, "no candidates"))


@query("SELECT l_returnflag, count(*) AS queries, " + ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {n}_p{int(100 * p)}" for n, c in (("semantic", "l_quantity"), ("lexical", "l_discount"), ("merge", "l_tax")) for p in (0.5, 0.95)) + ", " + ", ".join("round(" + " + ".join(f"quantile_cont({c}, {p})" for c in ("l_quantity", "l_discount", "l_tax")) + f", 6) AS total_p{int(100 * p)}" for p in (0.5, 0.95)) + " FROM lineitem GROUP BY 1")
def hybrid_latency_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = {"semantic": "l_quantity", "lexical": "l_discount", "merge": "l_tax"}
    return E.latency_parts(table(spark, d, "lineitem", "l_returnflag", *parts.values()), parts, ["l_returnflag"])


_SOURCES = {"semantic_only": "source = 'semantic'", "lexical_only": "source = 'lexical'", "both_sources": "source = 'semantic,lexical'", "unknown": "coalesce(source, '') = ''"}


@query("WITH h AS (SELECT DISTINCT run, query_id, chunk_id, source, rank FROM reranked_results), c AS (SELECT run, query_id, " + ", ".join(f"count(*) FILTER (WHERE {s}) AS before_{n}, count(*) FILTER (WHERE {s} AND rank <= 10) AS after_{n}" for n, s in _SOURCES.items()) + " FROM h GROUP BY 1, 2) SELECT run, count(*) AS queries, " + ", ".join(f"round(avg({t}_{n}), 6) AS avg_{t}_{n}" for n in _SOURCES for t in ("before", "after")) + " FROM c GROUP BY 1")
def provenance_before_after(spark: SparkSession, d: str) -> DataFrame:
    """Average sources of all candidates and of the first ten after reranking."""
    h = table(spark, d, "reranked_results", "run", "query_id", "chunk_id", "source", "rank").distinct()
    counts = [F.count_if(F.expr(s) & w).alias(f"{t}_{n}") for n, s in _SOURCES.items() for t, w in (("before", F.lit(True)), ("after", F.col("rank") <= 10))]
    per = h.groupBy("run", "query_id").agg(*counts)
    return per.groupBy("run").agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(f"{t}_{n}"), 6).alias(f"avg_{t}_{n}") for n in _SOURCES for t in ("before", "after")])


_RERANK_SQL = f"""WITH {_ONCE}, cand AS (SELECT DISTINCT h.query_id, h.rank AS original_rank, h.chunk_id, q.query, coalesce(c.content, '') AS content FROM reranked_results h JOIN queries q USING (query_id) JOIN once c ON c.id = h.chunk_id WHERE h.run = 'flat' AND h.rank <= 20),
 sc AS (SELECT *, round(coalesce(len(list_intersect(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+')))) / nullif(len(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+'))), 0), 0), 6) AS rerank_score FROM cand)
 SELECT query_id, chunk_id, original_rank, rerank_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, original_rank, chunk_id) AS rank FROM sc) WHERE rank <= 10"""


@query(_RERANK_SQL)
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "reranked_results", "run", "query_id", "rank", "chunk_id").where("run = 'flat'").drop("run").distinct()
    wanted = hits.where("rank <= 20").select(F.col("chunk_id").alias("id")).distinct()
    texts = delivered_once(table(spark, d, "document_chunks", "id", "content", "created_at").join(wanted, "id", "left_semi")).select(F.col("id").alias("chunk_id"), "content")
    cands = hits.join(table(spark, d, "queries", "query_id", "query"), "query_id").join(texts, "chunk_id")
    return H.rerank(cands, "query_id", "chunk_id", H.overlap_score(F.col("query"), F.col("content"))).select("query_id", "chunk_id", "original_rank", "rerank_score", "rank")


_LISTS_SQL = """WITH l AS (SELECT query_id, list_sort(list(DISTINCT chunk_id) FILTER (WHERE run = 'hybrid')) AS a, list_sort(list(DISTINCT chunk_id) FILTER (WHERE run = 'ann' AND rank <= 10)) AS b, list_sort(list(DISTINCT chunk_id) FILTER (WHERE run = 'flat')) AS c FROM reranked_results GROUP BY 1)
 SELECT query_id, array_to_string(CASE WHEN coalesce(len(a), 0) > 0 THEN a WHEN coalesce(len(b), 0) > 0 THEN b ELSE c END, ',') AS candidates FROM l"""


@query(_LISTS_SQL)
def candidate_lists(spark: SparkSession, d: str) -> DataFrame:
    """The first list of candidates that has any: expanded (hybrid), original (ann), results (flat)."""
    r = table(spark, d, "reranked_results", "run", "query_id", "chunk_id", "rank")
    own = lambda w: F.array_sort(F.collect_set(F.when(F.expr(w), F.col("chunk_id"))))
    lists = r.groupBy("query_id").agg(own("run = 'hybrid'").alias("a"), own("run = 'ann' and rank <= 10").alias("b"), own("run = 'flat'").alias("c"))
    return lists.select("query_id", F.array_join(H.first_list(F.col("a"), F.col("b"), F.col("c")), ",").alias("candidates"))


_RUNS_SQL = """flat AS (SELECT query_id, chunk_id AS vec_id, min(rank) AS rank FROM reranked_results WHERE run = 'flat' GROUP BY 1, 2), part AS (SELECT query_id, chunk_id AS vec_id, min(rank) AS rank FROM reranked_results WHERE run = 'ann' GROUP BY 1, 2)"""


def _run(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, "reranked_results", "run", "query_id", "chunk_id", "rank").where(F.col("run") == name).groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"))


@query(f"WITH {_RUNS_SQL}{_CAPPED} SELECT * FROM metrics")
def rerank_compare(spark: SparkSession, d: str) -> DataFrame:
    return E.ranking_metrics(_run(spark, d, "flat"), _run(spark, d, "ann"), "query_id", "chunk_id", [5, 10, 50], True)


@query("""WITH h AS (SELECT DISTINCT run, query_id, rank, chunk_id, source FROM reranked_results) SELECT run, query_id, count(*) FILTER (WHERE source = 'semantic') AS semantic_only, count(*) FILTER (WHERE source = 'lexical') AS lexical_only,
 count(*) FILTER (WHERE source NOT IN ('semantic', 'lexical')) AS other, count(*) FILTER (WHERE source IS NULL) AS unknown FROM h WHERE rank <= 10 GROUP BY 1, 2""")
def reranked_provenance(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "reranked_results", "run", "query_id", "rank", "chunk_id", "source").distinct().where("rank <= 10")
    s = F.col("source")
    return h.groupBy("run", "query_id").agg(F.count_if(s == "semantic").alias("semantic_only"), F.count_if(s == "lexical").alias("lexical_only"), F.count_if(~s.isin("semantic", "lexical")).alias("other"), F.count_if(s.isNull()).alias("unknown"))
