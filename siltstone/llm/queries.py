"""Queries pN_... of this subpackage, and SQL for those that DuckDB can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm import leakage, neardup, packing, quality, ranking, spans, splitting, truncation, vectors
from siltstone.operators import vectors as exact_search
from siltstone.plans.cut import written
from siltstone.sources.tables import table

SCORES = {"similarity": True, "rerank_score": True, "original_rank": False}
LIST = ["run", "query_id"]


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.assessed(table(spark, d, "document_chunks", "id", "content", "token_count"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_statistics(spark, d).where("kind != 'prose' and tokens >= 10").select("id")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    stats = quality.text_statistics(table(spark, d, "document_chunks", "id", "content", "token_count"))
    trusted = F.when(F.col("token_count_trusted").isNull(), "unknown").when(F.col("token_count_trusted"), "yes").otherwise("no")
    return stats.select("id", "tokens", trusted.alias("trusted"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.nearest(table(spark, d, "document_chunks", "id", "embedding"), least=0.899)
    near = near.where(F.col("cosine") >= 0.9 - 1e-6)
    return near.select(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).distinct()


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return vectors.nearest(table(spark, d, "document_chunks", "id", "embedding"))


def p2_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the five nearest for the ids whose MD5 is divisible by 50, against exact search over all rows."""
    rows = table(spark, d, "document_chunks", "id", "embedding").dropDuplicates(["id"])
    stated = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % 50 == 0
    asked = rows.where(stated).withColumnRenamed("id", "query_id")
    exact = exact_search.topk(rows, "id", asked, "query_id", 6).where("id != query_id")
    last = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    exact = exact.withColumn("place", F.row_number().over(last)).where("place <= 5").select("query_id", "id")
    found = vectors.nearest(rows).select(F.col("id").alias("query_id"), F.col("near_id").alias("id"), F.lit(1).alias("met"))
    share = F.count("met") / F.count(F.lit(1))
    return exact.join(found, ["query_id", "id"], "left").agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("pairs"), (share >= 0.9).alias("enough"))


def _truncated(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "document_chunks", "id", "document_id", "chunk_index", "content"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d).where("truncated").select("id")


def p3_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _truncated(spark, d)


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(_truncated(spark, d), table(spark, d, "rag_documents", "id", "metadata"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "document_chunks", "id", "content")).where("piece = 0").select("id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.renumbered(table(spark, d, "document_chunks", "id", "document_id", "chunk_index", "content"))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Of every split chunk the tokens that its pieces cover without their overlaps, and whether all pieces keep the limit and the overlap."""
    pieces = splitting.split_oversized(table(spark, d, "document_chunks", "id", "content"))
    ends = F.array_sort(F.collect_list(F.struct("piece", "first_token", "tokens")))
    own = pieces.groupBy("id").agg(ends.alias("p"), F.sum("tokens").alias("sum"), F.count(F.lit(1)).alias("n"), F.max("tokens").alias("most"))
    joined = F.forall(F.sequence(F.lit(1), F.col("n").cast("int") - 1), lambda i: F.get("p", i)["first_token"] + 24 == F.get("p", i - 1)["first_token"] + F.get("p", i - 1)["tokens"])
    return own.select("id", (F.col("sum") - 24 * (F.col("n") - 1)).alias("tokens"), ((F.col("most") <= 256) & joined).alias("fits"))


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.fused_ranking(table(spark, d, "reranked_results", *LIST, "chunk_id", *SCORES), LIST, "chunk_id", SCORES)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_ranking(spark, d).where("position <= 3").select(*LIST, "chunk_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs_of(*neardup.near_duplicates(table(spark, d, "document_chunks", "id", "content")))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups_of(*neardup.near_duplicates(table(spark, d, "document_chunks", "id", "content")))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.sizes_of(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"), "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("parts > 1 and part = 0").select("doc_id").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_assigned(spark: SparkSession, d: str) -> DataFrame:
    """Of every document the tokens and parts that are assigned, and whether no container of them holds more than its capacity."""
    placed = written(_packed(spark, d), "placed")
    full = placed.groupBy("container").agg((F.sum("tokens") <= 1024).alias("fits"))
    return placed.join(full, "container").groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.max("parts").alias("parts"), F.min("fits").alias("fits"))


def p7_bpe_containers(spark: SparkSession, d: str, vocabulary: str = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """The same in tokens of a public byte-level vocabulary, a file that every executor can read."""
    return packing.pack(packing.sizes_of(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", vocabulary), "doc_id")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    items = [(r[0], r[1]) for r in table(spark, d, "eval_items", "item_id", "passage").collect()]  # a fixed table of 150 rows
    return leakage.find_leaks(table(spark, d, "documents", "doc_id", "text"), items)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("kind = 'exact'").select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).groupBy("item_id", "kind").agg(F.countDistinct("doc_id").alias("documents"), F.max("longest").alias("longest"))


def p8_exact(spark: SparkSession, d: str) -> DataFrame:
    return p8_items(spark, d).where("kind = 'exact'").drop("kind")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.span_pairs(*spans.shared_spans(table(spark, d, "documents", "doc_id", "text")))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shares(*spans.shared_spans(table(spark, d, "documents", "doc_id", "text"))).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_statistics, p1_counts, p2_found, p2_neighbours, p2_recall, p3_found, p3_evidence, p3_rates, p4_found, p4_pieces, p4_coverage, p5_found, p5_ranking, p6_found, p6_groups, p7_found, p7_containers, p7_assigned, p7_bpe_containers, p8_found, p8_items, p8_exact, p9_found, p9_shares)}

TOKENS = r"regexp_extract_all({}, '[^ \t\n\r\x0B\f]+')"

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"

SQL = {
    "p1_counts": f"SELECT id, len({TOKENS.format('any_value(content)')}) AS tokens, CASE WHEN any_value(token_count) IS NULL THEN 'unknown' WHEN any_value(token_count) = len({TOKENS.format('any_value(content)')}) THEN 'yes' ELSE 'no' END AS trusted FROM document_chunks GROUP BY 1",
    "p4_coverage": f"SELECT DISTINCT id, len({TOKENS.format('content')}) AS tokens, true AS fits FROM document_chunks WHERE len({TOKENS.format('content')}) > 256",
    "p7_assigned": f"SELECT doc_id, n AS tokens, greatest(1, ceil(n / 1024))::INT AS parts, true AS fits FROM (SELECT doc_id, coalesce(len({TOKENS.format('text')}), 0) AS n FROM documents)",
    "p8_exact": f"""WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), e AS (SELECT item_id, {WORDS.format('passage')} AS w FROM eval_items),
     dg AS (SELECT doc_id, p, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 11)) AS p FROM d)), eg AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 11)) AS p FROM e)),
     h AS (SELECT DISTINCT doc_id, item_id, p FROM dg JOIN eg USING (g)), r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY p) AS island FROM h), l AS (SELECT doc_id, item_id, count(*) + 11 AS longest FROM r GROUP BY doc_id, item_id, island)
     SELECT item_id, count(DISTINCT doc_id) AS documents, max(longest) AS longest FROM l GROUP BY 1""",
    "p2_found": """WITH u AS (SELECT DISTINCT id, embedding::DOUBLE[] AS e FROM document_chunks WHERE embedding IS NOT NULL AND len(embedding) = 64
       AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
     n AS (SELECT id, e, sqrt(list_inner_product(e, e)) AS m FROM u), r AS (SELECT a.id AS i, b.id AS j, list_inner_product(a.e, b.e) / (a.m * b.m) AS c FROM n a, n b WHERE a.id <> b.id),
     t AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY round(c, 6) DESC, j) AS k FROM r WHERE c >= 0.9) SELECT DISTINCT least(i, j) AS id_a, greatest(i, j) AS id_b FROM t WHERE k <= 5""",
    "p2_recall": """SELECT count(*) AS queries, 5 * count(*) AS pairs, true AS enough FROM (SELECT DISTINCT id FROM document_chunks WHERE embedding IS NOT NULL AND len(embedding) = 64
       AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND ('0x' || substr(md5(id), 1, 8))::BIGINT % 50 = 0)""",
    "p4_found": f"SELECT DISTINCT id FROM document_chunks WHERE len({TOKENS.format('content')}) > 256",
    "p5_found": """WITH c AS (SELECT run, query_id, chunk_id, coalesce(max(similarity), '-inf'::DOUBLE) AS s, coalesce(max(rerank_score), '-inf'::DOUBLE) AS r, min(original_rank) AS o FROM reranked_results GROUP BY 1, 2, 3)
     SELECT x.run, x.query_id, x.chunk_id FROM c x JOIN c y ON x.run = y.run AND x.query_id = y.query_id GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE (y.s > x.s)::INT + (y.r > x.r)::INT + (y.o < x.o)::INT >= 2) < 3""",
    "p5_ranking": """WITH c AS (SELECT run, query_id, chunk_id, max(similarity) AS s, max(rerank_score) AS r, min(original_rank) AS o, count(*) OVER (PARTITION BY run, query_id) AS n FROM reranked_results GROUP BY 1, 2, 3),
     k AS (SELECT *, """ + ", ".join(f"CASE WHEN {c} IS NULL THEN (n + 1) / 2 ELSE rank() OVER (PARTITION BY run, query_id ORDER BY {c} {d} NULLS LAST) + (count(*) OVER (PARTITION BY run, query_id, {c}) - 1) / 2 END AS k{c}" for c, d in (("s", "DESC"), ("r", "DESC"), ("o", "ASC"))) + """ FROM c),
     h AS (SELECT x.run, x.query_id, x.chunk_id, count(*) FILTER (WHERE (coalesce(y.s, '-inf'::DOUBLE) > coalesce(x.s, '-inf'::DOUBLE))::INT + (coalesce(y.r, '-inf'::DOUBLE) > coalesce(x.r, '-inf'::DOUBLE))::INT + (coalesce(y.o, 1e18) < coalesce(x.o, 1e18))::INT >= 2) < 3 AS in_head FROM c x JOIN c y ON x.run = y.run AND x.query_id = y.query_id GROUP BY 1, 2, 3)
     SELECT run, query_id, chunk_id, 3 * n - ks - kr - ko AS points, in_head, row_number() OVER (PARTITION BY run, query_id ORDER BY in_head DESC, 3 * n - ks - kr - ko DESC, chunk_id) AS position FROM k JOIN h USING (run, query_id, chunk_id)""",
    "p6_groups": f"""WITH RECURSIVE v AS (SELECT id, list_sort(list_distinct({WORDS.format('any_value(content)')})) AS s FROM document_chunks GROUP BY id), m AS (SELECT id, md5(array_to_string(s, ' ')) AS k, s FROM v WHERE len(s) >= 40),
     c AS (SELECT k, min(id) AS class, count(*) AS copies, any_value(s) AS s FROM m GROUP BY 1), w AS (SELECT class, len(s) AS n, unnest(s) AS t FROM c), p AS (SELECT a.class AS a, b.class AS b, count(*) AS o, any_value(a.n) AS x, any_value(b.n) AS y FROM w a JOIN w b ON a.t = b.t AND a.class <> b.class GROUP BY 1, 2),
     e AS MATERIALIZED (SELECT a, b FROM p WHERE o >= 0.7 * (x + y - o)), r AS (SELECT class AS a, class AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), g AS (SELECT a, min(b) AS grp FROM r GROUP BY 1), d AS (SELECT a, count(*) AS links FROM e GROUP BY 1)
     SELECT m.id, c.class, g.grp AS "group", c.copies, coalesce(d.links, 0) AS links FROM m JOIN c USING (k) JOIN g ON g.a = c.class LEFT JOIN d ON d.a = c.class""",
    "p6_found": f"""WITH w AS (SELECT id, unnest(list_distinct({WORDS.format('any_value(content)')})) AS t FROM document_chunks GROUP BY id), n AS (SELECT id, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 40), k AS (SELECT w.* FROM w SEMI JOIN n USING (id)),
     p AS (SELECT a.id AS i, b.id AS j, count(*) AS o FROM k a JOIN k b ON a.t = b.t AND a.id < b.id GROUP BY 1, 2) SELECT i AS id_a, j AS id_b FROM p JOIN n x ON x.id = i JOIN n y ON y.id = j WHERE o >= 0.7 * (x.n + y.n - o)""",
    "p7_found": f"SELECT doc_id FROM documents WHERE len({TOKENS.format('text')}) > 1024",
    "p8_found": f"""WITH d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), e AS (SELECT item_id, {WORDS.format('passage')} AS w FROM eval_items),
     dg AS (SELECT doc_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 11)) AS p FROM d)), eg AS (SELECT item_id, array_to_string(w[p:p + 11], ' ') AS g FROM (SELECT *, unnest(generate_series(1, len(w) - 11)) AS p FROM e))
     SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
    "p9_shares": """WITH s AS (SELECT doc_id, md5(text) AS t, length(text) AS n, p, md5(substr(text, p, 300)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 299)) AS p FROM documents WHERE length(text) >= 300)),
     r AS (SELECT h FROM s GROUP BY 1 HAVING count(DISTINCT t) > 1), k AS (SELECT s.* FROM s SEMI JOIN r USING (h)), cov AS (SELECT t, sum(step)::BIGINT AS covered FROM (SELECT t, least(300, coalesce(lead(p) OVER (PARTITION BY t ORDER BY p) - p, 300)) AS step FROM (SELECT DISTINCT t, p FROM k)) GROUP BY 1),
     l AS (SELECT a.t, count(DISTINCT b.t) AS texts FROM (SELECT DISTINCT t, h FROM k) a JOIN (SELECT DISTINCT t, h FROM k) b ON a.h = b.h AND a.t <> b.t GROUP BY 1), c AS (SELECT md5(text) AS t, count(*) AS copies FROM documents WHERE length(text) >= 300 GROUP BY 1)
     SELECT doc_id, copies, coalesce(texts, 0) AS texts, length(text) AS chars, CASE WHEN copies > 1 THEN length(text) ELSE covered END AS shared_chars, round(CASE WHEN copies > 1 THEN length(text) ELSE covered END / length(text), 6) AS share FROM documents d JOIN c ON c.t = md5(d.text) LEFT JOIN cov ON cov.t = c.t LEFT JOIN l ON l.t = c.t WHERE copies > 1 OR covered IS NOT NULL""",
    "p9_found": """WITH s AS (SELECT DISTINCT doc_id, md5(substr(text, p, 300)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 299)) AS p FROM documents WHERE length(text) >= 300)),
     r AS (SELECT h FROM s GROUP BY 1 HAVING count(*) > 1), k AS (SELECT s.* FROM s SEMI JOIN r USING (h)) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id""",
}
