"""Queries over model calls (with offline providers), ingestion runs, resumed and staged runs, and learned models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import json as J
from siltstone.functions import text as T
from siltstone.operators import chunking as C
from siltstone.operators import evaluation as E
from siltstone.operators import hybrid as H
from siltstone.operators import ingest as I
from siltstone.operators import models as M
from siltstone.plans.cut import scratch, written
from siltstone.plans.queries_search import _around
from siltstone.plans.ranks import row_numbers
from siltstone.plans.registry import query
from siltstone.sources import reports as R
from siltstone.sources.tables import delivered_once, table

_WS, _NOT = r"[ \t\n\r\x0B\f]", r"[^ \t\n\r\x0B\f]"
_strip = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_count = lambda x: f"coalesce(len(regexp_extract_all({x}, '{_NOT}+')), 0)"
_set = lambda x: f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '{_NOT}+'))"
_covered = lambda q, t: f"coalesce(len(list_intersect({_set(q)}, {_set(t)})) / nullif(len({_set(q)}), 0), 0)"
_grade = lambda s: f"(1 + floor(4 * ({s}) + 0.5))::INT"
_ONCE = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM document_chunks) WHERE rn = 1)"

# --- summaries of documents

_SENTENCES = f"s AS (SELECT doc_id, list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(10), ' '), '. '), lambda x: {_strip('x')}), lambda x: x <> '') AS s FROM documents)"
_BODY = f"{{'summary': s[1], 'key_points': CASE WHEN len(s) >= 3 THEN s[1:5] ELSE list_concat(s, list_concat(s, s))[1:3] END, 'sentiment': 'neutral', 'entities': list_filter(regexp_extract_all(s[1], '{_NOT}+'), lambda w: regexp_matches(w, '^\\p{{Lu}}'))[1:5], 'why_it_matters': CASE WHEN len(s) = 2 THEN s[1] ELSE s[-1] END}}"


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    return M.summarized(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query(f"WITH {_SENTENCES} SELECT doc_id, len(s) >= 1 AS success, len(s) < 3 AS repair_used, CASE WHEN len(s) < 1 THEN 'summary must be a non-empty string' END AS error, CASE WHEN len(s) >= 1 THEN s[1] END AS summary FROM s")
def summarize_validate_repair(spark: SparkSession, d: str) -> DataFrame:
    return _summaries(spark, d).select("doc_id", "success", "repair_used", "error", J.field(F.col("reply"), "summary").alias("summary"))


@query(f"WITH {_SENTENCES} SELECT doc_id, to_json({_BODY}) AS target FROM s WHERE len(s) >= 1")
def teacher_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels of a teacher as JSON of fixed key order, lists as lists."""
    return _summaries(spark, d).where("success").select("doc_id", J.target(F.col("reply")).alias("target"))


@query(f"""WITH {_SENTENCES}, r AS (SELECT doc_id, len(s) < 3 AS again, len(s) >= 1 AS ok, {_count('text')} AS n FROM s JOIN documents USING (doc_id)), o AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM r)
 SELECT batch, min(doc_id) AS first_id, count(*) AS rows, count(*) FILTER (WHERE ok) AS succeeded, count(*) FILTER (WHERE again) AS repaired, sum(CASE WHEN again THEN 2 * n ELSE n END)::BIGINT AS input_tokens, true AS timed FROM o GROUP BY 1""")
def inference_run(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 64 documents in order with what they succeeded in, repaired and read; whether time was taken, for times differ from run to run."""
    done = written(_summaries(spark, d).withColumn("_g", F.lit(0)), "summaries")
    numbered = row_numbers(done, ["_g"], "doc_id", "doc_id", "n").withColumn("batch", F.floor((F.col("n") - 1) / 64))
    return numbered.groupBy("batch").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows"), F.count_if("success").alias("succeeded"), F.count_if("repair_used").alias("repaired"), F.sum("input_tokens").alias("input_tokens"), (F.sum("seconds") > 0).alias("timed"))


@query("""WITH f AS (SELECT event_type || '-' || (event_id % 50) AS batch, sum(value) AS t, sum(event_id % 97)::BIGINT AS i, sum(event_id % 31)::BIGINT AS o FROM events WHERE event_id % 3 <> 0 GROUP BY 1), r AS (SELECT event_type || '-' || (event_id % 50) AS batch, sum(value) AS t, sum(event_id % 97)::BIGINT AS i, sum(event_id % 31)::BIGINT AS o FROM events WHERE event_id % 15 = 0 GROUP BY 1)
 SELECT batch, round(f.t, 4) AS first_pass_time_sec, f.i AS first_pass_input_tokens, f.o AS first_pass_output_tokens, round(coalesce(r.t, 0), 4) AS repair_time_sec, coalesce(r.i, 0) AS repair_input_tokens, coalesce(r.o, 0) AS repair_output_tokens, round(f.t + coalesce(r.t, 0), 4) AS total_generation_time_sec,
  f.i + coalesce(r.i, 0) AS total_input_tokens, f.o + coalesce(r.o, 0) AS total_output_tokens, f.i + coalesce(r.i, 0) + f.o + coalesce(r.o, 0) AS total_tokens, round((f.i + coalesce(r.i, 0) + f.o + coalesce(r.o, 0)) / (f.t + coalesce(r.t, 0)), 4) AS tokens_per_sec, r.batch IS NOT NULL AS repair_used FROM f LEFT JOIN r USING (batch)""")
def generation_metrics(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events", "event_id", "event_type", "value").withColumn("batch", F.concat("event_type", F.lit("-"), (F.col("event_id") % 50).cast("string")))
    each = lambda w: ev.where(w).groupBy("batch").agg(F.sum("value").alias("batch_time_sec"), F.sum(F.col("event_id") % 97).alias("input_tokens"), F.sum(F.col("event_id") % 31).alias("output_tokens"))
    merged = M.merged_metrics(each("event_id % 3 <> 0"), each("event_id % 15 = 0"), "batch")
    return merged.withColumns({c: F.round(c, 4) for c in ("first_pass_time_sec", "repair_time_sec", "total_generation_time_sec", "tokens_per_sec")})


# --- judges of contexts and answers

_CONTEXT_SQL = f"""{_ONCE}, hits AS (SELECT DISTINCT query_id, rank, chunk_id, title FROM reranked_results WHERE run = 'flat' AND rank <= 3),
 ctx AS (SELECT query_id, string_agg(coalesce(content, ''), chr(10) || chr(10) ORDER BY rank, chunk_id) AS context, list(chunk_id ORDER BY rank, chunk_id) AS source_chunk_ids, list(coalesce(h.title, '') ORDER BY rank, chunk_id) AS source_titles FROM hits h LEFT JOIN once c ON c.id = h.chunk_id GROUP BY 1),
 asked AS (SELECT q.query_id, query, coalesce(context, '') AS context, source_chunk_ids, source_titles FROM queries q LEFT JOIN ctx USING (query_id)),
 cj AS (SELECT query_id, share, CASE WHEN share >= 0.6 THEN 'yes' WHEN share >= 0.3 THEN 'partial' ELSE 'no' END AS answerability, {_grade('share')} AS context_relevance_score, {_grade('share')} AS context_completeness_score, CASE WHEN context <> '' THEN 5 ELSE 1 END AS context_coherence_score, {_grade('1 - share')} AS noise_score,
  array_to_string(list_sort(missing), ' ') AS missing_information, CASE WHEN share >= 0.6 THEN 'none' WHEN share >= 0.3 THEN 'insufficient_detail' ELSE 'retrieval_miss' END AS failure_type, (words - len(missing)) || ' of ' || words || ' words found' AS reason, {_count('query')} + {_count('context')} AS prompt_tokens, 8 AS completion_tokens
  FROM (SELECT *, {_covered('query', 'context')} AS share, len({_set('query')}) AS words, list_filter({_set('query')}, lambda w: NOT list_contains({_set('context')}, w)) AS missing FROM asked))"""
_quoted = lambda x: x.replace("'", "''")
_ANSWER_SQL = f"""{_CONTEXT_SQL}, ans AS (SELECT *, CASE WHEN coalesce(len(source_chunk_ids), 0) = 0 THEN '{_quoted(M.NO_CONTEXT)}' WHEN {_covered('query', 'context')} = 0 THEN '{_quoted(M.NOT_IN_CONTEXT)}' ELSE {_strip("string_split(context, '. ')[1]")} || ' [Source 1]' END AS answer FROM asked),
 aj AS (SELECT *, CASE WHEN u >= 0.4 THEN 'yes' WHEN u >= 0.2 THEN 'partial' ELSE 'no' END AS answerability, {_grade('u')} AS answerability_score, {_grade('g')} AS groundedness_score, {_grade('u')} AS completeness_score, {_grade('r')} AS context_relevance_score, {_grade('r')} AS context_completeness_score,
  CASE WHEN u >= 0.4 THEN 'none' WHEN u >= 0.2 THEN 'incomplete_answer' ELSE 'unanswerable' END AS failure_type, n AS prompt_tokens, 10 AS completion_tokens FROM (SELECT *, {_covered('query', 'answer')} AS u, {_covered('answer', 'context')} AS g, {_covered('query', 'context')} AS r, {_count('query')} + {_count('answer')} + {_count('context')} AS n FROM ans))"""


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, query, context, source_chunk_ids, source_titles, found): the first three exact hits of every query."""
    hits = table(spark, d, "reranked_results", "run", "query_id", "rank", "chunk_id", "title").where("run = 'flat' and rank <= 3").drop("run").distinct()
    wanted = hits.select(F.col("chunk_id").alias("id")).distinct()
    # Texts of the hits only; a chunk that was delivered again is one.
    chunks = delivered_once(table(spark, d, "document_chunks", "id", "content", "created_at").join(wanted, "id", "left_semi")).select(F.col("id").alias("chunk_id"), "content")
    rows = hits.join(chunks, "chunk_id", "left")
    own = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.coalesce("content", F.lit("")).alias("t"), F.coalesce("title", F.lit("")).alias("title"))))
    context = rows.groupBy("query_id").agg(own.alias("h")).select("query_id", F.array_join("h.t", "\n\n").alias("context"), F.col("h.chunk_id").alias("source_chunk_ids"), F.col("h.title").alias("source_titles"))
    asked = table(spark, d, "queries", "query_id", "query").join(context, "query_id", "left")
    return asked.withColumns({"context": F.coalesce("context", F.lit("")), "found": F.lit(True)})


@query(f"WITH {_CONTEXT_SQL} SELECT * EXCLUDE (share) FROM cj")
def context_judgments(spark: SparkSession, d: str) -> DataFrame:
    return M.judged(_contexts(spark, d), "query", "context").select("query_id", "judgment.*")


@query(f"WITH {_ANSWER_SQL} SELECT query_id, answer, coalesce(len(source_chunk_ids), 0) AS sources FROM ans")
def grounded_answers(spark: SparkSession, d: str) -> DataFrame:
    out = M.answered(_contexts(spark, d), "query", "context", "source_chunk_ids", "found")
    return out.select("query_id", "answer", F.coalesce(F.size("source_chunk_ids"), F.lit(0)).alias("sources"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    out = M.answered(_contexts(spark, d), "query", "context", "source_chunk_ids", "found")
    return M.answers_judged(out, "query", "answer", "context")


@query(f"""WITH {_ANSWER_SQL} SELECT query_id, answerability, answerability_score, groundedness_score, completeness_score, context_relevance_score, context_completeness_score, failure_type, '' AS reason, prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens,
 round(prompt_tokens / 1e6 * 0.40 + completion_tokens / 1e6 * 1.60, 9) AS cost_usd, 'offline-overlap' AS model, true AS timed FROM aj""")
def answer_judgments(spark: SparkSession, d: str) -> DataFrame:
    """Judged answers with usage and cost; of the latency only whether it was taken, for it differs from run to run."""
    out = _answers(spark, d).select("query_id", "judgment.*", "total_tokens", F.round("cost_usd", 9).alias("cost_usd"), "model")
    return out.withColumn("timed", F.col("latency_ms").isNotNull()).drop("latency_ms")


@query(f"""WITH {_ANSWER_SQL}, a AS (SELECT * FROM cj WHERE query_id % 7 <> 0), b AS (SELECT * FROM aj WHERE query_id % 5 <> 0)
 SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.answerability, 'missing') AS context_answerability, coalesce(b.answerability, 'missing') AS answer_answerability, coalesce(a.failure_type, '') AS context_failure_type, coalesce(b.failure_type, '') AS answer_failure_type,
  a.context_relevance_score::VARCHAR AS context_relevance_score, a.context_completeness_score::VARCHAR AS context_completeness_score, b.answerability_score::VARCHAR AS answer_answerability_score, b.groundedness_score::VARCHAR AS answer_groundedness_score, b.completeness_score::VARCHAR AS answer_completeness_score,
  coalesce(array_to_string(b.source_titles, '|'), '') AS source_titles, coalesce(array_to_string(b.source_chunk_ids, '|'), '') AS source_chunk_ids, coalesce(b.answer, '') AS answer, coalesce(a.reason, '') AS context_reason, '' AS answer_reason FROM a FULL JOIN b ON a.query_id = b.query_id""")
def compact_cases(spark: SparkSession, d: str) -> DataFrame:
    """Context judgments beside answer judgments where each side lacks some queries, so every fallback occurs."""
    context = M.judged(_contexts(spark, d), "query", "context").where("query_id % 7 <> 0")
    cases = E.compact_cases(context, _answers(spark, d).where("query_id % 5 <> 0"), "query_id")
    scores = [c for c in cases.columns if c.endswith("_score")]
    return cases.withColumns({**{c: F.col(c).cast("string") for c in scores}, **{c: F.array_join(c, "|") for c in ("source_titles", "source_chunk_ids")}})


@query("""WITH known AS (SELECT DISTINCT query FROM queries WHERE query_id % 3 <> 0) SELECT count(*) FILTER (WHERE k.query IS NOT NULL) AS answered, count(*) FILTER (WHERE k.query IS NULL) AS skipped FROM queries q LEFT JOIN known k ON k.query = q.query""")
def known_queries(spark: SparkSession, d: str) -> DataFrame:
    """Of the queries of a report, how many belong to the evaluation set and how many are skipped."""
    q = table(spark, d, "queries", "query_id", "query")
    return R.membership(q, q.where("query_id % 3 <> 0"), "query")


# --- pairwise judges

_PAIR = "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS price_a, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE 100000.0 END AS price_b, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey * 10.0 END AS price_c FROM orders"


def _verdict_sql(names: str) -> str:
    best = f"greatest({', '.join(f'price_{n}' for n in names)})"
    wins = " + ".join(f"(price_{n} = best)::INT" for n in names)
    first = " ".join(f"WHEN price_{n} = best THEN '{n}'" for n in names)
    return f"""WITH p AS (SELECT *, {best} AS best, least({', '.join(f'price_{n}' for n in names)}) AS worst FROM ({_PAIR})) SELECT o_orderkey, best IS NOT NULL AS judge_success, CASE WHEN best IS NULL THEN 'No JSON object found in model output.' END AS judge_error,
 CASE WHEN best IS NULL THEN NULL WHEN {wins} > 1 THEN 'tie' {first} END AS winner, round(best - worst, 2) AS margin FROM p"""


def _compared(spark: SparkSession, d: str, names: str) -> DataFrame:
    pairs = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    lost = F.col("o_orderkey") % 11 == 0
    price = {"a": F.col("o_totalprice"), "b": F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice")).otherwise(100000.0), "c": F.col("o_custkey") * 10.0}
    frame = pairs.select("o_orderkey", "o_orderstatus", *[F.when(~lost, p).alias(f"price_{n}") for n, p in price.items()])
    return M.candidates_judged(frame, {n: f"price_{n}" for n in names}).select("o_orderkey", "judge_success", "judge_error", "winner", F.round("margin", 2).alias("margin"))


@query(_verdict_sql("ab"))
def pairwise_judge(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d, "ab")


@query(_verdict_sql("abc"))
def three_way_judge(spark: SparkSession, d: str) -> DataFrame:
    return _compared(spark, d, "abc")


# --- ingestion

_FIXED_SQL = f"""d AS (SELECT doc_id, {_strip('title')} AS title, {_strip('text')} AS text, url FROM documents), ok AS (SELECT *, regexp_extract_all(text, '{_WS}*{_NOT}+') AS t FROM d WHERE length(title) > 0 AND length(text) >= 500),
 win AS (SELECT doc_id, title, url, text, t, unnest(generate_series(0, CASE WHEN len(t) <= 256 THEN 0 ELSE ceil((len(t) - 256) / 232)::BIGINT * 232 END, 232)) AS a FROM ok), ch AS (SELECT doc_id, title, url, text, (a / 232)::INT AS chunk_index, {_strip("array_to_string(t[a + 1:a + 256], '')")} AS content FROM win)"""


@query(f"""WITH {_FIXED_SQL} SELECT substr(sha256('fixed_overlap|' || doc_id || '|' || sha256(text)), 1, 16) AS document_id, any_value(title) AS title, any_value(url) AS source_url, sha256(any_value(text)) AS article_hash, count(*) AS chunk_count, sum({_count('content')})::BIGINT AS tokens, 64 AS dims, max(chunk_index) AS last_index FROM ch GROUP BY doc_id, text""")
def ingest_run(spark: SparkSession, d: str) -> DataFrame:
    """Documents and chunks as an ingestion with fixed windows has written them, read again."""
    docs = table(spark, d, "documents", "doc_id", "title", "text", "url")
    documents, chunks = I.ingest(docs, scratch(spark, "ingest"), strategy="fixed_overlap")
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("token_count").alias("tokens"), F.max(F.size("embedding")).alias("dims"), F.max("chunk_index").alias("last_index"))
    return documents.join(counts, documents["id"] == counts["document_id"]).select("document_id", "title", "source_url", J.field(F.col("metadata"), "article_hash").alias("article_hash"), "chunk_count", "tokens", "dims", "last_index")


@query()
def ingest_sections_run(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "title", "text", "url")
    documents, chunks = I.ingest(docs, scratch(spark, "ingest"))
    return documents.select(F.col("id").alias("document_id"), J.field(F.col("metadata"), "chunk_count").cast("int").alias("chunk_count")).join(chunks.groupBy("document_id").agg(F.sum("token_count").alias("tokens")), "document_id")


@query()
def chunk_preview(spark: SparkSession, d: str) -> DataFrame:
    return I.preview(table(spark, d, "documents", "doc_id", "title", "text"), "doc_id", "title", "text", documents=3)


@query(f"WITH t AS (SELECT id, any_value(regexp_extract_all(content, '{_WS}*{_NOT}+')) AS t FROM document_chunks GROUP BY id) SELECT id, array_to_string(t[-24:], '') AS overlap_text FROM t")
def overlap_texts(spark: SparkSession, d: str) -> DataFrame:
    """The last 24 tokens of each chunk, as the next window would begin."""
    return table(spark, d, "document_chunks", "id", C.overlap_text(F.col("content")).alias("overlap_text")).dropDuplicates(["id"])


@query("SELECT doc_id, 64 AS dims FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r\\x0B\\f]') UNION ALL SELECT doc_id, -1 FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '[^ \\t\\n\\r\\x0B\\f]')")
def embed_texts(spark: SparkSession, d: str) -> DataFrame:
    return M.embedded(table(spark, d, "documents", "doc_id", "text"), "text").select("doc_id", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dims"))


# --- scans of corpora, constants, ids

@query("SELECT md5(text) AS text_hash, count(*) AS n FROM documents GROUP BY 1")
def corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    return R.read_corpus(table(spark, d, "documents")).groupBy(F.md5("article_text").alias("text_hash")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def split_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A corpus written as one folder per split and read with its split as a column."""
    path = scratch(spark, "corpus")
    docs = table(spark, d, "documents", "doc_id", "lang")
    for name, rest in (("train", 0), ("test", 1)):
        docs.where(F.col("doc_id") % 2 == rest).write.parquet(f"{path}/{name}")
    return R.read_splits(spark, path, ["train", "test"]).groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"))


_CONSTANTS = [("Events of 1998", "hybrid"), ("why do rivers bend", "semantic"), ("HTTP 404", "hybrid"), ("Y2K scare", "hybrid")]


@query("SELECT query, expected_route, route AS selected_route, route = expected_route AS correct FROM (VALUES ('Events of 1998', 'hybrid', 'hybrid'), ('why do rivers bend', 'semantic', 'semantic'), ('HTTP 404', 'hybrid', 'hybrid'), ('Y2K scare', 'hybrid', 'semantic')) t(query, expected_route, route)")
def constant_queries(spark: SparkSession, d: str) -> DataFrame:
    """Labelled queries as a constant relation, routed."""
    rows = spark.createDataFrame(_CONSTANTS, "query string, expected_route string")
    return H.route(rows).select("query", "expected_route", "selected_route", (F.col("selected_route") == F.col("expected_route")).alias("correct"))


@query("SELECT run, query_id, rank, coalesce(CASE WHEN rank % 2 = 0 THEN chunk_id END, CASE WHEN rank % 3 <> 0 THEN chunk_id END, '') AS chunk_id FROM (SELECT DISTINCT run, query_id, rank, chunk_id FROM reranked_results)")
def normalized_ids(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, else id, else the empty text."""
    r = table(spark, d, "reranked_results", "run", "query_id", "rank", "chunk_id").distinct()
    named = r.select("run", "query_id", "rank", F.when(F.col("rank") % 2 == 0, F.col("chunk_id")).alias("chunk_id"), F.when(F.col("rank") % 3 != 0, F.col("chunk_id")).alias("id"))
    return named.select("run", "query_id", "rank", R.normalized_id(F.col("chunk_id"), F.col("id"), "").alias("chunk_id"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') ORDER BY 1, 2 LIMIT 1000")
def semi_join_ids_capped(spark: SparkSession, d: str) -> DataFrame:
    """The scan by a list of keys with its row limit."""
    wanted = table(spark, d, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.by_keys(table(spark, d, "lineitem", "l_orderkey", "l_linenumber"), wanted, "l_orderkey", ["l_orderkey", "l_linenumber"], 1000)


# --- resumed and staged runs

_NEIGHBOUR_SQL = f"""WITH {_ONCE}, seeds AS (SELECT query_id, document_id, chunk_index, min(rank) AS rank FROM reranked_results WHERE run = 'flat' AND rank <= 3 AND chunk_index IS NOT NULL GROUP BY 1, 2, 3)
 SELECT query_id, count(DISTINCT (s.document_id, s.chunk_index)) AS passages, count(*) AS neighbours FROM seeds s JOIN once c ON c.document_id = s.document_id AND c.chunk_index BETWEEN greatest(0, s.chunk_index - 1) AND s.chunk_index + 1 GROUP BY 1"""


@query(_NEIGHBOUR_SQL)
def neighbor_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Neighbour expansion of every query, stopped after a part of them and resumed under the same settings."""
    seeds = table(spark, d, "reranked_results", "run", "query_id", "rank", "document_id", "chunk_index").where("run = 'flat' and rank <= 3").drop("run")
    chunks = _around(spark, d, seeds)

    def run(left: DataFrame) -> DataFrame:
        found = H.neighbours(seeds.join(left, "query_id", "left_semi"), chunks, "query_id")
        return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("passages"), F.sum(F.size(F.split("neighbour_indexes", ","))).alias("neighbours"))

    path, settings = scratch(spark, "benchmark"), {"neighbor_window": 1, "restrict_to_same_section": False, "top_k": 3}
    queries = seeds.select("query_id").distinct()
    R.resumed(spark, path, queries.where("query_id % 3 = 0"), "query_id", settings, run)
    return R.resumed(spark, path, queries, "query_id", settings, run)


_STAGED_SQL = f"""WITH {_SENTENCES}, r AS (SELECT doc_id, len(s) >= 1 AS ok, len(s) < 3 AS again, CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 70 THEN 'train' WHEN ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 80 THEN 'validation' ELSE 'test' END AS split FROM s)
 SELECT split, count(*) AS rows, count(*) FILTER (WHERE ok) AS labelled, count(*) FILTER (WHERE again) AS repaired FROM r GROUP BY 1"""


@query(_STAGED_SQL)
def staged_experiment(spark: SparkSession, d: str) -> DataFrame:
    """Splits, summaries, labels and their report as stages under one manifest; the second call finds them done."""
    docs = table(spark, d, "documents", "doc_id", "text")
    parts = {"train": 70, "validation": 10, "test": 20}
    stages = [
        ("splits", lambda t: docs.select("doc_id", M.split_of(F.col("doc_id"), parts).alias("split"))),
        ("summaries", lambda t: _summaries(spark, d).select("doc_id", "success", "repair_used", "reply")),
        ("labels", lambda t: t["summaries"].where("success").select("doc_id", J.target(F.col("reply")).alias("target"))),
        ("report", lambda t: t["splits"].join(t["summaries"].select("doc_id", "repair_used"), "doc_id").join(t["labels"].select("doc_id", F.lit(1).alias("labelled")), "doc_id", "left").groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count("labelled").alias("labelled"), F.count_if("repair_used").alias("repaired"))),
    ]
    path, settings = scratch(spark, "experiment"), {"splits": parts, "model": "extractive"}
    R.staged(spark, path, settings, stages[:2])
    return R.staged(spark, path, settings, stages)["report"]


@query("""WITH e AS (SELECT (event_id % 5) * 20 AS effort, value FROM events), a AS (SELECT effort, round(avg(value), 6) AS avg_ms FROM e GROUP BY 1), b AS (SELECT effort, round(max(value), 6) AS recall FROM e WHERE effort > 0 GROUP BY 1), c AS (SELECT effort, count(*) AS failures FROM e WHERE effort < 80 GROUP BY 1)
 SELECT effort, avg_ms, recall, failures FROM a JOIN b USING (effort) JOIN c USING (effort)""")
def effort_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Three kinds of reports, one file per effort and its number in the file name, side by side for the efforts that all have."""
    path = scratch(spark, "efforts")
    e = table(spark, d, "events", "event_id", "value").select(((F.col("event_id") % 5) * 20).cast("int").alias("effort"), "value").groupBy("effort").agg(F.round(F.avg("value"), 6).alias("avg_ms"), F.round(F.max("value"), 6).alias("recall"), F.count(F.lit(1)).alias("failures"))
    for r in e.collect():  # one row per effort
        kinds = {"latency": ("avg_ms", True), "comparison": ("recall", r["effort"] > 0), "failures": ("failures", r["effort"] < 80)}
        for kind, (name, shown) in kinds.items():
            if shown:
                R.write_json(spark, f"{path}/{kind}_ef{r['effort']}", {name: r[name]})
    read = lambda kind, schema: R.read_keyed(spark, f"{path}/{kind}_ef*", r"_ef(\d+)/[^/]*$", schema)
    return R.effort_metrics(read("latency", "avg_ms double"), read("comparison", "recall double"), read("failures", "failures bigint"))


# --- learned models

_FEATURES = ["l_quantity", "l_discount", "l_tax"]


def _rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", *_FEATURES)
    data = rows.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), (F.col("l_returnflag") == "R").cast("double").alias("label"), *_FEATURES)
    return M.standardized(data, _FEATURES)


@query()
def logreg_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a regression that was fitted, stored and loaded."""
    return M.logistic_scores(_rows(spark, d), "row_id", _FEATURES, "label", store=scratch(spark, "model"))


@query()
def mlp_scores(spark: SparkSession, d: str) -> DataFrame:
    return M.logistic_scores(_rows(spark, d), "row_id", _FEATURES, "label", [32, 16])


@query()
def model_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Losses of perceptrons of several widths and of regressions of several L2 penalties on held-out rows."""
    return M.sweep(_rows(spark, d), "row_id", _FEATURES, "label", [[8], [32, 16]], [0.0, 0.01, 0.1], F.pmod(F.xxhash64("row_id"), F.lit(5)) != 0)
