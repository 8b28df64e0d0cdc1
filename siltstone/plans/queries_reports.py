"""Queries over latencies, judgments, structured replies, comparison frames, labels and streams' batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import json as J
from siltstone.functions import numbers as N
from siltstone.functions import text as T
from siltstone.operators import evaluation as E
from siltstone.operators import models as M
from siltstone.plans.cut import scratch, written
from siltstone.plans.registry import query
from siltstone.sources import reports as R
from siltstone.sources.tables import delivered_once, table
from siltstone.streaming import streams as S

_STATS = "count(value) AS count, round(avg(value), 6) AS avg_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms"


@query(f"SELECT event_type, {_STATS} FROM events GROUP BY 1")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.latency_summary(table(spark, d, "events", "event_type", "value"), "value", ["event_type"])


@query(f"SELECT {_STATS} FROM events WHERE value < 0")
def latency_summary_empty(spark: SparkSession, d: str) -> DataFrame:
    return E.latency_summary(table(spark, d, "events", "value").where("value < 0"), "value")


@query(f"SELECT event_type, {_STATS} FROM (SELECT event_type, user_id, quantile_cont(value, 0.5) AS value FROM events GROUP BY 1, 2) GROUP BY 1")
def latency_two_level(spark: SparkSession, d: str) -> DataFrame:
    return E.two_level(table(spark, d, "events", "event_type", "user_id", "value"), "value", "user_id", "event_type")


@query("SELECT event_type, quantile_disc(value, 0.1) AS p10, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95, round(median(value), 6) AS median FROM events GROUP BY 1")
def nearest_rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events", "event_type", "value")
    return ev.groupBy("event_type").agg(*[N.nearest_rank("value", p / 100).alias(f"p{p}") for p in (10, 50, 90, 95)], F.round(F.median("value"), 6).alias("median"))


@query("SELECT user_id, (list_sort(list(value)))[count(*) // 2 + 1] AS upper_median FROM events GROUP BY 1")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return N.upper_median(table(spark, d, "events", "user_id", "value"), ["user_id"], "value")


@query("SELECT user_id, json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def json_extract_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "user_id", "props", "value").groupBy("user_id", J.field(F.col("props"), "k").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


# Judgments stand on orders: status and priority as two judges' answers, some missing, some outside the domain.
_A = "CASE o_orderstatus WHEN 'F' THEN ' YES ' WHEN 'O' THEN 'no' WHEN 'P' THEN 'Partial' END"
_B = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'yes' WHEN '2' THEN 'partial' WHEN '3' THEN 'no' WHEN '4' THEN 'maybe' END"
_norm = lambda x: f"CASE WHEN {x} IS NULL THEN 'missing' WHEN lower(trim({x})) IN ('yes', 'partial', 'no') THEN lower(trim({x})) ELSE 'error' END"
_JOINED = f"""a AS (SELECT o_orderkey AS q, {_A} AS l FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS q, {_B} AS l FROM orders WHERE o_orderkey % 5 <> 0),
 j AS (SELECT coalesce(a.q, b.q) AS q, a.q IS NOT NULL AND b.q IS NOT NULL AS matched, {_norm('a.l')} AS x, {_norm('b.l')} AS y FROM a FULL JOIN b ON a.q = b.q)"""
_DOMAIN = "(SELECT unnest(['yes', 'partial', 'no', 'error', 'missing']) AS v)"


def _judges(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    a = orders.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("q"), F.expr(_A).alias("la"), F.lit(True).alias("ia"))
    b = orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("q"), F.expr(_B).alias("lb"), F.lit(True).alias("ib"))
    j = a.join(b, "q", "full_outer")
    return j.select("q", (F.col("ia").isNotNull() & F.col("ib").isNotNull()).alias("matched"), E.answerability(F.col("la")).alias("x"), E.answerability(F.col("lb")).alias("y"))


@query(f"WITH {_JOINED} SELECT v AS label, coalesce(n, 0) AS count, round(100 * coalesce(n, 0) / (SELECT count(*) FROM j), 2) AS pct FROM {_DOMAIN} LEFT JOIN (SELECT x, count(*) AS n FROM j GROUP BY 1) ON x = v")
def judge_histogram(spark: SparkSession, d: str) -> DataFrame:
    return E.histogram(_judges(spark, d), "x", E.ANSWERABILITY, "label")


@query(f"WITH {_JOINED} SELECT v AS from_label, " + ", ".join(f"coalesce(count(*) FILTER (WHERE y = '{w}'), 0) AS to_{w}" for w in E.ANSWERABILITY) + f" FROM {_DOMAIN} LEFT JOIN j ON x = v GROUP BY 1")
def judge_transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    return E.transitions(_judges(spark, d), "x", "y", E.ANSWERABILITY)


@query(f"WITH {_JOINED} SELECT x || '_to_' || y AS transition, count(*) AS n FROM j GROUP BY 1")
def judge_transition_counts(spark: SparkSession, d: str) -> DataFrame:
    return _judges(spark, d).groupBy(F.concat("x", F.lit("_to_"), "y").alias("transition")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_JOINED} SELECT count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE NOT matched) AS one_sided, count(*) FILTER (WHERE matched AND x = 'partial' AND y = 'yes') AS partial_to_yes, count(*) FILTER (WHERE matched AND x = 'no' AND y = 'yes') AS no_to_yes,
 count(*) FILTER (WHERE matched AND x = 'yes' AND y = 'no') AS yes_to_no, round(100 * count(*) FILTER (WHERE matched AND x <> 'yes' AND y = 'yes') / count(*) FILTER (WHERE matched), 2) AS gained_pct FROM j""")
def judge_cases(spark: SparkSession, d: str) -> DataFrame:
    m, x, y = F.col("matched"), F.col("x"), F.col("y")
    case = lambda a, b: F.count_if(m & (x == a) & (y == b))
    return _judges(spark, d).agg(F.count_if(m).alias("matched"), F.count_if(~m).alias("one_sided"), case("partial", "yes").alias("partial_to_yes"), case("no", "yes").alias("no_to_yes"), case("yes", "no").alias("yes_to_no"), N.percent(F.count_if(m & (x != "yes") & (y == "yes")), F.count_if(m)).alias("gained_pct"))


_CASE_SQL = " UNION ALL ".join(f"SELECT q, '{n}' AS \"case\" FROM j WHERE matched AND " + (f"x = '{x}'" if x else "x <> 'yes'") + f" AND y = '{y}'" for n, (x, y) in E.CASES.items())


@query(f"WITH {_JOINED} {_CASE_SQL}")
def judge_case_lists(spark: SparkSession, d: str) -> DataFrame:
    return E.case_lists(_judges(spark, d).where("matched"), "x", "y").select("q", "case")


@query(f"WITH {_JOINED}, c AS ({_CASE_SQL}) SELECT \"case\", count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM j WHERE matched), 2) AS pct_of_matched FROM c GROUP BY 1")
def judge_case_shares(spark: SparkSession, d: str) -> DataFrame:
    j = _judges(spark, d).where("matched")
    total = j.agg(F.count(F.lit(1)).alias("_t"), F.lit(1).alias("_one"))
    n = E.case_lists(j, "x", "y").groupBy("case").agg(F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    return n.join(total, "_one").select("case", "n", N.percent(F.col("n"), F.col("_t")).alias("pct_of_matched"))


@query("SELECT event_type, round(avg(value), 6) AS avg_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms FROM events WHERE value IS NOT NULL GROUP BY 1")
def latency_short(spark: SparkSession, d: str) -> DataFrame:
    return E.short_latency(table(spark, d, "events", "event_type", "value"), "value", ["event_type"])


@query("""WITH c AS (SELECT l_orderkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * 1000 END AS p, l_extendedprice AS k FROM lineitem)
 SELECT l_orderkey, count(*) AS calls, round(sum(p), 4) AS prompt_tokens, round(sum(p / 1e6 * 0.40 + k / 1e6 * 1.60), 6) AS cost_usd FROM c GROUP BY 1""")
def llm_cost(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    p = F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_quantity") * 1000)
    c = c.select("l_orderkey", p.alias("p"), F.col("l_extendedprice").alias("k"))
    return c.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("p"), 4).alias("prompt_tokens"), F.round(F.sum(N.cost(F.col("p"), F.col("k"))), 6).alias("cost_usd"))


@query("""SELECT event_type, b AS batch, min(rn) - 1 AS start_index, max(rn) AS end_index, count(*) AS rows, round(sum(value), 4) AS seconds, round(count(*) / nullif(sum(value), 0), 6) AS per_second FROM
 (SELECT event_type, value, rn, (rn - 1) // 100 AS b FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)) GROUP BY 1, 2""")
def run_batches(spark: SparkSession, d: str) -> DataFrame:
    from siltstone.plans.ranks import row_numbers

    ev = table(spark, d, "events", "event_id", "event_type", "value")
    g = row_numbers(ev, ["event_type"], "event_id", "value", "rn").groupBy("event_type", F.floor((F.col("rn") - 1) / 100).alias("batch"))
    return g.agg((F.min("rn") - 1).alias("start_index"), F.max("rn").alias("end_index"), F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("seconds"), F.round(F.try_divide(F.count(F.lit(1)), F.sum("value")), 6).alias("per_second"))


_ONCE = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM document_chunks) WHERE rn = 1)"
_keys = lambda q: f"list_filter(regexp_split_to_array(replace(replace(replace(replace(lower(coalesce({q}, '')), '?', ''), ',', ''), '.', ''), '/', ' '), '[ \\t\\n\\r\\x0B\\f]+'), lambda w: w <> '' AND NOT list_contains([{', '.join(chr(39) + w + chr(39) for w in T.STOP_WORDS)}], w))"
_any = lambda terms, text: f"coalesce(len(list_filter({terms}, lambda w: contains({text}, w))) > 0, false)"
_asked = " OR ".join(f"contains(lower(query), '{t}')" for t in E.EXPECTED)
_shown = " OR ".join(f"(contains(lower(query), '{t}') AND contains(lower(ft), '{w}'))" for t, ws in E.EXPECTED.items() for w in ws)
_FAIL_SQL = f"""WITH {_ONCE}, h AS (SELECT DISTINCT r.run, r.query_id, r.rank, r.chunk_id, r.title, r.similarity FROM reranked_results r),
 f AS (SELECT h.query_id, max(CASE WHEN rank = 1 THEN h.title END) AS title, max(CASE WHEN rank = 1 THEN similarity END) AS sim, string_agg(coalesce(h.title, '') || ' ' || coalesce(c.content, ''), ' ' ORDER BY rank, chunk_id) AS ft FROM h LEFT JOIN once c ON c.id = h.chunk_id WHERE run = 'flat' AND rank <= 3 GROUP BY 1),
 a AS (SELECT query_id, max(CASE WHEN rank = 1 THEN title END) AS title, max(CASE WHEN rank = 1 THEN similarity END) AS sim FROM h WHERE run = 'ann' AND rank <= 3 GROUP BY 1),
 rc AS (SELECT x.query_id, count(y.chunk_id) / 5 AS recall FROM (SELECT DISTINCT query_id, chunk_id FROM h WHERE run = 'flat' AND rank <= 5) x LEFT JOIN (SELECT DISTINCT query_id, chunk_id FROM h WHERE run = 'ann' AND rank <= 5) y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id GROUP BY 1),
 k AS (SELECT q.query_id, q.query, round(recall, 6) AS recall, coalesce(f.sim, 0) AS fs, coalesce(a.sim, 0) AS hs, coalesce(f.ft, '') AS ft, {_any(_keys('query'), "lower(coalesce(f.title, ''))")} AS fm, {_any(_keys('query'), "lower(coalesce(a.title, ''))")} AS hm, {_any(_keys('query'), "lower(coalesce(f.ft, ''))")} AS cm
   FROM queries q LEFT JOIN f ON f.query_id = q.query_id LEFT JOIN a ON a.query_id = q.query_id LEFT JOIN rc ON rc.query_id = q.query_id),
 cl AS (SELECT query_id, query, recall, fs, hs, ft, CASE WHEN coalesce(recall, 0) >= 1 THEN 'healthy' WHEN ({_asked}) AND NOT ({_shown}) THEN 'corpus_gap' WHEN fs >= 0.3 AND hs >= 0.3 AND NOT fm AND NOT hm THEN 'semantic_ambiguity'
  WHEN (fs >= 0.4 OR fm OR cm) AND NOT hm AND hs < fs THEN 'ann_miss' WHEN coalesce(recall, 0) >= 0.5 THEN 'minor_ranking_difference' ELSE 'uncertain' END AS label FROM k)"""


def _texts(spark: SparkSession, d: str, hits: DataFrame) -> DataFrame:
    """(chunk_id, content) of the chunks in ``hits``: only these move."""
    wanted = hits.select(F.col("chunk_id").alias("id")).distinct()
    rows = table(spark, d, "document_chunks", "id", "content", "created_at").join(wanted, "id", "left_semi")
    return delivered_once(rows).select(F.col("id").alias("chunk_id"), "content")


def _failures(spark: SparkSession, d: str, more: bool = False) -> DataFrame:
    h = table(spark, d, "reranked_results", "run", "query_id", "rank", "chunk_id", "title", "similarity").distinct()
    head = h.where("rank <= 3")
    text = _texts(spark, d, head.where("run = 'flat'"))
    first = lambda c: F.max(F.when(F.col("rank") == 1, F.col(c)))
    joined = head.where("run = 'flat'").join(text, "chunk_id", "left").withColumn("t", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit(""))))
    flat = joined.groupBy("query_id").agg(first("title").alias("ftitle"), first("similarity").alias("fsim"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "t"))), lambda x: x["t"]), " ").alias("ftext"))
    ann = head.where("run = 'ann'").groupBy("query_id").agg(first("title").alias("atitle"), first("similarity").alias("asim"))
    top = lambda run: h.where((F.col("run") == run) & (F.col("rank") <= 5)).select("query_id", "chunk_id").distinct()
    recall = top("flat").join(top("ann").withColumn("in", F.lit(1)), ["query_id", "chunk_id"], "left").groupBy("query_id").agg((F.count("in") / 5).alias("recall"))
    q = table(spark, d, "queries", "query_id", "query").join(flat, "query_id", "left").join(ann, "query_id", "left").join(recall, "query_id", "left")
    label = E.failure_class(F.col("query"), F.col("recall"), (F.col("ftitle"), F.col("fsim"), F.col("ftext")), (F.col("atitle"), F.col("asim")))
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6)
    extra = ["query", zero("fsim").alias("flat_similarity"), zero("asim").alias("ann_similarity"), F.coalesce("ftext", F.lit("")).alias("text")] if more else []
    return q.select("query_id", F.round("recall", 6).alias("recall"), label.alias("label"), *extra)


@query(_FAIL_SQL + " SELECT query_id, recall, label FROM cl")
def classify_failures(spark: SparkSession, d: str) -> DataFrame:
    return _failures(spark, d)


@query(_FAIL_SQL + " SELECT label, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM cl), 2) AS pct FROM cl GROUP BY 1")
def failure_shares(spark: SparkSession, d: str) -> DataFrame:
    f = written(_failures(spark, d), "failures")
    return f.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", "n", N.percent(F.col("n"), F.lit(f.count())).alias("pct"))


_SHOWN = "trim(replace(ft, chr(10), ' '), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(_FAIL_SQL + f""", five AS (SELECT DISTINCT run, query_id, chunk_id FROM h WHERE rank <= 5), o AS (SELECT query_id, list_sort(list(DISTINCT chunk_id) FILTER (WHERE run = 'flat')) AS f, list_sort(list(DISTINCT chunk_id) FILTER (WHERE run = 'ann')) AS n FROM five GROUP BY 1)
 SELECT query_id, query, recall, label, round(fs, 6) AS flat_similarity, round(hs, 6) AS ann_similarity, coalesce(len(list_intersect(f, n)), 0) AS overlap, array_to_string(list_sort(list_filter(f, lambda c: NOT list_contains(coalesce(n, []), c))), ',') AS missed,
  CASE WHEN length({_SHOWN}) > 200 THEN substr({_SHOWN}, 1, 200) || '...' ELSE {_SHOWN} END AS preview FROM cl LEFT JOIN o USING (query_id) ORDER BY coalesce(recall, 0), query_id LIMIT 10""")
def worst_failures(spark: SparkSession, d: str) -> DataFrame:
    """The ten queries of least recall, with what both runs share, what the approximate one missed and how the exact hits begin."""
    five = table(spark, d, "reranked_results", "run", "query_id", "chunk_id", "rank").where("rank <= 5")
    own = lambda run: F.array_sort(F.collect_set(F.when(F.col("run") == run, F.col("chunk_id"))))
    lists = five.groupBy("query_id").agg(own("flat").alias("f"), own("ann").alias("n"))
    worst = _failures(spark, d, True).orderBy(F.coalesce("recall", F.lit(0.0)), "query_id").limit(10)
    return worst.join(lists, "query_id", "left").select("query_id", "query", "recall", "label", "flat_similarity", "ann_similarity", F.coalesce(F.size(F.array_intersect("f", "n")), F.lit(0)).alias("overlap"), F.coalesce(F.array_join(F.array_sort(F.array_except("f", "n")), ","), F.lit("")).alias("missed"), T.preview(F.col("text"), 200).alias("preview"))


# Structured replies: each tenth event carries another fault.
_REPLY = """CASE event_id % 11 WHEN 0 THEN 'no object here' WHEN 1 THEN '{"summary": "s", "key_points": ["a","b","c"], "sentiment": "positive", "entities": [], "why_it_matters": "w"}'
 WHEN 2 THEN 'Reply: {"summary": " ", "key_points": ["a","b","c"], "sentiment": "neutral", "entities": [], "why_it_matters": "w"} end' WHEN 3 THEN '{"summary": "s", "key_points": "a", "sentiment": "neutral", "entities": [], "why_it_matters": "w"}'
 WHEN 4 THEN '{"summary": "s", "key_points": ["a","b"], "sentiment": "neutral", "entities": [], "why_it_matters": "w"}' WHEN 5 THEN '{"summary": "s", "key_points": ["a","b"," "], "sentiment": "neutral", "entities": [], "why_it_matters": "w"}'
 WHEN 6 THEN '{"summary": "s", "key_points": ["a","b","c"], "sentiment": "Positive", "entities": [], "why_it_matters": "w"}' WHEN 7 THEN '{"summary": "s", "key_points": ["a","b","c"], "sentiment": "negative", "entities": ["x", ""], "why_it_matters": "w"}'
 WHEN 8 THEN '{"summary": "s", "key_points": ["a","b","c"], "sentiment": "negative", "entities": ["x"], "why_it_matters": ""}' WHEN 9 THEN '{"summary": "s"}' ELSE 'Reply: {"summary": "s", "key_points": ["a","b","c","d","e"], "sentiment": "negative", "entities": ["x"], "why_it_matters": "w"}' END"""
_OBJ = f"nullif(regexp_extract({_REPLY}, '\\{{.*\\}}'), '')"
_arr = lambda p: f"json_extract(o, '$.{p}')"
_blank = lambda p: f"len(list_filter(json_extract_string(o, '$.{p}[*]'), lambda x: x IS NULL OR trim(x) = '')) > 0"
_FAULT = f"""CASE WHEN o IS NULL OR NOT json_valid(o) THEN 'output is not a JSON object' WHEN list_sort(json_keys(o)) <> ['entities', 'key_points', 'sentiment', 'summary', 'why_it_matters'] THEN 'keys mismatch'
 WHEN trim(coalesce(json_extract_string(o, '$.summary'), '')) = '' THEN 'summary must be a non-empty string' WHEN json_type({_arr('key_points')}) <> 'ARRAY' THEN 'key_points must be a list' WHEN json_array_length({_arr('key_points')}) NOT BETWEEN 3 AND 5 THEN 'key_points must contain 3 to 5 items'
 WHEN {_blank('key_points')} THEN 'all key_points items must be non-empty strings' WHEN json_extract_string(o, '$.sentiment') NOT IN ('positive', 'negative', 'neutral') THEN 'sentiment is not allowed' WHEN json_type({_arr('entities')}) <> 'ARRAY' THEN 'entities must be a list'
 WHEN {_blank('entities')} THEN 'all entities must be non-empty strings' WHEN trim(coalesce(json_extract_string(o, '$.why_it_matters'), '')) = '' THEN 'why_it_matters must be a non-empty string' ELSE 'valid' END"""


def _replies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id").select("event_id", J.embedded_object(F.expr(_REPLY)).alias("o"))


@query(f"SELECT event_id, {_FAULT} AS fault FROM (SELECT event_id, {_OBJ} AS o FROM events)")
def validate_structured(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).select("event_id", J.summary_fault(F.col("o")).alias("fault"))


@query(f"SELECT event_id, {_OBJ} AS reply FROM events")
def extract_json(spark: SparkSession, d: str) -> DataFrame:
    return _replies(spark, d).withColumnRenamed("o", "reply")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, d, "events", "event_id", "props").select("event_id", J.field(J.unfenced(fenced), "k").alias("k"))


@query("SELECT o_orderkey, 3 AS items, o_orderstatus AS second FROM orders")
def parse_list_cell(spark: SparkSession, d: str) -> DataFrame:
    cell = F.concat(F.lit("['a', '"), F.col("o_orderstatus"), F.lit("', 'c']"))
    return table(spark, d, "orders", "o_orderkey", "o_orderstatus").select("o_orderkey", J.string_list(cell).alias("l")).select("o_orderkey", F.size("l").alias("items"), F.element_at("l", 2).alias("second"))


@query(f"""WITH r AS (SELECT event_id, {_FAULT} = 'valid' AS ok FROM (SELECT event_id, {_OBJ} AS o FROM events)) SELECT event_id, ok OR event_id % 2 = 0 AS success, NOT ok AS repair_used FROM r""")
def repair_merge(spark: SparkSession, d: str) -> DataFrame:
    r = _replies(spark, d).select("event_id", (J.summary_fault(F.col("o")) == "valid").alias("ok"))
    good = r.where("ok").select("event_id", F.lit(True).alias("success"), F.lit(False).alias("repair_used"))
    again = r.where("not ok").select("event_id", (F.col("event_id") % 2 == 0).alias("success"), F.lit(True).alias("repair_used"))  # the second pass sees only failures
    return good.unionByName(again)


_FRAME = "SELECT o_orderkey, o_custkey, o_totalprice AS price, o_orderstatus AS status FROM orders"


def _frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    return base.where("status <> 'F'"), base.where("price > 100000"), base.where("o_custkey % 3 = 0")


@query(f"SELECT o_orderkey, o_custkey, a.price AS price_a, a.status AS status_a, b.price AS price_b, b.status AS status_b FROM ({_FRAME} WHERE status <> 'F') a JOIN ({_FRAME} WHERE price > 100000) b USING (o_orderkey, o_custkey)")
def pairwise_frame(spark: SparkSession, d: str) -> DataFrame:
    a, b, _ = _frames(spark, d)
    keys = ["o_orderkey", "o_custkey"]
    return E.suffixed(a, keys, "a").join(E.suffixed(b, keys, "b"), keys)


@query(f"SELECT o_orderkey, o_custkey, a.price AS price_a, a.status AS status_a, b.price AS price_b, b.status AS status_b, c.price, c.status FROM ({_FRAME} WHERE status <> 'F') a JOIN ({_FRAME} WHERE price > 100000) b USING (o_orderkey, o_custkey) JOIN ({_FRAME} WHERE o_custkey % 3 = 0) c USING (o_orderkey, o_custkey)")
def three_way_frame(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = _frames(spark, d)
    keys = ["o_orderkey", "o_custkey"]
    return E.suffixed(a, keys, "a").join(E.suffixed(b, keys, "b"), keys).join(c, keys)


@query("SELECT c_custkey, c_name, n, winner FROM customer LEFT JOIN (SELECT o_custkey, count(*)::VARCHAR AS n, max(o_orderpriority) AS winner FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def judge_left_merge(spark: SparkSession, d: str) -> DataFrame:
    verdict = table(spark, d, "orders", "o_custkey", "o_orderpriority").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("string").alias("n"), F.max("o_orderpriority").alias("winner"))
    c = table(spark, d, "customer", "c_custkey", "c_name")
    return c.join(verdict, c["c_custkey"] == verdict["o_custkey"], "left").drop("o_custkey")


@query("SELECT coalesce(o_orderpriority, 'none') AS winner, count(*) AS n FROM orders GROUP BY 1")
def winner_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderpriority").groupBy(F.coalesce("o_orderpriority", F.lit("none")).alias("winner")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def resume_pending(spark: SparkSession, d: str) -> DataFrame:
    return R.pending(table(spark, d, "customer", "c_custkey"), table(spark, d, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join_ids(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber").join(wanted, "l_orderkey", "left_semi")


@query("SELECT s_nationkey AS nation FROM supplier INTERSECT SELECT c_nationkey FROM customer INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey < 3")
def three_way_intersection(spark: SparkSession, d: str) -> DataFrame:
    key = lambda name, c: table(spark, d, name, F.col(c).alias("nation"))
    return key("supplier", "s_nationkey").intersect(key("customer", "c_nationkey")).intersect(table(spark, d, "nation", "n_nationkey", "n_regionkey").where("n_regionkey < 3").select(F.col("n_nationkey").alias("nation")))


@query("SELECT DISTINCT k FROM (SELECT s_nationkey AS k FROM supplier UNION SELECT n_nationkey FROM nation) EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900")
def union_difference(spark: SparkSession, d: str) -> DataFrame:
    key = lambda df, c: df.select(F.col(c).alias("k"))
    rich = table(spark, d, "customer", "c_nationkey", "c_acctbal").where("c_acctbal > 9900")
    return key(table(spark, d, "supplier", "s_nationkey"), "s_nationkey").union(key(table(spark, d, "nation", "n_nationkey"), "n_nationkey")).distinct().subtract(key(rich, "c_nationkey"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events", "user_id", "event_id", "ts", "value")
    return ev.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.event_id", "r.value")


_SCHEMES = {"60/20/20": (60, 20, 20), "64/16/20": (64, 16, 20), "70/10/20": (70, 10, 20)}
_NAMES = ("train", "validation", "test")


@query("SELECT scheme, split, count(*) AS rows, min(doc_id) AS first_id FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS scheme, CASE WHEN h < {a} THEN 'train' WHEN h < {a + b} THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 AS h FROM documents)" for n, (a, b, _) in _SCHEMES.items()) + ") GROUP BY 1, 2")
def deterministic_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scheme"), M.split_of(F.col("doc_id"), dict(zip(_NAMES, p, strict=True))).alias("split")) for n, p in _SCHEMES.items()])).alias("s")
    return docs.select("doc_id", each).groupBy("s.scheme", "s.split").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first_id"))


@query("SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderkey % 5 <> 0)")
def standardize(spark: SparkSession, d: str) -> DataFrame:
    out = M.standardized(table(spark, d, "orders", "o_orderkey", "o_totalprice"), ["o_totalprice"], F.col("o_orderkey") % 5 != 0)
    return out.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@query("SELECT l_returnflag, count(*) AS rows, round((SELECT count(*) FROM lineitem) / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*)), 6) AS weight FROM lineitem GROUP BY 1")
def class_weights(spark: SparkSession, d: str) -> DataFrame:
    return M.class_weights(table(spark, d, "lineitem", "l_returnflag"), "l_returnflag")


_SCORED = "SELECT (l_returnflag = 'R')::INT AS label, l_discount * 10 AS prob FROM lineitem"
_CONF = "count(*) FILTER (WHERE label = 1 AND p) AS tp, count(*) FILTER (WHERE label <> 1 AND p) AS fp, count(*) FILTER (WHERE label = 1 AND NOT p) AS fn, count(*) FILTER (WHERE label <> 1 AND NOT p) AS tn"
_RATIOS = """tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
 round(coalesce(2 * coalesce(tp / nullif(tp + fp, 0), 0) * coalesce(tp / nullif(tp + fn, 0), 0) / nullif(coalesce(tp / nullif(tp + fp, 0), 0) + coalesce(tp / nullif(tp + fn, 0), 0), 0), 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((fp + fn) / (tp + fp + fn + tn), 6) AS error"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_returnflag", "l_discount").select((F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_discount") * 10).alias("prob"))


@query(f"SELECT {_RATIOS} FROM (SELECT {_CONF} FROM (SELECT label, prob >= 0.5 AS p FROM ({_SCORED})))")
def classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.classification(_scored(spark, d), "label", F.col("prob") >= 0.5)


@query(f"SELECT threshold, {_RATIOS} FROM (SELECT threshold, {_CONF} FROM (SELECT threshold::DOUBLE AS threshold, label, prob >= threshold AS p FROM ({_SCORED}), (SELECT unnest([0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.95]) AS threshold)) GROUP BY 1)")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    each = _scored(spark, d).select("*", F.explode(F.array(*[F.lit(t) for t in (0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.95)])).alias("threshold"))
    return E.classification(each, "label", F.col("prob") >= F.col("threshold"), ["threshold"])


@query(f"""WITH s AS (SELECT label, prob, (rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2) AS r FROM ({_SCORED}))
 SELECT round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label <> 1)), 6) AS auc FROM s""")
def auc(spark: SparkSession, d: str) -> DataFrame:
    return E.auc(_scored(spark, d), "label", "prob")


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS loss FROM events), b AS (SELECT *, min(loss) OVER (PARTITION BY user_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e),
 g AS (SELECT *, max(CASE WHEN best IS NULL OR loss < best THEN epoch END) OVER (PARTITION BY user_id ORDER BY epoch) AS gained FROM b), s AS (SELECT user_id, min(CASE WHEN epoch - gained >= 10 THEN epoch END) AS stop, max(epoch) AS last FROM g GROUP BY 1)
 SELECT user_id, arg_min(epoch, loss) AS best_epoch, min(loss) AS best_loss, max(epoch) AS stopped_at FROM g JOIN s USING (user_id) WHERE epoch <= coalesce(stop, last) GROUP BY 1""")
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    from siltstone.plans.ranks import row_numbers

    ev = table(spark, d, "events", "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("value").alias("loss"))
    runs = row_numbers(ev, ["user_id"], "ts", "event_id", "epoch").select("user_id", "epoch", "loss")
    return M.early_stopping(runs, "user_id", "epoch", "loss")


@query("SELECT query_id, len(p) AS prompt_tokens, array_to_string(list_concat(list_transform(p, lambda x: -100), list_concat([1, 2, 3], list_transform(generate_series(1, greatest(0, 24 - len(p) - 3)), lambda x: -100)))[1:24], ',') AS labels FROM (SELECT query_id, regexp_extract_all(query, '[^ ]+') AS p FROM queries)")
def response_only_labels(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries", "query_id", "query").select("query_id", F.regexp_extract_all("query", F.lit("[^ ]+"), F.lit(0)).alias("p"))
    labels = M.masked_labels(F.col("p"), F.array(F.lit(1), F.lit(2), F.lit(3)), 24)
    return q.select("query_id", F.size("p").alias("prompt_tokens"), F.array_join(F.transform(labels, lambda x: x.cast("string")), ",").alias("labels"))


_W = "strftime({s}, '%Y-%m-%d %H:%M:%S') AS window_start, strftime({e}, '%Y-%m-%d %H:%M:%S') AS window_end"
_AGG = "count(*) AS events, round(sum(value), 4) AS total, round(max(value), 6) AS most"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id", "value")


@query(f"SELECT {_W.format(s='b', e='b + INTERVAL 1 HOUR')}, event_type, {_AGG} FROM (SELECT *, date_trunc('hour', ts) AS b FROM events) GROUP BY b, event_type")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return S.tumbling(_events(spark, d), "1 hour", ["event_type"])


@query(f"SELECT {_W.format(s='b', e='b + INTERVAL 2 HOUR')}, event_type, {_AGG} FROM (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS b FROM events) GROUP BY b, event_type")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    return S.sliding(_events(spark, d), "2 hours", "1 hour", ["event_type"])


@query(f"""WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l)
 SELECT {_W.format(s='min(ts)', e="max(ts) + INTERVAL 3 HOUR")}, user_id, {_AGG} FROM s GROUP BY user_id, sid""")
def events_session(spark: SparkSession, d: str) -> DataFrame:
    return S.sessions(_events(spark, d), "3 hours", ["user_id"])


@query("SELECT run, query_id, count(*) AS hits, min(chunk_id) AS first_chunk FROM (SELECT DISTINCT run, query_id, chunk_id FROM reranked_results) GROUP BY 1, 2")
def report_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Rankings of every run written as JSON report rows, one per hit, into the shared folder and read again."""
    hits = table(spark, d, "reranked_results", "run", "query_id", "chunk_id").distinct()
    path = scratch(spark, "report")
    R.write_report(hits, path)
    return spark.read.schema("run string, query_id bigint, chunk_id string").json(path).groupBy("run", "query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("chunk_id").alias("first_chunk"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A table written as CSV into the shared folder and read again by its schema."""
    path = scratch(spark, "csv")
    R.write_csv(table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice"), path)
    back = R.read_csv(spark, path, "o_orderkey bigint, o_orderstatus string, o_totalprice double")
    return back.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_orderkey").alias("first_key"))


@query("SELECT query, count(*) AS n FROM queries WHERE query IS NOT NULL GROUP BY 1")
def query_files(spark: SparkSession, d: str) -> DataFrame:
    """Queries kept as a .jsonl file, read by its shape."""
    path = scratch(spark, "queries") + ".jsonl"
    table(spark, d, "queries", "query").write.json(path)
    return R.read_queries(spark, path).groupBy("query").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem GROUP BY 1, 2")
def grouped_totals(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))



@query(f"""WITH s AS ({_SCORED}), g AS (SELECT prob AS threshold, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label <> 1) AS n FROM s GROUP BY 1), c AS (SELECT threshold, sum(p) OVER w::BIGINT AS tp, sum(n) OVER w::BIGINT AS fp FROM g WINDOW w AS (ORDER BY threshold DESC))
 SELECT threshold, tp, fp, round(tp / (SELECT sum(p) FROM g), 6) AS tpr, round(fp / (SELECT sum(n) FROM g), 6) AS fpr FROM c""".replace("sum(p) OVER w::BIGINT", "(sum(p) OVER w)::BIGINT").replace("sum(n) OVER w::BIGINT", "(sum(n) OVER w)::BIGINT"))
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return E.roc_curve(_scored(spark, d), "label", "prob")


_VS = ("similarity", "rerank_score", "lexical_score")


@query(" UNION ALL ".join(f"SELECT '{c}' AS metric, count({c}) AS rows, round(avg({c}), 6) AS avg, round(median({c}), 6) AS median, quantile_disc({c}, 0.1) AS p10, quantile_disc({c}, 0.9) AS p90, min({c}) AS min, max({c}) AS max FROM reranked_results" for c in _VS))
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.value_summary(table(spark, d, "reranked_results", *_VS), list(_VS))


@query("""WITH c AS (SELECT value AS s, event_id % 500 AS t, event_id % 9 <> 0 AS ok FROM events) SELECT count(*) AS items, count(*) FILTER (WHERE NOT ok) AS failed, round(sum(s), 6) AS seconds, sum(t)::BIGINT AS tokens, round(sum(s) / count(*), 6) AS seconds_per_item,
 round(60 * count(*) / sum(s), 6) AS items_per_minute, round(sum(t) / sum(s), 6) AS tokens_per_second, round(sum(s) / 3600 * 0.171, 6) AS usd, round(100 * sum(s) / 3600 * 0.171 / count(*), 6) AS usd_per_100 FROM c""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events", "event_id", F.col("value").alias("s")).select("s", (F.col("event_id") % 500).alias("t"), (F.col("event_id") % 9 != 0).alias("ok"))
    return E.run_summary(ev, "s", "t", "ok", 0.171)


@query(f"""WITH {_ONCE}, docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM rag_documents) WHERE rn = 1)
 SELECT c.id, c.document_id, trim(d.title) AS document_title, json_extract_string(d.metadata, '$.source') AS source FROM once c LEFT JOIN docs d ON d.id = c.document_id""")
def chunks_with_documents(spark: SparkSession, d: str) -> DataFrame:
    chunks = delivered_once(table(spark, d, "document_chunks", "id", "document_id", "created_at")).select("id", "document_id")
    docs = delivered_once(table(spark, d, "rag_documents", "id", "title", "metadata", "created_at"))
    named = docs.select(F.col("id").alias("document_id"), F.trim("title").alias("document_title"), J.field(F.col("metadata"), "source").alias("source"))
    return chunks.join(named, "document_id", "left").select("id", "document_id", "document_title", "source")


@query(f"""WITH {_ONCE}, h AS (SELECT DISTINCT query_id, rank, chunk_id, title, similarity FROM reranked_results WHERE run = 'flat' AND rank <= 3),
 p AS (SELECT query_id, rank, chunk_id, concat_ws(chr(10), '[' || rank || '] ' || coalesce(h.title, ''), CASE WHEN similarity IS NOT NULL THEN 'Score: ' || printf('%.4f', similarity) END, coalesce(c.content, '')) AS t FROM h LEFT JOIN once c ON c.id = h.chunk_id)
 SELECT query_id, sha256(string_agg(t, chr(10) || chr(10) ORDER BY rank, chunk_id)) AS context_hash, count(*) AS passages FROM p GROUP BY 1""")
def context_strings(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "reranked_results", "run", "query_id", "rank", "chunk_id", "title", "similarity").where("run = 'flat' and rank <= 3").drop("run").distinct()
    text = _texts(spark, d, hits)
    part = T.scored_passage(F.col("rank"), F.col("title"), F.col("content"), F.col("similarity"))
    parts = hits.join(text, "chunk_id", "left").select("query_id", F.struct("rank", "chunk_id", part.alias("t")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "\n\n")
    return parts.groupBy("query_id").agg(F.sha2(joined, 256).alias("context_hash"), F.count(F.lit(1)).alias("passages"))


@query("SELECT query_id, 3 AS turns, 'user' AS second_role, query AS second_content FROM queries")
def chat_transcripts(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries", "query_id", "query", "expected_route")
    m = q.select("query_id", T.chat_messages(F.lit("Answer briefly."), F.col("query"), F.coalesce("expected_route", F.lit("none"))).alias("m"))
    return m.select("query_id", F.size("m").alias("turns"), F.col("m")[1]["role"].alias("second_role"), F.col("m")[1]["content"].alias("second_content"))


@query("SELECT doc_id, title FROM documents ORDER BY doc_id LIMIT 50")
def head_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "title").orderBy("doc_id").limit(50)
